"""Settings from a JSON file, with ${NAME} filled in from the environment."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping

_NAME = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")


def expand(field: str, value: str, env: Mapping[str, str]) -> str:
    """value with each ${NAME} replaced; a name that is unset or empty is an error."""
    absent = [n for n in _NAME.findall(value) if not env.get(n)]
    if absent:
        raise ValueError(f"{field}: no value for {', '.join(absent)}")
    return _NAME.sub(lambda m: env[m[1]], value)


def load(path: str, env: Mapping[str, str] | None = None) -> dict:
    """The settings of a file, strings at any depth expanded; no file, no settings."""
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
    except FileNotFoundError:
        return {}
    if not isinstance(raw, dict):
        raise ValueError(f"{path}: not an object")
    names = os.environ if env is None else env

    def filled(field: str, v):
        if isinstance(v, str):
            return expand(field, v, names)
        if isinstance(v, dict):
            return {k: filled(f"{field}.{k}" if field else k, x) for k, x in v.items()}
        return [filled(f"{field}[{i}]", x) for i, x in enumerate(v)] if isinstance(v, list) else v

    return filled("", raw)


def redacted(settings: dict) -> dict:
    """Settings for display: values whose names speak of secrets show their last four characters at most."""
    secret = re.compile(r"(?i)key|token|secret|password")
    hide = lambda v: f"...{v[-4:]}" if isinstance(v, str) and len(v) > 8 else "..."
    return {k: redacted(v) if isinstance(v, dict) else hide(v) if secret.search(k) and v else v for k, v in settings.items()}
