"""URLs and the local paths of a mirror, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _PARTS, k)


def _parts(url: Column, body: Callable[[Column], Column]) -> Column:
    """body of a struct: scheme, host (without user and default port), path, query."""

    def hosted(r: Column) -> Column:
        port = F.when(r["scheme"] == "http", ":(80)?$").when(r["scheme"] == "https", ":(443)?$").otherwise("$^")
        host = F.regexp_replace(F.lower(F.regexp_replace(r["host"], r"^.*@", "")), port, F.lit(""))
        return let(F.struct(r["scheme"].alias("scheme"), host.alias("host"), r["path"].alias("path"), r["query"].alias("query")), body)

    raw = lambda u: F.struct(
        F.lower(_part(u, 1)).alias("scheme"), _part(u, 2).alias("host"), _part(u, 3).alias("path"), F.coalesce(_part(u, 4), F.lit("")).alias("query")
    )
    return let(F.trim(url), lambda u: let(raw(u), hosted))


def canonical_host(url: Column) -> Column:
    """Host and port in lower case, without user and default port."""
    return _parts(url, lambda r: r["host"])


def origin(url: Column) -> Column:
    return _parts(url, lambda r: F.concat(r["scheme"], F.lit("://"), r["host"]))


def clean_path(path: Column) -> Column:
    """Dot segments and doubled slashes resolved; a trailing slash stays."""
    fold = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    slash = lambda stack: F.when((F.size(stack) > 0) & path.endswith("/"), F.lit("/")).otherwise(F.lit(""))
    folded = let(fold, lambda stack: F.concat(F.lit("/"), F.array_join(stack, "/"), slash(stack)))
    return F.when(path.rlike(r"^/[^./]") & ~path.rlike(r"//|/\."), path).otherwise(folded)  # most paths are clean


def _is_web(r: Column) -> Column:
    return F.coalesce(r["scheme"].isin("http", "https") & (r["host"] != ""), F.lit(False))


def is_absolute(url: Column) -> Column:
    """Whether it is http or https with a host."""
    return _parts(url, _is_web)


def normalise(url: Column) -> Column:
    """Scheme and host lower case, default port, user and fragment dropped, path cleaned;
    the query as it is; null for what is no absolute http(s) URL."""
    return _parts(url, lambda r: F.when(_is_web(r), F.concat(r["scheme"], F.lit("://"), r["host"], clean_path(r["path"]), r["query"])))


def same_host(a: Column, b: Column) -> Column:
    return canonical_host(a) == canonical_host(b)


def is_local(url: Column) -> Column:
    """Whether a URL points at this machine, by its host's name."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1)
    return host.isin("localhost", "127.0.0.1", "[::1]", "0.0.0.0")


def skip_href(href: Column) -> Column:
    return F.lower(F.trim(href)).rlike("^(#|mailto:|javascript:|tel:|data:)") | (F.trim(href) == "")


def _hash8(s: Column) -> Column:
    return F.substring(F.sha2(s, 256), 1, 8)


def local_path(url: Column, ext: str = ".md") -> Column:
    """A relative path that no two normalised URLs share and that never leaves its root.

    Segments keep [A-Za-z0-9._-], other characters become '-'; a hash is appended where
    that, a query, upper case or a length limit could make two URLs alike.
    """

    def from_parts(u: Column, r: Column, raw: Column) -> Column:
        safe = F.transform(
            F.filter(F.transform(raw, lambda x: F.regexp_replace(x, r"[^A-Za-z0-9._-]", "-")), lambda x: ~x.rlike(r"^\.+$")),
            lambda x: F.substring(F.replace(x, F.lit(".."), F.lit("-")), 1, 100),
        )
        host = F.substring(F.regexp_replace(F.regexp_replace(r["host"], r"[^A-Za-z0-9._-]", "-"), r"\.\.+", "-"), 1, 100)
        return let(F.struct(safe.alias("safe"), host.alias("host"), F.array_join(raw, "/").alias("raw")), lambda v: named(u, r, v))

    def named(u: Column, r: Column, v: Column) -> Column:
        folder = (r["path"] == "") | r["path"].endswith("/") | (F.size(v["safe"]) == 0)
        changed = (
            (r["query"] != "")
            | (F.array_join(v["safe"], "/") != v["raw"])
            | v["raw"].rlike("[A-Z]|%|-[0-9a-f]{8}$")
            | (v["host"] != r["host"])
            | (~folder & (F.element_at(v["safe"], -1) == "index"))
        )
        full = F.when(folder, F.array_append(v["safe"], F.lit("index"))).otherwise(v["safe"])
        mark = F.when(changed, F.concat(F.lit("-"), _hash8(u))).otherwise(F.lit(""))
        stem = F.concat(v["host"], F.lit("/"), F.array_join(full, "/"), mark)
        long = F.concat(v["host"], F.lit("/page-"), F.substring(F.sha2(u, 256), 1, 16))
        return F.concat(let(stem, lambda x: F.when(F.length(x) > 180 - len(ext), long).otherwise(x)), F.lit(ext))

    segments = lambda r: F.filter(F.split(r["path"], "/"), lambda x: x != "")
    return let(normalise(url), lambda u: _parts(u, lambda r: let(segments(r), lambda raw: from_parts(u, r, raw))))


def relative_to(target: Column, source: Column) -> Column:
    """The way from one file's folder to another file, each segment escaped."""

    def way(v: Column) -> Column:
        t, s, common = v["t"], v["s"], v["common"]
        rest = F.slice(t, common + 1, F.size(t))
        escaped = F.transform(rest, lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20")), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29")))
        return F.concat(F.repeat(F.lit("../"), F.greatest(F.size(s) - 1, F.lit(0)) - common), F.array_join(escaped, "/"))

    def shared(v: Column) -> Column:
        t, s = v["t"], v["s"]
        common = F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.least(F.size(t), F.size(s)) - 1, F.lit(1))),
            F.lit(0),
            lambda n, i: F.when((n == i - 1) & (i < F.size(s)) & (i < F.size(t)) & (F.get(t, i - 1) == F.get(s, i - 1)), i).otherwise(n),
        )
        return let(F.struct(t.alias("t"), s.alias("s"), common.alias("common")), way)

    return let(F.struct(F.split(target, "/").alias("t"), F.split(source, "/").alias("s")), shared)


def _resolve(base: pa.Array, ref: pa.Array) -> pa.Array:
    out = []
    for b, r in zip(base.to_pylist(), ref.to_pylist()):
        try:
            out.append(None if r is None else urljoin(b or "", r.strip()))
        except ValueError:
            out.append(None)
    return pa.array(out, pa.string())


def resolve(base: Column, ref: Column) -> Column:
    """A reference against its base, by RFC 3986; null where that can't be done."""
    return F.arrow_udf(_resolve, "string")(base, ref)


def check_patterns(patterns: list[str]) -> list[str]:
    """Filters must compile and use no lookaround or back reference."""
    for p in patterns:
        re.compile(p)
        if re.search(r"\(\?[=!<]|\\[1-9]", p):
            raise ValueError(f"pattern {p!r}: lookaround and back references are refused")
    return patterns


def allowed(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Exclusion wins; without inclusion patterns all are in."""
    some = lambda ps: F.greatest(*(url.rlike(p) for p in ps), F.lit(False))
    inside = some(check_patterns(include)) if include else F.lit(True)
    return inside & ~(some(check_patterns(exclude)) if exclude else F.lit(False))
