"""Operators of a training-data pipeline: scoring, deduplication, decontamination,
sharding, archives, fingerprints, mixing, language identification, token counts.

Nothing else in the library imports this subpackage.
"""
