"""Hash columns: stable order keys, draw numbers, content digests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stable_key(seed: int, *parts: Column) -> Column:
    """SHA-256 hex of ``seed|part|part…``: a reproducible random order key."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def hash_number(digest: Column) -> Column:
    """The first eight hex digits of a digest as a number below 2**32."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def unit_number(digest: Column) -> Column:
    """The first eight hex digits of a digest as a double in [0, 1)."""
    return hash_number(digest).cast("double") / F.lit(4294967296.0)


def text_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def normalised_text(text: Column) -> Column:
    """Lower case with runs of white space folded: equal for equivalent texts."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
