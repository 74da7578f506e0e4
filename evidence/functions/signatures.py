"""63-bit signatures held in a bigint, and the block keys used to match them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from evidence.functions.vectors import let

BITS = 63


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def signature_hex(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def signature_from_coefficients(values: Column) -> Column:
    """Drop the first of 64 numbers, set a bit where a number exceeds the median of the
    other 63; the first number left is the most significant bit."""
    tail = F.slice(values, 2, BITS)

    def packed(median: Column) -> Column:
        bit = lambda x: F.when(x > median, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        return F.aggregate(tail, F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 1) + bit(x))

    return let(F.element_at(F.array_sort(tail), 32), packed)


def token_signatures(texts: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by…, h): majority vote per bit over the SHA-256 of the distinct words of each text.

    The tokens are exploded and folded again, so the partial aggregation before the shuffle
    leaves one row per text and task. Each sum counts two bits at once, in the lower and
    the upper half of a bigint: a text cannot hold 2**31 words, so the halves never meet, and 32
    sums stay small enough for the JVM to compile. Bit i is set where most words have it.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(\w+)"), 1))
    tokens = texts.select(*by, F.explode_outer(words).alias("word")).select(
        *by, F.expr("CAST(conv(substring(sha2(word, 256), 1, 16), 16, -10) AS BIGINT)").alias("t")
    )
    pairs = range(0, BITS, 2)
    ones = [F.expr(f"coalesce(sum(((t >> {i}) & 1L) | (((t >> {i}) & 2L) << 31)), 0L)").alias(f"s{i}") for i in pairs]
    bits = " | ".join(
        f"IF(2L * ((s{i - i % 2} >> {32 * (i % 2)}) & 4294967295L) > n, {1 << i}L, 0L)" for i in range(BITS)
    )
    return tokens.groupBy(*by).agg(F.count("t").alias("n"), *ones).select(*by, F.expr(bits).alias("h"))


def block_masks(threshold: int, blocks: int) -> list[int]:
    """Masks of every choice of ``blocks - threshold`` blocks out of ``blocks``.

    Two signatures within ``threshold`` bits differ in at most ``threshold`` blocks, so they
    agree on at least one mask: matching on (mask, masked bits) loses no pair.
    """
    if not threshold < blocks <= BITS:
        raise ValueError("need threshold < blocks <= 63")
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - threshold)]


def block_keys(h: str, masks: list[int]) -> Column:
    """Array of struct(block, key) to explode; one entry per mask. ``h`` is a column name."""
    entries = ", ".join(f"named_struct('block', {i}, 'key', {h} & {m}L)" for i, m in enumerate(masks))
    return F.expr(f"array({entries})")


def first_block(a: str, b: str, masks: list[int]) -> Column:
    """Index of the first mask two signatures agree on; keeps each pair once without distinct."""
    tests = " ".join(f"WHEN ({a} ^ {b}) & {m}L = 0 THEN {i}" for i, m in enumerate(masks))
    return F.expr(f"CASE {tests} END")
