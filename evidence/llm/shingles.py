"""Hashes of words and of runs of words for many texts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Words of one shingle.
SHINGLE = 5
#: Letters of a word up to which all words are hashed side by side.
LETTERS = 40
#: Bytes of text that a worker handles together, beyond one whole text.
BATCH_BYTES = 3_000_000

_GOLD = 0x9E3779B97F4A7C15
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACE = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(_GOLD)) | np.uint64(1)
_LETTER = mix(np.arange(1000, 1256, dtype=np.uint64) * np.uint64(_GOLD))


def letters_hash(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of a matrix of bytes, never 0."""
    return mix((_LETTER[rows] * _PLACE[100 : 100 + rows.shape[1]]).sum(axis=1, dtype=np.uint64)) | np.uint64(1)


@dataclass
class Words:
    """Words of a list of texts: hash, text number, and place in the joined bytes; ``first`` has one entry more than texts."""

    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words(texts: list[bytes]) -> Words:
    """Words (runs of other bytes than space and \\t to \\r) of UTF-8 texts."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACES[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1  # the last byte is a space
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    first = np.searchsorted(start, bounds)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    if not len(start):
        return Words(np.zeros(0, np.uint64), text, start, end, first)
    return Words(mix(_sums(data, start, end - start)), text, start, end, first)


def _sums(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each word the sum of its letters' numbers times those of their places: letter by letter for all words of so many letters, the longest first."""
    order = np.argsort(np.minimum(length, LETTERS + 1).astype(np.uint8), kind="stable")[::-1]
    sums, at = np.zeros(len(start), np.uint64), start[order]
    more = len(length) - np.cumsum(np.bincount(np.minimum(length, LETTERS + 1), minlength=LETTERS + 2))  # words of more than so many letters
    for k in range(LETTERS):
        n = more[k]
        if not n:
            break
        sums[:n] += _LETTER[data[at[:n] + k]] * _PLACE[k]
    n = more[LETTERS]
    if n:
        long = length[order[:n]]
        begin = np.cumsum(long) - long
        place = np.arange(int(long.sum())) - np.repeat(begin, long)
        sums[:n] = np.add.reduceat(_LETTER[data[place + np.repeat(at[:n], long)]] * _PLACE[place & 4095], begin)
    out = np.empty_like(sums)
    out[order] = sums
    return out


@dataclass
class Shingles:
    """Hashes of the runs of SHINGLE words of each text; ``first`` has one entry more than texts."""

    hash: np.ndarray
    first: np.ndarray


def shingles(found: Words, size: int = SHINGLE) -> Shingles:
    """A text of fewer words than ``size`` has one shingle of all its words, one without words has none."""
    counts = np.diff(found.first)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(int(first[-1])) - np.repeat(first[:-1], n) + np.repeat(found.first[:-1], n)
    stop = np.repeat(found.first[1:], n)
    total = np.zeros(len(at), np.uint64)
    padded = np.concatenate([found.hash, np.zeros(size, np.uint64)])
    for k in range(size):
        total += np.where(at + k < stop, padded[at + k], np.uint64(0)) * _PLACE[k + 64]
    return Shingles(mix(total), first)


def in_batches(
    batches: Iterator[pa.RecordBatch], column: str, then: Callable[[pa.RecordBatch, list[bytes | None]], pa.RecordBatch | None],
    most: int = BATCH_BYTES,
) -> Iterator[pa.RecordBatch]:
    """Call ``then`` with slices of the batches and the bytes of their texts, each slice of about ``most`` bytes."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        texts: list[bytes | None] = []
        start = held = 0
        for i, value in enumerate(values):
            texts.append(value.as_py())
            held += len(texts[-1] or b"")
            if held >= most or i + 1 == len(values):
                out = then(batch.slice(start, i + 1 - start), texts)
                if out is not None and out.num_rows:
                    yield out
                texts, start, held = [], i + 1, 0
