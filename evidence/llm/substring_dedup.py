"""Removal of bytes in repeated substrings, exact across a corpus, by suffix arrays over candidate passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from evidence.llm.shingles import in_batches, mix
from evidence.llm.suffix_array import permuted_prefixes, suffix_array
from evidence.operators.scale import stored

#: Bytes of a repeated string, and of the strings inside whose smallest hash stands for it; longer ones where many passages share an anchor.
WINDOW, ANCHOR, LONGER = 100, 24, 72
#: Bytes of texts that a worker hashes together, beyond one whole text: some 150 bytes of memory each.
BATCH_BYTES = 700_000
#: Mean bytes of one suffix array, and different passages of one anchor from which on they are told apart by longer anchors.
SHARD_BYTES, CROWD = 400_000, 1000

_BASE = 0x9E3779B97F4A7C15
_LETTER = mix(np.arange(7000, 7256, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers of an odd base modulo 2 ** 64, kept for the longest request so far."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), np.uint64(base), np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


class Rolling:
    """Hashes of any piece of a byte string in constant time."""

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[data] * _power(base, n), out=self.sums[1:])
        self.back = _power(pow(base, -1, 2**64), n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def passages(texts: list[bytes], window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text, start, count, anchor hash, content hash, repeats) of the runs of windows with one smallest anchor hash.

    Every window of ``window`` bytes lies in exactly one passage, and equal windows have equal anchors. ``repeats`` tells
    that the anchor occurs twice in the passage, without which no two of its windows are equal.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    empty = np.zeros(0, np.int64)
    if len(data) < window:
        return empty, empty, empty, empty, empty, np.zeros(0, bool)
    first = Rolling(data, 0xD6E8FEB86659FD93)
    grams = len(data) - anchor + 1
    at = np.arange(grams)
    hashes = first.hash(at, at + anchor)
    width = window - anchor + 1
    least = sliding_min(hashes, width)
    starts = ends - np.array([len(t) for t in texts], np.int64)
    windows = np.maximum(ends - starts - window + 1, 0)
    owner = np.repeat(np.arange(len(texts)), windows)
    valid = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[owner]
    if not len(valid):
        return empty, empty, empty, empty, empty, np.zeros(0, bool)
    value = least[valid]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])
    run = np.flatnonzero(new)
    count = np.diff(np.append(run, len(valid)))
    start, text, key = valid[run], owner[run], value[run]
    repeats = np.zeros(len(run), bool)
    views = np.lib.stride_tricks.sliding_window_view(hashes, width)
    for a in range(0, len(run), 8192):
        part = slice(a, a + 8192)
        head = views[start[part]] == key[part, None]
        tail = views[start[part] + count[part] - 1] == key[part, None]
        place_h, place_t = head.argmax(axis=1) + start[part], tail.argmax(axis=1) + start[part] + count[part] - 1
        repeats[part] = (head.sum(axis=1) > 1) | (tail.sum(axis=1) > 1) | (place_h != place_t)
    second = Rolling(data, 0xA0761D6478BD642F)
    content = second.hash(start, start + count + window - 1)
    return text, start - starts[text], count, key.view(np.int64), content.view(np.int64), repeats


def all_passages(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc, start, n, anchor, content, repeats) of every text of (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def then(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            text, start, count, key, content, repeats = passages([t or b"" for t in texts], window, anchor)
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text)), pa.array(start), pa.array(count), pa.array(key), pa.array(content), pa.array(repeats)],
                ["doc", "start", "n", "anchor", "content", "repeats"],
            )

        yield from in_batches(batches, "text", then, BATCH_BYTES)

    return docs.mapInArrow(run, "doc long, start long, n long, anchor long, content long, repeats boolean")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc, packed): texts compressed for shuffles; null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress

        def then(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(t or b"") for t in texts], pa.binary())], ["doc", "packed"])

        yield from in_batches(batches, "text", then)

    return docs.mapInArrow(run, "doc long, packed binary")


def cut_passages(packed: DataFrame, wanted: DataFrame, window: int, anchor: int | None = None) -> DataFrame:
    """Rows of ``wanted`` (doc, start, n, key, crowd) with the bytes of their passages.

    With ``anchor`` they are cut again at longer anchors instead, in the same task: (doc, start, n, anchor, content, repeats). The
    new anchor is that of the old key and the longer string together, so equal windows of one old anchor still meet.
    """
    cuts = wanted.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "key", "crowd")).alias("cuts"))
    most = 8_000_000 if anchor is None else BATCH_BYTES

    def whole(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(["doc", "start", "n", "key", "crowd", "bytes"], zip(*rows))))

    def again(rows: list[tuple]) -> pa.RecordBatch:
        doc, begin, _, old, _, pieces = zip(*rows)
        text, start, count, key, content, repeats = passages(list(pieces), window, anchor)
        doc, begin, old = (np.array(x, np.int64)[text] for x in (doc, begin, old))
        key = mix(mix(old.view(np.uint64)) ^ key.view(np.uint64)).view(np.int64)
        columns = {"doc": doc, "start": begin + start, "n": count, "anchor": key, "content": content, "repeats": repeats}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, out = zstandard.ZstdDecompressor().decompress, whole if anchor is None else again
        rows, held = [], 0
        for batch in batches:
            for doc, data, cuts in zip(*(batch.column(i) for i in range(3))):
                text = unpack(data.as_py())
                for c in cuts.as_py():
                    piece = text[c["start"] : c["start"] + c["n"] + window - 1]
                    rows.append((doc.as_py(), c["start"], c["n"], c["key"], c["crowd"], piece))
                    held += len(piece)
                    if held > most:
                        yield out(rows)
                        rows, held = [], 0
        if rows:
            yield out(rows)

    kept = "key long, crowd boolean, bytes binary" if anchor is None else "anchor long, content long, repeats boolean"
    return packed.join(cuts, "doc").select("doc", "packed", "cuts").mapInArrow(run, f"doc long, start long, n long, {kept}")


def repeats_in_shard(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """Windows of a shard that start earlier in it, as runs (doc, start, n); firsts of crowded anchors with a digest.

    The passages, in order of document and start, are one text with a mark between them; its suffix array puts equal windows side by
    side, and the first of them in the text is the earliest.
    """
    rows = rows.sort_values(["doc", "start"], kind="stable")
    pieces = rows["bytes"].to_list()
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in pieces])
    begins = ends - np.array([len(p) + 1 for p in pieces])
    marked = text.astype(np.uint16) + 1
    marked[ends - 1] = 0
    order = suffix_array(marked)
    shared = permuted_prefixes(text, order)
    n = rows["n"].to_numpy(np.int64)
    piece = np.repeat(np.arange(len(n)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + begins[piece]
    at_piece = np.full(len(text), -1, np.int64)
    at_piece[place] = piece
    ordered = order[at_piece[order] >= 0]
    # neighbours among windows share their bytes if all suffixes between them do; others than windows never share so much
    joined = shared[ordered] >= window
    group = np.cumsum(~joined)
    earliest = np.full(int(group[-1]) + 1 if len(group) else 1, len(text), np.int64)
    np.minimum.at(earliest, group, ordered)
    again = np.zeros(len(text), bool)
    again[ordered] = ordered != earliest[group]
    docs, starts, crowd = rows["doc"].to_numpy(np.int64), rows["start"].to_numpy(np.int64), rows["crowd"].to_numpy(bool)
    edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    runs = pd.DataFrame({"doc": docs[at_piece[a]], "start": starts[at_piece[a]] + a - begins[at_piece[a]], "n": b - a, "digest": None})
    loose = np.flatnonzero((at_piece >= 0) & ~again & crowd[np.maximum(at_piece, 0)])
    whole = text.tobytes()
    firsts = pd.DataFrame({
        "doc": docs[at_piece[loose]], "start": starts[at_piece[loose]] + loose - begins[at_piece[loose]], "n": np.ones(len(loose), np.int64),
        "digest": [hashlib.blake2b(whole[i : i + window], digest_size=16).digest() for i in loose.tolist()],
    })
    return pd.concat([runs, firsts], ignore_index=True) if len(runs) and len(firsts) else (runs if len(runs) else firsts)


def repeated_spans(docs: DataFrame, packed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, start, n): runs of n windows of (doc, text) whose bytes also start earlier; every such window is in a run.

    1. Texts are cut into passages: the windows whose smallest anchor hash is one value. Equal windows lie in
       passages of equal anchors, so only passages whose anchor occurs twice go on.
    2. Passages of equal content are folded: all but the first consist of repeats. A passage that a third of all
       documents share costs one row a task.
    3. Different passages with one anchor go to a shard together, and a suffix array of the shard finds their equal windows.
    4. Where very many different passages have one anchor (a frequent phrase) they are cut again at the smallest hash of longer strings
       inside, and steps 1 to 3 are repeated: most have no other passage with that string. What is left of
       crowds around one long string is spread over shards, and the windows left there are compared by digest, one
       row per shard and window.
    """
    place = F.struct("doc", "start")
    longer = [size for size in (LONGER,) if anchor < size < window]
    rows, copies, wanted = all_passages(docs, window, anchor), [], []
    for size in [*longer, None]:
        often = rows.select("anchor").groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("anchor", F.lit(True).alias("often"))
        candidates = stored(rows.join(often, "anchor", "left").where("often OR repeats").drop("often"))
        leaders = stored(candidates.groupBy("anchor", "content").agg(
            F.min(place).alias("first"), F.first("n").alias("n"), F.max("repeats").alias("repeats")
        ))
        copies.append(
            candidates.join(leaders.select("anchor", "content", "first"), ["anchor", "content"]).where(place != F.col("first")).select("doc", "start", "n")
        )
        groups = leaders.groupBy("anchor").agg(F.count(F.lit(1)).alias("different"))
        alike = leaders.join(groups, "anchor").where("different > 1 OR repeats")
        crowd, salt = F.col("different") > CROWD, F.pmod(F.xxhash64("content"), F.ceil(F.col("different") / CROWD))
        alike = stored(alike.select(
            F.col("first.doc").alias("doc"), F.col("first.start").alias("start"), "n",
            F.when(crowd & F.lit(size is None), F.xxhash64("anchor", salt)).otherwise(F.col("anchor")).alias("key"), crowd.alias("crowd"),
        ))
        crowded = alike.where("crowd")
        if size is None or crowded.isEmpty():
            wanted.append(alike)
            break
        wanted.append(alike.where("NOT crowd"))
        rows = cut_passages(packed, crowded, window, size)
    wanted = stored(reduce(DataFrame.unionByName, wanted))
    copies = reduce(DataFrame.unionByName, copies)
    total = wanted.agg(F.coalesce(F.sum(F.col("n") + window), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, total // SHARD_BYTES)
    pieces = cut_passages(packed, wanted, window).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    found = stored(pieces.groupBy("shard").applyInPandas(
        lambda rows: repeats_in_shard(rows, window), "doc long, start long, n long, digest binary"
    ))
    earliest = Window.partitionBy("digest")
    loose = found.where("digest IS NOT NULL").withColumn("first", F.min(place).over(earliest)).where(place != F.col("first"))
    return copies.unionByName(found.where("digest IS NULL").select("doc", "start", "n")).unionByName(
        loose.select("doc", "start", "n")
    )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of (start, end) ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept binary): every text without its repeated bytes.

    A byte goes if it lies in a string of ``window`` bytes that also starts earlier: in a document of smaller key, or earlier in
    the same. Strings are judged on the input, overlaps count and matches never cross documents. ``kept`` may
    end in the middle of a character, so it is binary.

    A null text is empty; a text shorter than the window stays. Of rows that repeat a key, each is a document of its own: they are
    ordered by text, and all come out. A null key comes before all others. No rows: no rows.
    """
    plain = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    numbered = plain.select(F.col("_key").alias("doc"), "text")
    names = None
    if not plain.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR _key IS NULL").isEmpty():
        # ids that rise with the order of a range-partitioned sort
        placed = stored(plain.orderBy(F.col("_key").asc_nulls_first(), "text").withColumn("doc", F.monotonically_increasing_id()))
        numbered, names = placed.select("doc", "text"), placed.select("doc", F.col("_key").alias(key))
    packed = packed_texts(numbered)
    spans = repeated_spans(numbered, packed, window, anchor)
    end = F.col("start") + F.col("n") + (window - 1)
    by_doc = spans.groupBy("doc").agg(F.collect_list(F.struct(F.col("start").alias("a"), end.alias("b"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for batch in batches:
            rows, held = [], 0
            for doc, data, spans in zip(*(batch.column(i) for i in range(3))):
                whole, last, kept = unpack(data.as_py()), 0, []
                gone = merged([(s["a"], s["b"]) for s in spans.as_py() or []])
                for a, b in gone:
                    kept.append(whole[last:a])
                    last = b
                rest = b"".join([*kept, whole[last:]])
                held += len(rest)
                rows.append((doc.as_py(), len(whole), len(whole) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest))
                if held > 8_000_000:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows))))
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows))))

    out = packed.join(by_doc, "doc", "left").select("doc", "packed", "spans").mapInArrow(
        run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    return out.withColumnRenamed("doc", key) if names is None else out.join(names, "doc").drop("doc")
