"""Hard negatives by exact inner products, several candidates multiplied at once (Kronecker packing)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: Rows of one block of candidates and of anchors: a task holds one of each, whatever the size of the table.
CANDIDATES, ANCHORS = 32_768, 16_384
#: Anchors and candidates whose scores a task holds at once.
TILE, CHUNK = 16, 8_192

_LONG = T.LongType()
POSITIVE = T.StructType([T.StructField(c, _LONG) for c in ("anchor_id", "positive_id", "positive_score")])
NEGATIVE = T.StructType(
    [T.StructField(c, _LONG) for c in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")]
)


def labelled_vectors(df: DataFrame, key: str, vec: str, label: str, factor: int = 256) -> DataFrame:
    """(vec_id, label, v): every component x as floor(factor * x), x as double.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Of rows that repeat an
    id the one of the smallest (label, vector) counts. Extra columns are dropped, whatever their names.
    """
    doubles = F.transform(F.col(vec), lambda x: x.cast("double"))
    whole = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = df.where(
        F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vec).isNotNull() & F.coalesce(whole, F.lit(False))
    ).select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
        F.transform(doubles, lambda x: F.floor(x * factor)).alias("v"),
    )
    # only ids are counted here; vectors are shuffled for it only where an id does repeat
    if rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return rows
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def matrix(vectors: list, width: int) -> np.ndarray:
    """Integer vectors as rows, shorter ones filled with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    lengths = np.array([len(v) for v in vectors], np.int64)
    if len(vectors) and lengths.min() == width:
        out[:] = np.vstack(vectors) if width else 0
    else:
        for row, v in zip(out, vectors):
            row[: len(v)] = v
    return out


class Packed:
    """Candidates packed for products with any anchor whose components are at most ``largest`` above their least.

    Component t of several candidates sits in separated bit fields of one unsigned integer, shifted by the least component
    so that no field is negative. A field is as wide as the largest sum of products needs, so fields never
    carry into each other and the scores are exact. 64-bit words are used where a field fits, Python's own
    integers of any width beyond (the same arithmetic, slower).
    """

    def __init__(self, candidates: np.ndarray, largest: int):
        self.n, self.dims = candidates.shape
        self.low = int(candidates.min()) if candidates.size else 0
        top = int(candidates.max()) - self.low if candidates.size else 0
        self.width = max(1, (self.dims * largest * top).bit_length())
        native = self.width <= 64 and max(abs(self.low), top, largest) < 1 << 61
        self.type = np.uint64 if native else object
        self.fields = 64 // self.width if native else 8
        words = -(-self.n // self.fields)
        raised = np.zeros((words * self.fields, self.dims), self.type)
        raised[: self.n] = (candidates - self.low).astype(self.type) if native else candidates.astype(object) - self.low
        self.sums = candidates.astype(object).sum(axis=1) if not native else candidates.sum(axis=1)
        shifts = np.array([j * self.width for j in range(self.fields)], self.type)
        cut = raised.reshape(words, self.fields, self.dims) << shifts[None, :, None]
        self.words = np.ascontiguousarray(cut.sum(axis=1, dtype=self.type).T)
        self.shifts = shifts

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products (anchors x candidates): one product of words an anchor component, then the fields are unpacked."""
        low = int(anchors.min()) if anchors.size else 0
        raised = (anchors - low).astype(self.type) if self.type is np.uint64 else anchors.astype(object) - low
        total = np.zeros((len(anchors), self.words.shape[1]), self.type)
        product = np.empty_like(total)
        for t in range(self.dims):
            np.multiply(raised[:, t, None], self.words[t][None, :], out=product)
            np.add(total, product, out=total)
        mask = (1 << self.width) - 1
        mask = np.uint64(mask) if self.type is np.uint64 else mask
        fields = (total[:, :, None] >> self.shifts[None, None, :]) & mask
        fields = fields.reshape(len(anchors), -1)[:, : self.n]
        if self.type is np.uint64:
            fields = fields.astype(np.int64)
            own = raised.sum(axis=1).astype(np.int64)
        else:
            own = raised.sum(axis=1)
        # sum((A + low)(C + self.low)) from the product of the raised parts
        return fields + self.low * own[:, None] + low * self.sums[None, :]


def _tiles(candidates: pd.DataFrame, anchors: pd.DataFrame):
    """(anchor rows, scores, candidate ids, labels) in tiles; candidates in id order."""
    candidates = candidates.sort_values("vec_id", kind="stable")
    width = max(candidates["v"].map(len).max(), anchors["v"].map(len).max())
    asked = matrix(anchors["v"].to_list(), width)
    largest = int(asked.max()) - int(asked.min()) if asked.size else 0
    ids, labels, vectors = candidates["vec_id"].to_numpy(np.int64), candidates["label"].to_numpy(np.int64), candidates["v"].to_list()
    for at in range(0, len(ids), CHUNK):
        part = slice(at, at + CHUNK)
        packed = Packed(matrix(vectors[part], width), largest)
        for first in range(0, len(asked), TILE):
            yield slice(first, first + TILE), packed.scores(asked[first : first + TILE]), ids[part], labels[part]


def _highest(scores: np.ndarray, fits: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of the highest fitting score of each row, then of the next, k times; ties to the first column."""
    out = []
    left = fits.copy()
    least = scores.min(initial=0) - 1
    for _ in range(k):
        held = np.where(left, scores, least)
        best = held.argmax(axis=1)
        rows = np.flatnonzero(left[np.arange(len(left)), best])
        if not len(rows):
            break
        out.append((rows, best[rows]))
        left[rows, best[rows]] = False
    return out


def _positives(candidates: pd.DataFrame, anchors: pd.DataFrame, k: int) -> pd.DataFrame:
    found = [(np.zeros(0, np.int64),) * 3]
    if len(candidates) and len(anchors):
        own, mine = anchors["vec_id"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64)
        for at, scores, ids, labels in _tiles(candidates, anchors):
            fits = (labels[None, :] == mine[at][:, None]) & (ids[None, :] != own[at][:, None])
            found += [(own[at][r], ids[c], scores[r, c]) for r, c in _highest(scores, fits, k)]
    return pd.DataFrame(dict(zip(POSITIVE.names, (np.concatenate(x) for x in zip(*found)))))


def _negatives(candidates: pd.DataFrame, anchors: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    found = [(np.zeros(0, np.int64),) * 5]
    if len(candidates) and len(anchors):
        own, mine = anchors["vec_id"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64)
        lists = [[(p["positive_id"], p["positive_score"]) for p in ps] for ps in anchors["positives"]]
        for at, scores, ids, labels in _tiles(candidates, anchors):
            other = labels[None, :] != mine[at][:, None]
            held = lists[at]
            for place in range(max(map(len, held))):
                rows = np.array([i for i, ps in enumerate(held) if place < len(ps)])
                ids_p, ps = (np.array([held[i][place][j] for i in rows]) for j in (0, 1))
                part, times = scores[rows], 100 * scores[rows]
                fits = other[rows] & (times >= low * ps[:, None]) & (times <= high * ps[:, None])
                found += [
                    (own[at][rows[r]], ids_p[r], ps[r], ids[c], part[r, c]) for r, c in _highest(part, fits, k)
                ]
    return pd.DataFrame(dict(zip(NEGATIVE.names, (np.concatenate(x) for x in zip(*found)))))


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    candidates: int = CANDIDATES, anchors: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over (vec_id, label, v array<long>).

    The positives of an anchor are its best rows of the same label; the negatives of a positive are the best rows of other labels
    whose score is between ``low`` and ``high`` percent of the positive's. Scores are integer inner products, ties
    go to the smaller id, an anchor is never its own positive; a shorter vector counts as filled with zeros.

    Rows are dealt by the hash of their id to blocks of a bounded size (one block of each side a task), so labels or vectors
    that many rows share spread like all others. A pair of blocks returns at most ``positives`` rows an anchor, or
    ``negatives`` rows an anchor and positive, which windows merge. The products are made twice: the positives bound the
    search for negatives. No rows, no anchors, or an anchor without positives or without fitting rows: no rows.
    """
    sizes = vectors.agg(F.count(F.lit(1)).alias("all"), F.count_if(is_anchor).alias("asked")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    # small tables still use all cores, large ones have blocks of full size
    blocks = max(1, -(-sizes["all"] // candidates), min(cores, -(-sizes["all"] // 1024)))
    anchor_blocks = max(1, -(-sizes["asked"] // anchors))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = vectors.withColumn("c", block(blocks)).withColumn("q", every(anchor_blocks))
    asked = vectors.where(is_anchor).withColumn("q", block(anchor_blocks)).toDF("vec_id", "label", "v", "q")

    def met(right: DataFrame, fn, schema) -> DataFrame:
        dealt = right.withColumn("c", every(blocks))
        return left.groupBy("c", "q").cogroup(dealt.groupBy("c", "q")).applyInPandas(fn, schema)

    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    same = met(asked, lambda x, y: _positives(x, y, positives), POSITIVE)
    held = (
        same.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives)
        .groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    )
    told = asked.join(held, "vec_id")
    other = met(told, lambda x, y: _negatives(x, y, negatives, low, high), NEGATIVE)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return other.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
