"""Exact top-k search by inner product over integer vectors, term at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: Candidates of one block and queries of one block: a task holds one of each, and scores in tiles.
CANDIDATES, QUERIES, TILE = 4096, 4096, 64

PARTIAL = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType()),
])


def integer_vectors(df: DataFrame, key: str, vec: str, factor: int = 256) -> DataFrame:
    """(vec_id, v): every component x as floor(factor * x); vectors null or with null or non-finite parts are left out."""
    doubles = F.transform(F.col(vec), lambda x: x.cast("double"))
    finite = F.forall(
        doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    whole = F.transform(doubles, lambda x: F.floor(x * factor))
    return df.where(F.col(key).isNotNull() & F.col(vec).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(key).cast("long").alias("vec_id"), whole.alias("v")
    )


def _best(scores: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query row, candidate column) of the k best by (score, smaller id); the own row is left out."""
    valid = ids[None, :] != query_ids[:, None]
    low = np.iinfo(np.int64).min
    scores = np.where(valid, scores, low)
    n = scores.shape[1]
    cut = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), low)
    rows, cols = np.nonzero((scores >= cut[:, None]) & valid)
    # columns are in id order and lexsort is stable, so ties go to the smaller id
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(len(scores)))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], cols[keep], scores[rows[keep], cols[keep]]


def score_block(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of one block for every query of another.

    The block is laid out as postings (for each dimension the candidates and their weights).
    Each query row gives the weights of its non-zero dimensions, which scatter
    weight * posting into a dense array of scores, one dimension after the other.
    Vectors of another length share the dimensions that both have.
    """
    found = [(np.zeros(0, np.int64),) * 3]
    if len(candidates) and len(queries):
        candidates = candidates.sort_values("vec_id", kind="stable")
        ids = candidates["vec_id"].to_numpy(np.int64)
        lengths = candidates["v"].map(len).to_numpy()
        owner = np.repeat(np.arange(len(ids)), lengths)
        starts = np.cumsum(lengths) - lengths
        flat = np.concatenate(candidates["v"].to_list()).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
        term = np.arange(len(flat)) - starts[owner]
        nonzero = flat != 0
        order = np.argsort(term[nonzero], kind="stable")
        owner, weight, term = owner[nonzero][order], flat[nonzero][order], term[nonzero][order]
        bounds = np.searchsorted(term, np.arange(int(term.max(initial=-1)) + 2))
        postings = [(owner[a:b], weight[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        query_ids = queries["vec_id"].to_numpy(np.int64)
        vectors = queries["v"].to_list()
        for at in range(0, len(query_ids), TILE):
            part = vectors[at : at + TILE]
            scores = np.zeros((len(part), len(ids)), np.int64)
            for t, (who, w) in enumerate(postings):
                mine = np.array([v[t] if t < len(v) else 0 for v in part], np.int64)
                rows = np.flatnonzero(mine)
                if not len(rows) or not len(who):
                    continue
                if len(who) == len(ids) and len(rows) == len(part):
                    scores += mine[:, None] * w[None, :]
                else:
                    scores[rows[:, None], who[None, :]] += mine[rows][:, None] * w[None, :]
            rows, cols, best = _best(scores, ids, query_ids[at : at + TILE], k)
            found.append((query_ids[at + rows], ids[cols], best))
    query_id, vec_id, score = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": score})


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, candidates: int = CANDIDATES, queries: int = QUERIES
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query row by inner product.

    ``vectors`` is (vec_id, v array<long>). Candidates are all rows with another id. Rows are dealt by
    hash to blocks of a fixed mean size, so a task holds one block of candidates and one of queries whatever the
    size of the tables; vectors that many rows share are dealt like all others. Each pair of blocks gives at
    most k rows a query, and a window merges them. The number of blocks follows from two counts.

    A repeated id: every row is a candidate, the query is the smallest vector of the id. Fewer than k
    candidates: all of them. No rows: no rows. Products are 64-bit integers.
    """
    asked = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = vectors.agg(F.count(F.lit(1)).alias("all"), F.count_if(is_query).alias("asked")).first()
    blocks, query_blocks = max(1, -(-sizes["all"] // candidates)), max(1, -(-sizes["asked"] // queries))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = vectors.withColumn("c", block(blocks)).withColumn("q", every(query_blocks))
    right = asked.withColumn("q", block(query_blocks)).withColumn("c", every(blocks))
    partial = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(
        lambda x, y: score_block(x, y, k), PARTIAL
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
