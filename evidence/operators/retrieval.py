"""Exact nearest neighbours by inner product (cosine for unit vectors)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from evidence.operators.scale import BROADCAST_BYTES, small_matrix, stored

#: Similarities are ordered after rounding, so equal vectors tie whatever the addition order.
DIGITS = 10
#: Queries and gallery rows of a tile of products, 4 MB of them.
QUERY_STEP, GALLERY_STEP = 128, 4096
#: Products with pivots that are held at a time, and visits that leave a task at a time.
PIVOT_STEP, VISIT_STEP = 250_000, 20_000
#: Most cells of a large gallery.
CELLS = 2_048


def _search(queries: np.ndarray, gallery: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, gallery row, similarity) of the k best per query; gallery rows are in key order.

    Queries and gallery meet in tiles of at most TILE products, so memory does not follow the number of rows on either side.
    """
    parts = [_search_few(queries[at : at + QUERY_STEP], gallery, k, at) for at in range(0, len(queries), QUERY_STEP)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(column) for column in zip(*parts))


def _search_few(queries: np.ndarray, gallery: np.ndarray, k: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the rows of one tile, which are numbered from ``first``."""
    n = len(queries)
    who, rows, sims = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    kth = np.full(n, -np.inf)  # the k-th rounded value of each query so far; later rows have to exceed it
    for start in range(0, len(gallery), GALLERY_STEP):
        block = queries @ gallery[start : start + GALLERY_STEP].T
        least = kth
        if block.shape[1] > k and np.isneginf(kth).any():
            least = np.fmax(kth, -np.partition(-block, k - 1, axis=1)[:, k - 1])
        # what rounding may change is let in and sorted by rounded values
        slack = 2 * 10.0**-DIGITS + 1e-14 * np.where(np.isfinite(least), np.abs(least), 0.0)
        i, j = np.nonzero(~(block < (least - slack)[:, None]))
        new = block[i, j]
        later = ~(np.round(new, DIGITS) <= kth[i])
        who, rows, sims = np.concatenate([who, i[later]]), np.concatenate([rows, j[later] + start]), np.concatenate([sims, new[later]])
        order = np.lexsort((rows, -np.round(sims, DIGITS), who))
        who, rows, sims = who[order], rows[order], sims[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        last = place == k - 1
        kth[who[last]] = np.fmax(kth[who[last]], np.round(sims[last], DIGITS))
        who, rows, sims = who[place < k], rows[place < k], sims[place < k]
    return who + first, rows, sims


def nearest(
    queries: DataFrame,
    gallery: DataFrame,
    query: str,
    key: str,
    vec: str,
    k: int,
    carry_query: list[str] = [],
    carry: list[str] = [],
    max_bytes: int = BROADCAST_BYTES,
    block_rows: int = 20_000,
    cell_rows: int = 4_096,
) -> DataFrame:
    """The k best gallery rows of every query: (query, query columns…, rank, neighbour, gallery columns…, similarity).

    Order: similarity falling, gallery key rising. A gallery of checked small size is sent to every
    task and multiplied block by block. A larger one is cut into cells around pivots. Each query sees the cells nearest to it,
    which bounds what its k-th row can be; then it sees only those other cells that the triangle inequality does not rule out.
    A task holds one part of a cell and one block of the queries that see it, so query vectors are copied once a visit, and gallery
    vectors once a block of visits and round. Both ways give the same rows.
    """
    q = queries.select(query, *carry_query, vec)
    g = gallery.select(F.col(key).alias("neighbour"), *[F.col(c).alias(f"neighbour_{c}") for c in carry], F.col(vec).alias("_gallery"))
    names = [f"neighbour_{c}" for c in carry]
    schema = T.StructType(
        [f for f in q.schema.fields if f.name != vec] + [f for f in g.schema.fields if f.name != "_gallery"]
        + [T.StructField("similarity", T.DoubleType()), T.StructField("rank", T.IntegerType())]
    )
    left = [query, *carry_query]
    right = ["neighbour", *names]

    def assemble(qs: pd.DataFrame, gs: pd.DataFrame, matrix: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
        vectors = np.vstack(qs[vec].to_numpy()).astype(np.float64)
        qi, gi, sims = _search(vectors, matrix, k)
        out = pd.concat(
            [qs[left].iloc[qi].reset_index(drop=True), gs[right].iloc[gi].reset_index(drop=True)], axis=1
        )
        place = np.arange(len(qi)) - np.searchsorted(qi, qi) + 1  # the rows of a query follow each other, best first
        return qi, out.assign(similarity=sims, rank=place.astype(np.int32))

    small = small_matrix(g, "neighbour", "_gallery", names, max_bytes)
    if small is not None:
        shared = queries.sparkSession.sparkContext.broadcast(small)

        def search(batches):
            gs, matrix = shared.value
            for qs in batches:
                if len(qs) and len(gs):
                    yield assemble(qs, gs, matrix)[1]

        return q.mapInPandas(search, schema)

    placed, cells = gallery_cells(g, cell_rows, block_rows)
    if cells is None:
        return queries.sparkSession.createDataFrame([], schema)

    def met(rows: DataFrame) -> DataFrame:
        """At most k gallery rows of every visited cell for every visit, none below the visit's bound."""
        told = visits(rows, vec, cells, k)
        asked = {r["_cell"]: r["n"] for r in told.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        blocks = [(c, max(1, -(-n // (block_rows * int(cells.parts[c]))))) for c, n in asked.items()]
        sizes = lambda: F.broadcast(queries.sparkSession.createDataFrame(blocks, "_cell int, _blocks int"))
        left = told.join(sizes(), "_cell").withColumn("_block", F.pmod(F.xxhash64(query), F.col("_blocks")).cast("int"))
        dealt = placed.join(sizes(), "_cell").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        keys = ["_cell", "_part", "_block"]

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame(columns=schema.names)
            b = b.sort_values("neighbour", kind="stable")
            a = a.reset_index(drop=True)
            place, found = assemble(a, b, np.vstack(b["_gallery"].to_numpy()).astype(np.float64))
            return found[found["similarity"].to_numpy() >= a["_tau"].to_numpy()[place]]

        return left.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(meet, schema)

    def best(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(query).orderBy(F.round("similarity", DIGITS).desc(), F.asc("neighbour"))
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = stored(best(met(q.withColumn("_tau", F.lit(None).cast("double")))))
    bound = first.groupBy(query).agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).otherwise(F.lit(float("-inf"))).alias("_tau"))
    return best(first.unionByName(met(q.join(bound, query))))


@dataclass
class Cells:
    """Pivots of a gallery: each row belongs to the nearest pivot, at most ``radius`` away; a cell has ``parts`` parts."""

    pivots: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    parts: np.ndarray
    longest: float


def gallery_cells(gallery: DataFrame, cell_rows: int, block_rows: int) -> tuple[DataFrame, Cells | None]:
    """(stored gallery with _cell and _part, cells) over (neighbour, …, _gallery); None for an empty gallery.

    Pivots are the vectors of the first keys in hash order, one for ``cell_rows`` rows, at most CELLS and BROADCAST_BYTES of
    them, so the table of pivots is of bounded size. A cell that grows beyond ``block_rows`` rows, such as one of a vector that
    very many rows share, is dealt over several parts.
    """
    n = gallery.count()
    if not n:
        return gallery, None
    width = gallery.select(F.size("_gallery")).first()[0]
    number = max(1, min(-(-n // cell_rows), CELLS, BROADCAST_BYTES // (8 * max(width, 1))))
    drawn = gallery.select("neighbour", "_gallery").orderBy(F.xxhash64("neighbour"), "neighbour").limit(number).collect()
    pivots = np.array([r["_gallery"] for r in drawn], np.float64)
    shared = gallery.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        centres = shared.value
        half, step = (centres**2).sum(axis=1) / 2, max(1, PIVOT_STEP // len(centres))
        for rows in batches:
            if not len(rows):
                continue
            vectors = np.vstack(rows["_gallery"].to_numpy()).astype(np.float64)
            near = np.concatenate([(vectors[i : i + step] @ centres.T - half).argmax(axis=1) for i in range(0, len(vectors), step)])
            yield rows.assign(_cell=near.astype(np.int32), _away=np.linalg.norm(vectors - centres[near], axis=1), _long=np.linalg.norm(vectors, axis=1))

    fields = [T.StructField("_cell", T.IntegerType()), T.StructField("_away", T.DoubleType()), T.StructField("_long", T.DoubleType())]
    assigned = stored(gallery.mapInPandas(assign, T.StructType([*gallery.schema.fields, *fields])))
    rows, radius, longest = np.zeros(number, np.int64), np.zeros(number), 0.0
    for r in assigned.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_away").alias("away"), F.max("_long").alias("long")).collect():
        rows[r["_cell"]], radius[r["_cell"]], longest = r["n"], r["away"], max(longest, r["long"])
    cells = Cells(pivots, radius, rows, np.maximum(1, -(-rows // block_rows)), longest)
    parts = gallery.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(cells.parts)], "_cell int, _parts int")
    part = F.pmod(F.xxhash64("neighbour"), F.col("_parts")).cast("int")
    return assigned.join(F.broadcast(parts), "_cell").withColumn("_part", part).drop("_parts", "_away", "_long"), cells


def visits(queries: DataFrame, vec: str, cells: Cells, k: int) -> DataFrame:
    """(queries…, _cell, _part): the cells that each query has to see.

    A query without a bound (null ``_tau``) sees the cells of its nearest pivots that hold k rows, two cells at least. With the similarity
    of its k-th row so far as bound it sees, of the other cells, those that may hold a row as good: for every row g of a cell of
    pivot p and radius r, q·g = q·p + q·(g − p) ≤ q·p + |q|·r. A null vector has no visits.
    """
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def choose(batches):
        c = shared.value
        held = c.rows > 0
        step = max(1, PIVOT_STEP // len(c.rows))
        for whole in batches:
            whole = whole[whole[vec].notna()]
            for at in range(0, len(whole), step):
                rows = whole.iloc[at : at + step]
                vectors = np.vstack(rows[vec].to_numpy()).astype(np.float64)
                close = np.where(held, vectors @ c.pivots.T, -np.inf)
                order = np.argsort(-close, axis=1, kind="stable")
                before = np.cumsum(c.rows[order], axis=1) - c.rows[order]
                early = np.zeros(close.shape, bool)
                np.put_along_axis(early, order, (before < k) | (np.arange(len(c.rows)) < 2), axis=1)
                tau = rows["_tau"].to_numpy(np.float64, na_value=np.nan)
                norms = np.linalg.norm(vectors, axis=1)
                slack = 1e-9 * np.maximum(1.0, norms * c.longest)
                reach = close + norms[:, None] * c.radius[None, :]
                later = ~early & (reach >= (tau - slack)[:, None])
                who, cell = np.nonzero(np.where(np.isnan(tau)[:, None], early, later) & held)
                parts = c.parts[cell]
                who, cell = np.repeat(who, parts), np.repeat(cell, parts)
                part = np.arange(len(who)) - np.repeat(np.cumsum(parts) - parts, parts)
                # rows below the bound by more than the rounding of similarities are not returned
                least = np.where(np.isnan(tau), -np.inf, tau - slack)
                for out in range(0, len(who), VISIT_STEP):  # a visit copies its vector
                    some = slice(out, out + VISIT_STEP)
                    yield rows.iloc[who[some]].assign(_tau=least[who[some]], _cell=cell[some].astype(np.int32), _part=part[some].astype(np.int32))

    fields = [T.StructField("_cell", T.IntegerType()), T.StructField("_part", T.IntegerType())]
    return queries.mapInPandas(choose, T.StructType([*queries.schema.fields, *fields]))


def packed_neighbours(found: DataFrame, query: list[str], cls: str) -> DataFrame:
    """One row per query with its neighbours joined by ``|`` in rank order (k entries at most)."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "neighbour", cls, "similarity")))
    held = found.groupBy(*query).agg(rows.alias("r"))
    joined = lambda f: F.array_join(F.transform("r", f), "|")
    return held.select(
        *query,
        joined(lambda x: x["neighbour"].cast("string")).alias("identifiers"),
        joined(lambda x: x[cls]).alias("classes"),
        joined(lambda x: F.format_string("%.8f", x["similarity"])).alias("similarities"),
    )


def consistency(found: DataFrame, by: list[str], query: str, matches: dict, ks: list[int]) -> DataFrame:
    """(by…, factor, k, consistency, hit): mean share of matching neighbours and of queries with one.

    ``matches`` maps a factor to a boolean column over the neighbour rows.
    """
    top = max(ks)
    aggregates = []
    for name, match in matches.items():
        for k in ks:
            inside = F.when(F.col("rank") <= k, match.cast("double"))
            aggregates += [F.avg(inside).alias(f"{name}_{k}_c"), F.max(inside).alias(f"{name}_{k}_h")]
    per_query = found.where(F.col("rank") <= top).groupBy(*by, query).agg(*aggregates)
    means = per_query.groupBy(*by).agg(*[F.avg(c).alias(c) for c in per_query.columns if c not in [*by, query]])
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("factor"), F.lit(k).alias("k"),
                F.col(f"{n}_{k}_c").alias("consistency"), F.col(f"{n}_{k}_h").alias("hit"),
            )
            for n in matches for k in ks
        ]
    )
    return means.select(*by, F.explode(entries).alias("e")).select(*by, "e.*")


def winner_and_runner_up(found: DataFrame, query: list[str]) -> DataFrame:
    """Turn two neighbours per query (classes as gallery) into prediction, runner-up and margin."""
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    return found.groupBy(*query).agg(
        at(1, "neighbour").alias("predicted_class"), at(2, "neighbour").alias("runner_up_class"),
        at(1, "similarity").alias("score"), (at(1, "similarity") - at(2, "similarity")).alias("margin"),
    )
