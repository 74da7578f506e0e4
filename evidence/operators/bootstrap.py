"""Class-stratified bootstrap intervals from confusion cells, and replayable hash draws.

Resampling the n rows of a class with replacement and counting outcomes is a multinomial
draw over the cells of that class, so after one counting pass the work depends only on
replicates and cells, not on rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from evidence.functions.hashing import hash_number, stable_key
from evidence.functions.vectors import l2_normalize
from evidence.operators.geometry import direction_alignment
from evidence.operators.metrics import OTHER, cells, fold_cells
from evidence.operators.scale import hash_rank

#: Replicates drawn by one task.
CHUNK = 500


def draw_seed(*parts) -> int:
    """The first eight hex digits of sha256(``a|b|…``) as a seed."""
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def _rates(counts: np.ndarray, listed: int) -> tuple[np.ndarray, np.ndarray]:
    """Accuracy over all cells, and macro F1 over the first ``listed`` classes, of confusion matrices (replicate, true, predicted)."""
    hits = np.diagonal(counts, axis1=1, axis2=2).astype(float)
    total = counts.sum(axis=(1, 2))
    denominator = counts.sum(axis=1) + counts.sum(axis=2)
    f1 = np.divide(2 * hits, denominator, out=np.zeros_like(hits), where=denominator > 0)
    accuracy = np.divide(hits.sum(axis=1), total, out=np.zeros(len(counts)), where=total > 0)
    return accuracy, f1[:, :listed].mean(axis=1)


def _chunks(packed: DataFrame, replicates: int) -> DataFrame:
    return packed.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // CHUNK))))


def bootstrap_replicates(predictions: DataFrame, by: list[str], classes: list[str], replicates: int, seed: int) -> DataFrame:
    """(by…, replicate, accuracy, macro_f1) for every system, and one row of the observed values with a null replicate.

    Classes off the list, and nulls, are drawn with the rest: they count for the accuracy, not for the macro average.
    """
    packed = fold_cells(cells(predictions, by), by, classes).groupBy(*by).agg(
        F.collect_list(F.struct("true_class", "predicted_class", "n")).alias("_cells")
    )
    # rows and columns for classes off the list; a null prediction is never right
    index: dict[str | None, int] = {c: i for i, c in enumerate([*classes, OTHER, None])}

    def draw(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                counts = np.zeros((len(index), len(index)), dtype=np.int64)
                for cell in row["_cells"]:
                    counts[index[cell["true_class"]], index[cell["predicted_class"]]] = cell["n"]
                first = row["_chunk"] * CHUNK
                size = min(CHUNK, replicates - first)
                rng = np.random.default_rng(draw_seed(seed, *[row[b] for b in by], row["_chunk"]))
                drawn = np.zeros((size, *counts.shape), dtype=np.int64)
                for c, line in enumerate(counts):
                    if line.sum():
                        drawn[:, c] = rng.multinomial(line.sum(), line / line.sum(), size=size)
                accuracy, f1 = _rates(drawn, len(classes))
                keys = {b: row[b] for b in by}
                yield pd.DataFrame({**keys, "replicate": np.arange(first, first + size), "accuracy": accuracy, "macro_f1": f1})
                if first == 0:
                    accuracy, f1 = _rates(counts[None], len(classes))
                    yield pd.DataFrame({**keys, "replicate": pd.array([None], "Int64"), "accuracy": accuracy, "macro_f1": f1})

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema.fields if f.name in by)
    schema = f"{kept}, replicate bigint, accuracy double, macro_f1 double"
    return _chunks(packed, replicates).repartition(*by, "_chunk").mapInPandas(draw, schema)


def intervals(replicates: DataFrame, by: list[str], values: list[str], level: float = 0.95) -> DataFrame:
    """Observed value, mean and percentile interval; groups hold one row per replicate, and one without for the observed value."""
    lo, hi = (1 - level) / 2, (1 + level) / 2
    out = []
    for v in values:
        drawn, seen = F.when(F.col("replicate").isNotNull(), F.col(v)), F.when(F.col("replicate").isNull(), F.col(v))
        out += [
            F.max(seen).alias(f"{v}_observed"), F.avg(drawn).alias(f"{v}_mean"),
            F.percentile(drawn, lo).alias(f"{v}_lower"), F.percentile(drawn, hi).alias(f"{v}_upper"),
        ]
    return replicates.groupBy(*by).agg(*out)


def paired_replicates(paired: DataFrame, by: list[str], replicates: int, seed: int) -> DataFrame:
    """(by…, replicate, difference): left minus right accuracy under the same draws; the observed difference has a null replicate.

    ``paired`` has one row per item with true_class, left_class and right_class. Only whether each
    side is right matters, so a class has four joint cells.
    """
    left = F.coalesce((F.col("left_class") == F.col("true_class")).cast("int"), F.lit(0)).alias("l")
    right = F.coalesce((F.col("right_class") == F.col("true_class")).cast("int"), F.lit(0)).alias("r")
    counted = paired.select(*by, "true_class", left, right).groupBy(*by, "true_class", "l", "r").agg(F.count(F.lit(1)).alias("n"))
    packed = counted.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("true_class", "l", "r", "n"))).alias("_cells"))

    def draw(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                first = row["_chunk"] * CHUNK
                size = min(CHUNK, replicates - first)
                rng = np.random.default_rng(draw_seed(seed, *[row[b] for b in by], row["_chunk"]))
                held = pd.DataFrame([dict(c) if isinstance(c, dict) else c.asDict() for c in row["_cells"]])
                difference = np.zeros(size)
                for _, part in held.groupby("true_class", sort=True, dropna=False):
                    n = part["n"].to_numpy()
                    difference += rng.multinomial(n.sum(), n / n.sum(), size=size) @ (part["l"] - part["r"]).to_numpy()
                keys, total = {b: row[b] for b in by}, held["n"].sum()
                yield pd.DataFrame({**keys, "replicate": np.arange(first, first + size), "difference": difference / total})
                if first == 0:
                    seen = (held["n"] * (held["l"] - held["r"])).sum() / total
                    yield pd.DataFrame({**keys, "replicate": pd.array([None], "Int64"), "difference": [seen]})

    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in packed.schema.fields if f.name in by)
    return _chunks(packed, replicates).repartition("_chunk").mapInPandas(draw, f"{kept}replicate bigint, difference double")


# --- draws any engine can replay --------------------------------------------------------


def hash_draws(items: DataFrame, cls: str, item: str, replicates: int, seed: int) -> DataFrame:
    """(class, item, replicate, times): how often each item is drawn.

    The items of a class are numbered in hash order. Draw j of replicate b takes number
    int(sha256(``seed|b|class|j``)[:8], 16) mod n. Each item makes the draws of its own number, so
    the draws are spread like the items.
    """
    ranked = hash_rank(items.select(cls, item), [cls], stable_key(seed, F.col(cls), F.col(item)), item, total="_n")
    numbered = ranked.select(cls, item, (F.col("rank") - 1).alias("_j"), "_n")
    draws = numbered.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).select(
        cls, "replicate",
        (hash_number(stable_key(seed, F.col("replicate"), F.col(cls), F.col("_j"))) % F.col("_n")).alias("_j"),
    )
    times = draws.groupBy(cls, "_j", "replicate").agg(F.count(F.lit(1)).alias("times"))
    return times.join(numbered.select(cls, item, "_j"), [cls, "_j"]).select(cls, item, "replicate", "times")


# --- bootstrap of centroid directions ---------------------------------------------------


def block_totals(counts: np.ndarray, block: int, replicates: int, seed: int, names: list) -> np.ndarray:
    """How many of the draws of each replicate fall into one block of 2^depth blocks.

    ``counts`` holds the rows of the blocks that share the first 0, 1, … depth bits with this one. A node of the tree splits its
    draws by one binomial, seeded by the node, so all blocks below it derive the same split: the totals of all blocks
    are a multinomial, and a block draws one number a level.
    """
    depth = len(counts) - 1
    totals = np.full(replicates, counts[0], np.int64)
    for level in range(depth):
        prefix, right = block >> (depth - level), (block >> (depth - level - 1)) & 1
        left = counts[level] - counts[level + 1] if right else counts[level + 1]
        taken = np.random.default_rng(draw_seed(seed, *names, level, prefix)).binomial(totals, left / counts[level])
        totals = totals - taken if right else taken
    return totals


def direction_replicates(
    vectors: DataFrame, keys: list[str], item: str, vec: str, dimension: int, replicates: int, seed: int, block_rows: int = 4096
) -> DataFrame:
    """(keys…, replicate, mean): bootstrap means of every group, whatever its size.

    The rows of a group are hashed into 2^d blocks of about ``block_rows`` rows. A multinomial over all rows splits down a binary
    tree of binomials to a total per block, and inside each block into draws; the block sums are added. A task needs the d + 1
    counts on the way to its block, not those of the other blocks.
    """
    sizes = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / F.lit(float(block_rows))))).cast("int")
    rows = vectors.select(*keys, item, vec).join(sizes.select(*keys, depth.alias("_d")), keys).withColumn(
        "_block", F.pmod(F.xxhash64(item), F.expr("shiftleft(1L, _d)"))
    )
    held = rows.groupBy(*keys, "_d", "_block").agg(F.count(F.lit(1)).alias("_m"))
    paths = held.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_d")))).withColumn("_node", F.expr("shiftright(_block, _d - _level)"))
    node = [*keys, "_level", "_node"]
    counts = paths.groupBy(*node).agg(F.sum("_m").alias("_rows"))
    plan = paths.join(counts, node).groupBy(*[F.col(k).alias(f"_p_{k}") for k in keys], F.col("_block").alias("_p_block")).agg(
        F.array_sort(F.collect_list(F.struct("_level", "_rows"))).alias("_counts")
    )

    def draw(pdf: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item)
        x = np.vstack(pdf[vec].to_numpy()).astype(np.float64)
        path = np.array([c["_rows"] for c in info["_counts"].iloc[0]], np.int64)
        block, names = int(info["_p_block"].iloc[0]), [pdf[k].iloc[0] for k in keys]
        totals = block_totals(path, block, replicates, seed, names)
        rng = np.random.default_rng(draw_seed(seed, *names, "rows", block))
        parts = [rng.multinomial(totals[i : i + CHUNK], np.full(len(x), 1 / len(x))) @ x for i in range(0, replicates, CHUNK)]
        sums = np.vstack(parts) / path[0]
        return pd.DataFrame({**dict(zip(keys, names)), "replicate": np.arange(replicates), "part": list(sums)})

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.select(*keys).schema.fields)
    parts = rows.groupBy(*keys, "_block").cogroup(plan.groupBy(*[f"_p_{k}" for k in keys], "_p_block")).applyInPandas(
        draw, f"{kept}, replicate bigint, part array<double>"
    )
    # every later grouping has the replicate among its keys, so this is the last shuffle of the vectors
    parts = parts.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "replicate")
    return parts.groupBy(*keys, "replicate").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("part")))).alias("mean"))


def hash_direction_replicates(vectors: DataFrame, keys: list[str], item: str, vec: str, replicates: int, seed: int) -> DataFrame:
    """(keys…, replicate, mean) from draws that any engine can replay; the group is named by its keys joined by ``_``."""
    named = vectors.withColumn("_group", F.concat_ws("_", *keys))
    times = hash_draws(named, "_group", item, replicates, seed)
    drawn = named.select(*keys, "_group", item, vec).join(times, ["_group", item])
    weighted = Summarizer.mean(array_to_vector(F.transform(vec, lambda x: x.cast("double"))), F.col("times").cast("double"))
    return drawn.groupBy(*keys, "replicate").agg(vector_to_array(weighted).alias("mean"))


def direction_intervals(means: DataFrame, domain: str, identity: str, condition: str, first: str, second: str) -> DataFrame:
    """Bootstrap mean and 95 % interval of the cosine between the directions of two domains."""
    side = lambda c: F.max(F.when(F.col(condition) == c, F.col("mean")))
    dirs = means.groupBy(domain, identity, "replicate").agg(side(first).alias("_f"), side(second).alias("_s")).select(
        domain, identity, "replicate", l2_normalize(F.zip_with("_s", "_f", lambda s, f: s - f)).alias("direction")
    )
    cosines = direction_alignment(dirs, identity, domain, ["replicate"])
    return intervals(cosines, [identity, "a", "b"], ["cosine"])
