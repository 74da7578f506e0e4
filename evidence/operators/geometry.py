"""Geometry of embedding tables: means, centroids, drift, directions, separability, PCA.

The vectors are read once and folded into one sum per group; everything that compares
groups works on that small table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from evidence.functions.vectors import cosine, dot, l2_normalize
from evidence.operators.retrieval import nearest
from evidence.operators.sampling import hash_sample
from evidence.operators.scale import BROADCAST_BYTES, small_matrix, stored


def group_means(df: DataFrame, by: list[str], vec: str = "v") -> DataFrame:
    """(by…, n, mean): mean vector per group with map-side partial sums."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)))).alias("mean")
    )


def centroids(df: DataFrame, by: list[str], vec: str = "v") -> DataFrame:
    """(by…, n, unit): the normalised mean."""
    return group_means(df, by, vec).select(*by, "n", l2_normalize(F.col("mean")).alias("unit"))


def prototypes(df: DataFrame, by: list[str], vec: str = "v") -> DataFrame:
    """(by…, n, unit): normalise each vector, average, normalise again."""
    return centroids(df.withColumn(vec, l2_normalize(F.col(vec))), by, vec)


def _pairs(held: Column, key: str) -> Column:
    """All unordered pairs of a short array of structs, smaller key first."""
    return F.flatten(
        F.transform(held, lambda a: F.transform(
            F.filter(held, lambda b: b[key] > a[key]), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )


def centroid_distances(units: DataFrame, by: list[str], cls: str) -> DataFrame:
    """The class × class matrix of cosine distances within each group, in long form."""
    held = units.groupBy(*by).agg(F.collect_list(F.struct(cls, "unit")).alias("_c"))
    return (
        held.select(*by, "_c", F.explode("_c").alias("a")).select(*by, "a", F.explode("_c").alias("b"))
        .select(*by, F.col(f"a.{cls}").alias("class_a"), F.col(f"b.{cls}").alias("class_b"),
                (1 - dot(F.col("a.unit"), F.col("b.unit"))).alias("distance"))
    )


def centroid_contrast(distances: DataFrame, by: list[str], factor_b) -> DataFrame:
    """Mean distance between the conditions of one identity, between identities, and the difference."""
    a, b = F.col("class_a"), F.col("class_b")
    same = factor_b(a) == factor_b(b)
    upper = distances.where(a < b)
    within, between = F.avg(F.when(same, F.col("distance"))), F.avg(F.when(~same, F.col("distance")))
    return upper.groupBy(*by).agg(
        within.alias("within_identity_mean"), between.alias("between_identity_mean"), (within - between).alias("within_minus_between")
    )


def centroid_drift(units: DataFrame, cls: str, source) -> DataFrame:
    """(domain, class, drift): cosine distance of each external centroid from the source centroid."""
    origin = units.where(F.col("domain") == source).select(cls, F.col("unit").alias("_origin"))
    return units.where(F.col("domain") != source).join(origin, cls).select(
        "domain", cls, (1 - dot(F.col("unit"), F.col("_origin"))).alias("drift")
    )


def directions(means: DataFrame, by: list[str], condition: Column, first: str, second: str) -> DataFrame:
    """(by…, direction): normalised mean(second condition) − mean(first condition)."""
    side = lambda c: F.max(F.when(condition == c, F.col("mean")))
    both = means.groupBy(*by).agg(side(first).alias("_f"), side(second).alias("_s")).where("_f IS NOT NULL AND _s IS NOT NULL")
    return both.select(*by, l2_normalize(F.zip_with("_s", "_f", lambda s, f: s - f)).alias("direction"))


def direction_alignment(dirs: DataFrame, fixed: str, compared: str, by: list[str] = []) -> DataFrame:
    """(fixed, a, b, cosine): cosines of the directions of each pair of ``compared`` values."""
    held = dirs.groupBy(*by, fixed).agg(F.array_sort(F.collect_list(F.struct(compared, "direction"))).alias("_d"))
    return held.select(*by, fixed, F.explode(_pairs(F.col("_d"), compared)).alias("p")).select(
        *by, fixed, F.col(f"p.a.{compared}").alias("a"), F.col(f"p.b.{compared}").alias("b"),
        cosine(F.col("p.a.direction"), F.col("p.b.direction")).alias("cosine"),
    )


def spread_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("minimum"), F.max(value).alias("maximum"))


# --- separability -----------------------------------------------------------------------


def silhouette_cosine(
    df: DataFrame, item: str, label: str, vec: str = "v", max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Mean cosine silhouette of unit vectors, one row (n, clusters, silhouette).

    Cosine distance is linear in unit vectors, so the mean distance of x to a cluster is
    1 − x·mean. One product of every row with the cluster means replaces the n × n distances;
    the nearest other cluster is the largest product. Means of checked small size go to every
    task, otherwise the two best means per row are searched block by block.

    Rows with a null label take no part. With one cluster there is no other to compare with: all rows are counted, and the
    silhouette is null. No rows: 0 items, 0 clusters and null.
    """
    rows = df.where(F.col(label).isNotNull()).select(item, label, vec)
    means = stored(group_means(rows.select(label, vec), [label], vec))
    if means.limit(2).count() < 2:
        counts = rows.agg(F.count(F.lit(1)).alias("items"))
        return counts.select(
            "items", means.agg(F.count(F.lit(1))).scalar().alias("clusters"), F.lit(None).cast("double").alias("silhouette")
        )
    small = small_matrix(means, label, "mean", ["n"], max_bytes)
    if small is not None:
        shared = df.sparkSession.sparkContext.broadcast(small)

        def products(batches):
            groups, matrix = shared.value
            place = {k: i for i, k in enumerate(groups[label])}
            sizes = groups["n"].to_numpy()
            for pdf in batches:
                if not len(pdf):
                    continue
                scores = np.vstack(pdf[vec].to_numpy()).astype(np.float64) @ matrix.T
                own = pdf[label].map(place).to_numpy()
                at = np.arange(len(pdf))
                mine = scores[at, own].copy()
                scores[at, own] = -np.inf
                yield pd.DataFrame({"own": mine, "other": scores.max(axis=1), "n": sizes[own]})

        placed = rows.mapInPandas(products, "own double, other double, n bigint")
    else:
        found = nearest(rows, means.withColumnRenamed("mean", vec), item, label, vec, 2, [label], max_bytes=max_bytes)
        others = found.where(F.col("neighbour") != F.col(label)).groupBy(item).agg(F.max("similarity").alias("other"))
        placed = rows.join(others, item).join(means, label).select(
            dot(F.col(vec), F.col("mean")).alias("own"), "other", "n"
        )
    # the mean of the own cluster without the point itself (x·x = 1)
    inner = F.when(F.col("n") > 1, 1 - (F.col("own") * F.col("n") - 1) / (F.col("n") - 1))
    outer = 1 - F.col("other")
    value = F.coalesce(F.try_divide(outer - inner, F.greatest(inner, outer)), F.lit(0.0))
    total = placed.agg(F.count(F.lit(1)).alias("items"), F.avg(value).alias("silhouette"))
    return total.select("items", means.agg(F.count(F.lit(1))).scalar().alias("clusters"), "silhouette")


def calinski_harabasz(df: DataFrame, label: str, vec: str = "v") -> DataFrame:
    """Between over within dispersion from per-group sums alone: one pass over the vectors."""
    v = F.col(vec)
    groups = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(array_to_vector(v))).alias("s"),
        F.sum(dot(v, v)).alias("q"),
    )
    per_group = groups.select("n", "q", "s", (dot(F.col("s"), F.col("s")) / F.col("n")).alias("c"))
    total = per_group.agg(
        F.sum("n").alias("items"), F.count(F.lit(1)).alias("clusters"), F.sum("q").alias("q"), F.sum("c").alias("c"),
        vector_to_array(Summarizer.sum(array_to_vector(F.col("s")))).alias("s"),
    )
    between = F.col("c") - dot(F.col("s"), F.col("s")) / F.col("items")
    within = F.col("q") - F.col("c")
    ratio = F.try_divide(between / (F.col("clusters") - 1), within / (F.col("items") - F.col("clusters")))
    return total.select("items", "clusters", ratio.alias("calinski_harabasz"))


# --- projection and zero-shot scores ----------------------------------------------------


def pca_ratio(df: DataFrame, strata: list[str], item: str, per_group: int, k: int = 2, seed: int = 42, vec: str = "v") -> DataFrame:
    """(component, ratio): explained variance of a class-balanced sample."""
    sample = hash_sample(df.select(*strata, item, vec), strata, item, per_group, seed)
    points = sample.select(array_to_vector(F.col(vec)).alias("x"))
    model = PCA(k=k, inputCol="x", outputCol="p").fit(points)
    ratios = [(i + 1, float(x)) for i, x in enumerate(model.explainedVariance)]
    return df.sparkSession.createDataFrame(ratios, "component int, ratio double")


def pca_project(df: DataFrame, k: int = 2, vec: str = "v", into: str = "projection") -> DataFrame:
    """Centre the vectors and project them on the first k components."""
    points = df.withColumn("_x", array_to_vector(F.col(vec)))
    model = PCA(k=k, inputCol="_x", outputCol="_p").fit(points)
    mean = points.agg(vector_to_array(Summarizer.mean(F.col("_x"))).alias("m")).first()["m"]
    shift = np.asarray(mean) @ model.pc.toArray()
    moved = F.transform(vector_to_array(F.col("_p")), lambda x, i: x - F.get(F.array(*[F.lit(float(s)) for s in shift]), i))
    return model.transform(points).withColumn(into, moved).drop("_x", "_p")


def zero_shot(items: DataFrame, protos: DataFrame, item: list[str], cls: str, vec: str = "v", **options) -> DataFrame:
    """Best and second class by cosine to the class prototypes, for unit vectors: the two nearest rows of
    a gallery that holds one vector per class."""
    key, carry = item[0], item[1:]
    return nearest(items, stored(protos).withColumnRenamed("unit", vec), key, cls, vec, 2, carry, **options)
