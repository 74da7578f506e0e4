"""Queries over embeddings: centroids, directions, separability, retrieval, bootstrap."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from evidence.functions.labels import factor_a, factor_b
from evidence.functions.signatures import signature_from_coefficients
from evidence.operators import bootstrap, geometry, metrics, ranking, retrieval, sampling, subspace
from evidence.operators.scale import stored
from evidence.plans.catalog import query, r, rounded, with_views
from evidence.plans.metric_queries import _PAIRED, _grid, _report, _summary, beacon_pair
from evidence.plans.views import CLASSES, PREDICTIONS, VECTOR_ROWS, VECTORS, predictions, vectors

_MEANS = """
, means AS (SELECT domain, class, dim, COUNT(*) AS n, AVG(x) AS m FROM dims GROUP BY domain, class, dim),
units AS (SELECT domain, class, dim, n, m / sqrt(SUM(m * m) OVER (PARTITION BY domain, class)) AS u FROM means)"""

DOMAIN_CLASS = ["domain", "class"]


def domain_centroids(spark, folder):
    return geometry.centroids(vectors(spark, folder), DOMAIN_CLASS)


def _long(df, vec, keys):
    return df.select(*keys, F.posexplode(vec).alias("p", "value")).select(
        *keys, (F.col("p") + 1).cast("bigint").alias("dim"), "value")


@query(with_views(VECTOR_ROWS, body=_MEANS + f"SELECT domain, class, n, CAST(dim AS BIGINT) AS dim, {r('u', 'value')} FROM units"))
def centroids(spark, folder):
    return rounded(_long(domain_centroids(spark, folder), "unit", [*DOMAIN_CLASS, "n"]))


@query(with_views(VECTOR_ROWS, body=f"""
, normed AS (SELECT vec_id, class, dim, x / sqrt(SUM(x * x) OVER (PARTITION BY vec_id)) AS x FROM dims),
means AS (SELECT class, dim, AVG(x) AS m FROM normed GROUP BY class, dim)
SELECT class, CAST(dim AS BIGINT) AS dim, {r('m / sqrt(SUM(m * m) OVER (PARTITION BY class))', 'value')} FROM means"""))
def prototypes(spark, folder):
    return rounded(_long(geometry.prototypes(vectors(spark, folder), ["class"]), "unit", ["class"]))


_DISTANCES = _MEANS + """
, distances AS (
  SELECT a.domain, a.class AS class_a, b.class AS class_b, 1 - SUM(a.u * b.u) AS distance
  FROM units a JOIN units b ON a.domain = b.domain AND a.dim = b.dim GROUP BY a.domain, a.class, b.class)"""


@query(with_views(VECTOR_ROWS, body=_DISTANCES + f"SELECT domain, class_a, class_b, {r('distance', 'distance')} FROM distances"))
def centroid_distance(spark, folder):
    return rounded(geometry.centroid_distances(domain_centroids(spark, folder), ["domain"], "class"))


@query(with_views(VECTOR_ROWS, body=_DISTANCES + f"""
, upper AS (SELECT *, split_part(class_a, '_', 2) = split_part(class_b, '_', 2) AS same FROM distances WHERE class_a < class_b)
SELECT domain, {r('AVG(distance) FILTER (same)', 'within_identity_mean')}, {r('AVG(distance) FILTER (NOT same)', 'between_identity_mean')},
       {r('AVG(distance) FILTER (same) - AVG(distance) FILTER (NOT same)', 'within_minus_between')} FROM upper GROUP BY domain"""))
def centroid_contrast(spark, folder):
    distances = geometry.centroid_distances(domain_centroids(spark, folder), ["domain"], "class")
    return rounded(geometry.centroid_contrast(distances, ["domain"], factor_b))


_DRIFT = _MEANS + """
, drift AS (
  SELECT b.domain, b.class, 1 - SUM(a.u * b.u) AS drift FROM units a JOIN units b
    ON a.class = b.class AND a.dim = b.dim AND a.domain = 0 AND b.domain <> 0 GROUP BY b.domain, b.class)"""


@query(with_views(VECTOR_ROWS, body=_DRIFT + f"SELECT domain, class, {r('drift', 'drift')} FROM drift"))
def centroid_drift(spark, folder):
    return rounded(geometry.centroid_drift(domain_centroids(spark, folder), "class", 0))


@query(with_views(VECTOR_ROWS, body=_DRIFT + f"""
SELECT domain, {r('AVG(drift)', 'mean')}, {r('MIN(drift)', 'minimum')}, {r('MAX(drift)', 'maximum')} FROM drift GROUP BY domain"""))
def drift_summary(spark, folder):
    drift = geometry.centroid_drift(domain_centroids(spark, folder), "class", 0)
    return rounded(geometry.spread_summary(drift, ["domain"], "drift"))


_DIRECTIONS = """
, means AS (SELECT domain, class, dim, AVG(x) AS m FROM dims GROUP BY domain, class, dim),
diffs AS (
  SELECT f.domain, split_part(f.class, '_', 2) AS identity, f.dim, s.m - f.m AS d FROM means f JOIN means s
    ON f.domain = s.domain AND f.dim = s.dim AND split_part(f.class, '_', 2) = split_part(s.class, '_', 2)
   AND f.class LIKE 'fresh%' AND s.class LIKE 'stale%'),
dirs AS (SELECT *, d / sqrt(SUM(d * d) OVER (PARTITION BY domain, identity)) AS u FROM diffs)"""


def domain_directions(spark, folder):
    means = geometry.group_means(vectors(spark, folder), DOMAIN_CLASS).withColumn("identity", factor_b(F.col("class")))
    return geometry.directions(means, ["domain", "identity"], factor_a(F.col("class")), "fresh", "stale")


@query(with_views(VECTOR_ROWS, body=_DIRECTIONS + f"""
SELECT a.identity, a.domain AS a, b.domain AS b, {r('SUM(a.u * b.u)', 'cosine')} FROM dirs a JOIN dirs b
  ON a.identity = b.identity AND a.dim = b.dim AND a.domain < b.domain GROUP BY a.identity, a.domain, b.domain"""))
def direction_alignment(spark, folder):
    return rounded(geometry.direction_alignment(domain_directions(spark, folder), "identity", "domain"))


@query(with_views(VECTOR_ROWS, body=_DIRECTIONS + f"""
, cosines AS (SELECT a.domain, a.identity AS ia, b.identity AS ib, SUM(a.u * b.u) AS c FROM dirs a JOIN dirs b
  ON a.domain = b.domain AND a.dim = b.dim AND a.identity < b.identity GROUP BY 1, 2, 3)
SELECT domain, {r('AVG(c)', 'mean')}, {r('MIN(c)', 'minimum')}, {r('MAX(c)', 'maximum')} FROM cosines GROUP BY domain"""))
def cross_identity_alignment(spark, folder):
    cosines = geometry.direction_alignment(domain_directions(spark, folder), "domain", "identity")
    return rounded(geometry.spread_summary(cosines, ["domain"], "cosine"))


@query(with_views(VECTORS, body=f"""
, distances AS (SELECT a.vec_id, a.class, b.class AS other, AVG(1 - list_inner_product(a.v, b.v)) AS d
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
sides AS (SELECT vec_id, MAX(CASE WHEN class = other THEN d END) AS inside, MIN(CASE WHEN class <> other THEN d END) AS outside
  FROM distances GROUP BY vec_id)
SELECT COUNT(*) AS items, (SELECT COUNT(DISTINCT class) FROM vectors) AS clusters,
       {r('AVG(COALESCE((outside - inside) / GREATEST(inside, outside), 0))', 'silhouette')} FROM sides"""))
def silhouette_cosine(spark, folder):
    return rounded(geometry.silhouette_cosine(vectors(spark, folder), "vec_id", "class"))


@query(with_views(VECTOR_ROWS, body=f"""
, means AS (SELECT class, dim, AVG(x) AS m, COUNT(*) AS n FROM dims GROUP BY class, dim),
overall AS (SELECT dim, AVG(x) AS g FROM dims GROUP BY dim),
between_sum AS (SELECT SUM(m.n * (m.m - o.g) * (m.m - o.g)) AS b FROM means m JOIN overall o ON m.dim = o.dim),
within_sum AS (SELECT SUM((d.x - m.m) * (d.x - m.m)) AS w FROM dims d JOIN means m ON d.class = m.class AND d.dim = m.dim),
sizes AS (SELECT COUNT(*) AS items, COUNT(DISTINCT class) AS clusters FROM vectors)
SELECT items, clusters, {r('(b / (clusters - 1)) / (w / (items - clusters))', 'calinski_harabasz')} FROM between_sum, within_sum, sizes"""))
def calinski_harabasz(spark, folder):
    return rounded(geometry.calinski_harabasz(vectors(spark, folder), "class"))


@query(with_views(VECTOR_ROWS, body=f"""
, normed AS (SELECT vec_id, class, dim, x / sqrt(SUM(x * x) OVER (PARTITION BY vec_id)) AS x FROM dims),
means AS (SELECT class, dim, AVG(x) AS m FROM normed GROUP BY class, dim),
protos AS (SELECT class, dim, m / sqrt(SUM(m * m) OVER (PARTITION BY class)) AS p FROM means),
scores AS (SELECT d.vec_id, d.class AS true_class, p.class, SUM(d.x * p.p) AS s FROM dims d JOIN protos p ON d.dim = p.dim GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 10) DESC, class) AS k FROM scores)
SELECT vec_id, true_class, MAX(CASE WHEN k = 1 THEN class END) AS predicted_class, MAX(CASE WHEN k = 2 THEN class END) AS runner_up_class,
       {r('MAX(CASE WHEN k = 1 THEN s END)', 'score')},
       {r('MAX(CASE WHEN k = 1 THEN s END) - MAX(CASE WHEN k = 2 THEN s END)', 'margin')} FROM ranked GROUP BY vec_id, true_class"""))
def zero_shot_top2(spark, folder):
    items = vectors(spark, folder).withColumnRenamed("class", "true_class")
    protos = geometry.prototypes(vectors(spark, folder), ["class"])
    found = geometry.zero_shot(items, protos, ["vec_id", "true_class"], "class")
    return rounded(retrieval.winner_and_runner_up(found, ["vec_id", "true_class"]))


# --- retrieval --------------------------------------------------------------------------

_FOUND = """
, scored AS (
  SELECT q.vec_id, q.domain, q.class, g.vec_id AS neighbour, g.class AS neighbour_class,
         list_inner_product(q.v, g.v) AS similarity FROM vectors q JOIN vectors g ON q.domain <> 0 AND g.domain = 0),
found AS (SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(similarity, 10) DESC, neighbour) AS INTEGER) AS rank FROM scored) WHERE rank <= 10)"""


def neighbours(spark, folder):
    v = vectors(spark, folder)
    return retrieval.nearest(v.where("domain <> 0"), v.where("domain = 0"), "vec_id", "vec_id", "v", 10, ["domain", "class"], ["class"])


@query(with_views(VECTORS, body=_FOUND + f"SELECT vec_id, rank, neighbour, neighbour_class, {r('similarity', 'similarity', 8)} FROM found"))
def knn_topk(spark, folder):
    return rounded(neighbours(spark, folder).select("vec_id", "rank", "neighbour", "neighbour_class", "similarity"), 8)


@query(with_views(VECTORS, body=_FOUND + """
SELECT vec_id, string_agg(neighbour, '|' ORDER BY rank) AS identifiers, string_agg(neighbour_class, '|' ORDER BY rank) AS classes,
       string_agg(printf('%.8f', similarity), '|' ORDER BY rank) AS similarities FROM found GROUP BY vec_id"""))
def knn_packed(spark, folder):
    return retrieval.packed_neighbours(neighbours(spark, folder), ["vec_id"], "neighbour_class")


_MATCHES = """
, marks AS (
  SELECT domain, vec_id, rank, unnest(['class', 'condition', 'identity']) AS factor,
         unnest([CAST(class = neighbour_class AS INTEGER), CAST(split_part(class, '_', 1) = split_part(neighbour_class, '_', 1) AS INTEGER),
                 CAST(split_part(class, '_', 2) = split_part(neighbour_class, '_', 2) AS INTEGER)]) AS hit FROM found),
ks(k) AS (VALUES (1), (5), (10)),
per_query AS (SELECT domain, vec_id, factor, k, AVG(hit) AS c, MAX(hit) AS h FROM marks JOIN ks ON rank <= k GROUP BY 1, 2, 3, 4),
quality AS (SELECT domain, factor, CAST(k AS INTEGER) AS k, AVG(c) AS consistency, AVG(h) AS hit FROM per_query GROUP BY 1, 2, 3)"""


def retrieval_quality(spark, folder):
    mine, theirs = F.col("class"), F.col("neighbour_class")
    return retrieval.consistency(neighbours(spark, folder), ["domain"], "vec_id", {
        "class": mine == theirs, "condition": factor_a(mine) == factor_a(theirs), "identity": factor_b(mine) == factor_b(theirs)}, [1, 5, 10])


@query(with_views(VECTORS, body=_FOUND + _MATCHES + f"SELECT domain, factor, k, {r('consistency', 'consistency')}, {r('hit', 'hit')} FROM quality"))
def retrieval_consistency(spark, folder):
    return rounded(retrieval_quality(spark, folder))


def _probe_errors(spark, folder):
    """Error rate of the nearest-prototype classifier per external domain and class."""
    items = vectors(spark, folder).withColumnRenamed("class", "true_class")
    protos = geometry.prototypes(vectors(spark, folder), ["class"])
    found = geometry.zero_shot(items, protos, ["vec_id", "true_class", "domain"], "class").where("rank = 1 AND domain <> 0")
    return found.groupBy("domain", F.col("true_class").alias("class")).agg(
        F.avg((F.col("neighbour") != F.col("true_class")).cast("double")).alias("error_rate"))


_CELLS = _FOUND + _MATCHES + """
, dims AS (SELECT vec_id, domain, class, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM vectors),
means AS (SELECT domain, class, dim, AVG(x) AS m FROM dims GROUP BY domain, class, dim),
units AS (SELECT domain, class, dim, m / sqrt(SUM(m * m) OVER (PARTITION BY domain, class)) AS u FROM means),
drift AS (SELECT b.domain, b.class, 1 - SUM(a.u * b.u) AS drift FROM units a JOIN units b
    ON a.class = b.class AND a.dim = b.dim AND a.domain = 0 AND b.domain <> 0 GROUP BY b.domain, b.class),
diffs AS (SELECT f.domain, split_part(f.class, '_', 2) AS identity, f.dim, s.m - f.m AS d FROM means f JOIN means s
    ON f.domain = s.domain AND f.dim = s.dim AND split_part(f.class, '_', 2) = split_part(s.class, '_', 2)
   AND f.class LIKE 'fresh%' AND s.class LIKE 'stale%'),
dirs AS (SELECT *, d / sqrt(SUM(d * d) OVER (PARTITION BY domain, identity)) AS u FROM diffs),
alignment AS (SELECT a.identity, b.domain, SUM(a.u * b.u) AS alignment FROM dirs a JOIN dirs b
    ON a.identity = b.identity AND a.dim = b.dim AND a.domain = 0 AND b.domain <> 0 GROUP BY 1, 2),
normed AS (SELECT vec_id, class, dim, x / sqrt(SUM(x * x) OVER (PARTITION BY vec_id)) AS x FROM dims),
pmeans AS (SELECT class, dim, AVG(x) AS m FROM normed GROUP BY class, dim),
protos AS (SELECT class, dim, m / sqrt(SUM(m * m) OVER (PARTITION BY class)) AS p FROM pmeans),
scores AS (SELECT d.vec_id, d.domain, d.class AS true_class, p.class, round(SUM(d.x * p.p), 10) AS s FROM dims d JOIN protos p ON d.dim = p.dim
           WHERE d.domain <> 0 GROUP BY 1, 2, 3, 4),
winners AS (SELECT domain, true_class, arg_max(class, s) AS predicted FROM scores GROUP BY vec_id, domain, true_class),
errors AS (SELECT domain, true_class AS class, AVG(CASE WHEN predicted <> true_class THEN 1.0::DOUBLE ELSE 0 END) AS error_rate FROM winners GROUP BY 1, 2),
cells AS (
  SELECT e.domain, e.class, e.error_rate, d.drift, a.alignment, q.consistency FROM errors e
  JOIN drift d ON e.domain = d.domain AND e.class = d.class
  JOIN alignment a ON a.domain = e.domain AND a.identity = split_part(e.class, '_', 2)
  JOIN quality q ON q.domain = e.domain AND q.factor = 'class' AND q.k = 10)"""


def failure_cells(spark, folder):
    """Error rate, drift, direction alignment and retrieval consistency per external domain and class."""
    drift = geometry.centroid_drift(domain_centroids(spark, folder), "class", 0)
    alignment = geometry.direction_alignment(domain_directions(spark, folder), "identity", "domain").where("a = 0").select(
        "identity", F.col("b").alias("domain"), F.col("cosine").alias("alignment"))
    quality = retrieval_quality(spark, folder).where("factor = 'class' AND k = 10").select("domain", "consistency")
    cells = _probe_errors(spark, folder).join(drift, ["domain", "class"]).withColumn("identity", factor_b(F.col("class")))
    return cells.join(alignment, ["domain", "identity"]).join(quality, "domain").drop("identity")


@query(with_views(VECTORS, body=_CELLS + f"""
SELECT domain, class, {r('error_rate', 'error_rate')}, {r('drift', 'drift')}, {r('alignment', 'alignment')}, {r('consistency', 'consistency')} FROM cells"""))
def failure_associations(spark, folder):
    return rounded(failure_cells(spark, folder))


@query(with_views(VECTORS, body=_CELLS + f"""
, paired AS (
  SELECT unnest(['drift', 'alignment', 'consistency']) AS metric, round(error_rate, 6) AS x,
         unnest([round(drift, 6), round(alignment, 6), round(consistency, 6)]) AS y FROM cells),
ranks AS (
  SELECT metric, rank() OVER (PARTITION BY metric ORDER BY x) + (COUNT(*) OVER (PARTITION BY metric, x) - 1) / 2.0::DOUBLE AS rx,
         rank() OVER (PARTITION BY metric ORDER BY y) + (COUNT(*) OVER (PARTITION BY metric, y) - 1) / 2.0::DOUBLE AS ry FROM paired)
SELECT metric, COUNT(*) AS n, {r('corr(rx, ry)', 'spearman_rho')} FROM ranks GROUP BY metric"""))
def failure_correlations(spark, folder):
    """Rank correlation of the error rate with drift, alignment and retrieval over the cells."""
    cells = rounded(failure_cells(spark, folder))
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("y")) for m in ("drift", "alignment", "consistency")])
    paired = cells.select(F.col("error_rate").alias("x"), F.explode(entries).alias("e")).select("x", "e.*")
    return rounded(ranking.spearman(paired, ["metric"]))


@query(with_views(VECTORS, body="""
, tails AS (SELECT vec_id, v[2:64] AS t, list_median(v[2:64]) AS m FROM vectors)
SELECT vec_id, CAST(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN t[i] > m THEN 1::BIGINT << (63 - i) ELSE 0 END)) AS BIGINT) AS h FROM tails"""))
def embedding_signatures(spark, folder):
    """The 63-bit signature of every vector, taken like that of an image from its low frequencies."""
    return vectors(spark, folder).select("vec_id", signature_from_coefficients(F.col("v")).alias("h"))


@query(with_views(VECTORS, body=f"""
, chosen AS (SELECT vec_id, class, v, row_number() OVER (PARTITION BY class ORDER BY sha256('42|' || class || '|' || vec_id), vec_id) AS k FROM vectors)
SELECT class, COUNT(*) AS n, {r('SUM(list_sum(v))', 'checksum')} FROM chosen WHERE k <= 10 GROUP BY class"""))
def subset_vectors(spark, folder):
    """The rows of the ten-per-class budget with their vectors."""
    v = vectors(spark, folder)
    chosen = sampling.nested_budgets(v.select("class", "vec_id"), "class", "vec_id", [1, 5, 10, 20], 42)
    held = sampling.subset_rows(chosen, v.select("vec_id", "v"), "vec_id", 10)
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return rounded(held.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("checksum")))


# --- bootstrap --------------------------------------------------------------------------

REPLICATES = 20


def _draw_sql(replicates: int) -> str:
    return f"""
, sizes AS (SELECT true_class, COUNT(DISTINCT item_id) AS n FROM predictions GROUP BY true_class),
numbered AS (SELECT true_class, item_id, row_number() OVER (PARTITION BY true_class
    ORDER BY sha256('42|' || true_class || '|' || item_id), item_id) - 1 AS j FROM (SELECT DISTINCT true_class, item_id FROM predictions)),
draws AS (
  SELECT m.true_class, b.replicate, ('0x' || substr(sha256('42|' || b.replicate || '|' || m.true_class || '|' || m.j), 1, 8))::BIGINT % s.n AS j
  FROM numbered m JOIN sizes s ON m.true_class = s.true_class CROSS JOIN range({replicates}) b(replicate)),
times AS (SELECT d.true_class, n.item_id, d.replicate, COUNT(*) AS times FROM draws d JOIN numbered n
          ON d.true_class = n.true_class AND d.j = n.j GROUP BY 1, 2, 3)"""


def _interval_sql(value: str) -> str:
    return f"{r(f'MAX(seen_{value})', f'{value}_observed')}, {r(f'AVG({value})', f'{value}_mean')}, {r(f'quantile_cont({value}, 0.025)', f'{value}_lower')}, {r(f'quantile_cont({value}, 0.975)', f'{value}_upper')}"


def _apart(sql: str) -> str:
    """The same views under other names, for the values observed without resampling."""
    return re.sub(r"\b(names|counted|groups|grid|per_class|report|summary)\b", r"\1_seen", sql)


def _draws(spark, folder):
    items = predictions(spark, folder).where("system = 'anchor_probe'")  # every item once: all systems share the items
    return bootstrap.hash_draws(items, "true_class", "item_id", REPLICATES, 42)


_DRAWN = _draw_sql(REPLICATES) + """
, drawn AS (SELECT p.system, t.replicate, p.true_class, p.predicted_class, t.times FROM times t JOIN predictions p ON p.item_id = t.item_id)"""


@query(with_views(PREDICTIONS, body=_DRAWN + ", " + _grid("drawn", "system, replicate").replace(
    "COUNT(*) AS n", "CAST(SUM(times) AS BIGINT) AS n") + ", " + _report("system, replicate") + ", " + _summary("system, replicate")
    + ", " + _apart(_grid("predictions", "system") + ", " + _report("system") + ", " + _summary("system")) + f"""
SELECT s.system, {_interval_sql('accuracy')}, {_interval_sql('macro_f1')}
FROM summary s JOIN (SELECT system, accuracy AS seen_accuracy, macro_f1 AS seen_macro_f1 FROM summary_seen) o ON s.system = o.system
GROUP BY s.system"""))
def bootstrap_hash(spark, folder):
    by = ["system", "replicate"]
    drawn = predictions(spark, folder).join(_draws(spark, folder), ["true_class", "item_id"])
    counted = drawn.groupBy(*by, "true_class", "predicted_class").agg(F.sum("times").alias("n"))
    summary = metrics.summary_report(metrics.class_report(metrics.full_grid(counted, by, CLASSES), by), by)
    seen = metrics.evaluate(predictions(spark, folder), ["system"], CLASSES).withColumn("replicate", F.lit(None).cast("int"))
    return rounded(bootstrap.intervals(summary.unionByName(seen), ["system"], ["accuracy", "macro_f1"]))


@query(with_views(PREDICTIONS, body=_PAIRED + _draw_sql(REPLICATES) + f"""
, deltas AS (SELECT t.replicate, SUM(t.times * (CAST(p.lc = p.true_class AS INTEGER) - CAST(p.rc = p.true_class AS INTEGER)))::DOUBLE / SUM(t.times) AS difference
  FROM times t JOIN paired p ON p.item_id = t.item_id GROUP BY t.replicate)
SELECT {_interval_sql('difference')}
FROM deltas, (SELECT AVG(CAST(lc = true_class AS INTEGER) - CAST(rc = true_class AS INTEGER)) AS seen_difference FROM paired)"""))
def paired_bootstrap_hash(spark, folder):
    drawn = beacon_pair(spark, folder).join(_draws(spark, folder), ["true_class", "item_id"])
    gain = (F.col("left_class") == F.col("true_class")).cast("int") - (F.col("right_class") == F.col("true_class")).cast("int")
    deltas = drawn.groupBy("replicate").agg((F.sum(F.col("times") * gain) / F.sum("times")).alias("difference"))
    seen = beacon_pair(spark, folder).select(F.lit(None).cast("int").alias("replicate"), gain.alias("difference"))
    seen = seen.groupBy("replicate").agg(F.avg("difference").alias("difference"))
    return rounded(bootstrap.intervals(deltas.unionByName(seen), [], ["difference"]))


@query()
def bootstrap_multinomial(spark, folder):
    replicates = bootstrap.bootstrap_replicates(predictions(spark, folder), ["system"], CLASSES, 5000, 42)
    return rounded(bootstrap.intervals(replicates, ["system"], ["accuracy", "macro_f1"]))


@query()
def paired_bootstrap_multinomial(spark, folder):
    replicates = bootstrap.paired_replicates(beacon_pair(spark, folder), ["domain"], 5000, 42)
    return rounded(bootstrap.intervals(replicates, ["domain"], ["difference"]))


@query()
def bootstrap_directions(spark, folder):
    v = vectors(spark, folder).withColumn("condition", factor_a(F.col("class"))).withColumn("identity", factor_b(F.col("class")))
    means = bootstrap.direction_replicates(v, ["domain", "identity", "condition"], "vec_id", "v", 64, 2000, 42)
    return rounded(bootstrap.direction_intervals(means, "domain", "identity", "condition", "fresh", "stale"))


_DIRECTION_DRAWS = f"""
, items AS (SELECT DISTINCT vec_id, domain || '_' || split_part(class, '_', 2) || '_' || split_part(class, '_', 1) AS g FROM dims),
sizes AS (SELECT g, COUNT(*) AS n FROM items GROUP BY g),
numbered AS (SELECT g, vec_id, row_number() OVER (PARTITION BY g ORDER BY sha256('42|' || g || '|' || vec_id), vec_id) - 1 AS j FROM items),
draws AS (
  SELECT m.g, b.replicate, ('0x' || substr(sha256('42|' || b.replicate || '|' || m.g || '|' || m.j), 1, 8))::BIGINT % s.n AS j
  FROM numbered m JOIN sizes s ON m.g = s.g CROSS JOIN range({REPLICATES}) b(replicate)),
times AS (SELECT n.vec_id, d.replicate, COUNT(*) AS times FROM draws d JOIN numbered n ON d.g = n.g AND d.j = n.j GROUP BY 1, 2),
drawn AS (SELECT t.replicate, d.domain, split_part(d.class, '_', 2) AS identity, split_part(d.class, '_', 1) AS condition, d.dim,
    SUM(t.times * d.x) / SUM(t.times) AS m FROM dims d JOIN times t ON d.vec_id = t.vec_id GROUP BY ALL),
dirs AS (SELECT replicate, domain, identity, dim, SUM(CASE condition WHEN 'stale' THEN m ELSE -m END) AS d FROM drawn GROUP BY ALL),
unit AS (SELECT *, d / sqrt(SUM(d * d) OVER (PARTITION BY replicate, domain, identity)) AS u FROM dirs),
cosines AS (SELECT a.replicate, a.identity, a.domain AS a, b.domain AS b, SUM(a.u * b.u) AS cosine FROM unit a JOIN unit b
    ON a.replicate = b.replicate AND a.identity = b.identity AND a.dim = b.dim AND a.domain < b.domain GROUP BY ALL)"""


@query(with_views(VECTOR_ROWS, body=_DIRECTION_DRAWS + f"""
SELECT identity, a, b, {r('AVG(cosine)', 'cosine_mean')}, {r('quantile_cont(cosine, 0.025)', 'cosine_lower')},
       {r('quantile_cont(cosine, 0.975)', 'cosine_upper')} FROM cosines GROUP BY identity, a, b"""))
def bootstrap_directions_hash(spark, folder):
    v = vectors(spark, folder).withColumn("condition", factor_a(F.col("class"))).withColumn("identity", factor_b(F.col("class")))
    means = bootstrap.hash_direction_replicates(v, ["domain", "identity", "condition"], "vec_id", "v", REPLICATES, 42)
    found = bootstrap.direction_intervals(means, "domain", "identity", "condition", "fresh", "stale")
    return rounded(found.select("identity", "a", "b", "cosine_mean", "cosine_lower", "cosine_upper"))


@query()
def pca_ratio(spark, folder):
    return rounded(geometry.pca_ratio(vectors(spark, folder), ["class"], "vec_id", 200))


@query()
def pca_external(spark, folder):
    """Axes of a balanced sample of the source domain, and all rows of all domains on them."""
    rows = vectors(spark, folder)
    source = stored(sampling.hash_sample(rows.where("domain = 0").select("class", "vec_id", "v"), ["class"], "vec_id", 200, 42))
    axes = subspace.principal_axes(source, 2)
    p = subspace.on_axes(axes, "v")
    return rounded(rows.select("vec_id", "domain", "class", p.alias("p")).select(
        "vec_id", "domain", "class", F.col("p")[0].alias("first"), F.col("p")[1].alias("second")
    ))
