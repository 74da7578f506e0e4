"""Queries over attribution tables, probes and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence.functions.grids import grid_regions
from evidence.functions.labels import factor_a, factor_b
from evidence.operators import attribution, metrics, probes
from evidence.operators.scale import stored
from evidence.plans.catalog import query, r, rounded, table, with_views
from evidence.plans.metric_queries import _grid, _report
from evidence.plans.views import CLASSES, PREDICTIONS, VECTOR_CLASSES, predictions, vectors
from evidence.session import work_folder
from evidence.streaming import ledger, windows

# --- attribution ------------------------------------------------------------------------


def regions(spark, folder):
    """Region importances: each (event type, user) is an image on a 7 × 7 grid."""
    return table(spark, folder, "events").groupBy(
        F.col("event_type").alias("system"), (F.col("user_id") % 3).cast("int").alias("domain"), F.col("user_id").alias("identifier"),
        (F.col("event_id") % 49).cast("int").alias("index"),
    ).agg(F.round(F.avg("value") - 20, 6).alias("importance")).select(
        "system", "domain", "identifier", "index", F.floor(F.col("index") / 7).cast("int").alias("row"),
        (F.col("index") % 7).cast("int").alias("column"), "importance",
        F.concat(F.lit("k"), (F.col("identifier") % 4).cast("string")).alias("class"), (F.col("identifier") % 2 == 0).alias("correct"))


REGIONS = """regions AS (
  SELECT event_type AS system, CAST(user_id % 3 AS INTEGER) AS domain, user_id AS identifier, CAST(event_id % 49 AS INTEGER) AS idx,
         round(AVG(value) - 20, 6) AS importance FROM events GROUP BY ALL),
placed AS (SELECT *, idx // 7 AS y, idx % 7 AS x, GREATEST(importance, 0) AS positive,
  'k' || (identifier % 4) AS class, identifier % 2 = 0 AS correct FROM regions)"""


def curve(spark, folder):
    """Margins at eleven fractions for both removal orders of every image."""
    rows = table(spark, folder, "events").select(
        F.col("event_type").alias("system"), (F.col("user_id") % 3).cast("int").alias("domain"), F.col("user_id").alias("identifier"),
        F.when(F.col("event_id") % 2 == 0, "top").otherwise("random").alias("kind"),
        (F.floor(F.col("event_id") / 2) % 11).alias("step"), "value")
    points = rows.groupBy("system", "domain", "identifier", "kind", "step").agg(F.avg("value").alias("margin"))
    base = rows.groupBy("system", "domain", "identifier").agg((F.avg("value") - 20).alias("base_margin"))
    return points.join(base, attribution.IMAGE).withColumn("fraction", F.col("step") / 10.0)


CURVE = """curve AS (
  SELECT event_type AS system, CAST(user_id % 3 AS INTEGER) AS domain, user_id AS identifier,
         CASE WHEN event_id % 2 = 0 THEN 'top' ELSE 'random' END AS kind, ((event_id // 2) % 11) / 10.0::DOUBLE AS fraction,
         AVG(value) AS margin FROM events GROUP BY ALL),
base AS (SELECT event_type AS system, user_id AS identifier, AVG(value) - 20 AS base_margin FROM events GROUP BY ALL),
relative AS (SELECT c.*, margin / GREATEST(abs(base_margin), 1e-8) AS rel FROM curve c JOIN base b ON c.system = b.system AND c.identifier = b.identifier),
steps AS (SELECT *, lag(fraction) OVER w AS f0, lag(rel) OVER w AS r0 FROM relative WINDOW w AS (PARTITION BY system, domain, identifier, kind ORDER BY fraction)),
areas AS (
  SELECT system, domain, identifier, COALESCE(SUM((fraction - f0) * (rel + r0) / 2) FILTER (kind = 'top'), 0) AS top_auc,
         COALESCE(SUM((fraction - f0) * (rel + r0) / 2) FILTER (kind = 'random'), 0) AS random_auc FROM steps GROUP BY ALL)"""

_SHARES = """
, ordered AS (SELECT *, row_number() OVER (PARTITION BY system, domain, identifier ORDER BY importance DESC, idx) AS k FROM placed),
shares AS (
  SELECT system, domain, identifier, SUM(positive) AS positive_sum,
         COALESCE(SUM(positive) FILTER (y IN (0, 6) OR x IN (0, 6)), 0) / NULLIF(SUM(positive), 0) AS edge_share,
         COALESCE(SUM(positive) FILTER (NOT (y IN (0, 6) OR x IN (0, 6))), 0) / NULLIF(SUM(positive), 0) AS interior_share,
         AVG(sqrt((y - 3) * (y - 3) + (x - 3) * (x - 3))) FILTER (k <= 5) AS top5_radius FROM ordered GROUP BY ALL)"""


@query(with_views(REGIONS, body="""
SELECT system, domain, identifier, idx AS "index",
  CAST(row_number() OVER (PARTITION BY system, domain, identifier ORDER BY importance DESC, idx) AS INTEGER) AS "order" FROM placed"""))
def deletion_order(spark, folder):
    return attribution.deletion_order(regions(spark, folder)).select(*attribution.IMAGE, "index", "order")


@query(with_views(CURVE, body=f"""
SELECT system, domain, identifier, {r('top_auc', 'top_auc')}, {r('random_auc', 'random_auc')}, {r('random_auc - top_auc', 'gap')} FROM areas"""))
def deletion_auc(spark, folder):
    return rounded(attribution.deletion_areas(curve(spark, folder)))


@query(with_views(REGIONS, body=_SHARES + f"""
SELECT system, domain, identifier, {r('positive_sum', 'positive_sum')}, {r('edge_share', 'edge_share')},
       {r('interior_share', 'interior_share')}, {r('top5_radius', 'top5_radius')} FROM shares"""))
def edge_share(spark, folder):
    return rounded(attribution.region_summary(regions(spark, folder), 7, 7))


@query(with_views(REGIONS, CURVE, body=_SHARES + f"""
, records AS (
  SELECT a.*, random_auc - top_auc AS gap, s.edge_share, s.top5_radius,
         unnest(['all', 'domain:' || a.domain, 'class:k' || (a.identifier % 4), 'outcome:' || (a.identifier % 2 = 0)]) AS "group"
  FROM areas a JOIN shares s ON a.system = s.system AND a.domain = s.domain AND a.identifier = s.identifier)
SELECT system, "group", COUNT(*) AS images, {r('AVG(gap)', 'gap_mean')}, {r('quantile_cont(gap, 0.5)', 'gap_median')},
       {r('AVG(CASE WHEN gap > 0 THEN 1.0::DOUBLE ELSE 0 END)', 'gap_positive')}, {r('AVG(top_auc)', 'top_auc_mean')},
       {r('AVG(random_auc)', 'random_auc_mean')}, {r('AVG(edge_share)', 'edge_share_mean')}, {r('AVG(top5_radius)', 'top5_radius_mean')}
FROM records GROUP BY system, "group\""""))
def attribution_groups(spark, folder):
    r_ = regions(spark, folder)
    records = attribution.region_summary(r_, 7, 7).join(attribution.deletion_areas(curve(spark, folder)), attribution.IMAGE)
    records = records.withColumn("class", F.concat(F.lit("k"), (F.col("identifier") % 4).cast("string"))).withColumn(
        "correct", F.col("identifier") % 2 == 0)
    return rounded(attribution.group_summary(records))


@query(with_views(REGIONS, body=f"""
, totals AS (SELECT *, positive / GREATEST(SUM(positive) OVER (PARTITION BY system, domain, identifier), 1e-12) AS share,
  unnest(['all', 'domain:' || domain, 'class:' || class, 'outcome:' || correct]) AS "group" FROM placed)
SELECT system, "group", CAST(y AS INTEGER) AS "row", CAST(x AS INTEGER) AS "column", {r('AVG(share)', 'mean_share')} FROM totals GROUP BY ALL"""))
def importance_grid(spark, folder):
    return rounded(attribution.importance_grid(regions(spark, folder)))


@query("""WITH cells AS (
  SELECT p_partkey, i, i // 7 AS y, i % 7 AS x, p_size AS h, CAST(floor(p_retailprice) AS INTEGER) AS w FROM part, range(49) t(i)),
bounds AS (SELECT *, h * y // 7 AS y0, h * (y + 1) // 7 AS y1, w * x // 7 AS x0, w * (x + 1) // 7 AS x1 FROM cells)
SELECT p_partkey, COUNT(*) AS regions, CAST(SUM((y1 - y0) * (x1 - x0)) AS BIGINT) AS area,
       CAST(SUM(i * (y0 + y1 + x0 + x1)) AS BIGINT) AS checksum FROM bounds GROUP BY p_partkey""")
def grid_bounds(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_size", F.floor("p_retailprice").cast("int").alias("w"))
    cells = parts.select("p_partkey", F.explode(grid_regions(F.col("p_size"), F.col("w"), 7, 7)).alias("c")).select("p_partkey", "c.*")
    size = (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    return cells.groupBy("p_partkey").agg(
        F.count(F.lit(1)).alias("regions"), F.sum(size).alias("area"),
        F.sum(F.col("index") * (F.col("y0") + F.col("y1") + F.col("x0") + F.col("x1"))).alias("checksum"))


# --- probes -----------------------------------------------------------------------------


@query()
def linear_probe(spark, folder):
    v = vectors(spark, folder).withColumn("y", probes.class_number(F.col("class"), VECTOR_CLASSES))
    train, validation = v.where("domain = 0"), v.where("domain <> 0")
    return rounded(probes.linear_probe(train, validation, "y", "v", [(0.001, 20), (0.01, 20), (0.1, 20)])[0])


@query()
def cv_probe(spark, folder):
    return rounded(probes.cross_validated_probe(vectors(spark, folder), "class", "vec_id", "v"))


@query()
def factor_gap(spark, folder):
    v = vectors(spark, folder).withColumn("condition", factor_a(F.col("class"))).withColumn("identity", factor_b(F.col("class")))
    return rounded(probes.factor_gap(
        probes.cross_validated_probe(v, "condition", "vec_id", "v"), probes.cross_validated_probe(v, "identity", "vec_id", "v")))


def encoders(spark, folder):
    """The vectors as two encoders see them: whole, and the first half of the dimensions."""
    seen = F.array(
        F.struct(F.lit("whole").alias("encoder"), F.col("v").alias("v")),
        F.struct(F.lit("half").alias("encoder"), F.slice("v", 1, 32).alias("v")),
    )
    return vectors(spark, folder).select("vec_id", "domain", "class", F.explode(seen).alias("e")).select("vec_id", "domain", "class", "e.*")


def _efficiency(spark, folder):
    v = encoders(spark, folder)
    fits = stored(probes.few_shot_fits(v.where("domain = 0"), "class", "vec_id", "v", VECTOR_CLASSES, [1, 2, 5, 10], [11, 22, 33, 44, 55]))
    chosen = stored(probes.select_epochs(fits, v.where("domain = 1"), "class", "v", VECTOR_CLASSES))
    return probes.few_shot_report(chosen, v.where("domain = 2"), "class", "v", VECTOR_CLASSES)


@query()
def label_efficiency(spark, folder):
    """Every fit on the test domain, at the epoch chosen on the validation domain."""
    return rounded(_efficiency(spark, folder)[1])


@query()
def label_efficiency_classes(spark, folder):
    """Per encoder, budget and class: precision, recall and F1 over the draws."""
    return rounded(probes.class_draw_statistics(_efficiency(spark, folder)[0], ["encoder", "budget"]))


@query(with_views(PREDICTIONS, _grid("predictions", "system, domain"), _report("system, domain"), body=f"""
, long AS (
  SELECT system, class, 'precision' AS metric, precision AS value FROM report UNION ALL
  SELECT system, class, 'recall', recall FROM report UNION ALL SELECT system, class, 'f1', f1 FROM report)
SELECT system, class, metric, COUNT(*) AS draws, {r('AVG(value)', 'mean')}, {r('stddev_samp(value)', 'standard_deviation')},
       {r('MIN(value)', 'minimum')}, {r('MAX(value)', 'maximum')} FROM long GROUP BY system, class, metric"""))
def class_draws(spark, folder):
    """The statistics over draws, with the domains as the draws of a system."""
    by = ["system", "domain"]
    report = metrics.class_report(metrics.confusion(predictions(spark, folder), by, CLASSES), by)
    return rounded(probes.class_draw_statistics(report, ["system"]))


# --- streams ----------------------------------------------------------------------------


def event_stream(spark, folder):
    """The events as a stream; a glob, because a file stream wants a folder."""
    path = f"{folder}/events*.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT event_type, user_id, arg_min(event_id, ts) AS event_id, (round(arg_min(value, ts) * 2, 6) + 0.0) AS score
FROM events GROUP BY event_type, user_id""")
def stream_once_only(spark, folder):
    base = work_folder(spark, "once-only")
    stream = event_stream(spark, folder).select("event_type", "user_id", "event_id", "ts", "value")
    score = lambda df: df.withColumn("score", F.col("value") * 2)
    ledger.once_only(stream, ["event_type", "user_id"], "ts", score, f"{base}/ledger", f"{base}/checkpoint").awaitTermination()
    return rounded(ledger.read(spark, f"{base}/ledger").select("event_type", "user_id", "event_id", "score"))


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS true_class,
  CASE WHEN value < 10 THEN 'view' WHEN value < 20 THEN 'click' WHEN value < 40 THEN 'signup' ELSE 'purchase' END AS predicted_class,
  COUNT(*) AS n FROM events GROUP BY ALL""")
def stream_window_confusion(spark, folder):
    base = work_folder(spark, "windows")
    value = F.col("value")
    stream = event_stream(spark, folder).select(
        "ts", F.col("event_type").alias("true_class"),
        F.when(value < 10, "view").when(value < 20, "click").when(value < 40, "signup").otherwise("purchase").alias("predicted_class"))
    windows.window_confusion(stream, "ts", "1 day", "1 hour", f"{base}/counts", f"{base}/checkpoint").awaitTermination()
    counts = windows.latest_counts(spark, f"{base}/counts")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "true_class", "predicted_class", "n")
