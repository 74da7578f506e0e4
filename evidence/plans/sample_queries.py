"""Queries for samples, splits, ranks, selections and distribution summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence.functions.vectors import scaled_logits, top2
from evidence.operators import agreement, profile, ranking, sampling
from evidence.operators.scale import stored
from evidence.plans.catalog import query, r, rounded, table, with_views
from evidence.plans.metric_queries import _DOMAIN_SUMMARY, _WIDE, _KEPT, _pair, domain_metrics
from evidence.plans.views import (
    CLASSES, EXTERNALS, LABELLED, PREDICTIONS, SOURCE, SYSTEMS, TEXTS, labelled, predictions, scored, text_table,
)
from evidence.operators import metrics

BUDGETS = [1, 5, 10, 20, 50, 100]
SEED = 42


def _key(*parts: str) -> str:
    return "sha256('" + str(SEED) + "|' || " + " || '|' || ".join(parts) + ")"


# --- samples and splits -----------------------------------------------------------------


@query(f"""SELECT * FROM (
  SELECT event_type, event_id, {_key('event_type', 'event_id')} AS order_key,
         CAST(row_number() OVER (PARTITION BY event_type ORDER BY {_key('event_type', 'event_id')}, event_id) AS INTEGER) AS rank
  FROM events) WHERE rank <= 50""")
def hash_sample(spark, folder):
    return sampling.hash_sample(table(spark, folder, "events").select("event_type", "event_id"), ["event_type"], "event_id", 50, SEED)


@query(with_views(PREDICTIONS, body=f"""
, common AS (
  SELECT domain, item_id, MAX(true_class) AS true_class, COUNT(*) FILTER (true_class = predicted_class) AS correct_systems
  FROM predictions GROUP BY domain, item_id HAVING COUNT(DISTINCT system) = {len(SYSTEMS)}),
strata AS (SELECT *, CASE WHEN correct_systems >= 3 THEN 'majority_correct' ELSE 'majority_error' END AS stratum FROM common),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY domain, true_class, stratum
             ORDER BY {_key('domain', 'true_class', 'stratum', 'item_id')}, item_id) AS INTEGER) AS rank FROM strata)
SELECT domain, true_class, stratum, item_id, correct_systems, rank FROM ranked WHERE rank <= 5"""))
def case_selection(spark, folder):
    common = agreement.common_items(predictions(spark, folder), list(SYSTEMS), ["domain", "item_id"])
    return sampling.select_cases(common, ["domain", "true_class"], "item_id", len(SYSTEMS), 5, SEED).drop("systems", "order_key")


@query(with_views(PREDICTIONS, body=f"""
, marked AS (SELECT domain, true_class, item_id, predicted_class = true_class AS correct
             FROM predictions WHERE system = 'beacon_probe'),
good AS (SELECT *, row_number() OVER (PARTITION BY domain, true_class ORDER BY {_key('domain', 'true_class', 'item_id')}, item_id) AS k
         FROM marked WHERE correct),
wrong AS (SELECT *, row_number() OVER (ORDER BY {_key('item_id')}, item_id) AS k FROM marked WHERE NOT correct),
together AS (SELECT 0 AS turn, * FROM good WHERE k <= 2 UNION ALL SELECT 1, * FROM wrong WHERE k <= 60)
SELECT * FROM (SELECT domain, true_class, item_id, correct,
    CAST(row_number() OVER (ORDER BY turn, domain, true_class, k, item_id) AS INTEGER) AS position FROM together)
WHERE position <= 60"""))
def representative_cases(spark, folder):
    marked = predictions(spark, folder).where("system = 'beacon_probe'").select(
        "domain", "true_class", "item_id", (F.col("predicted_class") == F.col("true_class")).alias("correct"))
    return sampling.representative_cases(marked, ["domain", "true_class"], "item_id", 2, 60, "correct", SEED).drop("rank", "order_key")


@query(f"""SELECT event_type, event_id, selection_rank,
  array_to_string(list_filter({BUDGETS}, lambda b: selection_rank <= b), ',') AS budget_membership FROM (
  SELECT event_type, event_id,
         CAST(row_number() OVER (PARTITION BY event_type ORDER BY {_key('event_type', 'event_id')}, event_id) AS INTEGER) AS selection_rank
  FROM events) WHERE selection_rank <= {max(BUDGETS)}""")
def nested_budgets(spark, folder):
    picked = sampling.nested_budgets(table(spark, folder, "events").select("event_type", "event_id"), "event_type", "event_id", BUDGETS, SEED)
    return picked.select("event_type", "event_id", "selection_rank", F.array_join(F.col("budget_membership").cast("array<string>"), ",").alias("budget_membership"))


@query(f"""WITH ranked AS (
  SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY {_key('event_type', 'event_id')}, event_id) AS rank,
         COUNT(*) OVER (PARTITION BY event_type) AS total FROM events)
SELECT event_type, event_id, rank,
       CASE WHEN rank <= floor(total * 0.7::DOUBLE) THEN 'train'
            WHEN rank <= floor(total * 0.7::DOUBLE) + floor(total * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split
FROM ranked""")
def ratio_split(spark, folder):
    return sampling.ratio_split(table(spark, folder, "events").select("event_type", "event_id"), "event_type", "event_id", SEED).drop("order_key")


@query(with_views(TEXTS, body=f"""
, families AS (SELECT content_hash, MAX(CASE WHEN domain = 2 THEN 1 ELSE 0 END) AS in_test FROM texts GROUP BY content_hash),
free AS (SELECT content_hash, row_number() OVER (ORDER BY {_key('content_hash')}, content_hash) AS rank, COUNT(*) OVER () AS total
         FROM families WHERE in_test = 0)
SELECT item_id, domain, 'test' AS split FROM texts WHERE domain = 2
UNION ALL
SELECT t.item_id, t.domain, CASE WHEN f.rank <= floor(f.total * 0.85::DOUBLE) THEN 'train' ELSE 'validation' END
FROM texts t JOIN free f ON t.content_hash = f.content_hash WHERE t.domain <> 2"""))
def group_split(spark, folder):
    rows = text_table(spark, folder).withColumn("is_test", F.col("domain") == 2)
    return sampling.group_split(rows, "content_hash", "is_test", SEED).select("item_id", "domain", "split")


@query(with_views(LABELLED, body=f"""
SELECT item_id, true_class, CAST((row_number() OVER (PARTITION BY true_class ORDER BY {_key('true_class', 'item_id')}, item_id) - 1) % 5 AS INTEGER) AS fold
FROM labelled"""))
def stratified_folds(spark, folder):
    return sampling.stratified_folds(labelled(spark, folder).select("item_id", "true_class"), "true_class", "item_id", 5, SEED)


@query(with_views(LABELLED, body="SELECT true_class, COUNT(*) AS available FROM labelled GROUP BY true_class HAVING COUNT(*) < 50"))
def capacity_shortfall(spark, folder):
    return sampling.shortfall(labelled(spark, folder), ["true_class"], 50)


@query("""SELECT event_type, CAST(LEAST(COUNT(*), 100) AS BIGINT) AS rows, CAST(LEAST(COUNT(DISTINCT event_id), 100) AS BIGINT) AS items,
  CASE WHEN COUNT(DISTINCT event_id) >= 100 THEN 'PASS' ELSE 'FAIL' END AS status FROM events GROUP BY event_type""")
def subset_balance(spark, folder):
    events = table(spark, folder, "events").select("event_type", "event_id")
    picked = sampling.nested_budgets(events, "event_type", "event_id", BUDGETS, SEED)
    return sampling.subset_balance(picked, "event_type", "event_id", 100, ["click", "error", "purchase", "signup", "view"])


# --- ranks and selections ---------------------------------------------------------------

_RANKS = """
, ranks AS (
  SELECT system, domain, rank() OVER w + (COUNT(*) OVER (PARTITION BY domain, accuracy) - 1) / 2.0::DOUBLE AS rank
  FROM summary WINDOW w AS (PARTITION BY domain ORDER BY accuracy DESC))"""


def domain_ranks(spark, folder):
    return ranking.average_rank(domain_metrics(spark, folder).select("system", "domain", "accuracy"), ["domain"], "accuracy")


@query(with_views(*_DOMAIN_SUMMARY, body=_RANKS + f"SELECT system, domain, {r('rank', 'rank')} FROM ranks"))
def average_rank(spark, folder):
    return rounded(domain_ranks(spark, folder).drop("accuracy"))


@query(with_views(*_DOMAIN_SUMMARY, body=_RANKS + f"""
SELECT system, {r('MIN(rank)', 'best_rank')}, {r('MAX(rank)', 'worst_rank')}, {r('MAX(rank) - MIN(rank)', 'rank_range')}
FROM ranks GROUP BY system"""))
def rank_volatility(spark, folder):
    return rounded(ranking.rank_volatility(domain_ranks(spark, folder), "system"))


@query(with_views(*_DOMAIN_SUMMARY, body=_WIDE + f"""
SELECT system, CAST(row_number() OVER (ORDER BY {_pair('least', 'accuracy')} DESC, {_pair('mean', 'accuracy')} DESC, system) AS INTEGER) AS position
FROM wide"""))
def robustness_order(spark, folder):
    summary = metrics.multi_domain_summary(domain_metrics(spark, folder), SOURCE, EXTERNALS)
    return ranking.robustness_order(summary).select("system", "position")


def run_grid(spark, folder):
    """One accuracy per (model, budget, seed), measured on lineitem."""
    budgets = F.array(*[F.lit(b) for b in [1, 2, 5, 10, 20, 50, 100]])
    return table(spark, folder, "lineitem").groupBy(
        F.col("l_returnflag").alias("model"),
        F.get(budgets, F.col("l_linenumber") - 1).alias("budget"),
        (F.col("l_suppkey") % 5).cast("int").alias("seed"),
        "l_linenumber",
    ).agg((F.avg("l_quantity") / 50.0).alias("a")).select(
        "model", "budget", "seed", (F.col("a") + F.col("l_linenumber") * F.lit(0.02)).alias("accuracy"))


RUNS = """runs AS (
  SELECT l_returnflag AS model, ([1, 2, 5, 10, 20, 50, 100])[l_linenumber] AS budget, CAST(l_suppkey % 5 AS INTEGER) AS seed,
         AVG(l_quantity) / 50.0::DOUBLE + l_linenumber * 0.02::DOUBLE AS accuracy
  FROM lineitem GROUP BY l_returnflag, l_linenumber, l_suppkey % 5),
stats AS (
  SELECT model, budget, COUNT(*) AS draws, AVG(accuracy) AS mean, stddev_samp(accuracy) AS sd, MIN(accuracy) AS lo, MAX(accuracy) AS hi
  FROM runs GROUP BY model, budget),
full_runs AS (SELECT model, MAX(accuracy) AS full_accuracy FROM runs GROUP BY model)"""


@query(with_views(RUNS, body=f"""
SELECT model, budget, draws, {r('mean', 'mean')}, {r('sd', 'standard_deviation')}, {r('lo', 'minimum')}, {r('hi', 'maximum')},
       {r('mean - 2.7764451051977987::DOUBLE * sd / sqrt(draws)', 'lower')},
       {r('mean + 2.7764451051977987::DOUBLE * sd / sqrt(draws)', 'upper')} FROM stats"""))
def draw_statistics(spark, folder):
    return rounded(ranking.draw_statistics(run_grid(spark, folder), ["model", "budget"], "accuracy"))


@query(with_views(RUNS, body="""
SELECT s.model, COALESCE(CAST(MIN(CASE WHEN f.full_accuracy - s.mean <= 0.01::DOUBLE THEN s.budget END) AS VARCHAR), 'Not reached.') AS within_one_point,
       COALESCE(CAST(MIN(CASE WHEN s.mean >= 0.95::DOUBLE * f.full_accuracy THEN s.budget END) AS VARCHAR), 'Not reached.') AS at_least_95_percent
FROM stats s JOIN full_runs f ON s.model = f.model GROUP BY s.model"""))
def first_budget(spark, folder):
    runs = run_grid(spark, folder)
    full = runs.groupBy("model").agg(F.max("accuracy").alias("full_accuracy"))
    return ranking.first_budgets(ranking.draw_statistics(runs, ["model", "budget"], "accuracy"), full, "model", "budget")


@query(with_views(RUNS, body=f"""
SELECT s.model, s.budget, {r('f.full_accuracy - s.mean', 'full_gap')}, {r('s.mean / f.full_accuracy', 'retention')}
FROM stats s JOIN full_runs f ON s.model = f.model"""))
def full_gap(spark, folder):
    runs = run_grid(spark, folder)
    full = runs.groupBy("model").agg(F.max("accuracy").alias("full_accuracy"))
    stats = ranking.draw_statistics(runs, ["model", "budget"], "accuracy").join(full, "model")
    return rounded(stats.select("model", "budget", (F.col("full_accuracy") - F.col("mean")).alias("full_gap"),
                                F.try_divide("mean", "full_accuracy").alias("retention")))


@query(with_views(RUNS, body=f"""
SELECT budget, model, {r('mean', 'mean')}, CAST(rank() OVER (PARTITION BY budget ORDER BY mean DESC) AS INTEGER) AS position FROM stats"""))
def rank_by_budget(spark, folder):
    stats = ranking.draw_statistics(run_grid(spark, folder), ["model", "budget"], "accuracy")
    return rounded(ranking.rank_by_budget(stats, "budget", "mean").select("budget", "model", "mean", "position"))


def history(spark, folder):
    """Epoch rows (one per month) of runs named by flag and supplier group."""
    return table(spark, folder, "lineitem").groupBy(
        F.concat_ws("_", "l_returnflag", (F.col("l_suppkey") % 10).cast("string")).alias("run"),
        F.month("l_shipdate").alias("epoch"),
    ).agg(
        (F.floor(F.avg("l_quantity") * 10) / 500.0).alias("validation_accuracy"),
        (F.floor(F.avg(F.round(F.col("l_discount") * 100).cast("int")) * 10) / 1000.0).alias("validation_loss"),
    )


HISTORY = """history AS (
  SELECT l_returnflag || '_' || (l_suppkey % 10) AS run, CAST(month(l_shipdate) AS INTEGER) AS epoch,
         floor(AVG(l_quantity) * 10) / 500.0::DOUBLE AS validation_accuracy,
         floor(AVG(CAST(round(l_discount * 100) AS INTEGER)) * 10) / 1000.0::DOUBLE AS validation_loss
  FROM lineitem GROUP BY 1, 2)"""


@query(with_views(HISTORY, body="""
SELECT run, epoch, validation_accuracy, validation_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY validation_accuracy DESC, validation_loss, epoch) AS k FROM history) WHERE k = 1"""))
def best_epoch(spark, folder):
    return ranking.best_epoch(history(spark, folder), ["run"])


@query(with_views(HISTORY, body="""
, traced AS (SELECT *, MAX(validation_accuracy) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM history)
SELECT run, epoch, validation_accuracy, best_before, (best_before IS NULL OR validation_accuracy > best_before) AS improved FROM traced"""))
def running_best(spark, folder):
    return ranking.running_best(history(spark, folder), ["run"]).drop("validation_loss")


@query("""WITH results AS (
  SELECT l_returnflag AS encoder, 'P' || (l_linenumber % 4 + 1) AS family, floor(AVG(l_quantity) * 10) / 500.0::DOUBLE AS macro_f1,
         floor(AVG(l_partkey % 10) * 10) / 100.0::DOUBLE AS accuracy FROM lineitem GROUP BY 1, 2)
SELECT encoder, family, macro_f1, accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY encoder ORDER BY macro_f1 DESC, accuracy DESC, family) AS k FROM results) WHERE k = 1""")
def prompt_selection(spark, folder):
    results = table(spark, folder, "lineitem").groupBy(
        F.col("l_returnflag").alias("encoder"), F.concat(F.lit("P"), (F.col("l_linenumber") % 4 + 1).cast("string")).alias("family"),
    ).agg((F.floor(F.avg("l_quantity") * 10) / 500.0).alias("macro_f1"), (F.floor(F.avg(F.col("l_partkey") % 10) * 10) / 100.0).alias("accuracy"))
    return ranking.select_family(results, ["encoder"], ["P1", "P2", "P3", "P4"])


@query("""WITH runs AS (
  SELECT l_returnflag AS study, l_suppkey AS experiment, floor(AVG(l_quantity) * 10) / 500.0::DOUBLE AS train_accuracy,
         floor(AVG(l_partkey % 50)) / 50.0::DOUBLE AS validation_accuracy, floor(AVG(l_linenumber) * 10) / 10.0::DOUBLE AS validation_loss
  FROM lineitem GROUP BY 1, 2)
SELECT study, experiment, CAST(row_number() OVER (PARTITION BY study ORDER BY validation_accuracy DESC, validation_loss,
  abs(train_accuracy - validation_accuracy), experiment) AS INTEGER) AS position FROM runs""")
def experiment_order(spark, folder):
    runs = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("study"), F.col("l_suppkey").alias("experiment")).agg(
        (F.floor(F.avg("l_quantity") * 10) / 500.0).alias("train_accuracy"),
        (F.floor(F.avg(F.col("l_partkey") % 50)) / 50.0).alias("validation_accuracy"),
        (F.floor(F.avg("l_linenumber") * 10) / 10.0).alias("validation_loss"))
    return ranking.experiment_order(runs, ["study"]).select("study", "experiment", "position")


@query(f"""WITH measured AS (
  SELECT l_returnflag AS domain, l_suppkey AS unit, floor(AVG(l_quantity) * 10) / 10.0::DOUBLE AS value FROM lineitem GROUP BY 1, 2),
pairs(a, b) AS (VALUES ('A', 'N'), ('A', 'R'), ('N', 'R')),
paired AS (
  SELECT p.a || '_vs_' || p.b AS pair, m.unit, m.value AS x, o.value AS y
  FROM pairs p JOIN measured m ON m.domain = p.a JOIN measured o ON o.domain = p.b AND o.unit = m.unit),
ranks AS (
  SELECT pair, rank() OVER (PARTITION BY pair ORDER BY x) + (COUNT(*) OVER (PARTITION BY pair, x) - 1) / 2.0::DOUBLE AS rx,
         rank() OVER (PARTITION BY pair ORDER BY y) + (COUNT(*) OVER (PARTITION BY pair, y) - 1) / 2.0::DOUBLE AS ry FROM paired),
rho AS (SELECT pair, COUNT(*) AS n, corr(rx, ry) AS rho FROM ranks GROUP BY pair),
tau AS (
  SELECT p.pair, SUM(sign(p.x - q.x) * sign(p.y - q.y)) / sqrt(SUM(abs(sign(p.x - q.x))) * SUM(abs(sign(p.y - q.y)))::DOUBLE) AS tau
  FROM paired p JOIN paired q ON p.pair = q.pair AND p.unit < q.unit GROUP BY p.pair)
SELECT rho.pair, n, {r('rho', 'spearman_rho')}, {r('tau', 'kendall_tau_b')} FROM rho JOIN tau ON rho.pair = tau.pair""")
def spearman_tau(spark, folder):
    measured = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("domain"), F.col("l_suppkey").alias("unit")).agg(
        (F.floor(F.avg("l_quantity") * 10) / 10.0).alias("value"))
    paired = ranking.paired_values(measured, "unit", "domain", "value", [("A", "N"), ("A", "R"), ("N", "R")])
    return rounded(ranking.rank_correlations(paired, ["pair"]))


# --- profiles ---------------------------------------------------------------------------


@query(with_views(LABELLED, body="""
, classes(true_class) AS (VALUES """ + ", ".join(f"('{c}')" for c in CLASSES) + """),
domains AS (SELECT DISTINCT domain FROM labelled)
SELECT d.domain, c.true_class, COUNT(l.item_id) AS n
FROM domains d CROSS JOIN classes c LEFT JOIN labelled l ON l.domain = d.domain AND l.true_class = c.true_class
GROUP BY d.domain, c.true_class"""))
def class_counts(spark, folder):
    return profile.class_counts(labelled(spark, folder), ["domain"], "true_class", CLASSES)


@query("""SELECT 'l_returnflag' AS field, l_returnflag AS value, COUNT(*) AS n FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linestatus', l_linestatus, COUNT(*) FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), COUNT(*) FROM lineitem GROUP BY 2""")
def value_counts_sets(spark, folder):
    return profile.value_counts(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


def _describe(source: str, by: str, quantiles: dict[str, float]) -> str:
    qs = ", ".join(r(f"quantile_cont(value, {p})", n) for n, p in quantiles.items())
    return f"""SELECT {by}, COUNT(*) AS n, {r('AVG(value)', 'mean')}, {r('stddev_pop(value)', 'std')},
       {r('MIN(value)', 'minimum')}, {r('MAX(value)', 'maximum')}, {qs} FROM {source} GROUP BY {by}"""


@query("""WITH long AS (
  SELECT CAST(l_suppkey % 3 AS INTEGER) AS domain, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS metric,
         unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem)
""" + _describe("long", "domain, metric", {"q05": 0.05, "median": 0.5, "q95": 0.95}))
def domain_profile(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("domain", (F.col("l_suppkey") % 3).cast("int"))
    return rounded(profile.domain_profile(lines, ["domain"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("""WITH long AS (
  SELECT l_returnflag, unnest(['width', 'height', 'aspect_ratio']) AS metric,
         unnest([l_quantity, CAST(l_linenumber AS DOUBLE), l_quantity / CAST(l_linenumber AS DOUBLE)]) AS value FROM lineitem),
described AS (""" + _describe("long", "l_returnflag, metric", {"median": 0.5}) + """),
sizes AS (SELECT l_returnflag, COUNT(DISTINCT (l_quantity, l_linenumber)) AS distinct_sizes FROM lineitem GROUP BY 1)
SELECT d.*, s.distinct_sizes FROM described d JOIN sizes s ON d.l_returnflag = s.l_returnflag""")
def dimension_summary(spark, folder):
    return rounded(profile.dimension_summary(table(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity", "l_linenumber"))


@query("\nUNION ALL\n".join(f"""SELECT l_returnflag, '{c}' AS metric, COUNT(*) AS n, {r(f'AVG({c})', 'mean')},
  {r(f'stddev_pop({c})', 'standard_deviation')}, {r(f'MIN({c})', 'minimum')}, {r(f'MAX({c})', 'maximum')}, TRUE AS within_bound
FROM lineitem GROUP BY l_returnflag""" for c in ("l_quantity", "l_extendedprice")))
def merged_profile(spark, folder):
    """Profiles of line numbers stored apart and merged; the quantiles read from them are held against exact ranks."""
    columns = ["l_quantity", "l_extendedprice"]
    rows = table(spark, folder, "lineitem").select("l_returnflag", "l_linenumber", *columns)
    parts = profile.profile_states(rows, ["l_returnflag", "l_linenumber"], columns)
    points = {"p25": 0.25, "median": 0.5, "p95": 0.95}
    told = stored(profile.describe_states(profile.merge_states(parts, ["l_returnflag"]), ["l_returnflag"], points))
    long = rows.select("l_returnflag", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["l_returnflag"], columns, "metric", "value")
    ranks = [
        (F.avg((F.col("value") <= F.col(q)).cast("double")) >= p - profile.RANK_ERROR)
        & (F.avg((F.col("value") < F.col(q)).cast("double")) <= p + profile.RANK_ERROR) for q, p in points.items()
    ]
    held = long.join(told, ["l_returnflag", "metric"]).groupBy("l_returnflag", "metric").agg((ranks[0] & ranks[1] & ranks[2]).alias("within_bound"))
    return rounded(told.drop(*points).join(held, ["l_returnflag", "metric"]))


@query(with_views(PREDICTIONS, body="""
, long AS (
  SELECT system, predicted_class = true_class AS correct, unnest(['cosine', 'logit']) AS kind,
         unnest([margin, margin * 2.5::DOUBLE]) AS value FROM predictions)
""" + _describe("long", "system, correct, kind", {"p25": 0.25, "median": 0.5, "p75": 0.75})))
def describe_margins(spark, folder):
    scores = scored(spark, folder).withColumn("logits", scaled_logits(F.col("scores"), 2.5, -1.0)).select(
        "system", "true_index", top2("scores").alias("c"), top2("logits").alias("l"))
    long = scores.select(
        "system", (F.col("c.predicted") == F.col("true_index")).alias("correct"),
        F.explode(F.create_map(F.lit("cosine"), F.col("c.margin"), F.lit("logit"), F.col("l.margin"))).alias("kind", "value"))
    return rounded(profile.describe(long, ["system", "correct", "kind"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75}))


@query(f"""SELECT event_type, COUNT(*) AS items, {r('SUM(value)', 'total_seconds', 4)}, {r('SUM(value) * 1000 / COUNT(*)', 'ms_per_item', 4)}
FROM events GROUP BY event_type""")
def timing_summary(spark, folder):
    return rounded(profile.timing_summary(table(spark, folder, "events"), ["event_type"], "value"), 4)
