"""Queries over prediction tables: confusion, reports, errors, gaps, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence.functions.labels import correctness
from evidence.functions.vectors import cross_entropy, rank_changed, scaled_logits, target_margin, top2
from evidence.operators import agreement, metrics
from evidence.plans.catalog import query, r, rounded, with_views
from evidence.plans.views import (
    BIG_CLASSES, BIG_PREDICTIONS, CLASSES, EXTERNALS, PREDICTIONS, SCORES, SOURCE, SYSTEMS,
    big_predictions, predictions, scored,
)


def _grid(view: str, by: str) -> str:
    """Confusion cells on the full grid of classes, as SQL."""
    values = ", ".join(f"('{c}')" for c in (BIG_CLASSES if view == "big_predictions" else CLASSES))
    keys = f"{by}, " if by else ""
    join = " AND ".join(f"g.{c.strip()} = c.{c.strip()}" for c in by.split(",")) + " AND " if by else ""
    return f"""names(name) AS (VALUES {values}),
counted AS (SELECT {keys}true_class, predicted_class, COUNT(*) AS n FROM {view} GROUP BY ALL),
groups AS (SELECT DISTINCT {by or '1 AS one'} FROM {view}),
grid AS (
  SELECT {', '.join('g.' + c.strip() for c in by.split(',')) + ', ' if by else ''}
         a.name AS true_class, b.name AS predicted_class, COALESCE(c.n, 0) AS n
  FROM groups g CROSS JOIN names a CROSS JOIN names b
  LEFT JOIN counted c ON {join}c.true_class = a.name AND c.predicted_class = b.name)"""


def _report(by: str) -> str:
    keys = f"{by}, " if by else ""
    return f"""per_class AS (
  SELECT {keys}class, CAST(SUM(support) AS BIGINT) AS support, CAST(SUM(hits) AS BIGINT) AS hits,
         COALESCE(SUM(hits)::DOUBLE / NULLIF(SUM(predicted), 0), 0) AS precision,
         COALESCE(SUM(hits)::DOUBLE / NULLIF(SUM(support), 0), 0) AS recall
  FROM (SELECT {keys}true_class AS class, n AS support, 0 AS predicted,
               CASE WHEN true_class = predicted_class THEN n ELSE 0 END AS hits FROM grid
        UNION ALL
        SELECT {keys}predicted_class, 0, n, 0 FROM grid)
  GROUP BY ALL),
report AS (
  SELECT *, COALESCE(2 * precision * recall / NULLIF(precision + recall, 0), 0) AS f1 FROM per_class)"""


def _summary(by: str) -> str:
    keys = f"{by}, " if by else ""
    weighted = ", ".join(f"SUM({m} * support) / SUM(support) AS weighted_{m}" for m in ("precision", "recall", "f1"))
    return f"""summary AS (
  SELECT {keys}CAST(SUM(support) AS BIGINT) AS samples, SUM(hits)::DOUBLE / SUM(support) AS accuracy,
         AVG(precision) AS macro_precision, AVG(recall) AS macro_recall, AVG(f1) AS macro_f1, {weighted}
  FROM report {'GROUP BY ' + by if by else ''})"""


REPORT_COLUMNS = ", ".join([r("precision", "precision"), r("recall", "recall"), r("f1", "f1")])
SUMMARY_COLUMNS = ", ".join(
    r(m, m) for m in ("accuracy", "macro_precision", "macro_recall", "macro_f1",
                      "weighted_precision", "weighted_recall", "weighted_f1")
)


@query(with_views(PREDICTIONS, _grid("predictions", "system, domain"), body="SELECT * FROM grid"))
def confusion_long(spark, folder):
    return metrics.confusion(predictions(spark, folder), ["system", "domain"], CLASSES)


@query(with_views(
    BIG_PREDICTIONS, _grid("big_predictions", "domain"),
    body="SELECT domain, true_class, "
    + ", ".join(f"CAST(SUM(CASE WHEN predicted_class = '{c}' THEN n END) AS BIGINT) AS {c}" for c in BIG_CLASSES)
    + " FROM grid GROUP BY domain, true_class"))
def confusion_pivot_big(spark, folder):
    grid = metrics.confusion(big_predictions(spark, folder), ["domain"], BIG_CLASSES)
    return metrics.confusion_wide(grid, ["domain"], BIG_CLASSES)


@query(with_views(
    PREDICTIONS, _grid("predictions", "system"), _report("system"),
    body=f"SELECT system, class, support, {REPORT_COLUMNS} FROM report"))
def classification_report(spark, folder):
    report = metrics.class_report(metrics.confusion(predictions(spark, folder), ["system"], CLASSES), ["system"])
    return rounded(report.drop("hits"))


@query(with_views(
    PREDICTIONS, _grid("predictions", "system, domain"), _report("system, domain"), _summary("system, domain"),
    body=f"SELECT system, domain, samples, {SUMMARY_COLUMNS} FROM summary"))
def system_summary(spark, folder):
    return rounded(metrics.evaluate(predictions(spark, folder), ["system", "domain"], CLASSES))


@query(with_views(
    BIG_PREDICTIONS, _grid("big_predictions", "domain"), _report("domain"), _summary("domain"),
    body=f"SELECT domain, samples, {SUMMARY_COLUMNS} FROM summary"))
def report_big(spark, folder):
    return rounded(metrics.evaluate(big_predictions(spark, folder), ["domain"], BIG_CLASSES))


# --- a list of classes that does not hold all: one is left off, and close calls are null ---------

OPEN_CLASSES = [c for c in CLASSES if c != "good_fr"]
_ON_LIST = ", ".join(f"'{c}'" for c in OPEN_CLASSES)
OPEN_REPORT = f"""open AS (
  SELECT system, true_class AS t, CASE WHEN margin >= 0.05 THEN predicted_class END AS p FROM predictions),
sides AS (
  SELECT system, CASE WHEN t IN ({_ON_LIST}) THEN t ELSE '(other)' END AS class, 1 AS support, 0 AS predicted,
         CASE WHEN t = p THEN 1 ELSE 0 END AS hits FROM open
  UNION ALL
  SELECT system, CASE WHEN p IN ({_ON_LIST}) THEN p ELSE '(other)' END, 0, 1, 0 FROM open
  UNION ALL
  SELECT DISTINCT system, name, 0, 0, 0 FROM open, (VALUES {', '.join(f"('{c}')" for c in OPEN_CLASSES)}) n(name)),
per_class AS (
  SELECT system, class, CAST(SUM(support) AS BIGINT) AS support, CAST(SUM(hits) AS BIGINT) AS hits,
         COALESCE(SUM(hits)::DOUBLE / NULLIF(SUM(predicted), 0), 0) AS precision,
         COALESCE(SUM(hits)::DOUBLE / NULLIF(SUM(support), 0), 0) AS recall
  FROM sides GROUP BY system, class),
report AS (
  SELECT *, COALESCE(2 * precision * recall / NULLIF(precision + recall, 0), 0) AS f1 FROM per_class)"""


def open_predictions(spark, folder):
    close = F.when(F.col("margin") >= 0.05, F.col("predicted_class"))
    return predictions(spark, folder).withColumn("predicted_class", close)


@query(with_views(PREDICTIONS, OPEN_REPORT, body=f"SELECT system, class, support, {REPORT_COLUMNS} FROM report"))
def report_open_classes(spark, folder):
    grid = metrics.confusion(open_predictions(spark, folder), ["system"], OPEN_CLASSES)
    return rounded(metrics.class_report(grid, ["system"]).drop("hits"))


@query(with_views(PREDICTIONS, OPEN_REPORT, body="SELECT system, CAST(SUM(support) AS BIGINT) AS samples, "
    + r("SUM(hits)::DOUBLE / SUM(support)", "accuracy") + ", "
    + ", ".join(r(f"AVG({m}) FILTER (class <> '(other)')", f"macro_{m}") for m in ("precision", "recall", "f1")) + ", "
    + ", ".join(r(f"SUM({m} * support) FILTER (class <> '(other)') / SUM(support) FILTER (class <> '(other)')", f"weighted_{m}")
                for m in ("precision", "recall", "f1"))
    + " FROM report GROUP BY system"))
def summary_open_classes(spark, folder):
    return rounded(metrics.evaluate(open_predictions(spark, folder), ["system"], OPEN_CLASSES))


@query(with_views(SCORES, body=f"""
, best AS (SELECT system, item_id, MAX(score) AS top, MAX(CASE WHEN class = true_class THEN score END) AS own
           FROM score_rows GROUP BY system, item_id),
loss AS (SELECT b.system, b.item_id, ln(SUM(exp(s.score - b.top))) + b.top - b.own AS loss,
                CASE WHEN b.top = b.own THEN 1 ELSE 0 END AS hit
         FROM best b JOIN score_rows s ON b.system = s.system AND b.item_id = s.item_id
         GROUP BY b.system, b.item_id, b.top, b.own)
SELECT system, COUNT(*) AS samples, {r('AVG(loss)', 'loss')}, {r('AVG(hit)', 'accuracy')} FROM loss GROUP BY system"""))
def cross_entropy_loss(spark, folder):
    rows = scored(spark, folder)
    winner = top2("scores")["predicted"]
    return rounded(metrics.cross_entropy_summary(
        rows, ["system"], cross_entropy(F.col("scores"), F.col("true_index")), winner == F.col("true_index")))


_FACTORS = """split_part(true_class, '_', 1) AS ta, split_part(true_class, '_', 2) AS tb,
         split_part(predicted_class, '_', 1) AS pa, split_part(predicted_class, '_', 2) AS pb"""


@query(with_views(PREDICTIONS, body=f"""
, parts AS (SELECT *, {_FACTORS} FROM predictions)
SELECT system, domain, COUNT(*) AS samples,
       COUNT(*) FILTER (true_class = predicted_class) AS correct,
       COUNT(*) FILTER (ta = pa) AS factor_a_correct, COUNT(*) FILTER (tb = pb) AS factor_b_correct
FROM parts GROUP BY system, domain"""))
def factor_correctness(spark, folder):
    flags = predictions(spark, folder).select(
        "system", "domain", *correctness(F.col("true_class"), F.col("predicted_class")))
    return flags.groupBy("system", "domain").agg(
        F.count(F.lit(1)).alias("samples"), *[F.count_if(c).alias(c) for c in flags.columns[2:]])


def _errors(view: str, by: str) -> str:
    return f"""
, kinds AS (
  SELECT {by}, CASE WHEN true_class = predicted_class THEN NULL WHEN tb = pb THEN 'condition_error'
                    WHEN ta = pa THEN 'identity_error' ELSE 'combined_error' END AS kind
  FROM (SELECT *, {_FACTORS} FROM {view})),
sums AS (SELECT {by}, COUNT(*) AS samples, COUNT(kind) AS total_errors,
                COUNT(*) FILTER (kind = 'condition_error') AS c1,
                COUNT(*) FILTER (kind = 'identity_error') AS c2,
                COUNT(*) FILTER (kind = 'combined_error') AS c3 FROM kinds GROUP BY {by}),
long AS (SELECT {by}, samples, total_errors, 'condition_error' AS category, c1 AS n FROM sums
         UNION ALL SELECT {by}, samples, total_errors, 'identity_error', c2 FROM sums
         UNION ALL SELECT {by}, samples, total_errors, 'combined_error', c3 FROM sums)
SELECT {by}, total_errors, category, n,
       {r("COALESCE(n * 100.0::DOUBLE / NULLIF(total_errors, 0), 0)", "percent_of_errors")},
       {r("COALESCE(n * 100.0::DOUBLE / NULLIF(samples, 0), 0)", "percent_of_predictions")} FROM long"""


@query(with_views(PREDICTIONS, body=_errors("predictions", "system, domain")))
def semantic_errors(spark, folder):
    by = ["system", "domain"]
    return rounded(metrics.semantic_errors(metrics.cells(predictions(spark, folder), by), by))


@query(with_views(BIG_PREDICTIONS, body=_errors("big_predictions", "domain")))
def semantic_errors_big(spark, folder):
    return rounded(metrics.semantic_errors(metrics.cells(big_predictions(spark, folder), ["domain"]), ["domain"]))


@query(with_views(PREDICTIONS, body="""
, pairs AS (SELECT system, true_class || ' -> ' || predicted_class AS pair, COUNT(*) AS n
            FROM predictions WHERE true_class <> predicted_class GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY system ORDER BY n DESC, pair) AS INTEGER) AS position FROM pairs)
SELECT * FROM ranked WHERE position <= 15"""))
def confusion_pairs_top15(spark, folder):
    return metrics.confusion_pairs(metrics.cells(predictions(spark, folder), ["system"]), ["system"])


# --- comparisons between domains -------------------------------------------------------

_DOMAIN_SUMMARY = (PREDICTIONS, _grid("predictions", "system, domain"), _report("system, domain"), _summary("system, domain"))


def domain_metrics(spark, folder):
    return metrics.evaluate(predictions(spark, folder), ["system", "domain"], CLASSES)


def domain_report(spark, folder):
    by = ["system", "domain"]
    return metrics.class_report(metrics.confusion(predictions(spark, folder), by, CLASSES), by)


def _split(df, domain):
    return df.where(F.col("domain") == domain)


@query(with_views(*_DOMAIN_SUMMARY, body=f"""
SELECT s.system, e.domain,
       {r('s.accuracy', 'source_accuracy')}, {r('s.weighted_f1', 'source_weighted_f1')},
       {r('e.accuracy', 'external_accuracy')}, {r('e.weighted_f1', 'external_weighted_f1')},
       {r('e.accuracy - s.accuracy', 'accuracy_gap')}, {r('e.accuracy / NULLIF(s.accuracy, 0)', 'accuracy_retention')},
       {r('e.weighted_f1 - s.weighted_f1', 'weighted_f1_gap')},
       {r('e.weighted_f1 / NULLIF(s.weighted_f1, 0)', 'weighted_f1_retention')}
FROM summary s JOIN summary e ON s.system = e.system AND s.domain = {SOURCE} AND e.domain <> {SOURCE}"""))
def gap_retention(spark, folder):
    m = domain_metrics(spark, folder)
    external = m.where(F.col("domain") != SOURCE)
    return rounded(metrics.gap_retention(_split(m, SOURCE), external, ["system"], ["accuracy", "weighted_f1"], ["domain"]))


@query(with_views(*_DOMAIN_SUMMARY, body=f"""
SELECT s.system, s.class, e.domain, {r('s.recall', 'source_recall')}, {r('e.recall', 'external_recall')},
       {r('e.recall - s.recall', 'shift')}
FROM report s JOIN report e ON s.system = e.system AND s.class = e.class
  AND s.domain = {SOURCE} AND e.domain <> {SOURCE}"""))
def recall_shift(spark, folder):
    report = domain_report(spark, folder)
    external = report.where(F.col("domain") != SOURCE)
    return rounded(metrics.recall_shift(_split(report, SOURCE), external, ["system", "class"], ["domain"]))


_WIDE = """
, wide AS (
  SELECT system, """ + ", ".join(
    f"MAX(CASE WHEN domain = {d} THEN {m} END) AS {m}_{d}"
    for m in ("accuracy", "weighted_f1", "macro_f1") for d in (SOURCE, *EXTERNALS)) + """
  FROM summary GROUP BY system)"""


def _pair(fn: str, m: str) -> str:
    a, b = (f"{m}_{d}" for d in EXTERNALS)
    return f"({a} + {b}) / 2" if fn == "mean" else f"LEAST({a}, {b})"


_KEPT = [f"accuracy_{d} / NULLIF(accuracy_{SOURCE}, 0)" for d in EXTERNALS]


@query(with_views(*_DOMAIN_SUMMARY, body=_WIDE + f"""
SELECT system, {r(f'accuracy_{SOURCE}', 'source_accuracy')},
       {r(_pair('mean', 'accuracy'), 'mean_external_accuracy')}, {r(_pair('least', 'accuracy'), 'worst_external_accuracy')},
       {r(_pair('mean', 'weighted_f1'), 'mean_external_weighted_f1')}, {r(_pair('least', 'weighted_f1'), 'worst_external_weighted_f1')},
       {r(_pair('least', 'macro_f1'), 'worst_external_macro_f1')},
       {r(f'({_KEPT[0]} + {_KEPT[1]}) / 2', 'mean_external_retention')},
       {r(f'LEAST({_KEPT[0]}, {_KEPT[1]})', 'worst_external_retention')}
FROM wide"""))
def multi_domain_summary(spark, folder):
    return rounded(metrics.multi_domain_summary(domain_metrics(spark, folder), SOURCE, EXTERNALS))


_RECALLS = f"""
, recalls AS (
  SELECT system, class, MAX(CASE WHEN domain = {EXTERNALS[0]} THEN recall END) AS a,
         MAX(CASE WHEN domain = {EXTERNALS[1]} THEN recall END) AS b FROM report GROUP BY system, class)"""


@query(with_views(*_DOMAIN_SUMMARY, body=_RECALLS + f"""
SELECT system, class, {r('a', 'first_recall')}, {r('b', 'second_recall')}, {r('(a + b) / 2', 'mean_external_recall')},
       {r('LEAST(a, b)', 'worst_external_recall')}, {r('abs(a - b)', 'external_recall_range')} FROM recalls"""))
def class_robustness_by_system(spark, folder):
    return rounded(metrics.class_robustness(domain_report(spark, folder), EXTERNALS)[0])


@query(with_views(*_DOMAIN_SUMMARY, body=_RECALLS + f"""
SELECT class, {r('AVG((a + b) / 2)', 'mean_recall')}, {r('MIN(LEAST(a, b))', 'minimum_recall')},
       {r('AVG(abs(a - b))', 'mean_range')}, {r('MAX(abs(a - b))', 'maximum_range')} FROM recalls GROUP BY class"""))
def class_robustness(spark, folder):
    return rounded(metrics.class_robustness(domain_report(spark, folder), EXTERNALS)[1])


@query(with_views(*_DOMAIN_SUMMARY, body=f"""
SELECT split_part(z.system, '_', 1) AS family, z.domain, {r('z.accuracy - p.accuracy', 'delta')}
FROM summary z JOIN summary p ON z.domain = p.domain AND z.system LIKE '%\\_zero' ESCAPE '\\'
  AND p.system = split_part(z.system, '_', 1) || '_probe'"""))
def zero_minus_probe(spark, folder):
    system = F.col("system")
    return rounded(metrics.family_delta(
        domain_metrics(spark, folder), F.substring_index(system, "_", 1), F.substring_index(system, "_", -1), "zero", "probe"))


# --- paired systems ---------------------------------------------------------------------

_PAIRED = """
, paired AS (
  SELECT l.domain, l.item_id, l.true_class, l.predicted_class AS lc, x.predicted_class AS rc,
         l.margin AS lm, x.margin AS rm,
         CASE WHEN l.predicted_class = l.true_class AND x.predicted_class = x.true_class THEN 'both_correct'
              WHEN l.predicted_class = l.true_class THEN 'left_only_correct'
              WHEN x.predicted_class = x.true_class THEN 'right_only_correct' ELSE 'both_wrong' END AS outcome
  FROM predictions l JOIN predictions x ON l.item_id = x.item_id AND l.domain = x.domain
    AND l.system = 'beacon_probe' AND x.system = 'beacon_zero')"""


def beacon_pair(spark, folder):
    return agreement.pair_systems(predictions(spark, folder), "beacon_probe", "beacon_zero", ["domain", "item_id"])


_OUTCOMES = ", ".join(
    r(f"AVG(CASE WHEN outcome = '{o}' THEN 1.0::DOUBLE ELSE 0 END)", o)
    for o in ("both_correct", "left_only_correct", "right_only_correct", "both_wrong"))


@query(with_views(PREDICTIONS, body=_PAIRED + f"""
SELECT domain, COUNT(*) AS samples, {r('AVG(CASE WHEN lc = rc THEN 1.0::DOUBLE ELSE 0 END)', 'agreement_rate')},
       {_OUTCOMES} FROM paired GROUP BY domain"""))
def disagreement(spark, folder):
    return rounded(agreement.disagreement(beacon_pair(spark, folder), ["domain"]))


@query(with_views(PREDICTIONS, body=_PAIRED + f"""
SELECT domain, outcome, COUNT(*) AS n, {r('AVG(lm)', 'left_margin_mean')}, {r('AVG(rm)', 'right_margin_mean')},
       {r('quantile_cont(rm, 0.5)', 'right_margin_median')} FROM paired GROUP BY domain, outcome"""))
def outcome_margins(spark, folder):
    return rounded(agreement.outcome_margins(beacon_pair(spark, folder), ["domain"]))


@query(with_views(PREDICTIONS, body=_PAIRED + f"""
SELECT domain, true_class, outcome, COUNT(*) AS n,
       {r('COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY domain, true_class)', 'share')}
FROM paired GROUP BY domain, true_class, outcome"""))
def class_outcomes(spark, folder):
    return rounded(agreement.class_outcomes(beacon_pair(spark, folder), ["domain"]))


@query(with_views(PREDICTIONS, body=f"""
SELECT domain, item_id, MAX(true_class) AS true_class, CAST(COUNT(DISTINCT system) AS INTEGER) AS systems,
       COUNT(*) FILTER (true_class = predicted_class) AS correct_systems
FROM predictions GROUP BY domain, item_id HAVING COUNT(DISTINCT system) = {len(SYSTEMS)}"""))
def common_ids(spark, folder):
    return agreement.common_items(predictions(spark, folder), list(SYSTEMS), ["domain", "item_id"])


# --- score vectors ----------------------------------------------------------------------


@query(with_views(PREDICTIONS, body=f"""
SELECT p.system, p.item_id, p.predicted_class, p.runner_up_class, {r('p.score', 'score', 8)}, {r('p.margin', 'margin', 8)},
       {r('t.own - t.other', 'target_margin', 8)}, {r('p.margin * 2.5::DOUBLE', 'logit_margin', 8)}, FALSE AS rank_changed
FROM predictions p JOIN (
  SELECT system, item_id, MAX(CASE WHEN class = true_class THEN score END) AS own,
         MAX(CASE WHEN class <> true_class THEN score END) AS other FROM score_rows GROUP BY system, item_id) t
ON p.system = t.system AND p.item_id = t.item_id"""))
def score_margins(spark, folder):
    """Top two classes, margins and rank check after scaling, for every score array."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    s = F.col("scores")
    rows = scored(spark, folder).withColumn("logits", scaled_logits(s, 2.5, -1.0)).select(
        "system", "item_id", top2("scores").alias("t"), top2("logits")["margin"].alias("logit_margin"),
        target_margin(s, F.col("true_index")).alias("target_margin"), rank_changed("scores", "logits").alias("rank_changed"))
    return rounded(rows.select(
        "system", "item_id", F.get(names, F.col("t.predicted")).alias("predicted_class"),
        F.get(names, F.col("t.runner_up")).alias("runner_up_class"), F.col("t.best").alias("score"),
        F.col("t.margin").alias("margin"), "target_margin", "logit_margin", "rank_changed"), 8)
