"""Queries for duplicates, contamination, reviews and integrity gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence.functions.hashing import text_digest
from evidence.operators import dedup, families, fingerprints, gates, sampling
from evidence.operators.scale import stored
from evidence.plans.catalog import query, r, rounded, table, with_views
from evidence.plans.views import CLASSES, LABELLED, SIGNATURES, TEXTS, labelled, signatures, text_table, texts

THRESHOLD = 6
DIGESTS = ["file_hash", "content_hash"]


def _sides(df):
    return df.where("domain = 0"), df.where("domain <> 0")


def signed(spark, folder):
    """The signature table, computed from the texts once and written to the shared folder."""
    return dedup.stored(signatures(spark, folder))


@query(with_views(TEXTS, body="SELECT content_hash, COUNT(*) AS n, MIN(item_id) AS first FROM texts GROUP BY content_hash HAVING COUNT(*) > 1"))
def duplicate_groups(spark, folder):
    return dedup.duplicate_groups(texts(spark, folder), "content_hash", "item_id")


@query(with_views(TEXTS, body="""
, groups AS (SELECT file_hash, COUNT(*) AS n, MIN(item_id) AS first FROM texts GROUP BY file_hash HAVING COUNT(*) > 1)
SELECT t.file_hash, t.item_id, g.n, t.item_id = g.first AS is_first FROM texts t JOIN groups g ON t.file_hash = g.file_hash"""))
def duplicate_members(spark, folder):
    return dedup.duplicate_members(text_table(spark, folder), "file_hash", "item_id")


@query(with_views(TEXTS, body=f"""
, numbered AS (SELECT row_number() OVER (PARTITION BY file_hash ORDER BY item_id) AS a,
                      row_number() OVER (PARTITION BY content_hash ORDER BY item_id) AS b FROM texts)
SELECT COUNT(*) AS items, COUNT(*) FILTER (a > 1 OR b > 1) AS secondary,
       {r('COUNT(*) FILTER (a > 1 OR b > 1)::DOUBLE / COUNT(*)', 'fraction')},
       COUNT(*) FILTER (a > 1 OR b > 1)::DOUBLE / COUNT(*) > 0.10 AS severe FROM numbered"""))
def secondary_fraction(spark, folder):
    return rounded(dedup.secondary_fraction(text_table(spark, folder), "item_id", DIGESTS))


def _match_sql(digest: str) -> str:
    return with_views(TEXTS, body=f"""
, l AS (SELECT {digest}, COUNT(*) AS left_items, MIN(item_id) AS left_first FROM texts WHERE domain = 0 GROUP BY 1),
x AS (SELECT {digest}, COUNT(*) AS right_items, MIN(item_id) AS right_first FROM texts WHERE domain <> 0 GROUP BY 1)
SELECT l.*, x.right_items, x.right_first, left_items * right_items AS item_pairs FROM l JOIN x ON l.{digest} = x.{digest}""")


@query(_match_sql("file_hash"))
def exact_match(spark, folder):
    return dedup.hash_matches(*_sides(text_table(spark, folder)), "file_hash", "item_id")


@query(_match_sql("content_hash"))
def normalised_match(spark, folder):
    return dedup.hash_matches(*_sides(text_table(spark, folder)), "content_hash", "item_id")


@query(with_views(TEXTS, body="""
SELECT item_id, domain FROM texts t WHERE domain <> 0
  AND NOT EXISTS (SELECT 1 FROM texts s WHERE s.domain = 0 AND s.file_hash = t.file_hash)
  AND NOT EXISTS (SELECT 1 FROM texts s WHERE s.domain = 0 AND s.content_hash = t.content_hash)"""))
def exclude_contaminated(spark, folder):
    source, external = _sides(text_table(spark, folder))
    excluded = dedup.contaminated(external, source, DIGESTS, "item_id")
    return dedup.exclude(external.select("item_id", "domain"), excluded, "item_id")


_CROSS = f"""
, l AS (SELECT h, COUNT(*) AS n FROM signatures WHERE domain = 0 GROUP BY h),
x AS (SELECT h, COUNT(*) AS n FROM signatures WHERE domain <> 0 GROUP BY h),
matches AS (
  SELECT l.h AS left_h, x.h AS right_h, CAST(bit_count(xor(l.h, x.h)) AS INTEGER) AS distance,
         l.n AS left_items, x.n AS right_items, l.n * x.n AS item_pairs
  FROM l, x WHERE bit_count(xor(l.h, x.h)) <= {THRESHOLD})"""

_WITHIN = f"""
, totals AS (SELECT h, COUNT(*) AS n FROM signatures GROUP BY h),
same AS (
  SELECT a.h, COUNT(*) AS item_pairs FROM signatures a JOIN signatures b ON a.h = b.h AND a.item_id < b.item_id
    AND a.file_hash <> b.file_hash AND a.content_hash <> b.content_hash GROUP BY a.h),
matches AS (
  SELECT l.h AS left_h, x.h AS right_h, CAST(bit_count(xor(l.h, x.h)) AS INTEGER) AS distance,
         l.n AS left_items, x.n AS right_items, l.n * x.n AS item_pairs
  FROM totals l, totals x WHERE l.h < x.h AND bit_count(xor(l.h, x.h)) <= {THRESHOLD}
  UNION ALL
  SELECT s.h, s.h, 0, t.n, t.n, s.item_pairs FROM same s JOIN totals t ON s.h = t.h)"""


@query(with_views(SIGNATURES, body=_CROSS + "SELECT * FROM matches"))
def hamming_join(spark, folder):
    return dedup.near_matches(*_sides(signed(spark, folder)), THRESHOLD)


@query(with_views(SIGNATURES, body=_WITHIN + "SELECT * FROM matches"))
def hamming_self_join(spark, folder):
    return dedup.near_matches_within(signed(spark, folder), THRESHOLD, DIGESTS)


_FAMILIES = f""",
edges AS (
  SELECT a.item_id AS a, b.item_id AS b FROM signatures a JOIN signatures b ON a.item_id <> b.item_id
    AND (a.file_hash = b.file_hash OR a.content_hash = b.content_hash OR bit_count(xor(a.h, b.h)) <= {THRESHOLD})),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
found AS (SELECT s.item_id, s.domain, LEAST(s.item_id, COALESCE(MIN(r.b), s.item_id)) AS family
          FROM signatures s LEFT JOIN reach r ON r.a = s.item_id GROUP BY s.item_id, s.domain)"""


def _families(spark, folder):
    return families.near_families(signed(spark, folder), "item_id", DIGESTS, "h", THRESHOLD)


@query(with_views(SIGNATURES, body=_FAMILIES + """
SELECT item_id, family, COUNT(*) OVER (PARTITION BY family) AS members FROM found""").replace("WITH", "WITH RECURSIVE", 1))
def near_families(spark, folder):
    found = stored(_families(spark, folder).select("item_id", "family"))
    return found.join(found.groupBy("family").agg(F.count(F.lit(1)).alias("members")).hint("merge"), "family")


@query(with_views(SIGNATURES, body=_FAMILIES + """,
grouped AS (SELECT family, MAX(CASE WHEN domain = 2 THEN 1 ELSE 0 END) AS in_test FROM found GROUP BY family),
free AS (SELECT family, row_number() OVER (ORDER BY sha256('42|' || family), family) AS rank, COUNT(*) OVER () AS total FROM grouped WHERE in_test = 0)
SELECT item_id, family, 'test' AS split FROM found WHERE domain = 2
UNION ALL
SELECT t.item_id, t.family, CASE WHEN f.rank <= floor(f.total * 0.85::DOUBLE) THEN 'train' ELSE 'validation' END
FROM found t JOIN free f ON t.family = f.family WHERE t.domain <> 2""").replace("WITH", "WITH RECURSIVE", 1))
def near_family_split(spark, folder):
    """No family of copies or near copies has rows on two sides of the split."""
    rows = stored(_families(spark, folder).select("item_id", "family", (F.col("domain") == 2).alias("is_test")))
    return sampling.group_split(rows, "family", "is_test", 42).select("item_id", "family", "split")


@query(with_views(SIGNATURES, body=_WITHIN + """
SELECT distance, COUNT(*) AS signature_pairs, CAST(SUM(item_pairs) AS BIGINT) AS item_pairs FROM matches GROUP BY distance"""))
def distance_histogram(spark, folder):
    return dedup.distance_histogram(dedup.near_matches_within(signed(spark, folder), THRESHOLD, DIGESTS))


@query(with_views(SIGNATURES, body=_CROSS + f"""
, seen AS (SELECT DISTINCT domain = 0 AS source, h FROM signatures WHERE item_id IN (SELECT doc_id FROM labels)),
reviewed AS (
  SELECT a.h AS left_h, b.h AS right_h, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance
  FROM seen a, seen b WHERE a.source AND NOT b.source AND bit_count(xor(a.h, b.h)) <= {THRESHOLD + 1}),
state AS (
  SELECT COUNT(*) FILTER (m.left_h IS NOT NULL AND v.left_h IS NOT NULL) AS matched,
         COUNT(*) FILTER (v.left_h IS NULL) AS unreviewed, COUNT(*) FILTER (m.left_h IS NULL) AS stale
  FROM matches m FULL JOIN reviewed v ON m.left_h = v.left_h AND m.right_h = v.right_h AND m.distance = v.distance)
SELECT matched, unreviewed, stale,
       CASE WHEN unreviewed = 0 AND stale = 0 THEN 'PASS_REVIEW_COMPLETE' ELSE 'REVIEW_INCOMPLETE' END AS status FROM state"""))
def review_reconcile(spark, folder):
    """Candidates against a review of the labelled documents only, made with a threshold one bit wider."""
    items = signed(spark, folder)
    candidates = dedup.near_matches(*_sides(items), THRESHOLD)
    labelled = items.join(table(spark, folder, "labels").select(F.col("doc_id").alias("item_id")), "item_id", "left_semi")
    reviewed = dedup.near_matches(*_sides(labelled), THRESHOLD + 1)
    return dedup.reconcile(candidates, reviewed, ["left_h", "right_h", "distance"])


@query(with_views(SIGNATURES, body=_CROSS + """
, numbered AS (SELECT row_number() OVER (PARTITION BY content_hash ORDER BY item_id) AS b,
                      row_number() OVER (PARTITION BY file_hash ORDER BY item_id) AS a FROM texts),
facts AS (
  SELECT (SELECT COUNT(*) FROM documents WHERE length(text) = 0) AS broken,
         (SELECT AVG(CASE WHEN a > 1 OR b > 1 THEN 1.0::DOUBLE ELSE 0 END) FROM numbered) > 0.10 AS severe,
         (SELECT CAST(COALESCE(SUM(item_pairs), 0) AS BIGINT) FROM matches) AS candidates)
SELECT broken, severe, candidates,
       CASE WHEN broken > 0 THEN 'BLOCKED_BROKEN_FILES' WHEN severe THEN 'BLOCKED_SEVERE_DUPLICATION' ELSE 'PASS' END AS audit_status,
       CASE WHEN candidates > 0 THEN 'REVIEW_REQUIRED' ELSE 'PASS_NO_CANDIDATES' END AS contamination_status FROM facts"""))
def gate_status(spark, folder):
    items = signed(spark, folder)
    pairs = dedup.near_matches(*_sides(items), THRESHOLD).agg(F.coalesce(F.sum("item_pairs"), F.lit(0)).alias("n"))
    severe = dedup.secondary_fraction(items, "item_id", DIGESTS).select("severe")
    broken = table(spark, folder, "documents").agg(F.count_if(F.length("text") == 0).alias("broken"))
    facts = broken.select("broken", severe.scalar().alias("severe"), pairs.scalar().alias("candidates"))
    return facts.select("*", *dedup.gate(F.col("broken"), F.col("severe"), F.col("candidates")))


# --- integrity --------------------------------------------------------------------------


@query("""WITH checks AS (
  SELECT COUNT(*) FILTER (len(embedding) <> 64) AS dimension,
         COUNT(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS finite,
         COUNT(*) FILTER (abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.00001) AS unit_norm,
         COUNT(*) FILTER (label < 0 OR label >= 10) AS label_range,
         COUNT(*) FILTER (vec_id IS NULL) AS missing_id, COUNT(vec_id) - COUNT(DISTINCT vec_id) AS repeated_id FROM embeddings),
long AS (UNPIVOT checks ON dimension, finite, unit_norm, label_range, missing_id, repeated_id INTO NAME "check" VALUE violations)
SELECT "check", violations, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM long""")
def embedding_gates(spark, folder):
    return gates.embedding_checks(table(spark, folder, "embeddings"), "vec_id", "embedding", "label", 64, 10)


@query("""WITH shifted AS (SELECT vec_id + 1 AS position, vec_id + 1 AS vec_id, label FROM embeddings),
joined AS (SELECT e.vec_id AS l, s.vec_id AS x, e.label AS ll, s.label AS xl FROM embeddings e FULL JOIN shifted s ON e.vec_id = s.position),
checks AS (SELECT COUNT(*) FILTER (x IS NULL) AS only_left, COUNT(*) FILTER (l IS NULL) AS only_right,
                  COUNT(*) FILTER (l <> x) AS id_differs, COUNT(*) FILTER (ll <> xl) AS label_differs FROM joined),
long AS (UNPIVOT checks ON only_left, only_right, id_differs, label_differs INTO NAME "check" VALUE violations)
SELECT "check", violations, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM long""")
def cache_alignment(spark, folder):
    """The embedding table against a copy moved by one position."""
    base = table(spark, folder, "embeddings").select(F.col("vec_id").alias("position"), "vec_id", "label")
    moved = base.select((F.col("position") + 1).alias("position"), (F.col("vec_id") + 1).alias("vec_id"), "label")
    return gates.cache_alignment(base, moved, ["position"], "vec_id", "label")


@query(with_views(TEXTS, body="""
SELECT item_id, domain FROM texts t WHERE domain <> 0 AND EXISTS (SELECT 1 FROM texts s WHERE s.domain = 0 AND s.content_hash = t.content_hash)"""))
def overlap_check(spark, folder):
    train, validation = _sides(text_table(spark, folder))
    return gates.overlap(train, validation, "content_hash").select("item_id", "domain")


_REGISTRY = """WITH recorded AS (
  SELECT 'documents/' || d.doc_id AS path, sha256(d.text) AS want FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 'benchmark/' || item_id, sha256(text) FROM benchmark),
actual AS (SELECT 'documents/' || doc_id AS path, sha256(trim(text)) AS have FROM documents),
checked AS (
  SELECT COALESCE(a.path, x.path) AS path, CASE WHEN want IS NULL THEN 'UNREGISTERED' WHEN have IS NULL THEN 'MISSING'
         WHEN want = have THEN 'OK' ELSE 'CHANGED' END AS status FROM recorded a FULL JOIN actual x ON a.path = x.path)"""


def _registry(spark, folder):
    """Digests recorded for labelled documents and benchmark items against the trimmed documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = lambda kind, key: F.concat(F.lit(kind + "/"), F.col(key).cast("string")).alias("path")
    recorded = docs.join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi").select(
        path("documents", "doc_id"), text_digest(F.col("text")).alias("sha256"))
    recorded = recorded.unionAll(table(spark, folder, "benchmark").select(path("benchmark", "item_id"), text_digest(F.col("text"))))
    actual = docs.select(path("documents", "doc_id"), text_digest(F.trim("text")).alias("sha256"))
    return gates.registry_check(recorded, actual)


@query(_REGISTRY + " SELECT * FROM checked")
def registry_verify(spark, folder):
    return _registry(spark, folder)


@query(_REGISTRY + """ SELECT COUNT(*) FILTER (status <> 'UNREGISTERED') AS registered,
  COUNT(*) FILTER (status IN ('MISSING', 'CHANGED')) AS broken,
  CASE WHEN COUNT(*) FILTER (status IN ('MISSING', 'CHANGED')) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM checked""")
def registry_verdict(spark, folder):
    return gates.registry_verdict(_registry(spark, folder))


_LEDGER = """WITH planned AS (SELECT DISTINCT user_id, event_type FROM events),
done AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 50)"""


def _ledger(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_type", "value")
    return events.select("user_id", "event_type").distinct(), events.where("value > 50").select("user_id", "event_type").distinct()


@query(_LEDGER + " SELECT * FROM planned EXCEPT SELECT * FROM done")
def ledger_remaining(spark, folder):
    return gates.remaining(*_ledger(spark, folder), ["user_id", "event_type"])


@query(_LEDGER + """ SELECT (SELECT COUNT(*) FROM planned) AS planned, (SELECT COUNT(*) FROM done) AS completed, CAST(0 AS BIGINT) AS unexpected,
  CASE WHEN (SELECT COUNT(*) FROM done) < (SELECT COUNT(*) FROM planned) THEN 'PARTIAL' ELSE 'COMPLETE' END AS status""")
def ledger_verdict(spark, folder):
    return gates.ledger_verdict(*_ledger(spark, folder), ["user_id", "event_type"])


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("""WITH seen AS (SELECT DISTINCT user_id, event_type, CAST(day(ts) AS INTEGER) AS day FROM events)
SELECT u.user_id, t.event_type, CAST(d.day AS INTEGER) AS day
FROM (SELECT DISTINCT user_id FROM events) u
CROSS JOIN (VALUES """ + ", ".join(f"('{t}')" for t in _TYPES) + """) t(event_type) CROSS JOIN range(1, 31) d(day)
EXCEPT SELECT * FROM seen""")
def grid_completeness(spark, folder):
    seen = table(spark, folder, "events").select("user_id", "event_type", F.dayofmonth("ts").alias("day"))
    return gates.missing_cells(seen, "user_id", {"event_type": _TYPES, "day": list(range(1, 31))})


@query(with_views(LABELLED, body="""
, names(value) AS (VALUES """ + ", ".join(f"('{c}')" for c in [*CLASSES[1:], "good_it"]) + """)
SELECT 'missing' AS side, value FROM names WHERE value NOT IN (SELECT true_class FROM labelled)
UNION ALL SELECT 'unexpected', c FROM (SELECT DISTINCT true_class AS c FROM labelled) WHERE c NOT IN (SELECT value FROM names)"""))
def class_set_check(spark, folder):
    return gates.set_difference(labelled(spark, folder), [*CLASSES[1:], "good_it"], "true_class")


@query(with_views(LABELLED, body="""
, a AS (SELECT true_class, COUNT(*) AS n FROM labelled WHERE domain = 1 GROUP BY 1),
b AS (SELECT true_class, COUNT(*) AS n FROM labelled WHERE domain = 2 GROUP BY 1)
SELECT *, 'actual_only' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT *, 'registered_only' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"""))
def registered_counts(spark, folder):
    items = labelled(spark, folder)
    counts = lambda d: items.where(F.col("domain") == d).groupBy("true_class").agg(F.count(F.lit(1)).alias("n"))
    return gates.multiset_difference(counts(1), counts(2))


_CHANGED = """WITH changed AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 997 = 3 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice
  FROM orders WHERE o_orderkey % 1009 <> 5
  UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 1013 = 7),
plain AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders)"""
_ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def _changed(spark, folder):
    """The orders, and a copy with values set to null, rows left out and rows that occur twice."""
    orders = table(spark, folder, "orders").select(*_ORDER)
    status = F.when(F.col("o_orderkey") % 997 != 3, F.col("o_orderstatus")).alias("o_orderstatus")
    copy = orders.where("o_orderkey % 1009 <> 5").select("o_orderkey", "o_custkey", status, "o_totalprice")
    return orders, copy.unionAll(orders.where("o_orderkey % 1013 = 7"))


@query(_CHANGED + """
SELECT *, 'left_only' AS side FROM (SELECT * FROM plain EXCEPT ALL SELECT * FROM changed)
UNION ALL SELECT *, 'right_only' FROM (SELECT * FROM changed EXCEPT ALL SELECT * FROM plain)""")
def table_changes(spark, folder):
    """Rows in which two tables differ, found through unequal branches of their fingerprints."""
    return fingerprints.differing_rows(*_changed(spark, folder), _ORDER)


@query(_CHANGED + """
SELECT 'copy' AS compared, COUNT(*) AS left_rows, COUNT(*) AS right_rows, 'EQUAL' AS status FROM plain
UNION ALL SELECT 'changed', (SELECT COUNT(*) FROM plain), (SELECT COUNT(*) FROM changed),
  CASE WHEN EXISTS (FROM plain EXCEPT ALL FROM changed) OR EXISTS (FROM changed EXCEPT ALL FROM plain) THEN 'DIFFERENT' ELSE 'EQUAL' END""")
def table_equality(spark, folder):
    """The orders against a copy in another order, and against a changed one."""
    orders, changed = _changed(spark, folder)
    moved = orders.repartition(7, "o_custkey").sortWithinPartitions(F.desc("o_totalprice"))
    pairs = {"copy": moved, "changed": changed}
    first, second = (
        fingerprints.equality(orders, other, _ORDER).select(F.lit(name).alias("compared"), "*") for name, other in pairs.items()
    )
    return first.unionAll(second)
