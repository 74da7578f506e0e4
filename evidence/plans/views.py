"""Views that give the given tables the shapes the operators work on, in Spark and in SQL.

labelled    documents ⋈ labels as items with two-factor classes and a domain (0 is the source)
scored      class scores of five rule systems for every labelled item
predictions the winning class and margin of each score array
big_predictions   the same shape straight from lineitem
vectors     embeddings as doubles, with a domain and a two-factor class
texts       documents with digests of the text and of its normal form
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidence.functions.hashing import normalised_text, text_digest
from evidence.functions.signatures import token_signatures
from evidence.functions.vectors import as_double, top2
from evidence.operators.scale import spread, stored
from evidence.plans.catalog import table

LANGS = ["de", "en", "es", "fr"]
CLASSES = [f"{a}_{b}" for a in ("bad", "good") for b in LANGS]
BIG_CLASSES = [f"{s}_{f}" for s in "FO" for f in "ANR"]
SOURCE, EXTERNALS = 0, [1, 2]
SYSTEMS = {
    "anchor_probe": 0.30,
    "anchor_zero": 0.10,
    "beacon_probe": 0.45,
    "beacon_zero": 0.20,
    "cinder_net": 0.25,
}


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, folder, "labels"), "doc_id").select(
        F.col("doc_id").alias("item_id"),
        F.concat_ws("_", F.when(F.col("quality") == 1, "good").otherwise("bad"), "lang").alias("true_class"),
        domain_of(F.col("source")).alias("domain"),
        "n_chars",
        "toxic",
    )


def domain_of(source: Column) -> Column:
    return (F.regexp_extract(source, r"([0-9]+)", 1).cast("int") % 3).cast("int")


LABELLED = """labelled AS (
  SELECT d.doc_id AS item_id,
         CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END || '_' || d.lang AS true_class,
         CAST(CAST(regexp_extract(d.source, '([0-9]+)', 1) AS INTEGER) % 3 AS INTEGER) AS domain,
         d.n_chars, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """(system, item_id, domain, true_class, true_index, scores array<double>)."""
    entries = F.array(*[F.struct(F.lit(n).alias("system"), F.lit(b).alias("bonus")) for n, b in SYSTEMS.items()])
    items = labelled(spark, folder).withColumn("s", F.explode(entries)).select("*", "s.system", "s.bonus")
    noted = items.withColumn("length_says", F.when(F.col("n_chars") >= 1000, "good").otherwise("bad")).withColumn(
        "tone_says", F.when(F.col("toxic") == 1, "bad").otherwise("good")
    )

    def score(cls: str) -> str:
        half = cls.split("_")[0]
        return f"""CAST(conv(substring(sha2(concat_ws('|', '7', system, item_id, '{cls}'), 256), 1, 8), 16, 10) AS BIGINT)
            / 4294967296.0D + IF(true_class = '{cls}', bonus, 0.0D)
            + IF(length_says = '{half}', 0.15D, 0.0D) + IF(tone_says = '{half}', 0.1D, 0.0D)"""

    names = F.array(*[F.lit(c) for c in CLASSES])
    return noted.select(
        "system", "item_id", "domain", "true_class",
        (F.array_position(names, F.col("true_class")) - 1).cast("int").alias("true_index"),
        F.expr("array(" + ", ".join(score(c) for c in CLASSES) + ")").alias("scores"),
    )


SCORES = LABELLED + """,
systems(system, bonus) AS (VALUES """ + ", ".join(f"('{n}', CAST({b} AS DOUBLE))" for n, b in SYSTEMS.items()) + """),
classes(class, idx) AS (VALUES """ + ", ".join(f"('{c}', {i})" for i, c in enumerate(CLASSES)) + """),
score_rows AS (
  SELECT s.system, i.item_id, i.domain, i.true_class, c.class, c.idx,
         CAST(('0x' || substr(sha256('7|' || s.system || '|' || i.item_id || '|' || c.class), 1, 8))::BIGINT AS DOUBLE)
           / CAST(4294967296 AS DOUBLE)
         + CASE WHEN i.true_class = c.class THEN s.bonus ELSE CAST(0 AS DOUBLE) END
         + CASE WHEN split_part(c.class, '_', 1) = CASE WHEN i.n_chars >= 1000 THEN 'good' ELSE 'bad' END
                THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
         + CASE WHEN split_part(c.class, '_', 1) = CASE WHEN i.toxic = 1 THEN 'bad' ELSE 'good' END
                THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score
  FROM labelled i, systems s, classes c)"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in CLASSES])
    best = scored(spark, folder).withColumn("t", top2("scores"))
    return best.select(
        "system", "item_id", "domain", "true_class",
        F.get(names, F.col("t.predicted")).alias("predicted_class"),
        F.get(names, F.col("t.runner_up")).alias("runner_up_class"),
        F.col("t.best").alias("score"),
        F.col("t.margin").alias("margin"),
    )


PREDICTIONS = SCORES + """,
score_ranks AS (
  SELECT *, row_number() OVER (PARTITION BY system, item_id ORDER BY score DESC, idx) AS rn FROM score_rows),
predictions AS (
  SELECT a.system, a.item_id, a.domain, a.true_class, a.class AS predicted_class,
         b.class AS runner_up_class, a.score, a.score - b.score AS margin
  FROM score_ranks a JOIN score_ranks b
    ON a.system = b.system AND a.item_id = b.item_id AND a.rn = 1 AND b.rn = 2)"""


def big_predictions(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return lines.select(
        (F.col("l_suppkey") % 3).cast("int").alias("domain"),
        F.concat_ws("_", "l_linestatus", "l_returnflag").alias("true_class"),
        F.concat_ws(
            "_",
            F.when(F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp_ntz"), "F").otherwise("O"),
            F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R"),
        ).alias("predicted_class"),
    )


BIG_PREDICTIONS = """big_predictions AS (
  SELECT CAST(l_suppkey % 3 AS INTEGER) AS domain,
         l_linestatus || '_' || l_returnflag AS true_class,
         CASE WHEN l_shipdate < TIMESTAMP '1998-06-01' THEN 'F' ELSE 'O' END || '_' ||
         CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS predicted_class
  FROM lineitem)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, domain, label, class, v): class = fresh/stale by parity, identity by label // 2."""
    return table(spark, folder, "embeddings").select(
        "vec_id",
        (F.col("vec_id") % 3).cast("int").alias("domain"),
        "label",
        F.concat(F.when(F.col("label") % 2 == 0, "fresh_k").otherwise("stale_k"), F.floor(F.col("label") / 2).cast("string")).alias("class"),
        as_double(F.col("embedding")).alias("v"),
    )


VECTOR_CLASSES = [f"{c}_k{i}" for i in range(5) for c in ("fresh", "stale")]

VECTORS = """vectors AS (
  SELECT vec_id, CAST(vec_id % 3 AS INTEGER) AS domain, label,
         CASE WHEN label % 2 = 0 THEN 'fresh_k' ELSE 'stale_k' END || CAST(label // 2 AS VARCHAR) AS class,
         embedding::DOUBLE[] AS v
  FROM embeddings)"""

#: Long form of the vectors, one row per dimension.
VECTOR_ROWS = VECTORS + """,
dims AS (
  SELECT vec_id, domain, label, class, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM vectors)"""


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, domain, file_hash, content_hash): the text digest stands for the file hash, the
    digest of the normal form for the hash of the decoded content."""
    return digests(spread(table(spark, folder, "documents").select("doc_id", "source", "text"))).drop("text")


def text_table(spark: SparkSession, folder: str) -> DataFrame:
    """The digests written once, for plans that read them several times: the texts are scanned once."""
    return stored(texts(spark, folder))


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("item_id"),
        domain_of(F.col("source")).alias("domain"),
        text_digest(F.col("text")).alias("file_hash"),
        text_digest(normalised_text(F.col("text"))).alias("content_hash"),
        "text",
    )


TEXTS = r"""texts AS (
  SELECT doc_id AS item_id,
         CAST(CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 3 AS INTEGER) AS domain,
         sha256(text) AS file_hash,
         sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS content_hash
  FROM documents)"""


def signatures(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, domain, file_hash, content_hash, h): texts with their 63-bit signature, in one scan."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return token_signatures(digests(docs), ["item_id", "domain", "file_hash", "content_hash"], "text")


SIGNATURES = TEXTS + r""",
words AS (
  SELECT doc_id AS item_id, unnest(list_distinct(regexp_extract_all(lower(text), '\w+'))) AS word FROM documents),
word_bits AS (
  SELECT item_id, i,
         ((('0x' || substr(sha256(word), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT)::BIGINT >> i) & 1 AS bit
  FROM words, range(63) AS t(i)),
votes AS (
  SELECT item_id, i, SUM(2 * bit - 1) AS vote FROM word_bits GROUP BY item_id, i),
hashes AS (
  SELECT item_id, CAST(SUM(CASE WHEN vote > 0 THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS h
  FROM votes GROUP BY item_id),
signatures AS (
  SELECT t.*, COALESCE(s.h, 0) AS h FROM texts t LEFT JOIN hashes s ON t.item_id = s.item_id)"""
