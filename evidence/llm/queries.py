"""Registered queries over the corpus operators, each beside its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from evidence.llm import (
    dense_topk, hard_negatives, mixing, near_dedup, near_passages, personal_data, pieces, quality_rules, spelling, substring_dedup,
    toxicity, warc, weak_quality,
)
from evidence.plans.catalog import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""")
def op9_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Five highest inner products of every fiftieth vector among all others."""
    vectors = dense_topk.integer_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return dense_topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


MIX_RATES = """
WITH counts AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
rates AS (
  SELECT source, sum(n_docs) OVER () * sqrt(n_docs) / sum(sqrt(n_docs)) OVER () / n_docs AS rate FROM counts),
parts AS (SELECT source, CAST(ceil(rate / 16.0) AS INTEGER) AS parts, rate / ceil(rate / 16.0) AS part_rate FROM rates),
terms AS (
  SELECT source, parts, i,
         coalesce(list_product(list_transform(range(1, i + 1), lambda j: part_rate / j)), 1) * exp(-part_rate) AS term
  FROM parts, range(0, 101) t(i)),
cdf AS (SELECT source, parts, i, sum(term) OVER (PARTITION BY source ORDER BY i) AS p FROM terms)
"""


@query(MIX_RATES + """,
draws AS (
  SELECT d.doc_id, d.source, c.parts, part,
         CAST('0x' || substr(md5('0|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || part), 1, 13) AS BIGINT)
           / 4503599627370496.0 AS u
  FROM documents d JOIN (SELECT DISTINCT source, parts FROM parts) c ON d.source IS NOT DISTINCT FROM c.source,
       LATERAL (SELECT unnest(range(1, c.parts + 1)) AS part)),
counted AS (
  SELECT doc_id, sum((SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM draws.source AND c.p <= draws.u)) AS n
  FROM draws GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(copy AS INTEGER) AS copy,
       CAST('0x' || substr(md5('0|order|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || copy), 1, 13) AS BIGINT) AS shuffle_key
FROM documents d JOIN counted USING (doc_id), LATERAL (SELECT unnest(range(1, CAST(n AS BIGINT) + 1)) AS copy)
""")
def op4_poisson_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Documents repeated so that sources appear in proportion to the square root of their size, in shuffled order."""
    return mixing.mix(table(spark, folder, "documents"))


@query("""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p),
m AS (SELECT *, payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM m
""")
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to an archive and read back, repeated payloads as revisits."""
    records = warc.round_trip(spark, table(spark, folder, "pages"), "page_id", "url", "html")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of every document and the verdict of the base rule and the learned decision list."""
    docs = table(spark, folder, "documents")
    rules = quality_rules.fit(docs, table(spark, folder, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality_rules.judge(docs, rules).select(
        F.col("_row.doc_id").alias("doc_id"), *[F.col(f"_s.{c}").alias(c) for c in counts], "base_failed", "kept", "rule"
    )


@query()
def op2_piece_viterbi(spark: SparkSession, folder: str) -> DataFrame:
    """Piece ids of every whole text, with the check that they decode to it."""
    return pieces.encode(table(spark, folder, "documents"), pieces.Vocabulary.load())


@query()
def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and digests of the spans of personal data in every whole text."""
    docs = table(spark, folder, "documents")
    return personal_data.digests(docs, personal_data.train(docs))


@query()
def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return near_dedup.classes(table(spark, folder, "documents"))


@query()
def op8_weak_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Scores and verdict of the weakly supervised classifier for every document."""
    docs = table(spark, folder, "documents")
    return weak_quality.classify(docs, weak_quality.train(docs, table(spark, folder, "labels")))


@query()
def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that start earlier."""
    return substring_dedup.remove_repeats(table(spark, folder, "documents")).drop("kept")


@query()
def op5_near_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of fifty words or more that an earlier document holds too, word for word or nearly."""
    return near_passages.near_passages(table(spark, folder, "documents"))


@query()
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words one edit apart in the vocabulary of all texts, the frequent form and the root of each."""
    return spelling.variants(spelling.vocabulary(table(spark, folder, "documents")))


@query("""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY 2, 3) = 1),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
""")
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Near vectors of other labels for every fiftieth vector and its nearest of the same label."""
    moved = F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(hard_negatives.labelled_vectors(rows, "vec_id", "embedding", "label"), F.expr("vec_id % 50 = 0"))


@query()
def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every whole text after disguised words are restored; a fifth of the labels is never learned from."""
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels"))).drop("matched")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
