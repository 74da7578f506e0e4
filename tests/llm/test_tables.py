"""Mixing, archives, exact search and the pipeline, with hard rows and with none."""

import gzip
import hashlib
import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from evidence.llm import components, dense_topk, mixing, near_dedup, pieces, warc
from evidence.session import work_folder

from tests.llm.samples import documents, passage
from tests.parity import connect, differences

FOLDER = os.environ.get("PARITY_FOLDER", "/root/testdata/sf0.001")
OWN = [n for n in entry.queries() if n == "pipeline" or (n.startswith("op") and n[2].isdigit())]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_one_query_for_each_operator():
    assert sorted({int(n[2:].split("_")[0]) for n in OWN if n != "pipeline"}) == list(range(1, 14)) and "pipeline" in OWN


@pytest.mark.parametrize("name", sorted(n for n in OWN if n in entry.oracle_sql()))
def test_parity(spark, duck, name):
    assert differences(entry.queries()[name](spark, FOLDER), duck, entry.oracle_sql()[name]) == []


def test_mix_follows_the_distribution(spark):
    rows = [(i, "t", None, "big" if i % 10 else None, 1) for i in range(20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copy long")
    weights = spark.createDataFrame([("big", 1.0), (None, 1.0), ("absent", 5.0)], "source string, weight double")
    mixed = mixing.mix(docs, weights=weights, total=24000)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "copy", "shuffle_key"]
    by = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(by["big"] - 12000) < 500 and abs(by[None] - 12000) < 500  # a rate of 2/3 and one of 6
    counts = [r["n"] for r in mixed.where("source IS NULL").groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    assert abs(np.var(counts + [0] * (2000 - len(counts))) - 6) < 1
    keys = [r["shuffle_key"] for r in mixed.select("shuffle_key").collect()]
    assert keys == sorted(keys)
    high = mixing.mix(docs.where("doc_id < 50"), total=50 * 40.0, temperature=1.0)  # parts of a rate of 40
    assert abs(high.count() - 2000) < 200


def test_mix_hard_rows(spark):
    docs = documents(spark)
    again = mixing.mix(docs.repartition(5)).orderBy("shuffle_key").collect()
    assert mixing.mix(docs).orderBy("shuffle_key").collect() == again
    assert mixing.mix(documents(spark, [])).count() == 0
    none = spark.createDataFrame([], "source string, weight double")
    assert mixing.mix(docs, weights=none).count() == 0


PAGES = [
    (1, "http://a/1", "x" * 120), (2, None, "x" * 120), (3, "u\r\nv%0A", ""), (4, "d", None), (5, "e", "y" * 99), (6, "f", "y" * 99),
    (7, "g", "WARC/1.1\r\n\r\n" + "z" * 200), (None, "h", "x" * 120), (None, "i", "only " * 30), (8, "j", "é日😀" * 60000), (1, "k", "x" * 120),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("other"))
    folder = work_folder(spark, "warc-test")
    archives = warc.write_archives(warc.mark_revisits(pages.repartition(2), "page_id", "url", "html"), folder, archive_bytes=400)
    for split in (50, 333, 1 << 20):
        records = warc.read_archives(archives, folder, split)
        got = warc.resolve_payloads(records).collect()
        assert len(got) == len(PAGES) and all(r["digest_ok"] for r in got)
        assert sorted((str(r["page_id"]), str(r["url"]), bytes(r["payload"]).decode()) for r in got) == sorted((str(i), str(u), t or "") for i, u, t in PAGES)
        assert all(r["payload_digest"] == hashlib.sha256(r["payload"]).hexdigest() and r["payload_bytes"] == len(r["payload"]) for r in got)
        assert sorted((str(r["page_id"]), r["refers_to"]) for r in got if r["record_type"] == "revisit") == [("2", 1), ("None", 1)]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(spark, empty, "page_id", "url", "html").count() == 0


def test_reader_is_not_misled():
    inner = warc.encode_record(9, "u", b"inner", hashlib.sha256(b"inner").hexdigest(), None)
    noise = os.urandom(3000) + warc.GZIP_MAGIC + b"junk" + gzip.compress(b"no archive record")
    first = warc.encode_record(1, "u", noise, hashlib.sha256(noise).hexdigest(), None)
    second = warc.encode_record(2, "v", b"second" * 5, hashlib.sha256(b"second" * 5).hexdigest(), None)
    data = first + second + inner
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 3
    for step in (100, 777, 5000):
        found = [r["page_id"] for a in range(0, len(data), step) for _, _, r in warc.read_range(io.BytesIO(data), len(data), a, min(a + step, len(data)))]
        assert found == [1, 2, 9]


def brute_top(rows, k):
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in whole:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_with_ties_nulls_and_repeats(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=8).round(1).tolist()) for i in range(230)] + [(300 + i, [0.5] * 8) for i in range(90)]
    rows += [(50, [0.1] * 8), (7, [0.2] * 8), (400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (450, [0.0] * 8), (451, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))
    vectors = dense_topk.integer_vectors(table, "vec_id", "embedding")
    for sizes in ((4096, 4096), (40, 2)):
        got = dense_topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5, *sizes)
        assert sorted(map(tuple, got.collect())) == brute_top(rows, 5)
    few = dense_topk.top_k(vectors.where("vec_id IN (0, 1, 2)"), F.col("vec_id") % 50 == 0, 5)
    assert few.count() == 2 and dense_topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    got = {r["id"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def write_tables(docs, folder, spark):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_stages(spark):
    good = [(i, passage(i, 90) + f" write to user{i}@mail.example.org today") for i in range(20, 60)]
    rows = [*good, (90, good[0][1]), (91, good[1][1] + " more"), (92, "too short"), (93, None), (94, "junk " * 400)]
    folder = work_folder(spark, "pipeline-test")
    write_tables(documents(spark, rows).select(*corpus_pipeline.COLUMNS), folder, spark)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        seen[name] = docs
        docs = near_dedup.stored(docs)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(seen["quality rules"]) == [*range(20, 60), 90, 91]
    assert ids(seen["near-dedup"]) == list(range(20, 60))
    hidden = seen["personal data"].collect()
    assert all("<EMAIL>" in r["text"] and "@" not in r["text"] and r["n_chars"] == len(r["text"]) for r in hidden)
    assert all(seen[n].columns == corpus_pipeline.COLUMNS for n, _ in corpus_pipeline.STAGES[:-1])
    assert set(ids(seen["source mixing"])) <= set(range(20, 60))
    v, mixed = pieces.Vocabulary.load(), {r["doc_id"]: r["text"] for r in seen["source mixing"].collect()}
    assert all(pieces.decode(r["ids"], v) == mixed[r["doc_id"]] for r in docs.collect())
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, docs.collect()))


def test_pipeline_of_no_documents(spark):
    folder = work_folder(spark, "pipeline-test")
    write_tables(documents(spark, []).select(*corpus_pipeline.COLUMNS), folder, spark)
    assert corpus_pipeline.run(spark, folder).count() == 0
