"""Restoring against all readings, and the scorer on plain and disguised texts it has not learned from."""

import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evidence.llm import toxicity as tx
from evidence.plans.catalog import table

from tests.llm.samples import documents

FOLDER = "/root/testdata/sf0.01"
TEXT = "the idiot said that it was a stupid class of loser and the sell was all about trash in the small hills " * 20


@pytest.fixture(scope="module")
def model():
    return tx.LanguageModel(tx.trigram_counts([TEXT]))


def path_cost(options, model):
    at, total, out = 0, 0.0, ""
    for text, extra, symbols in options:
        total += extra
        out += text
        for s in symbols:
            if s or at % tx.SYMBOLS:
                total += model.costs[at][s]
                at = at % tx.SYMBOLS * tx.SYMBOLS + s if s else 0
    return total + (model.costs[at][0] if at % tx.SYMBOLS else 0.0), out


@pytest.mark.parametrize("token", ["1d10t", "i.d.i.o.t", "s t u p i d", "sssttuuupid", "l0$er", "tr@sh", "s-e-l-l", "c1@$$", "4ll", "$ell|ng", "it's"])
def test_search_finds_the_least_reading(model, token):
    every = [path_cost(o, model) for o in itertools.product(*tx.lattice(token))]
    cost = min(every)[0]
    found = tx.decode(token, model)
    assert min(c for c, t in every if t == found) == pytest.approx(cost)


def test_disguises_are_undone(model):
    for token, word in [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("sstttuupidd", "stupid"), ("l0$er", "loser"), ("tr@sh", "trash"), ("i d i o t", "idiot")]:
        assert tx.decode(token, model).split() == [word]
    words = tx.Reader(model).words("You I.D.I.O.T!!! (stupid), s t u p i d; sells 2021 l0$er")
    assert {"idiot", "stupid", "loser", "sells", "2021", "you"} <= words
    assert "class" in tx.Reader(model).words("class")  # two equal letters are no disguise


def test_counts_follow_all_texts(spark):
    docs = documents(spark, [(i, t) for i, t in enumerate(["ab a", None, "", "Ab\n a", "é日😀 x1%"])])
    got = tx.language_model(docs.repartition(3))
    want = tx.LanguageModel(sum(tx.trigram_counts([t or ""]) for t in ["ab a", None, "", "Ab\n a", "é日😀 x1%"]))
    at = lambda m: m.costs[tx.symbol("a")][tx.symbol("b")]
    assert at(got) == pytest.approx(at(want)) and at(got) < got.costs[tx.symbol("b")][tx.symbol("b")]


def disguised(word: str, draw: random.Random) -> str:
    kind = draw.randrange(3)
    if kind == 0:
        return "".join({"i": "1", "o": "0", "s": "$", "a": "@", "e": "3"}.get(c, c) for c in word)
    if kind == 1:
        return ".".join(word)
    return "".join(c * draw.choice([1, 3]) for c in word)


def test_held_out_labels_and_disguises(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    scorer = tx.train(docs, labels)
    assert all(abs(w) < 50 for w in scorer.weights.values())
    rows = tx.score(docs, scorer).join(labels.where("quality = 1"), "doc_id").collect()
    unseen = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] for r in unseen if r["toxic"] == 0) == 0
    assert sum(r["predicted"] for r in rows if r["toxic"] == 1) >= 0.8 * sum(r["toxic"] for r in rows)
    # whole words of the scorer, hidden in clean texts
    read, plain = scorer.reader(), tx.Scorer(scorer.weights, scorer.intercept, None).reader()
    telling = [f[1:] for f, w in scorer.weights.items() if f[0] == "=" and plain("a " + f[1:])[0] >= 0.5 and len(f) > 5]
    assert len(telling) >= 3
    draw = random.Random(1)
    hidden = [("the and of " + disguised(w, draw) + " to be that", w) for w in telling for _ in range(12)]
    restored = sum(read(t)[0] >= 0.5 for t, _ in hidden)
    assert restored >= 0.8 * len(hidden) and sum(plain(t)[0] >= 0.5 for t, _ in hidden) < 0.2 * len(hidden)


def test_hard_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 0), (4, None), (None, 1), (5, 0), (6, 0), (99, 1), (12, 1), (13, 0), (9, 0)], "doc_id long, toxic int"
    )
    scorer = tx.train(docs, labels, least_evidence=0.1)
    rows = tx.score(docs, scorer).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[7] == by[8] == by[9]  # null, empty and blank texts
    assert [r["score"] for r in rows if r["doc_id"] == 13] == [by[13]] * 2
    again = {r["doc_id"]: r["score"] for r in tx.score(docs.repartition(4), tx.train(docs.repartition(3), labels, least_evidence=0.1)).collect()}
    assert all(again[k] == pytest.approx(v) for k, v in by.items())
    for few in (labels.where("toxic = 1"), labels.where("toxic = 5")):  # one kind of label, and none
        assert {r["predicted"] for r in tx.score(docs, tx.train(docs, few)).collect()} <= {0, 1}
    assert tx.score(documents(spark, []), scorer).count() == 0
    assert tx.train(documents(spark, []), labels).weights == {}
    assert entry.queries()["op13_toxicity"](spark, "/root/testdata/sf0.001").columns == ["doc_id", "held_out", "score", "predicted"]


def test_sample_is_bounded_and_leaves_a_fifth_out(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    labels = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert tx.training_sample(docs, labels, rows=100).count() == 100
    whole = {r["key"] for r in tx.training_sample(docs, labels).collect()}
    assert whole == {i for i in range(500) if zlib.crc32(str(i).encode()) % 5}
