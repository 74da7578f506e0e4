"""Tables whose extra columns have the names that the operators use inside."""

from pyspark.sql import functions as F

from evidence.llm import mixing, weak_quality

from tests.llm.samples import documents

NAMES = ["_source", "_parts", "_cdf", "_count", "_key", "_from", "bad", "rate", "n_docs", "weight", "features", "order"]


def clashing(spark):
    return documents(spark).select("*", *[F.lit(n).alias(n) for n in NAMES])


def test_mixing_carries_columns_of_any_name(spark):
    plain, more = documents(spark), clashing(spark)
    got = mixing.mix(more)
    assert got.columns == [c for c in more.columns if c != "copy"] + ["copy", "shuffle_key"]
    same = ["doc_id", "text", "source", "copy", "shuffle_key"]
    rows = lambda df: sorted(map(repr, df.select(*same).collect()))
    assert rows(got) == rows(mixing.mix(plain)) and all(r["_cdf"] == "_cdf" and r["rate"] == "rate" for r in got.collect())


def test_weak_labels_read_only_their_columns(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (10, 0)], "doc_id long, toxic int")
    ids = lambda df: sorted(map(repr, df.drop("_row").collect()))
    plain, more = documents(spark), clashing(spark)
    model, same = weak_quality.train(plain, labels), weak_quality.train(more, labels)
    assert ids(weak_quality.classify(plain, model)) == ids(weak_quality.classify(plain, same))
    assert weak_quality.classify(more, same).count() == more.count()
