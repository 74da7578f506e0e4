import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidence.streaming import ledger, windows


def write(spark, folder, name, data):
    frame = pd.DataFrame(data, columns=["system", "item", "ts", "value"]).assign(ts=lambda d: pd.to_datetime(d["ts"]))
    spark.createDataFrame(frame).select("system", "item", F.col("ts").cast("timestamp").alias("ts"), "value").coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder):
    schema = "system string, item bigint, ts timestamp, value double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_once_only_across_batches_and_restarts(spark, tmp_path, rows):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / "ck")
    score = lambda df: df.withColumn("score", F.col("value") * 10)

    def drain():
        ledger.once_only(stream(spark, src), ["system", "item"], "ts", score, out, ck).awaitTermination()
        return rows(ledger.read(spark, out), "system", "item", "score")

    write(spark, src, "a", [("s", 1, "2024-01-01 00:00", 1.0), ("s", 1, "2024-01-01 00:05", 9.0), ("s", 2, "2024-01-01 00:01", 2.0)])
    assert drain() == [("s", 1, 10.0), ("s", 2, 20.0)]
    write(spark, src, "b", [("s", 1, "2024-01-02 00:00", 7.0), ("s", 3, "2024-01-02 00:00", 3.0)])
    write(spark, src, "c", [("s", 3, "2024-01-03 00:00", 8.0), ("t", 1, "2024-01-03 00:00", 4.0)])
    want = [("s", 1, 10.0), ("s", 2, 20.0), ("s", 3, 30.0), ("t", 1, 40.0)]
    assert drain() == want
    assert drain() == want  # nothing new, nothing scored twice


def test_once_only_breaks_ties_by_the_other_columns(spark, tmp_path, rows):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / "ck")
    write(spark, src, "a", [("s", 1, "2024-01-01 00:00", v) for v in (5.0, 2.0, 9.0)])
    ledger.once_only(stream(spark, src).repartition(3), ["system", "item"], "ts", lambda df: df, out, ck).awaitTermination()
    assert rows(ledger.read(spark, out), "system", "item", "value") == [("s", 1, 2.0)]


def test_once_only_with_bounded_state(spark, tmp_path, rows):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / "ck")
    write(spark, src, "a", [("s", 1, "2024-01-01 00:00", 1.0), ("s", 2, "2024-01-01 00:01", 2.0)])
    write(spark, src, "b", [("s", 1, "2024-01-09 00:00", 7.0), ("s", 3, "2024-01-09 00:00", 3.0)])
    keep = lambda df: df
    for _ in range(2):
        ledger.once_only(stream(spark, src), ["system", "item"], "ts", keep, out, ck, max_wait="1 day").awaitTermination()
    assert rows(ledger.read(spark, out), "system", "item") == [("s", 1), ("s", 2), ("s", 3)]


def test_repeated_batch_is_committed_once(spark, tmp_path):
    fields = spark.createDataFrame([], "system string, item bigint").schema.fields
    path = str(tmp_path / "ledger")
    assert ledger.scored_keys(spark, path, fields).count() == 0
    df = spark.createDataFrame([("s", 1)], "system string, item bigint")
    assert ledger.append(df, path, "run", 0) and not ledger.append(df, path, "run", 0)
    assert ledger.append(df.limit(0), path, "run", 1) and ledger.append(df, path, "other", 0)
    assert ledger.scored_keys(spark, path, fields).count() == 2
    with pytest.raises(RuntimeError, match="another writer"):
        ledger._advance(spark, path, ledger.last_record(spark, path))


def drained(spark, src, out, ck, score=lambda df: df):
    ledger.once_only(stream(spark, src), ["system", "item"], "ts", score, out, ck).awaitTermination()


@pytest.mark.parametrize("fails", ["before the rows", "before the record", "after the record"])
def test_restart_in_the_middle_of_a_batch(spark, tmp_path, rows, monkeypatch, fails):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / "ck")
    write(spark, src, "a", [("s", 1, "2024-01-01 00:00", 1.0), ("s", 2, "2024-01-01 00:01", 2.0)])
    drained(spark, src, out, ck)
    write(spark, src, "b", [("s", 2, "2024-01-02 00:00", 7.0), ("s", 3, "2024-01-02 00:05", 4.0), ("s", 3, "2024-01-02 00:00", 3.0)])
    write(spark, src, "c", [("s", 3, "2024-01-01 00:00", 8.0), ("s", 4, "2024-01-03 00:00", 4.0)])
    append, advance = ledger.append, ledger._advance

    def stop(*_):
        raise KeyError("lost")

    if fails == "before the rows":
        monkeypatch.setattr(ledger, "append", stop)
    elif fails == "before the record":
        monkeypatch.setattr(ledger, "_advance", stop)
    else:
        monkeypatch.setattr(ledger, "append", lambda *a: append(*a) and stop())
    with pytest.raises(Exception, match="lost"):
        drained(spark, src, out, ck)
    monkeypatch.setattr(ledger, "append", append)
    monkeypatch.setattr(ledger, "_advance", advance)
    drained(spark, src, out, ck)
    want = [("s", 1, 1.0), ("s", 2, 2.0), ("s", 3, 3.0), ("s", 4, 4.0)]
    assert rows(ledger.read(spark, out), "system", "item", "value") == want
    drained(spark, src, out, ck)
    assert rows(ledger.read(spark, out), "system", "item", "value") == want


def test_batches_do_not_read_the_history(spark, tmp_path, rows):
    """The rows of earlier batches are gone from the ledger's folders, and still no key is scored again."""
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / "ck")
    write(spark, src, "a", [("s", i, "2024-01-01 00:00", 1.0) for i in range(5)])
    drained(spark, src, out, ck)
    held = tmp_path / "ledger" / ledger.last_record(spark, out)["folders"][0]["name"]
    for part in held.glob("*.parquet"):
        part.write_bytes(b"not to be read")
    write(spark, src, "b", [("s", i, "2024-01-02 00:00", 2.0) for i in range(3, 8)])
    drained(spark, src, out, ck)
    new = ledger.last_record(spark, out)["folders"][1]["name"]
    assert rows(spark.read.parquet(f"{out}/{new}"), "item") == [(5,), (6,), (7,)]


def test_a_new_checkpoint_keeps_to_the_ledger(spark, tmp_path, rows):
    src, out = str(tmp_path / "in"), str(tmp_path / "ledger")
    write(spark, src, "a", [("s", 1, "2024-01-01 00:00", 1.0), (None, 2, "2024-01-01 00:00", 1.0)])
    drained(spark, src, out, str(tmp_path / "ck"))
    write(spark, src, "b", [("s", 1, "2024-01-02 00:00", 5.0), (None, 2, "2024-01-02 00:00", 5.0), ("s", 9, "2024-01-02 00:00", 5.0)])
    drained(spark, src, out, str(tmp_path / "ck2"))
    assert rows(ledger.read(spark, out), "item", "value") == [(1, 1.0), (2, 1.0), (9, 5.0)]


def test_the_number_of_folders_is_bounded(spark, tmp_path, rows):
    path = str(tmp_path / "ledger")
    for n in range(20):
        ledger.append(spark.createDataFrame([(n, n % 3)], "item long, v long").coalesce(1), path, "run", n)
    record = ledger.last_record(spark, path)
    assert sorted(f["rows"] for f in record["folders"]) == [1] * 4 + [8] * 2 and record["runs"] == {"run": 19}
    assert rows(ledger.read(spark, path), "item", "batch") == [(n, n) for n in range(20)]
    folders = [p for p in (tmp_path / "ledger").iterdir() if p.name.startswith("data-")]
    assert len(folders) <= 6 + ledger.MERGED and len(list((tmp_path / "ledger" / "_log").glob("*.json"))) <= ledger.RECORDS


def test_windows_count_and_drop_late_rows(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    named = lambda s: s.select("ts", F.col("system").alias("true_class"), F.when(F.col("value") > 5, "x").otherwise("y").alias("predicted_class"))

    dropped = []

    def drain():
        query = windows.window_confusion(named(stream(spark, src)), "ts", "1 hour", "10 minutes", out, ck)
        query.awaitTermination()
        dropped.append(windows.dropped_rows(query))
        return windows.latest_counts(spark, out)

    write(spark, src, "a", [("x", 1, "2024-01-01 00:10", 9.0), ("x", 2, "2024-01-01 00:20", 1.0), ("y", 3, "2024-01-01 00:30", 1.0)])
    assert drain().agg(F.sum("n")).first()[0] == 3
    write(spark, src, "b", [("x", 4, "2024-01-01 05:00", 9.0)])
    drain()
    write(spark, src, "c", [("x", 5, "2024-01-01 00:40", 9.0), ("x", 6, "2024-01-01 05:10", 1.0)])
    counts = drain()
    per_window = {str(r.window_start)[11:16]: (r.samples, round(r.accuracy, 3)) for r in windows.window_accuracy(counts).collect()}
    assert per_window == {"00:00": (3, 0.667), "05:00": (2, 0.5)}  # the row of 00:40 came too late
    assert dropped == [0, 0, 1]
    running = windows.running_accuracy(windows.window_accuracy(counts)).orderBy("window_start").collect()
    assert [round(r.running_accuracy, 3) for r in running] == [0.667, 0.6]
