"""Once-only scoring of a stream: every key is scored exactly once, also across restarts.

A ledger is a folder of data folders and of numbered commit records. The last record names the data folders that count, so
readers see whole batches only; a record is created by one writer alone. Equal numbers of small folders are merged into one
of the next level, so n batches leave about log n folders and each row is copied about log n times.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from evidence.sources import commits

#: Folders of one level that are merged, rows of one file of a merged folder, and commit records that are kept.
MERGED, FILE_ROWS, RECORDS = 8, 5_000_000, 20

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": _ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def last_record(spark, path: str) -> dict:
    """The state of a ledger: version, folders with level, rows and runs, the last batch of each run, and retired folders."""
    found = [n for n in commits.names(spark, f"{path}/_log") if n.endswith(".json")]
    empty = {"version": -1, "folders": [], "runs": {}, "retired": [], "clock": ""}
    return commits.read_record(spark, f"{path}/_log/{found[-1]}") if found else empty


def _advance(spark, path: str, record: dict) -> None:
    """Commit the next version; fails if another writer of the ledger was first."""
    name = f"{path}/_log/{record['version']:020d}.json"
    if not commits.create_once(spark, name, record):
        raise RuntimeError(f"another writer advanced the ledger: {name}")


def read(spark, path: str, schema: StructType | None = None) -> DataFrame:
    """All rows of the ledger with the batch that wrote them, as of the last commit."""
    folders = [f"{path}/{f['name']}" for f in last_record(spark, path)["folders"]]
    if not folders:
        return spark.createDataFrame([], schema or StructType([]))
    return (spark.read.schema(schema) if schema else spark.read).parquet(*folders)


def scored_keys(spark, path: str, keys: list[StructField]) -> DataFrame:
    """(keys…) of the ledger so far; only the key columns are read."""
    return read(spark, path, StructType(keys))


def append(df: DataFrame, path: str, run: str, batch: int, clock: str = "") -> bool:
    """Commit the rows of one batch of a run; False, and nothing written, if that batch was committed before."""
    spark = df.sparkSession
    before = last_record(spark, path)
    if batch <= before["runs"].get(run, -1):
        return False
    name = f"data-{batch:012d}-{uuid.uuid4().hex}"
    df.withColumn("batch", F.lit(batch).cast("long")).write.parquet(f"{path}/{name}")
    rows = spark.read.parquet(f"{path}/{name}").count()  # from the files' footers
    folders = before["folders"] + ([{"name": name, "level": 0, "rows": rows, "runs": [run]}] if rows else [])
    _advance(spark, path, before | {
        "version": before["version"] + 1, "folders": folders, "runs": before["runs"] | {run: batch}, "clock": max(before["clock"], clock),
    })
    if not rows:
        commits.delete(spark, f"{path}/{name}")
    compact(spark, path)
    return True


def compact(spark, path: str) -> None:
    """Merge folders of one level while there are enough of them, and drop what earlier merges replaced.

    Replaced folders stay until the next merge, for readers of an older record. A crash leaves the last record valid and at
    most a folder that no record names.
    """
    while True:
        record = last_record(spark, path)
        levels: dict[int, list[dict]] = {}
        for folder in record["folders"]:
            levels.setdefault(folder["level"], []).append(folder)
        full = next((fs[:MERGED] for _, fs in sorted(levels.items()) if len(fs) >= MERGED), None)
        if full is None:
            break
        rows = sum(f["rows"] for f in full)
        name = f"data-{uuid.uuid4().hex}"
        parts = [spark.read.parquet(f"{path}/{f['name']}") for f in full]
        merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        merged.coalesce(max(1, -(-rows // FILE_ROWS))).write.parquet(f"{path}/{name}")
        old = {f["name"] for f in full}
        new = {"name": name, "level": full[0]["level"] + 1, "rows": rows, "runs": sorted({r for f in full for r in f["runs"]})}
        _advance(spark, path, record | {
            "version": record["version"] + 1, "folders": [f for f in record["folders"] if f["name"] not in old] + [new], "retired": sorted(old),
        })
        for gone in record["retired"]:
            commits.delete(spark, f"{path}/{gone}")
    for old in [n for n in commits.names(spark, f"{path}/_log") if n.endswith(".json")][:-RECORDS]:
        commits.delete(spark, f"{path}/_log/{old}")


def once_only(
    stream: DataFrame,
    keys: list[str],
    order: str,
    score: Callable[[DataFrame], DataFrame],
    ledger: str,
    checkpoint: str,
    max_wait: str | None = None,
):
    """Append each key's first item, scored, to the ledger; runs until the input is drained.

    Of the items of a key the first batch counts, in it the first by ``order``, and of equal ones the smallest by all other
    columns. Keyed state holds the first item of every key and when it came (the time of its batch, which a
    repeated batch keeps), so a batch touches the state of its own keys only, however long the history. A batch that is repeated
    after a failure finds the same items new; the ledger's record tells if it had been committed.

    The ledger itself is read only where state cannot know a key: keys that another run with its own checkpoint wrote,
    batches whose clock went back, and with ``max_wait``, which bounds the state to duplicates that come within that time.
    """
    spark = stream.sparkSession
    others = [order, *sorted(c for c in stream.columns if c not in keys and c != order)]
    run: list[str] = []

    if max_wait is None:
        # a key of this batch is new if its first item came in this batch
        timed = stream.withColumn("_seen", F.current_timestamp())
        source = timed.groupBy(*keys).agg(F.min(F.struct("_seen", *others)).alias("_r"), F.max("_seen").alias("_now"))
    else:
        source = stream.withWatermark(order, max_wait).dropDuplicatesWithinWatermark(keys)

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if not run:
            run.append(session.read.text(f"{checkpoint}/metadata").first()[0])
        # the batch runs once, whole, so that its state is committed once; what follows reads the new items only
        staged = f"{ledger}/_staged-{uuid.uuid4().hex}"
        if max_wait is None:
            new = batch.where("_r._seen = _now").select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others], "_now")
        else:
            new = batch.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_r")).select(*keys, "_r.*", F.lit(None).alias("_now").cast("timestamp"))
        new.write.parquet(staged)
        fresh = session.read.schema(new.schema).parquet(staged)
        record = last_record(session, ledger)
        if number > record["runs"].get(run[0], -1):
            clock = str(fresh.agg(F.max("_now")).first()[0] or "")
            folders = record["folders"]
            if max_wait is None and (not clock or clock > record["clock"]):
                folders = [f for f in folders if set(f["runs"]) != {run[0]}]
            fresh = fresh.drop("_now")
            if folders:
                known = StructType([f for f in fresh.schema.fields if f.name in keys])
                held = session.read.schema(known).parquet(*[f"{ledger}/{f['name']}" for f in folders]).select(*[F.col(k).alias(f"_{k}") for k in keys])
                fresh = fresh.join(held, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti")
            append(score(fresh), ledger, run[0], number, clock)
        commits.delete(session, staged)

    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():  # state on disk and checkpoints of changes alone; a query keeps what it was started with
        spark.conf.set(k, v)
    try:
        writer = source.writeStream.outputMode("update" if max_wait is None else "append")
        return writer.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
