"""Readers and writers for manifests, metrics, predictions, caches, registries, runs, prompts, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence.operators.gates import identity_check
from evidence.sources import commits

# --- write once -------------------------------------------------------------------------


def write_once(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Write a table that must not exist yet; JSON gets its keys in sorted order.

    Every writer writes into a hidden folder of its own. The commit record, which one writer alone can create, names the files of
    the winner; only then they are moved into place. All other writers fail and leave nothing.
    """
    spark = df.sparkSession
    if commits.names(spark, path) and (commits.read_record(spark, f"{path}/{_RECORD}") or _visible(spark, path)):
        raise FileExistsError(f"[PATH_ALREADY_EXISTS] {path} is written already")
    attempt = f"_attempt-{uuid.uuid4().hex}"
    out = df.select(*sorted(df.columns)) if format == "json" else df
    out.write.format(format).save(f"{path}/{attempt}")
    held = [n for n in commits.names(spark, f"{path}/{attempt}") if n[0] not in "._"]
    if not commits.create_once(spark, f"{path}/{_RECORD}", {"attempt": attempt, "files": held, "format": format}):
        commits.delete(spark, f"{path}/{attempt}")
        raise FileExistsError(f"[PATH_ALREADY_EXISTS] {path} was written by another writer")
    settle(spark, path)


_RECORD = "_COMMITTED"


def _visible(spark: SparkSession, path: str) -> list[str]:
    return [n for n in commits.names(spark, path) if n[0] not in "._"]


def settle(spark: SparkSession, path: str) -> None:
    """Move the files of a committed writer into place; goes on where one that crashed has stopped."""
    record = commits.read_record(spark, f"{path}/{_RECORD}")
    waiting = set(commits.names(spark, f"{path}/{record['attempt']}"))
    for name in record["files"]:
        if name in waiting:
            commits.move(spark, f"{path}/{record['attempt']}/{name}", f"{path}/{name}")
    commits.delete(spark, f"{path}/{record['attempt']}")


def read_once(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table of ``write_once``: the files that its record names, and no others; fails if nothing was committed."""
    record = commits.read_record(spark, f"{path}/{_RECORD}")
    if record is None:
        raise FileNotFoundError(f"nothing is committed at {path}")
    if set(record["files"]) - set(_visible(spark, path)):
        settle(spark, path)
    reader = spark.read.format(record["format"])
    return (reader.schema(schema) if schema else reader).load([f"{path}/{n}" for n in record["files"]])


def file_digest(spark: SparkSession, path: str) -> str:
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


# --- manifests --------------------------------------------------------------------------


def read_manifest(spark: SparkSession, path: str, sha256: str | None = None, count: int | None = None) -> DataFrame:
    """The rows of the ``images`` list of a JSON manifest, after checking its digest and length."""
    if sha256 is not None and file_digest(spark, path) != sha256:
        raise ValueError(f"manifest changed after it was frozen: {path}")
    body = spark.read.json(path, multiLine=True)
    if count is not None:
        held = body.select(F.size("images")).first()[0]
        if held != count:
            raise ValueError(f"manifest has {held} images, not {count}")
    return body.select(F.explode("images").alias("i")).select("i.*")


# --- metric files -----------------------------------------------------------------------

_CLASS = "precision double, recall double, `f1-score` double, f1 double, support double"


def read_metrics(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(per file, per file and class) metrics from both layouts of metric files.

    Class metrics sit under ``classification_report`` or ``per_class``; the weighted F1 sits at
    the top or inside the report.
    """
    outer = "accuracy double, macro_f1 double, weighted_f1 double, classification_report map<string,string>, per_class map<string,string>"
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", outer).alias("m"))
    report = F.coalesce(F.col("m.classification_report"), F.col("m.per_class"))
    inside = lambda key: F.from_json(F.try_element_at(report, F.lit(key)), _CLASS)
    totals = files.select(
        "file", F.col("m.accuracy").alias("accuracy"),
        F.coalesce(F.col("m.weighted_f1"), inside("weighted avg")["f1-score"]).alias("weighted_f1"),
        F.coalesce(F.col("m.macro_f1"), inside("macro avg")["f1-score"]).alias("macro_f1"),
    )
    classes = files.select("file", F.explode(report).alias("class", "v")).where(
        ~F.col("class").isin("accuracy", "macro avg", "weighted avg", "micro avg")
    ).withColumn("c", F.from_json("v", _CLASS))
    return totals, classes.select(
        "file", "class", F.col("c.precision").alias("precision"), F.col("c.recall").alias("recall"),
        F.coalesce(F.col("c.f1"), F.col("c.f1-score")).alias("f1"), F.col("c.support").cast("bigint").alias("support"),
    )


# --- predictions ------------------------------------------------------------------------

# Names and types of the columns of a prediction file, in file order.
PREDICTION_COLUMNS = {
    "condition": "string", "system": "string", "image_identifier": "string", "ground_truth_class": "string",
    "predicted_class": "string", "correct": "boolean", "fruit_identity_correct": "boolean",
    "freshness_condition_correct": "boolean", "score": "double", "margin": "double", "score_kind": "string",
    "score_warning": "string",
}


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A prediction CSV with "True"/"False" as booleans; the schema is given, never inferred."""
    raw = ", ".join(f"{c} {'string' if t == 'boolean' else t}" for c, t in PREDICTION_COLUMNS.items())
    rows = spark.read.schema(raw).csv(path, header=True, escape='"')
    return rows.select(
        *[(F.col(c) == "True").alias(c) if t == "boolean" else F.col(c) for c, t in PREDICTION_COLUMNS.items()]
    )


def write_predictions(df: DataFrame, path: str) -> None:
    text = lambda c: F.when(F.col(c), "True").when(~F.col(c), "False").alias(c)
    df.select(*[text(c) if t == "boolean" else F.col(c) for c, t in PREDICTION_COLUMNS.items()]).write.mode(
        "errorifexists").csv(path, header=True, escape='"')


# --- embedding caches -------------------------------------------------------------------


def write_embedding_cache(df: DataFrame, identity: dict[str, str], path: str) -> None:
    """(sample_id, label, embedding) as Parquet with the identity in a table beside it."""
    df.select("sample_id", "label", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("errorifexists").parquet(f"{path}/vectors")
    rows = [(k, str(v)) for k, v in sorted(identity.items())]
    df.sparkSession.createDataFrame(rows, "field string, value string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/identity")


def read_embedding_cache(spark: SparkSession, path: str, expected: dict[str, str] | None = None) -> DataFrame:
    """The vectors of a cache, after comparing its whole identity (one row per field) with the expected one."""
    if expected is not None:
        recorded = {r["field"]: r["value"] for r in spark.read.parquet(f"{path}/identity").collect()}
        wrong = identity_check(recorded, {k: str(v) for k, v in expected.items()})
        if wrong:
            raise ValueError(f"cache identity differs in {', '.join(wrong)}: {path}")
    return spark.read.parquet(f"{path}/vectors")


# --- registries, runs, prompts ----------------------------------------------------------


def read_hash_registry(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) from lines ``<hex>  <path>``."""
    parts = F.split("value", "  ", 2)
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(
        F.get(parts, F.lit(1)).alias("path"), F.lower(F.get(parts, F.lit(0))).alias("sha256")
    )


def write_hash_registry(digests: DataFrame, path: str) -> None:
    digests.select(F.concat_ws("  ", "sha256", "path").alias("value")).orderBy("value").write.mode("errorifexists").text(path)


def read_run_records(spark: SparkSession, glob: str, schema: str | None = None) -> DataFrame:
    """Run records with the budget and seed found in their paths (``budget_<n>/seed_<n>.json``)."""
    reader = spark.read.schema(schema) if schema else spark.read
    runs = reader.json(glob, multiLine=True).withColumn("file", F.input_file_name())
    number = lambda name: F.regexp_extract("file", name + r"_0*([0-9]+)", 1)
    return runs.withColumn("path_budget", F.nullif(number("budget"), F.lit("")).cast("int")).withColumn(
        "path_seed", F.nullif(number("seed"), F.lit("")).cast("int"))


def read_prompt_registry(spark: SparkSession, path: str) -> DataFrame:
    """(family, family_order, class, class_order, prompt_idx, text) from a YAML registry.

    A registry is a hand-written page of text, so it is parsed where the job starts.
    """
    import yaml

    body = spark.read.text(path, wholetext=True).first()[0]
    registry = yaml.safe_load(body)
    rows = [
        (family, i, cls, j, k, text)
        for i, (family, spec) in enumerate(registry["families"].items())
        for j, (cls, prompts) in enumerate(spec["prompts"].items())
        for k, text in enumerate(prompts)
    ]
    return spark.createDataFrame(rows, "family string, family_order int, class string, class_order int, prompt_idx int, text string")


def prompt_problems(prompts: DataFrame, families: list[str], classes: list[str], counts: dict[str, int], canonical: DataFrame) -> DataFrame:
    """(problem, where): wrong family or class order, wrong counts, canonical texts that differ.

    ``canonical`` holds (family, class, text) rows that must match exactly.
    """
    at = lambda names, c: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)) - 1
    order = prompts.where((at(families, "family") != F.col("family_order")) | (at(classes, "class") != F.col("class_order")))
    wanted = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    grid = prompts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f) for f in families])).alias("family")).select(
        "family", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    counted = prompts.groupBy("family", "class").agg(F.count(F.lit(1)).alias("n"))
    wrong = grid.join(counted, ["family", "class"], "full_outer").where(~F.col("n").eqNullSafe(F.try_element_at(wanted, F.col("family")).cast("bigint")))
    place = F.concat_ws("/", "family", "class")
    fixed = prompts.join(canonical.select("family").distinct(), "family", "left_semi").select("family", "class", "text")
    texts = fixed.exceptAll(canonical).unionByName(canonical.exceptAll(fixed))
    return (
        order.select(F.lit("order").alias("problem"), place.alias("where"))
        .unionAll(wrong.select(F.lit("count"), place)).unionAll(texts.select(F.lit("text"), place)).distinct()
    )


# --- reports ----------------------------------------------------------------------------


def export_report(summary: DataFrame, report: DataFrame, system: str = "system") -> DataFrame:
    """(system, json): totals and per-class metrics of each system as one nested document."""
    totals = [c for c in sorted(summary.columns) if c != system]
    per_class = report.groupBy(system).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("class"), F.struct("f1", "precision", "recall", "support"))))).alias("per_class")
    )
    return summary.join(per_class, system).select(
        system, F.to_json(F.struct(*sorted([*totals, "per_class"]))).alias("json")
    )


def utc_timestamp():
    """The current time as ISO-8601 text in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
