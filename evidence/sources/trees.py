"""Class-labelled file trees ``root/split/class/file``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence.operators.gates import set_difference

# File extensions accepted as images.
EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "tif", "tiff"]


def plain_path(column: str):
    """``file:/a`` and ``file:///a`` in one form, so paths of different sources can be joined."""
    return F.regexp_replace(column, r"^([a-z0-9]+):/+", "$1:/")


def _parts(path: str, length) -> list:
    pieces = F.split(path, "/")
    return [
        plain_path(path).alias("path"),
        F.element_at(pieces, -3).alias("split"),
        F.element_at(pieces, -2).alias("class"),
        F.array_join(F.slice(pieces, -2, 2), "/").alias("identifier"),
        F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).alias("extension"),
        length.alias("size_bytes"),
    ]


def list_files(spark: SparkSession, root: str, folders: list[str] = []) -> DataFrame:
    """(path, split, class, identifier, extension, size_bytes) of every file below root.

    Only the listing is used: the content column is pruned, so no file is opened. Spark's file
    sources pass over empty files; name the class folders in ``folders`` to have those listed too.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = files.select(*_parts("path", F.col("length")))
    return found.unionByName(empty_files(spark, folders)) if folders else found


def empty_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The files of length 0 directly in the given folders, listed in one task per folder."""

    def search(batches):
        from pyarrow import fs

        for pdf in batches:
            for folder in pdf["folder"]:
                system, inner = fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") else folder)
                infos = system.get_file_info(fs.FileSelector(inner))
                empty = [f"{folder.rstrip('/')}/{i.base_name}" for i in infos if i.is_file and i.size == 0]
                if empty:
                    yield pd.DataFrame({"path": empty})

    names = spark.createDataFrame([(f if ":" in f else f"file:{f}",) for f in folders], "folder string")
    found = names.repartition(len(folders), "folder").mapInPandas(search, "path string")
    return found.select(*_parts("path", F.lit(0).cast("bigint")))


def scan_class_tree(spark: SparkSession, root: str, split: str, classes: list[str] = []) -> DataFrame:
    """The image files of one split, in case-folded order; with ``classes`` empty files are listed too."""
    base = f"{root.rstrip('/')}/{split}"
    files = list_files(spark, base, [f"{base}/{c}" for c in classes])
    return files.where((F.col("split") == split) & F.col("extension").isin(*EXTENSIONS)).orderBy(F.lower("path"), "path")


def class_problems(files: DataFrame, classes: list[str]) -> DataFrame:
    """(side, value): classes without files, and folders that are not classes."""
    return set_difference(files, classes, "class")


def require_classes(files: DataFrame, classes: list[str]) -> DataFrame:
    """The files, after checking that exactly the expected classes have some."""
    found = class_problems(files, classes).orderBy("side", "value").collect()
    if found:
        raise ValueError("class folders differ: " + ", ".join(f"{r['side']} {r['value']}" for r in found))
    return files


def file_digests(spark: SparkSession, root: str, strip: str = "") -> DataFrame:
    """(path, sha256) of every file below root; ``strip`` is removed from the front of paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(plain_path("path"), "^file:" + strip.rstrip("/") + "/" if strip else "^$", "")
    return files.select(relative.alias("path"), F.sha2("content", 256).alias("sha256"))
