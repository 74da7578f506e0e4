"""Commit records: small files that one writer alone can create, through the file system of the path."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    """(file system, path) of the Hadoop API."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def create_once(spark: SparkSession, path: str, record: dict) -> bool:
    """Create a record with its whole content; False if it is there already.

    The content is written aside first. A local file is then linked to its name, elsewhere it is renamed without
    leave to overwrite; both fail where the name is taken, so of several writers one wins.
    """
    fs, place = _place(spark, path)
    fs.mkdirs(place.getParent())
    aside = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    text = json.dumps(record, sort_keys=True)
    if fs.getUri().getScheme() == "file":
        local, target = (_place(spark, p)[1].toUri().getPath() for p in (aside, path))
        with open(local, "w") as out:
            out.write(text)
        try:
            os.link(local, target)
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(local)
    out = fs.create(_place(spark, aside)[1], False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(_place(spark, aside)[1], place, options)
        return True
    except Exception:
        delete(spark, aside)
        if fs.exists(place):
            return False
        raise


def names(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder in order; none where there is no folder."""
    fs, place = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def read_record(spark: SparkSession, path: str) -> dict | None:
    """The content of a record, None if there is none. Records are small and read by the driver."""
    fs, place = _place(spark, path)
    if not fs.exists(place):
        return None
    source = fs.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a file; another process may do the same move at the same time."""
    fs, place = _place(spark, path)
    target = _place(spark, to)[1]
    try:
        moved = fs.rename(place, target)
    except Py4JJavaError:
        moved = False
    if not moved and not fs.exists(target):
        raise OSError(f"cannot move {path} to {to}")


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)
