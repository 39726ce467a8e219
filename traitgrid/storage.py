"""Folders and records in whatever store Spark writes to.

A record is a small table in one file: Spark moves it to its place when its job
commits, so it is there as a whole or not at all.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, sorted; none if it is not there. Hidden ones (``_``, ``.``) are left out."""
    fs, p = _store(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in found if n[0] not in "._")


def files(spark: SparkSession, path: str) -> list[str]:
    """Paths, relative to a folder, of all files below it; hidden ones are left out."""
    fs, p = _store(spark, path)
    if not fs.exists(p):
        return []
    base, found, more = fs.resolvePath(p).toString().rstrip("/") + "/", [], fs.listFiles(p, True)
    while more.hasNext():
        found.append(more.next().getPath().toString())
    cut = [f[f.index(base) + len(base):] if base in f else f for f in found]
    return sorted(f for f in cut if f.rsplit("/", 1)[-1][0] not in "._")


def count_files(spark: SparkSession, path: str) -> int:
    """How many files a folder and those below it hold (markers of a finished write among them)."""
    fs, p = _store(spark, path)
    return fs.getContentSummary(p).getFileCount()


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or a folder with all it holds, if it is there."""
    fs, p = _store(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Moves a file into place (folders on the way are made); what is there already is replaced."""
    fs, p = _store(spark, source)
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(to.getParent())
    if not fs.rename(p, to):
        fs.delete(to, False)
        if not fs.rename(p, to):
            raise OSError(f"cannot move {source} to {target}")


def new_name() -> str:
    """A unique name; later ones sort after earlier ones."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def put_record(df: DataFrame, path: str, name: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def records(spark: SparkSession, path: str) -> list[str]:
    """Names of the records under ``path`` that are whole, oldest first."""
    return [n for n in names(spark, path) if any(f.endswith(".json") for f in names(spark, f"{path}/{n}"))]


def read_records(spark: SparkSession, path: str, schema: str, found: list[str]) -> DataFrame:
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path}/{n}" for n in found])
