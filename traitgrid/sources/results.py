"""Result layouts: cell-partitioned response tables, run files, corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitgrid.functions.files import parse_run_file


def read_cells(spark: SparkSession, root: str) -> DataFrame:
    """A response table written with ``sinks.write_cells``; ``model, trait,
    value`` come from partition discovery, so filters on them prune files."""
    return spark.read.parquet(root)


def list_files(spark: SparkSession, directory: str, path_glob: str | None = None) -> DataFrame:
    """``file_name, length`` of the files (not the folders) of a directory; none is opened."""
    reader = spark.read.format("binaryFile")
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    return reader.load(f"{directory.rstrip('/')}/*").select(F.col("_metadata.file_name").alias("file_name"), "length")


def list_cells(spark: SparkSession, root: str) -> DataFrame:
    """``model, trait, value`` of the cells that a table written with ``sinks.write_cells`` has, from the names of its
    folders: no data file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(root).select("path")
    steps = {c: F.regexp_extract("path", f"/{c}=([^/]*)/", 1) for c in ("model", "trait", "value")}
    plain = {c: F.when(e != "__HIVE_DEFAULT_PARTITION__", F.url_decode(F.replace(e, F.lit("+"), F.lit("%2B")))) for c, e in steps.items()}
    return files.select(plain["model"].alias("model"), plain["trait"].alias("trait"), plain["value"].try_cast("int").alias("value")).distinct()


def list_models(cells: DataFrame) -> DataFrame:
    """The models of a table of cells (``list_cells``: of those written)."""
    return cells.select("model").distinct()


def read_run_files(spark: SparkSession, directory: str, path_glob: str = "*.json") -> DataFrame:
    """File names of a run directory, parsed: ``file_name, model, trait, stamp, run_ts``."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", path_glob).load(directory)
             .select(F.col("_metadata.file_name").alias("file_name")))
    return files.select("file_name", parse_run_file("file_name").alias("p")).select("file_name", "p.*")


def read_split(spark: SparkSession, path: str, split: str, split_col: str = "split") -> DataFrame:
    """A question/answer corpus stored with a split column; the filter is pushed
    into the scan (and prunes partitions when written with partitionBy)."""
    return spark.read.parquet(path).filter(F.col(split_col) == split)
