"""Inventory text files, one row per file (parsed by ``operators.instrument``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_inventory_text(spark: SparkSession, paths) -> DataFrame:
    # text()'s own wholetext argument would override a reader option, so pass it here
    raw = spark.read.text(paths if isinstance(paths, (list, tuple)) else [paths], wholetext=True)
    # universal newlines, as a text-mode read gives: \r\n and lone \r become \n
    text = F.regexp_replace("value", "\r\n?", "\n")
    return raw.select(F.col("_metadata.file_path").alias("file_id"), text.alias("text"))
