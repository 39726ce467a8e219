"""Helpers shared by the operators: durable cuts of lineage, Arrow maps over
bounded slices of text, and gapless numbering without a single-task window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traitgrid.session import CLEANUP, configured, shared_path, ship_package

SLICE_BYTES = 1 << 21
#: Words of a text, as every contract here has them; on UTF-8 bytes this is bytes.split().
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and
    a lost executor costs no recomputation. Nothing reads the shuffles of the write again,
    so Spark removes their files with its end (else when the driver happens to collect its garbage)."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with configured(spark, {CLEANUP: "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, limit: int, rows: int):
    """What runs meanwhile hands Python at most ``limit`` bytes (or a row) at once, and reads Parquet by ``rows`` rows: for tables
    of long values, of which the usual batches (thousands of rows) hold a whole file several times over."""
    return configured(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(limit), "spark.sql.parquet.columnarReaderBatchSize": str(rows)})


def cut(df: DataFrame) -> DataFrame:
    """``stored`` for small, iterated state. A table on disk also has its true size:
    a checkpoint keeps the plan's estimate, and the product of its joins grows
    round by round until the planner fails on it."""
    return stored(df, "state")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about ``limit`` bytes in ``column`` (at least one
    row each), so that what a task holds does not follow the Arrow batch size."""
    for b in batches:
        if not b.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(n + 64) // limit
        at = np.flatnonzero(np.diff(run)) + 1
        for i, j in zip([0, *at], [*at, len(n)], strict=True):
            yield b.slice(i, j - i)


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[list]], schema: str,
             column: str = "text") -> DataFrame:
    """``mapInArrow`` over slices of ``df``; ``fn`` yields the output's columns as
    lists or arrays, in the schema's order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for part in slices(batches, column):
            for cols in fn(part):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type, from_pandas=False) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def as_bytes(name: str = "text") -> Column:
    return F.col(name).cast("binary").alias(name)


def running(df: DataFrame, by: list[str], bucket: list[Column], order: list[Column], amount: Column) -> DataFrame:
    """Adds ``before``: the sum of ``amount`` over the rows of the same ``by`` that
    come earlier, in the order bucket columns, then ``order``.

    One window per group would put a hot group into one task. Here rows are
    dealt by (group, bucket): bucket totals are added up first (partial
    aggregation; the window over them sees buckets, not rows), then each bucket
    counts on from its own offset."""
    names = [f"__b{i}" for i in range(len(bucket))]
    df = df.withColumns(dict(zip(names, bucket, strict=True)) | {"__a": amount})
    totals = df.groupBy(*by, *names).agg(F.sum("__a").alias("__t"))
    w = Window.partitionBy(*by).orderBy(*names) if by else Window.orderBy(*names)
    offsets = totals.select(*by, *names, (F.sum("__t").over(w) - F.col("__t")).alias("__o"))
    w = Window.partitionBy(*by, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    right = offsets.select(*[F.col(c).alias(f"__r{c}") for c in [*by, *names]], "__o")
    on = [F.col(c).eqNullSafe(F.col(f"__r{c}")) for c in [*by, *names]]
    inside = df.withColumn("__s", F.sum("__a").over(w) - F.col("__a"))
    return (inside.join(right, on).withColumn("before", F.col("__o") + F.col("__s"))
            .drop(*names, *[f"__r{c}" for c in [*by, *names]], "__o", "__s", "__a"))
