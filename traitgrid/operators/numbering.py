"""Gapless numbering in a global order without a window over all rows.

Rows are dealt to tasks by sampled bounds of the order columns and sorted there;
each task's share of a group starts where the shares of the tasks before it end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from traitgrid.session import shared_path


def written(df: DataFrame, name: str, under: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder (``under`` a folder that the caller removes): fixed, and of known size."""
    path = shared_path(df.sparkSession, name, under)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: list[str], order: list[str | Column], name: str = "pos", under: str | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2 … within each group of the columns ``by`` (none: over
    all rows), in the ascending order of ``order`` (nulls first). Rows equal in all of them
    are numbered in any order, spread over tasks like all others. The result is read
    from the shared folder (``under`` a folder that the caller removes), so the numbers are fixed."""
    keys = {f"__k{i}": c if isinstance(c, Column) else F.col(c) for i, c in enumerate(order)}
    # chance only parts rows that are alike in every column: a task that runs again deals all others as before
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))]
    dealt = df.withColumns(keys | {"__row": F.xxhash64(*plain), "__tie": F.rand(11)})
    sort = [*by, *keys, "__row", "__tie"]
    dealt = dealt.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id())
    table = written(dealt.drop(*keys, "__row", "__tie"), "numbered", under)
    task, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    shares = table.groupBy(*by, task.alias("__task")).agg(F.min(row).alias("__low"), F.count(F.lit(1)).alias("__n"))
    if by:
        # a share per task and group; a group's window holds one row for each of its tasks
        upto = F.sum("__n").over(Window.partitionBy(*by).orderBy("__task").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        shares = shares.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(by)], "__task", (upto - F.col("__n") - F.col("__low")).alias("__shift"))
    else:
        # one row per task: as many as Spark has shuffle partitions
        rows, total = [], 0
        for r in sorted(shares.collect(), key=lambda x: x["__task"]):
            rows.append((r["__task"], total - r["__low"]))
            total += r["__n"]
        shares = df.sparkSession.createDataFrame(rows, "__task long, __shift long")
    shares = written(shares, "numbered-shares", under)
    on = [task == F.col("__task")] + [F.col(c).eqNullSafe(F.col(f"__r{i}")) for i, c in enumerate(by)]
    out = table.join(shares, on).withColumn(name, (F.col("__shift") + row).cast("long"))
    return out.select(*df.columns, name)
