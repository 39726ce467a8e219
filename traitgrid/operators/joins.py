"""Join helpers.

``sized_broadcast`` proves a size bound before hinting a broadcast. The bound is in bytes
and comes from the planner's statistics where it has them (files, literals); only a side
without any is counted, by partial counts. Beyond the bound the plain
DataFrame is returned and the planner picks a shuffle join (AQE may still
convert it at runtime and splits skewed partitions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 1_000_000
DEFAULT_MAX_PARTITIONS = 1024
#: Bytes a row of a dimension may take; the bound in bytes is so many for each row allowed.
ROW_BYTES = 256


def estimated_bytes(df: DataFrame) -> int | None:
    """The planner's size of a side, or None where it knows none (an RDD of rows, Spark Connect)."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        unknown = int(df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes())
    except Exception:  # no access to the plan: count
        return None
    return size if size < unknown else None


def fits(df: DataFrame, max_rows: int, max_partitions: int = DEFAULT_MAX_PARTITIONS) -> bool:
    """True iff ``df`` is small enough to be broadcast: at most ``max_rows`` × ``ROW_BYTES`` by the planner's
    statistics, without a job. A side without statistics is counted (each task counts its own rows, nothing is
    gathered), unless it has more than ``max_partitions`` input splits, which is taken as large."""
    size = estimated_bytes(df)
    if size is not None and size > max_rows * ROW_BYTES:
        return False
    try:
        if df.rdd.getNumPartitions() > max_partitions:
            return False
    except Exception:  # sessions without RDD access (Spark Connect)
        pass
    if size is not None and size <= max_rows * 8:  # no row is smaller
        return True
    return df.count() <= max_rows


def sized_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Use on source-level dimension tables (a scan with a projection/filter). Sides that are themselves aggregates
    of a large input are joined plainly instead: AQE measures them after
    their shuffle stage and broadcasts them only when they turn out small."""
    return F.broadcast(df) if fits(df, max_rows) else df
