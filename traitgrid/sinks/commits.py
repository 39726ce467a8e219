"""All-or-nothing publication of cells.

Each run writes the tables of a cell (responses, scores) into folders of its own,
``<table>/run=<run>/model=…/trait=…/value=…``, and last a record, ``commits/<run>``, that names the
cells and how many rows each table has for them. Readers and resume go by the records: a cell is there
with all of its tables or not at all. Folders that no record names were left by a crash; the next run
removes them. One run at a time may write under a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitgrid import storage
from traitgrid.operators.grid import CELL
from traitgrid.sinks.writers import write_cells

TABLES = ("responses", "scores")
RECORD = "model string, trait string, value int, run string, n_responses long, n_scores long"


def write_run(df: DataFrame, root: str, table: str, run: str) -> None:
    write_cells(df, f"{root}/{table}/run={run}")


def publish(spark: SparkSession, root: str, run: str) -> None:
    """The record of a run whose tables are written. Rows are counted from the files."""
    counts = None
    for t in TABLES:
        n = _table(spark, root, t, [run]).groupBy(*CELL).agg(F.count(F.lit(1)).alias(f"n_{t}"))
        counts = n if counts is None else counts.join(n, CELL)
    storage.put_record(counts.select(*CELL, F.lit(run).alias("run"), *[f"n_{t}" for t in TABLES]), f"{root}/commits", run)


def committed_cells(spark: SparkSession, root: str) -> DataFrame:
    """``RECORD`` rows, each cell's last commit. No data file is opened."""
    path = f"{root}/commits"
    rows = storage.read_records(spark, path, RECORD, storage.records(spark, path))
    last = F.max(F.struct("run", "n_responses", "n_scores")).alias("c")
    return rows.groupBy(*CELL).agg(last).select(*CELL, "c.*")


def read_committed(spark: SparkSession, root: str, table: str, cells: DataFrame | None = None) -> DataFrame:
    """A table's rows of committed cells (of ``cells``, if given: ``model, trait, value``). The folders of other
    cells and runs are pruned."""
    done = committed_cells(spark, root)
    if cells is not None:
        done = done.join(cells.select(*CELL).distinct(), CELL, "left_semi")
    data = _table(spark, root, table, None)
    if data is None:
        raise FileNotFoundError(f"nothing is committed under {root}")
    # the comparison (run names are digits first) tells the planner that the records select among the folders
    done = done.filter(F.col("run") >= "0").select(*CELL, "run")
    return data.join(done, [*CELL, "run"], "left_semi").drop("run")


def _table(spark: SparkSession, root: str, table: str, runs: list[str] | None) -> DataFrame | None:
    """A table with its partition columns as written (labels that look like numbers stay text)."""
    base = f"{root}/{table}"
    if runs is None and not storage.names(spark, base):
        return None
    paths = [base] if runs is None else [f"{base}/run={r}" for r in runs]
    kinds = {"run": T.StringType(), "model": T.StringType(), "trait": T.StringType(), "value": T.IntegerType()}
    found = spark.read.option("basePath", base).parquet(*paths).schema
    schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in found])
    return spark.read.schema(schema).option("basePath", base).parquet(*paths)


def clean_up(spark: SparkSession, root: str) -> list[str]:
    """Removes run folders that no record names; their runs."""
    done = set(storage.records(spark, f"{root}/commits"))
    gone = []
    for t in TABLES:
        for name in storage.names(spark, f"{root}/{t}"):
            run = name.removeprefix("run=")
            if name.startswith("run=") and run not in done:
                storage.remove(spark, f"{root}/{t}/{name}")
                gone.append(run)
    return sorted(set(gone))
