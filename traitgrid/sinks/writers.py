"""Writers.

Results are partitioned by cell (``model/trait/value``) with dynamic partition
overwrite: re-running a cell (or a retried task) replaces exactly that cell,
and the resume step reads which cells exist from the partition listing.
"""

from __future__ import annotations

import json
from itertools import groupby
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from traitgrid import storage
from traitgrid.operators.grid import CELL
from traitgrid.operators.numbering import numbered, written
from traitgrid.schemas import TRAITS
from traitgrid.session import CLEANUP, configured, parallelism, shared_path, ship_package

#: Rows of column files that are dealt, sorted and turned into text at once (more where these would be fewer than four files for each task slot).
WAVE_ROWS = 16_000_000


def write_cells(responses: DataFrame, path: str, cell_cols: list[str] = CELL, fmt: str = "parquet",
                rebalance: bool = True) -> None:
    """Cell-partitioned write. The ``rebalance`` hint shuffles rows by cell and
    lets AQE coalesce small partitions and split skewed ones, so a cell lands in
    few files without one task having to write a huge cell alone. Pass
    ``rebalance=False`` for output of a non-deterministic step (model replies):
    it is then written by the tasks that produced it, with no shuffle whose loss
    could force the step to run again."""
    df = responses.hint("rebalance", *cell_cols) if rebalance else responses
    (df.sortWithinPartitions(*cell_cols).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*cell_cols).format(fmt).save(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    df.write.mode(mode).format(fmt).save(path)


def _lines(group: list[str], index: str, cols: list[str], schema):
    """Rows sorted by file and index → the lines of the files: ``group…, __j, __i, line``. Each batch of a file's rows gives a line for each
    column; sorted by ``__j`` (column) and ``__i``, a file's lines make up one JSON object, and no task holds a file."""
    def run(batches):
        import pyarrow as pa

        def emit(name, js, at, texts):
            return pa.RecordBatch.from_arrays([*[pa.array([v] * len(js), type=f.type) for v, f in zip(name, schema)],
                                               pa.array(js, pa.int32()), pa.array([at] * len(js), pa.int64()), pa.array(texts, pa.string())], schema=schema)

        def close(name, at):
            return emit(name, list(range(len(cols))), at, ["}" + ("}" if j == len(cols) - 1 else "") for j in range(len(cols))])

        name, at = None, 0
        for b in batches:
            names = list(zip(*[b.column(c).to_pylist() for c in group], strict=True))
            start = 0
            for key, run_ in groupby(names):
                stop = start + sum(1 for _ in run_)
                if key != name:
                    if name is not None:
                        yield close(name, at)
                    name, at = key, 0
                index_ = b.column(index).slice(start, stop - start).cast(pa.string()).to_pylist()
                texts = []
                for j, c in enumerate(cols):
                    body = json.dumps(dict(zip(index_, b.column(c).slice(start, stop - start).to_pylist(), strict=True)), ensure_ascii=False, separators=(",", ":"))[1:-1]
                    head = "," if at else ("{" if j == 0 else ",") + json.dumps(c, ensure_ascii=False) + ":{"
                    texts.append(head + body)
                yield emit(name, list(range(len(cols))), at, texts)
                at, start = at + 1, stop
        if name is not None:
            yield close(name, at)

    return run


def write_column_files(df: DataFrame, root: str, index_col: str, folders: list[str], file: Column, rows_per_file: int = 1_000_000,
                       columns: list[str] | None = None, plain: bool = False, beside: DataFrame | None = None, on: str = "") -> list[str]:
    """Column-oriented JSON files under their real names: ``root/<folders>/<file>.json``; the paths written.

    ``folders`` are columns: partition folders (``model=…``), or with ``plain`` folders of their values alone. ``file`` is
    a file's name without ``.json``. Rows are counted: a file of more than ``rows_per_file`` is cut into
    ``<file>.json``, ``<file>.1.json``, …, in the order of ``index_col`` (unique in a file). Lines are written to a staging folder by Spark
    and moved into place, file by file, when the whole job has succeeded; a job that fails leaves nothing. A number that is
    not finite becomes null. (Hadoop's paths take no colon.)

    Many rows are stored once and go to their files in waves of about ``WAVE_ROWS``: what a wave has shuffled, spilled and stored is removed with its
    end, so that it lies beside the files only for one wave at a time.

    ``beside`` has more columns, by ``on``: it is broadcast to rows that are dealt to their files already, so that the shuffle does not
    carry them. ``columns`` then names all columns of the files."""
    spark = ship_package(df.sparkSession)
    cols = columns or [c for c in df.columns if c != index_col and c not in folders]
    group = [*folders, "__file"]
    df = df.withColumn("__file", file)
    staging = f"{root.rstrip('/')}/.staging-{storage.new_name()}"
    held = shared_path(spark, "column-files")
    try:
        with configured(spark, {CLEANUP: "true"}):
            sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
            names = [f"__s{i}" for i in range(len(group))]
            sizes = written(sizes, "file-sizes", held).select(*[F.col(c).alias(s) for c, s in zip(group, names, strict=True)], "__n")
            waves = _waves(sizes, rows_per_file)
            if waves > 1:
                before = F.sum("__n").over(Window.orderBy(*names)) - F.col("__n")  # a row for each file
                sizes = sizes.withColumn("wave__", F.floor(before * waves / F.sum("__n").over(Window.partitionBy())).cast("int"))
            rows = df.join(sizes, [F.col(c).eqNullSafe(F.col(s)) for c, s in zip(group, names, strict=True)]).drop(*names)
            stages = [staging]
            if waves == 1:
                _write_lines(rows, staging, index_col, group, cols, rows_per_file, beside, on, held)
            else:
                fixed = [*folders, "__file", "__n", index_col, on]
                rows = rows.select(*[c if c in fixed else _value(c, kind) for c, kind in rows.dtypes if c in (*fixed, *cols)], "wave__")
                stored, schema = f"{held}/rows", rows.drop("wave__").schema
                rows.write.partitionBy("wave__").parquet(stored)
                stages = [f"{staging}/{r[0]}" for r in sizes.select("wave__").distinct().sort("wave__").collect()]
                for stage in stages:
                    now = f"{stored}/wave__={stage.rsplit('/', 1)[1]}"
                    _write_lines(spark.read.schema(schema).parquet(now), stage, index_col, group, cols, rows_per_file, beside, on, meanwhile := f"{held}/wave")
                    storage.remove(spark, now)
                    storage.remove(spark, meanwhile)
        out = []
        for stage in stages:
            for path in storage.files(spark, stage):
                steps = path.split("/")[:-1]  # folders and file name, as partition folders
                last = unquote(steps[-1].partition("=")[2])
                inside = [unquote(s.partition("=")[2]) for s in steps[:-1]] if plain else steps[:-1]
                target = "/".join([root.rstrip("/"), *inside, last])
                if target in out:
                    raise ValueError(f"{target} was written in more than one piece (spark.sql.files.maxRecordsPerFile?)")
                storage.move(spark, f"{stage}/{path}", target)
                out.append(target)
    finally:
        storage.remove(spark, staging)
        storage.remove(spark, held)
    return sorted(out)


def _value(c: str, kind: str) -> Column:
    """A column as the files have it."""
    if kind in ("double", "float"):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c)
    return F.col(c) if kind in ("string", "boolean", "tinyint", "smallint", "int", "bigint") else F.col(c).cast("string").alias(c)


def _waves(sizes: DataFrame, rows_per_file: int) -> int:
    """In how many turns files of these sizes are written."""
    r = sizes.agg(F.sum("__n").alias("rows"), F.sum(F.ceil(F.col("__n") / rows_per_file)).alias("files")).first()
    return max(1, min(-(-(r["rows"] or 0) // WAVE_ROWS), (r["files"] or 0) // (4 * parallelism(sizes.sparkSession))))


def _write_lines(rows: DataFrame, staging: str, index_col: str, group: list[str], cols: list[str], rows_per_file: int, beside: DataFrame | None, on: str, held: str) -> None:
    """Writes the lines of the files of ``rows`` (``__n``: rows of the row's file); what it stores meanwhile lies in ``held``."""
    folders, dealt = group[:-1], rows.withColumn("__part", F.lit(0).cast("long"))
    if not rows.filter(F.col("__n") > rows_per_file).isEmpty():
        at = numbered(rows.filter(F.col("__n") > rows_per_file), group, [index_col], "__at", held)
        dealt = dealt.filter(F.col("__n") <= rows_per_file).unionByName(at.withColumn("__part", F.floor(F.col("__at") / rows_per_file)).drop("__at"))
    name = F.when(F.col("__part") == 0, F.concat("__file", F.lit(".json"))).otherwise(F.concat("__file", F.lit("."), F.col("__part").cast("string"), F.lit(".json")))
    kinds = dict(rows.dtypes) | dict(beside.dtypes if beside is not None else [])
    values = [_value(c, kinds[c]) for c in cols]
    dealt = dealt.select(*folders, name.alias("__file"), F.col(index_col).alias("__order"), *[c for c in rows.columns if c in (*cols, on)])
    dealt = dealt.repartition(*group)
    if beside is not None:
        dealt = dealt.join(F.broadcast(beside), on)  # before the sort: Spark drops a sort below a join
    dealt = dealt.sortWithinPartitions(*group, "__order").select(*group, F.col("__order").cast("string").alias("__index"), *values)
    schema = T.StructType([*[dealt.schema[c] for c in group], T.StructField("__j", T.IntegerType()), T.StructField("__i", T.LongType()), T.StructField("line", T.StringType())])
    lines = dealt.mapInArrow(_lines(group, "__index", cols, to_arrow_schema(schema)), schema)
    lines.sortWithinPartitions(*group, "__j", "__i").select(*group, "line").write.partitionBy(*group).text(staging)


def write_columns_json(df: DataFrame, path: str, index_col: str, rows_per_file: int = 1000,
                       chunk_cols: list[str] | None = None) -> None:
    """Column-oriented JSON export: one ``{column: {index: value}}`` object per
    file, at most ``rows_per_file`` rows a file, in partition folders of ``chunk_cols`` (e.g. a grid cell:
    ``model/trait/value``). What was at ``path`` is replaced."""
    storage.remove(df.sparkSession, path)
    write_column_files(df, path, index_col, chunk_cols or [], F.lit("part"), rows_per_file)


def write_response_files(responses: DataFrame, root: str, index_col: str = "item_id", rows_per_file: int = 1_000_000,
                         columns: list[str] | None = None, beside: DataFrame | None = None, on: str = "") -> list[str]:
    """Response files of grid cells, ``root/<model>/<trait>_<value>.json``."""
    file = F.concat_ws("_", F.col("trait"), F.col("value").cast("string"))
    cols = columns or [c for c in responses.columns if c not in (*CELL, index_col)]
    return write_column_files(responses, root, index_col, ["model"], file, rows_per_file, cols, plain=True, beside=beside, on=on)


def write_run_cards(cards: DataFrame, root: str, file_col: str = "file_name", traits: list[str] | None = None) -> list[str]:
    """Score cards under their run file names (``functions.files.run_file_name``), one row each; traits a card has
    no value for are left out of no file, but null."""
    traits = traits or [t for t in TRAITS if t in cards.columns]
    share = "na_share_rounded" if "na_share_rounded" in cards.columns else "na_share"
    rows = cards.select(F.lit(0).alias("__row"), F.regexp_replace(file_col, r"\.json$", "").alias("__name"), *traits, F.col(share).alias("N/A"))
    return write_column_files(rows, root, "__row", [], F.col("__name"), columns=[*traits, "N/A"])


def write_score_card(card: DataFrame, path: str, run_cols: list[str] | None = None,
                     traits: list[str] | None = None) -> None:
    """One column-oriented card file per run (``{trait: {"0": "m+-s"}, "N/A":
    {"0": share}}``, the card layout), in ``run=…`` directories. The rounded
    share goes under the card's own name ``N/A``."""
    traits = [t for t in (traits or TRAITS) if t in card.columns]
    share = "na_share_rounded" if "na_share_rounded" in card.columns else "na_share"
    run_cols = run_cols or [c for c in card.columns
                            if c not in traits and c not in ("n_rows", "n_na", "na_share", "na_share_rounded")]
    rows = card.select(*run_cols, F.lit(0).alias("__row"), *traits, F.col(share).alias("N/A"))
    write_columns_json(rows, path, index_col="__row", chunk_cols=run_cols)


def write_markdown(lines: DataFrame, path: str, group_cols: list[str]) -> None:
    """One text file per group, lines in order; groups are written in parallel."""
    (lines.repartition(*group_cols).sortWithinPartitions(*group_cols, "line_no")
     .select(*group_cols, "line").write.mode("overwrite").partitionBy(*group_cols).text(path))


def training_dataset(examples: DataFrame, cols: tuple[str, ...] = ("question", "prompt", "answer")) -> DataFrame:
    """Training rows without the index column."""
    return examples.select(*[c for c in cols if c in examples.columns])
