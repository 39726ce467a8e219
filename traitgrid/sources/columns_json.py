"""Column-oriented JSON (``{column: {rowIndex: value}}``, one object per file).

``spark.read.json`` would infer one struct field per row index. Here Spark lists the
files (the ``binaryFile`` source, which also keeps partition directories such as
``value=3`` as columns; their contents are not loaded), deals them to tasks, and each task
reads its files a chunk at a time (``column_files``): no file, column or cell is held as a
whole. Values arrive as text and are ``try_cast`` to the declared types (numbers written
as JSON numbers arrive as their text, ``"N/A"`` in a numeric column becomes null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitgrid.schemas import TRAITS
from traitgrid.session import parallelism, ship_package
from traitgrid.sources import column_files

_BINARY_FILE_COLS = {"path", "modificationTime", "length", "content"}


def list_json_files(spark: SparkSession, paths, path_glob: str | None = None, recursive: bool = False) -> DataFrame:
    """``<partition columns>, file_path, file_name, path, length, content`` of the files under ``paths``, dealt to the
    task slots; no file is opened. ``content`` (null elsewhere) is set where only Spark can read the store."""
    reader = spark.read.format("binaryFile")
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    many = list(paths) if isinstance(paths, (list, tuple)) else [paths]
    raw = reader.load(many)
    part_cols = [c for c in raw.columns if c not in _BINARY_FILE_COLS]
    content = F.lit(None).cast("binary") if all(map(_reachable, many)) else F.col("content")
    files = raw.select(*part_cols, F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"),
                       "path", "length", content.alias("content"))
    return files.repartition(parallelism(spark))


def _reachable(path: str) -> bool:
    """Whether workers can open files of this store themselves."""
    scheme = path.split("://")[0] if "://" in path else "file"
    if scheme.startswith("file"):
        return True
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(path)
    except Exception:  # no driver for this scheme here
        return False
    return True


def read_columns_json(spark: SparkSession, paths, columns: dict[str, str], index_name: str = "row_index",
                      path_glob: str | None = None, recursive: bool = False,
                      index_type: str = "long", file_columns: dict[str, Column] | None = None) -> DataFrame:
    """Rows of every file under ``paths``: ``file_path, file_name, <index_name>,
    <columns…>``, after partition columns and ``file_columns`` (made of the file's path or name, once a file). ``columns`` maps JSON column name → Spark type; the row
    indices are the union of the columns' keys, and a column that a file lacks reads as
    nulls. A file that is no such JSON fails the job with its path (nothing is skipped in silence)."""
    files = list_json_files(ship_package(spark), paths, path_glob, recursive)
    made = file_columns or {}
    files = files.select(*[e.alias(c) for c, e in made.items()], *[c for c in files.columns if c not in made])
    carried = [f for f in files.schema if f.name not in ("path", "length", "content")]
    names = list(columns)
    schema = T.StructType([*carried, T.StructField("__k", T.StringType()), *[T.StructField(f"__c{j}", T.StringType()) for j in range(len(names))]])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    same = [f.name for f in carried]

    def read(batches):
        import pyarrow as pa
        for b in batches:
            for i in range(b.num_rows):
                one = {c: b.column(c)[i] for c in (*same, "path", "length", "content")}
                try:
                    with column_files.as_file(one["content"].as_py(), one["path"].as_py()) as f:
                        for keys, values in column_files.rows(f, one["length"].as_py(), names):
                            fixed = [pa.repeat(one[c], len(keys)) for c in same]
                            cols = [*fixed, pa.array(keys, pa.string()), *[pa.array(v, pa.string()) for v in values]]
                            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
                except ValueError as e:
                    raise ValueError(f"not column-oriented JSON: {one['file_path'].as_py()}: {e}") from e

    out = files.mapInArrow(read, schema)
    values = [F.col(f"__c{j}").try_cast(t).alias(c) for j, (c, t) in enumerate(columns.items())]
    return out.select(*same, F.col("__k").try_cast(index_type).alias(index_name), *values)


def json_columns(spark: SparkSession, paths, path_glob: str | None = None, recursive: bool = False) -> list[str]:
    """The distinct column names of all files under ``paths``, sorted. Values are passed over, not parsed."""
    files = list_json_files(ship_package(spark), paths, path_glob, recursive).select("file_path", "path", "length", "content")

    def read(batches):
        import pyarrow as pa
        for b in batches:
            for r in b.to_pylist():
                try:
                    with column_files.as_file(r["content"], r["path"]) as f:
                        found = sorted(set(column_files.column_names(f, r["length"])))
                except ValueError as e:
                    raise ValueError(f"not column-oriented JSON: {r['file_path']}: {e}") from e
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["name"])

    return sorted(r["name"] for r in files.mapInArrow(read, "name string").distinct().collect())


def read_key(spark: SparkSession, paths, traits: list[str] = TRAITS) -> DataFrame:
    """Scoring key (wide): ``item_id, question, <trait weights as double>``."""
    cols = {"question": "string", **{t: "double" for t in traits}}
    return read_columns_json(spark, paths, cols, "item_id", recursive=True).select("item_id", *cols)


def read_personas(spark: SparkSession, paths) -> DataFrame:
    cols = {"Domain": "string", "QualifierType": "string", "Qualifier": "string", "Value": "int",
            "Description": "string"}
    df = read_columns_json(spark, paths, cols, "row_index")
    return df.select(F.col("Domain").alias("domain"), F.col("QualifierType").alias("qualifier_type"),
                     F.col("Qualifier").alias("qualifier"), F.col("Value").alias("value"),
                     F.col("Description").alias("description"))


def read_responses(spark: SparkSession, paths, traits: list[str] = TRAITS, recursive: bool = True,
                   path_glob: str | None = "*.json", index_type: str = "long", file_columns: dict[str, Column] | None = None) -> DataFrame:
    """Response files (key columns + ``responses``, ``numbers_extracted``,
    ``elapsed_times``) of any number of cells, with their file path."""
    cols = {"question": "string", **{t: "double" for t in traits},
            "responses": "string", "numbers_extracted": "string", "elapsed_times": "double"}
    df = read_columns_json(spark, paths, cols, "item_id", path_glob=path_glob, recursive=recursive,
                           index_type=index_type, file_columns=file_columns)
    return (df.withColumnRenamed("responses", "response_text")
              .withColumnRenamed("numbers_extracted", "rating_text")
              .withColumnRenamed("elapsed_times", "elapsed_s"))


# ``<root>/<model>/<trait>_<value>.json`` — one response file per grid cell (a large one goes on in ``….1.json``, …).
CELL_PATH_RE = r"([^/]+)/[^/]*$"
CELL_FILE_RE = r"^([^/_]+)_(\d+)(?:\.\d+)?\.json$"


def read_result_tree(spark: SparkSession, root: str, traits: list[str] = TRAITS,
                     path_glob: str | None = None, index_type: str = "long") -> DataFrame:
    """All response files of a result tree in one read, with their cell.

    Accepts the per-cell file layout ``<root>/<model>/<trait>_<value>.json``
    (cell parsed from the path) and the partitioned layout written by
    ``sinks.write_columns_json(..., chunk_cols=["model", "trait", "value"])``
    (cell from partition discovery). Only cells that exist are read."""
    df = read_responses(spark, root, traits, recursive=False, path_glob=path_glob, index_type=index_type)
    if {"model", "trait", "value"} <= set(df.columns):  # decided from the listing, no job
        return df.withColumn("value", F.col("value").cast("int"))
    p = F.col("file_path")
    cell = {"model": F.url_decode(F.replace(F.regexp_extract(p, CELL_PATH_RE, 1), F.lit("+"), F.lit("%2B"))), "trait": F.regexp_extract("file_name", CELL_FILE_RE, 1),
            "value": F.regexp_extract("file_name", CELL_FILE_RE, 2).try_cast("int")}
    return read_responses(spark, root, traits, recursive=True, path_glob=path_glob or "*.json", index_type=index_type, file_columns=cell)


def read_score_cards(spark: SparkSession, directory: str, traits: list[str] | None = None,
                     path_glob: str | None = "*.json") -> DataFrame:
    """All score cards of a directory in one read, with file name: the files of
    the directory itself (``path_glob``), or — with ``path_glob=None`` — cards
    written by ``sinks.write_score_card`` (run directories become columns).

    Cards need not have the same columns: without ``traits`` the files are looked through first, and every column that
    any card has is read (null where a card lacks it), besides the known traits."""
    if traits is None:
        found = json_columns(spark, directory, path_glob)
        traits = [*TRAITS, *[c for c in found if c not in TRAITS and c != "N/A"]]
    cols = {**{t: "string" for t in traits}, "N/A": "double"}
    df = read_columns_json(spark, directory, cols, "row_index", path_glob=path_glob)
    return df.withColumnRenamed("N/A", "na_share")
