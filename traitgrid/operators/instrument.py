"""Instrument (scoring key) operators.

Canonical key is long: ``item_id, question, trait, weight`` with one row per
(item, trait). The wide form (one weight column per trait) is its pivot and
is what the scorer joins against, so the response table is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitgrid.functions.text import PY_WHITESPACE, normalize_item, py_strip
from traitgrid.schemas import TRAIT_CODES, TRAITS


def trait_of_code(code) -> Column:
    """One-letter facet code → trait name (null for unknown codes)."""
    m = F.create_map(*[x for k, v in TRAIT_CODES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, code if isinstance(code, Column) else F.col(code))


def key_long(wide: DataFrame, traits: list[str] = TRAITS, keyed_only: bool = False,
             id_cols: tuple[str, ...] = ("item_id", "question")) -> DataFrame:
    """Wide key → long (one row per item and trait)."""
    out = wide.unpivot(list(id_cols), traits, "trait", "weight")
    out = out.withColumn("weight", F.col("weight").try_cast("double"))
    return keyed_items(out) if keyed_only else out


def key_wide(long: DataFrame, traits: list[str] = TRAITS,
             id_cols: tuple[str, ...] = ("item_id", "question")) -> DataFrame:
    """Long key → one-hot signed wide key; absent (item, trait) pairs get 0.

    A pivot over the explicit trait list written as one conditional aggregate
    (partial + final), not Spark's two-level pivot. An item listing the same
    trait twice keeps the larger weight."""
    w = F.col("weight").cast("double")
    return long.groupBy(*id_cols).agg(
        *[F.coalesce(F.max(F.when(F.col("trait") == t, w)), F.lit(0.0)).alias(t) for t in traits])


def keyed_items(long: DataFrame, traits: list[str] | None = None, sign: float | None = None) -> DataFrame:
    """Items keyed to the given traits (all when None), optionally of one sign.
    Null or NaN weights count as not keyed."""
    cond = F.col("weight").isNotNull() & ~F.isnan("weight") & (F.col("weight") != 0)
    if traits is not None:
        cond = cond & F.col("trait").isin(*traits)
    if sign is not None:
        cond = cond & (F.col("weight") == float(sign))
    return long.filter(cond)


_HEADER_RE = r"^(\S+?):\s*(.*?)\s*\((?:Alpha\s*=\s*)?(\.\d+)\)\s*$"


def parse_inventory(texts: DataFrame, file_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """Inventory text → items.

    A text is a sequence of blank-line-separated blocks. A block whose first
    line is not a ``keyed`` line starts with a facet header (its first
    character is the trait code); the next segment is the sign marker
    (``+`` → 1, anything else → −1) and the remaining lines are items. A block
    without a header continues the most recent header of the same text.
    Items are numbered in text order from 0 within each text.
    """
    blocks = texts.select(F.col(file_col).alias("file_id"),
                          F.posexplode(F.split(F.col(text_col), "\n\n")).alias("block_no", "block"))
    segs = F.split(F.col("block"), "keyed|\n")
    first_line = F.substring_index(F.col("block"), "\n", 1)
    has_header = ~first_line.contains("keyed")
    blocks = blocks.select(
        "file_id", "block_no",
        F.when(has_header, F.element_at(segs, 1)).alias("header"),
        F.when(has_header, F.element_at(segs, 2)).otherwise(F.element_at(segs, 1)).alias("sign_seg"),
        F.when(has_header, F.slice(segs, 3, F.greatest(F.size(segs) - 2, F.lit(0))))
         .otherwise(F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0)))).alias("lines"),
    )
    by_file = Window.partitionBy("file_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    blocks = (blocks
              .withColumn("facet", F.last("header", ignorenulls=True).over(by_file))
              .withColumn("sign", F.when(F.substring(py_strip("sign_seg"), 1, 1) == "+", F.lit(1)).otherwise(F.lit(-1))))
    items = blocks.select("file_id", "block_no", "facet", "sign",
                          F.posexplode("lines").alias("line_no", "line"))
    items = items.filter(F.regexp_replace("line", f"{PY_WHITESPACE}+", "") != "")
    order = Window.partitionBy("file_id").orderBy("block_no", "line_no")
    code = F.substring(py_strip(F.substring(F.col("facet"), 1, 1)), 1, 1)
    return items.select(
        "file_id",
        (F.row_number().over(order) - 1).alias("item_no"),
        trait_of_code(code).alias("trait"),
        F.col("sign").cast("int").alias("sign"),
        F.regexp_extract("facet", _HEADER_RE, 1).alias("facet_code"),
        F.regexp_extract("facet", _HEADER_RE, 2).alias("facet_name"),
        normalize_item("line").alias("question"),
    )


def key_from_inventory(items: DataFrame, traits: list[str] = TRAITS) -> DataFrame:
    """Parsed items → long key (``item_id`` = running number)."""
    return items.select(F.col("item_no").cast("long").alias("item_id"), "question", "trait",
                        F.col("sign").cast("double").alias("weight"))
