"""Derived fixtures D1–D7: questionnaire-shaped tables computed by Spark from the
driver's test tables, so every registered query scales with them.

Each ``dN_*`` has a SQL twin in ``plans/oracle.py``; keep them in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitgrid.schemas import TRAITS

# Labels used by D6; the 4th and 5th exercise the provider rules.
D6_MODELS = ["Qwen2.5-1.5B", "Qwen-1.5B-GRPO", "Qwen2.5-3B", "hyperbolic-Qwen2.5-1.5B-Instruct", "claude-3-haiku"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], idx) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx.cast("int") + 1)


def d1_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response table: model = return flag, persona value 1..9, item = part key,
    rating = line number when ≤ 5 else 'N/A'."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("model"),
        (F.lit(1) + F.col("l_suppkey") % 9).cast("int").alias("value"),
        F.col("l_partkey").alias("item_id"),
        F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber").cast("string")).otherwise(F.lit("N/A")).alias("rating_text"),
    )


def d1_cell_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, bool]:
    """D1 as response-file rows of grid cells, without the item's own columns: each response goes to the cell of its
    item's trait; the row key is ``orderkey:linenumber:partkey:suppkey`` (unique) and a file holds one cell's
    rows of at most 1,000,000 orders. Beside them the items' question and weights, and whether these may be broadcast."""
    from traitgrid.operators.instrument import key_wide
    from traitgrid.operators.joins import fits
    li = table(spark, sf_dir, "lineitem")
    key = d2_key(spark, sf_dir)
    small = fits(key, 1_000_000)  # checked on the source, before the pivot
    keyed = key.filter(F.col("weight") != 0).select("item_id", "trait")
    r = li.select(
        F.col("l_returnflag").alias("model"),
        (F.lit(1) + F.col("l_suppkey") % 9).cast("int").alias("value"),
        F.expr("l_orderkey div 1000000").alias("chunk"),
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        F.col("l_partkey").alias("item_id"),
        F.concat(F.lit("My answer: "), F.col("l_linenumber").cast("string")).alias("responses"),
        F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber").cast("string")).otherwise(F.lit("N/A")).alias("numbers_extracted"),
        (F.col("l_quantity") / 10.0).alias("elapsed_times"))
    return r.join(F.broadcast(keyed) if small else keyed, "item_id"), key_wide(key), small


def d1_cell_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``d1_cell_rows`` with their item's question and weight columns."""
    r, wide, small = d1_cell_rows(spark, sf_dir)
    r = r.join(F.broadcast(wide) if small else wide, "item_id")
    return r.select("model", "trait", "value", "chunk", "row_id", "question", *TRAITS,
                    "responses", "numbers_extracted", "elapsed_times")


def d2_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long scoring key: trait by key mod 5, unkeyed when key mod 11 = 0, else
    +1 for even and −1 for odd keys."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("item_id"),
        F.concat(F.lit("I "), F.lower("p_name")).alias("question"),
        _pick(TRAITS, k % 5).alias("trait"),
        F.when(k % 11 == 0, F.lit(0.0)).when(k % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("weight"),
    )


def d3_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempt log: item = user, reply = props, seconds = value; order (ts, event_id)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("item_id"), "ts", F.col("event_id").alias("call_id"),
                     F.lit(True).alias("ok"), F.col("props").alias("response_text"),
                     F.col("value").alias("elapsed_s"))


def d4_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory texts built from part: a facet per (key div 50, trait) with a
    plus block (even keys) and a minus block (odd keys); one text per key div
    500 (so 50 facets, 500 items at most per text)."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    code = _pick(["E", "A", "C", "N", "O"], k % 5)
    item = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))
    items = p.select(
        F.expr("p_partkey div 500").alias("file_id"),
        F.expr("p_partkey div 50").alias("chunk"),
        (k % 5).cast("int").alias("t"),
        code.alias("code"),
        (k % 2 == 0).alias("plus"),
        k.alias("k"), item.alias("item"))

    def block(arr, plus: bool, marker: str):
        lines = F.transform(F.filter(arr, lambda x: x["plus"] if plus else ~x["plus"]), lambda x: x["item"])
        return F.when(F.size(lines) > 0, F.concat(F.lit(marker), F.array_join(lines, "\n \t")))

    # one row per facet (≤ 10 items)
    facets = items.groupBy("file_id", "chunk", "t", "code").agg(
        F.array_sort(F.collect_list(F.struct("k", "plus", "item"))).alias("arr"))
    alpha = F.concat(F.lit(".8"), (F.col("chunk") % 10).cast("string"))
    header = F.concat(F.col("code"), F.col("chunk").cast("string"), F.lit(": FACET "), F.col("chunk").cast("string"),
                      F.when(F.col("chunk") % 10 == 0, F.concat(F.lit(" (Alpha = "), alpha, F.lit(")")))
                      .otherwise(F.concat(F.lit(" ("), alpha, F.lit(")"))))
    facet_text = F.concat_ws("\n\n", F.concat(header, F.lit("\n"), block("arr", True, "+ keyed\t")),
                             block("arr", False, "– keyed\t"))
    facets = facets.select("file_id", "chunk", "t", facet_text.alias("facet_text"))
    # one row per text (≤ 50 facets)
    return facets.groupBy("file_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "t", "facet_text"))),
                                 lambda s: s["facet_text"]), "\n\n").alias("text"))


def d5_personas(spark: SparkSession, sf_dir: str | None = None, traits: list[str] = TRAITS) -> DataFrame:
    """Persona catalogue: every trait × value 1..9 with a generated description."""
    from traitgrid.operators.grid import persona_catalogue
    return persona_catalogue(spark, traits)


def d6_run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score-card files named like the local runner's output; level = value."""
    from traitgrid.functions.files import run_file_name
    ev = table(spark, sf_dir, "events")
    e = F.col("event_id")
    hub_path = F.concat(F.lit("org/"), _pick(D6_MODELS, e % len(D6_MODELS)))
    trait = F.when(e % 2 == 0, F.lit("")).otherwise(F.lit("Neuroticism"))
    ts = F.make_timestamp_ntz(F.lit(2025), F.lit(1), F.lit(1), F.lit(12), F.lit(0), (e % 60).cast("int"))
    name = run_file_name(hub_path, trait, ts)
    return ev.select(e.alias("event_id"), name.alias("file_name"), F.col("value").alias("level"))


def d7_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion log: prompt = order, completion id = (line, part, supplier),
    text shape by part key mod 6 with n = line number."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber").cast("string")
    shape = F.col("l_partkey") % 6
    text = (F.when(shape == 0, n)
            .when(shape == 1, F.concat(F.lit(" "), n))
            .when(shape == 2, F.concat(F.lit("0"), n))
            .when(shape == 3, F.concat(n, F.lit(" because")))
            .when(shape == 4, F.concat(F.lit("<answer> "), n, F.lit(" </answer>")))
            .otherwise(F.concat(F.lit("so #### $1,"), F.col("l_partkey").cast("string"))))
    prompt = F.concat(F.lit("Q"), F.col("l_orderkey").cast("string"), F.lit(": rate it\n"))
    return li.select(F.col("l_orderkey").alias("prompt_id"), F.col("l_linenumber").alias("line_no"),
                     F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supp_id"),
                     prompt.alias("prompt"), text.alias("completion"))
