"""Experiment grid: personas × keyed items × models × repetitions, and resume.

The grid is built by an equi-join of the keyed items with the (broadcast,
size-checked) persona catalogue on ``trait == domain`` — at most one persona
per intensity per trait, so the fan-out per item is bounded — followed by
``explode`` over the model list and the repetition range. No cartesian join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitgrid.functions.prompts import agreement_prompt, rating_prompt
from traitgrid.operators.instrument import keyed_items
from traitgrid.operators.joins import sized_broadcast
from traitgrid.schemas import TRAITS

CELL = ["model", "trait", "value"]

# The catalogue's intensity wording per prompted value 1..9.
QUALIFIERS = {
    1: ("low", "extremely"), 2: ("low", "very"), 3: ("low", ""), 4: ("low", "a bit"),
    5: ("neither", "neither-nor"),
    6: ("high", "a bit"), 7: ("high", ""), 8: ("high", "very"), 9: ("high", "extremely"),
}


def persona_catalogue(spark: SparkSession, traits: list[str] = TRAITS, values=range(1, 10)) -> DataFrame:
    """A generated catalogue (domain, qualifier_type, qualifier, value, description);
    real catalogues come from ``sources.columns_json.read_personas``."""
    qt = F.create_map(*[x for v, (t, _) in QUALIFIERS.items() for x in (F.lit(v), F.lit(t))])
    ql = F.create_map(*[x for v, (_, q) in QUALIFIERS.items() for x in (F.lit(v), F.lit(q))])
    base = spark.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(t) for t in traits])).alias("domain"))
    base = base.select("domain", F.explode(F.array(*[F.lit(int(v)) for v in values])).alias("value"))
    return base.select(
        "domain", F.try_element_at(qt, F.col("value")).alias("qualifier_type"),
        F.try_element_at(ql, F.col("value")).alias("qualifier"), F.col("value").cast("int").alias("value"),
        F.concat(F.lit("You score "), F.col("value").cast("string"), F.lit(" on "), F.col("domain"),
                 F.lit(". ")).alias("description"))


def personas_of(personas: DataFrame, trait: str) -> DataFrame:
    return personas.filter(F.col("domain") == trait)


def persona_prefix(personas: DataFrame, trait: str, qualifier_type: str, qualifier: str) -> DataFrame:
    """One row ``persona``: the first description (lowest value) of the domain
    with that qualifier type and qualifier; ``''`` for the baseline trait ``''``.
    Without a match the job fails with the three arguments: no persona is not the baseline."""
    if trait == "":
        return personas.sparkSession.range(0, 1, 1, 1).select(F.lit("").alias("persona"))
    hit = personas.filter((F.col("domain") == trait) & (F.col("qualifier_type") == qualifier_type)
                          & (F.col("qualifier") == qualifier))
    none = F.raise_error(F.lit(f"no persona for trait {trait!r}, qualifier type {qualifier_type!r}, qualifier {qualifier!r}"))
    return hit.agg(F.min_by("description", "value").alias("persona")).select(
        F.coalesce("persona", none.cast("string")).alias("persona"))


def grid_cells(spark: SparkSession, models: list[str], traits: list[str], values=range(1, 10)) -> DataFrame:
    """All (model, trait, value) cells of an experiment."""
    df = spark.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    df = df.select("model", F.explode(F.array(*[F.lit(t) for t in traits])).alias("trait"))
    return df.select("model", "trait", F.explode(F.array(*[F.lit(int(v)) for v in values])).alias("value"))


def prompt_grid(key: DataFrame, personas: DataFrame, models: list[str], repetitions: int = 1,
                traits: list[str] | None = None, style: str = "rating") -> DataFrame:
    """One row per (model, trait, value, repetition, item) with its prompt.

    ``style='rating'`` is the API wording (persona + prefix + item + suffix);
    ``'agreement'`` the local-model wording (persona line + intro + template)."""
    items = keyed_items(key, traits).select("item_id", "question", "trait")
    p = personas.select(F.col("domain").alias("trait"), "value", "description")
    if traits is not None:
        p = p.filter(F.col("trait").isin(*traits))
    g = items.join(sized_broadcast(p, 100_000), "trait")
    g = g.select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), "*")
    g = g.select("*", F.explode(F.array(*[F.lit(r) for r in range(repetitions)]).cast("array<int>")).alias("repetition"))
    prompt = (rating_prompt("description", "question") if style == "rating"
              else agreement_prompt("question", F.col("description")))
    return g.select("model", "trait", "value", F.col("repetition").cast("int").alias("repetition"),
                    "item_id", "question", prompt.alias("prompt"))


def done_cells(responses: DataFrame, cols: list[str] = CELL) -> DataFrame:
    """Cells present in a response table (partial aggregate; tiny output)."""
    return responses.select(*cols).distinct()


def pending_cells(cells: DataFrame, done: DataFrame, cols: list[str] = CELL) -> DataFrame:
    """Grid cells with no result yet (resume: skip what is done)."""
    return cells.join(done.select(*cols), cols, "left_anti")


def present_cells(cells: DataFrame, done: DataFrame, cols: list[str] = CELL) -> DataFrame:
    """Grid cells that have a result."""
    return cells.join(done.select(*cols), cols, "left_semi")
