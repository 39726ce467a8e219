"""Trait scoring: reverse keying, mean, population std, N/A share.

Plan: responses ⋈ (broadcast, size-checked) wide key → ONE hash aggregate per
run with integer moments per trait (n, Σx, Σx²) → explode the ≤ |traits|
structs per run. Partial aggregation happens map-side, so a run holding a
third of all rows costs one partial row per task, not a hot reducer. Integer
moments make mean and std exact and independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitgrid.functions.ratings import format_score, python_round_ratio, rating_value, reverse_key, round_half_even
from traitgrid.operators.instrument import key_wide
from traitgrid.operators.joins import DEFAULT_MAX_BROADCAST_ROWS, fits
from traitgrid.schemas import DEFAULT_SCALE, TRAITS, RatingScale

_DEC = "decimal(38,0)"


def _wide_key(key: DataFrame, traits: list[str], item_col: str, max_rows: int) -> DataFrame:
    """Wide key for the join, broadcast when the key (checked at its source,
    before any pivot) has at most ``max_rows`` rows."""
    small = fits(key, max_rows)
    if "trait" in key.columns and "weight" in key.columns:
        key = key_wide(key.select(item_col, "trait", "weight"), traits, id_cols=(item_col,))
    key = key.select(item_col, *[F.col(t).try_cast("double").alias(f"__w{i}") for i, t in enumerate(traits)])
    return F.broadcast(key) if small else key


def run_moments(responses: DataFrame, key: DataFrame | None, run_cols: list[str],
                traits: list[str] = TRAITS, scale: RatingScale = DEFAULT_SCALE,
                item_col: str = "item_id", rating_col: str = "rating_text",
                max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Per run: ``n_rows`` and, per trait i, ``n_keyed_i, n_valid_i, s1_i, s2_i``.

    ``key`` may be long (item, trait, weight) or wide (one column per trait).
    A response whose item is not in the key still counts in ``n_rows``. With
    ``key=None`` the responses carry their own weight columns (one per trait,
    as response files do) and no join is needed.
    """
    if key is None:
        j = responses.select(*run_cols, rating_value(rating_col, scale).alias("__r"),
                             *[F.col(t).try_cast("double").alias(f"__w{i}") for i, t in enumerate(traits)])
    else:
        k = _wide_key(key, traits, item_col, max_broadcast_rows)
        r = responses.select(*run_cols, item_col, rating_value(rating_col, scale).alias("__r"))
        j = r.join(k, item_col, "left")
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i in range(len(traits)):
        w = F.col(f"__w{i}")
        keyed = w.isNotNull() & ~F.isnan(w) & (w != 0)
        x = F.when(keyed, reverse_key("__r", w, scale))
        aggs += [F.count(F.when(keyed, F.lit(1))).alias(f"n_keyed_{i}"),
                 F.count(x).alias(f"n_valid_{i}"),
                 F.sum(x).cast("long").alias(f"s1_{i}"),
                 F.sum(x * x).cast("long").alias(f"s2_{i}")]
    return j.groupBy(*run_cols).agg(*aggs)


def _mean(n: Column, s1: Column) -> Column:
    return round_half_even(F.try_divide(s1.cast("double"), n.cast("double")))


def _std(n: Column, s1: Column, s2: Column) -> Column:
    """Population std from exact integer moments: sqrt(nΣx² − (Σx)²) / n."""
    num = n.cast(_DEC) * s2.cast(_DEC) - s1.cast(_DEC) * s1.cast(_DEC)
    return round_half_even(F.try_divide(F.sqrt(num.cast("double")), n.cast("double")))


def _run_na(traits: list[str]) -> Column:
    return sum((F.col(f"n_keyed_{i}") - F.col(f"n_valid_{i}") for i in range(len(traits))), F.lit(0).cast("long"))


def scores_from_moments(moments: DataFrame, run_cols: list[str], traits: list[str] = TRAITS) -> DataFrame:
    """Wide moments → long scores, one row per (run, trait)."""
    if "trait" in run_cols:
        raise ValueError("a run column named 'trait' clashes with the scored trait; rename it (e.g. cell_trait)")
    per_trait = F.array(*[
        F.struct(F.lit(t).alias("trait"),
                 F.col(f"n_keyed_{i}").alias("n_keyed"),
                 F.col(f"n_valid_{i}").alias("n_valid"),
                 F.col(f"s1_{i}").alias("s1"),
                 F.col(f"s2_{i}").alias("s2"))
        for i, t in enumerate(traits)])
    long = moments.select(*run_cols, "n_rows", _run_na(traits).alias("run_n_na"), F.inline(per_trait))
    n, s1, s2 = F.col("n_valid"), F.col("s1"), F.col("s2")
    return long.select(
        *run_cols, "trait", "n_rows", "n_keyed", "n_valid",
        (F.col("n_keyed") - F.col("n_valid")).alias("n_na"),
        _mean(n, s1).alias("mean"),
        _std(n, s1, s2).alias("std"),
        "run_n_na",
        (F.col("run_n_na") / F.col("n_rows")).alias("na_share"),
    )


def trait_scores(responses: DataFrame, key: DataFrame | None, run_cols: list[str],
                 traits: list[str] = TRAITS, scale: RatingScale = DEFAULT_SCALE, **kw) -> DataFrame:
    """Long score table: per (run, trait) ``n_keyed, n_valid, n_na, mean, std``
    (mean/std rounded half-even to 2 places; null without a valid rating), with
    the run's ``n_rows``, ``run_n_na`` and unrounded ``na_share``."""
    return scores_from_moments(run_moments(responses, key, run_cols, traits, scale, **kw), run_cols, traits)


def score_card(responses: DataFrame, key: DataFrame | None, run_cols: list[str],
               traits: list[str] = TRAITS, scale: RatingScale = DEFAULT_SCALE,
               sep: str = "+-", **kw) -> DataFrame:
    """Wide score card per run: one ``"m+-s"`` / ``"N/A"`` column per trait plus
    ``n_rows``, ``n_na``, the share ``na_share`` and ``na_share_rounded`` (the
    card's ``N/A`` entry, rounded exactly as Python's ``round(x, 2)`` does).
    Built straight from the moments: no pivot, no extra shuffle."""
    m = run_moments(responses, key, run_cols, traits, scale, **kw)
    cols = []
    for i, t in enumerate(traits):
        n, s1, s2 = F.col(f"n_valid_{i}"), F.col(f"s1_{i}"), F.col(f"s2_{i}")
        cols.append(F.when(n > 0, format_score(_mean(n, s1), _std(n, s1, s2), sep)).otherwise(F.lit("N/A")).alias(t))
    na = _run_na(traits)
    return m.select(*run_cols, *cols, "n_rows", na.alias("n_na"), (na / F.col("n_rows")).alias("na_share"),
                    python_round_ratio(na, F.col("n_rows"), max_value=float(max(1, len(traits)))).alias("na_share_rounded"))


def cell_scores(responses: DataFrame, key: DataFrame | None, cell_cols: tuple[str, ...] = ("model", "trait", "value"),
                traits: list[str] = TRAITS, scale: RatingScale = DEFAULT_SCALE, **kw) -> DataFrame:
    """Scores of grid cells, each on its own trait (the persona's domain): the
    cell's ``trait`` column is the scored trait; other traits are dropped."""
    runs = [("cell_trait" if c == "trait" else c) for c in cell_cols]
    r = responses.withColumnRenamed("trait", "cell_trait")
    s = trait_scores(r, key, runs, traits, scale, **kw)
    return s.filter(F.col("trait") == F.col("cell_trait")).drop("cell_trait")


def format_scores(scores: DataFrame, sep: str = "+-") -> DataFrame:
    """Add the display column ``score`` (``"m+-s"`` or ``"N/A"``) to a long score table."""
    return scores.withColumn("score", F.when(F.col("n_valid") > 0, format_score("mean", "std", sep))
                             .otherwise(F.lit("N/A")))


def rating_counts(responses: DataFrame, run_cols: list[str], rating_col: str = "rating_text") -> DataFrame:
    """Frequency of each stored rating per run, with its integer value (null for
    non-numeric text) and the run total."""
    counts = responses.groupBy(*run_cols, rating_col).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy(*run_cols)  # ≤ (scale size + 1) rows per run after the aggregate
    return counts.select(*run_cols, F.col(rating_col).alias("rating_text"),
                         F.col(rating_col).try_cast("int").alias("rating"), "n",
                         F.sum("n").over(total).alias("n_total"))


def target_mse(scores: DataFrame, target: Column | DataFrame, run_cols: list[str], on: list[str] | None = None) -> DataFrame:
    """Mean squared error of the rounded trait means against a target per run. ``target`` is a Column of
    ``scores``, or a table with a column ``target``, joined by ``on`` (default: the columns both have); a score without a target
    is left out.

    Differences are taken in exact decimals, so the result is one final double
    division (independent of summation order)."""
    if isinstance(target, DataFrame):
        keys = on or [c for c in target.columns if c != "target" and c in scores.columns]
        t = target.select(*[F.col(c).alias(f"__t{i}") for i, c in enumerate(keys)], F.col("target").alias("__target"))
        scores = scores.join(t, [F.col(c).eqNullSafe(F.col(f"__t{i}")) for i, c in enumerate(keys)]).filter(F.col("__target").isNotNull())
        target = F.col("__target")
    d = target.cast("decimal(20,6)") - F.col("mean").cast("decimal(20,6)")
    return (scores.filter(F.col("mean").isNotNull())
            .groupBy(*run_cols)
            .agg(F.count(F.lit(1)).alias("n_traits"), F.sum(d * d).alias("__sq"))
            .select(*run_cols, "n_traits", (F.col("__sq").cast("double") / F.col("n_traits")).alias("mse")))
