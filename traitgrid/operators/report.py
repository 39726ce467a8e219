"""Reports: score series, dose-response table, Markdown, cohort histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitgrid.functions.ratings import parse_score
from traitgrid.operators.scoring import format_scores
from traitgrid.schemas import GRID_TRAITS, TRAITS


def score_series(card: DataFrame, run_cols: list[str], traits: list[str] = TRAITS, sep: str = "+-") -> DataFrame:
    """Wide card (formatted cells) → long series ``run…, trait, score, mean, std``;
    ``'N/A'`` parses to nulls."""
    long = card.unpivot(run_cols, traits, "trait", "score")
    return long.select(*run_cols, "trait", "score",
                       parse_score("score", 1, sep).alias("mean"), parse_score("score", 2, sep).alias("std"))


def dose_response_table(scores: DataFrame, group_cols: list[str], index_col: str = "value",
                        traits: list[str] = GRID_TRAITS, sep: str = "+-") -> DataFrame:
    """Long scores → one row per (group, index) with a formatted column per trait
    in the given order; missing cells are null."""
    f = format_scores(scores.filter(F.col("trait").isin(*traits)), sep)
    return f.groupBy(*group_cols, index_col).pivot("trait", traits).agg(F.first("score")).select(
        *group_cols, index_col, *traits)


def markdown_lines(table: DataFrame, group_cols: list[str], index_col: str, value_cols: list[str]) -> DataFrame:
    """A pipe table per group as text lines (``group…, line_no, line``): header,
    alignment row, then one row per index value in order. The index column is
    right-aligned, value columns left-aligned; a column is as wide as its
    longest cell and at least its header plus two."""
    w = Window.partitionBy(*group_cols)
    idx = F.col(index_col).cast("string")
    t = table.select(*group_cols, idx.alias("__i"), F.col(index_col).alias("__o"),
                     *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__v{j}") for j, c in enumerate(value_cols)])
    t = t.withColumn("__wi", F.greatest(F.lit(2), F.max(F.length("__i")).over(w)))
    for j, c in enumerate(value_cols):
        t = t.withColumn(f"__w{j}", F.greatest(F.lit(len(c) + 2), F.max(F.length(f"__v{j}")).over(w)))
    t = t.withColumn("__rn", F.row_number().over(w.orderBy("__o")))

    def cells(first: Column, rest: list[Column]) -> Column:
        return F.concat(F.lit("|"), first, F.lit("|"), *[x for r in rest for x in (r, F.lit("|"))])

    def pad(s: Column, width: str, right: bool) -> Column:
        return F.concat(F.lit(" "), (F.lpad if right else F.rpad)(s, F.col(width), F.lit(" ")), F.lit(" "))

    def dashes(width: str, extra: int) -> Column:
        return F.repeat(F.lit("-"), F.col(width) + extra)

    header = cells(pad(F.lit(""), "__wi", True),
                   [pad(F.lit(c), f"__w{j}", False) for j, c in enumerate(value_cols)])
    align = cells(F.concat(dashes("__wi", 1), F.lit(":")),
                  [F.concat(F.lit(":"), dashes(f"__w{j}", 1)) for j in range(len(value_cols))])
    row = cells(pad(F.col("__i"), "__wi", True),
                [pad(F.col(f"__v{j}"), f"__w{j}", False) for j in range(len(value_cols))])
    body = F.struct((F.col("__rn") + 1).alias("line_no"), row.alias("line"))
    lines = F.when(F.col("__rn") == 1, F.array(F.struct(F.lit(0).alias("line_no"), header.alias("line")),
                                               F.struct(F.lit(1).alias("line_no"), align.alias("line")), body)
                   ).otherwise(F.array(body))
    out = t.select(*group_cols, F.inline(lines))
    return out.select(*group_cols, F.col("line_no").cast("int").alias("line_no"), "line")


def cohort_histogram(df: DataFrame, cohort_col: str, value_col: str, bins: int = 5,
                     cohorts: list[str] | None = None) -> DataFrame:
    """Equal-width histogram per cohort over the cohort's own [min, max]
    (all values equal → [v−0.5, v+0.5]); the top edge belongs to the last bin.
    Bin assignment follows numpy's uniform-bin rule, including its edge
    correction, so counts match ``numpy.histogram(x, bins)``.

    Plan: partial-aggregated min/max per cohort → joined back onto the values.
    With ``cohorts`` (the possible labels) the per-cohort table has a proven
    bound and is broadcast, so the values are never shuffled for the join;
    otherwise AQE broadcasts it once it is measured small → partial-aggregated count per (cohort, bin) → all bins per
    cohort via a bounded explode. Two scans of the input, no skew exposure.
    """
    x = F.col(value_col).cast("double")
    vals = df.select(F.col(cohort_col).alias("cohort"), x.alias("x")).filter(
        F.col("cohort").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x"))
    if cohorts is not None:
        vals = vals.filter(F.col("cohort").isin(*cohorts))
    st = vals.groupBy("cohort").agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
    st = st.select("cohort",
                   F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
                   F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    st = st.withColumn("step", (F.col("hi") - F.col("lo")) / F.lit(float(bins)))

    def edge(j: Column) -> Column:
        return F.when(j == bins, F.col("hi")).otherwise(j.cast("double") * F.col("step") + F.col("lo"))

    b = vals.join(F.broadcast(st) if cohorts is not None else st, "cohort")  # ≤ len(cohorts) rows
    i0 = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(bins))).cast("int")
    b = b.withColumn("__i", F.when(i0 >= bins, F.lit(bins - 1)).otherwise(i0))
    b = b.withColumn("__i", F.when(F.col("x") < edge(F.col("__i")), F.col("__i") - 1).otherwise(F.col("__i")))
    b = b.withColumn("__i", F.when((F.col("x") >= edge(F.col("__i") + 1)) & (F.col("__i") != bins - 1),
                                   F.col("__i") + 1).otherwise(F.col("__i")))
    counts = b.groupBy("cohort", F.col("__i").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = st.select("cohort", "lo", "hi", "step", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    grid = grid.select("cohort", "bin", edge(F.col("bin")).alias("bin_lo"), edge(F.col("bin") + 1).alias("bin_hi"))
    return (grid.join(counts, ["cohort", "bin"], "left")
            .select("cohort", F.col("bin").cast("int").alias("bin"), "bin_lo", "bin_hi",
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))
