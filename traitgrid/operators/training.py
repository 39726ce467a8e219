"""Training-set preparation, reward scoring and group-relative advantages."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traitgrid.functions.prompts import AGREEMENT_INTRO, statement
from traitgrid.operators.instrument import keyed_items
from traitgrid.operators.numbering import written
from traitgrid.session import ship_package


def training_examples(key: DataFrame, trait: str = "Neuroticism", sign: float = 1.0, answer: str = "5",
                      system_prompt: str = AGREEMENT_INTRO) -> DataFrame:
    """Items of one trait and sign → ``item_id, question, prompt, answer``:
    ``question`` is the filled agreement template, ``prompt`` the system text
    followed by it."""
    items = keyed_items(key, [trait], sign)
    q = statement("question")
    return items.select("item_id", q.alias("question"),
                        F.concat(F.lit(system_prompt), q).alias("prompt"), F.lit(answer).alias("answer"))


def train_eval_split(df: DataFrame, order_cols: list[str], n_eval: int = 16, by: list[str] | None = None) -> DataFrame:
    """First ``n_eval`` rows by ``order_cols`` → ``split='eval'``, the rest
    ``'train'`` (fewer rows → all eval); with ``by``, so for each data set. Exactly
    ``n_eval`` rows: ties go by a hash of the whole row, and of rows that are the
    same in every column as many are taken as are due.

    The rows due are found with a distributed top-k (``orderBy().limit()``, or a
    grouped limit per data set, both applied in each task first) — no global
    window, no single-task sort. Only copies of those rows are numbered."""
    by, names = by or [], df.columns
    d = df.withColumn("__h", F.xxhash64(*[F.col(c) for c in names]))
    order = [*[F.col(c) for c in order_cols], F.col("__h")]
    if by:
        top = d.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= n_eval)
    else:
        top = d.orderBy(*order).limit(n_eval)
    due = top.groupBy(F.col("__h").alias("__d")).agg(F.count(F.lit(1)).alias("__due"))
    j = d.join(due if by else F.broadcast(due), F.col("__h") == F.col("__d"), "left")  # without ``by``: n_eval rows at most
    rest = j.filter(F.col("__due").isNull()).select(*names, F.lit("train").alias("split"))
    # copies of a due row are alike: they are counted, and come back as so many rows of either split
    copies = j.filter(F.col("__due").isNotNull()).groupBy("__h").agg(F.first(F.struct(*names)).alias("__r"), F.first("__due").alias("__due"), F.count(F.lit(1)).alias("__n"))
    many = F.concat(F.array_repeat(F.lit("eval"), F.least("__due", "__n").cast("int")), F.array_repeat(F.lit("train"), F.greatest(F.col("__n") - F.col("__due"), F.lit(0)).cast("int")))
    return rest.unionByName(copies.select("__r.*", F.explode(many).alias("split")))


@dataclass(frozen=True)
class BatchReward:
    """A reward function over lists, ``fn(completions, **columns) -> list of numbers`` (one for each completion; None: no
    reward): ``columns`` of the completion log go along as lists, under their names. It is called on batches
    of rows in Python, all such functions of a table in one pass."""

    fn: Callable[..., list]
    columns: tuple[str, ...] = ()


RewardSpec = tuple[Callable[[Column], Column] | Column | BatchReward, float]


def score_completions(df: DataFrame, rewards: dict[str, RewardSpec], completion_col: str = "completion",
                      total_col: str = "reward") -> DataFrame:
    """One column per reward function plus their weighted sum. Functions are Columns (or make them), or
    ``BatchReward`` over lists; a table may mix both."""
    out = batch_rewards(df, {n: fn for n, (fn, _w) in rewards.items() if isinstance(fn, BatchReward)}, completion_col)
    for name, (fn, _w) in rewards.items():
        if not isinstance(fn, BatchReward):
            out = out.withColumn(name, fn(F.col(completion_col)) if callable(fn) else fn)
    total = None
    for name, (_fn, w) in rewards.items():
        term = F.lit(float(w)) * F.col(name)
        total = term if total is None else total + term
    return out.withColumn(total_col, total)


def batch_rewards(df: DataFrame, functions: dict[str, BatchReward], completion_col: str = "completion") -> DataFrame:
    """``df`` with a double column for each function, all of them called in one pass over Arrow batches."""
    if not functions:
        return df
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = T.StructType([*df.schema, *[T.StructField(n, T.DoubleType()) for n in functions]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            lists = {c: b.column(c).to_pylist() for c in {completion_col, *(c for f in functions.values() for c in f.columns)}}
            found = []
            for name, f in functions.items():
                values = f.fn(lists[completion_col], **{c: lists[c] for c in f.columns})
                if len(values) != b.num_rows:
                    raise ValueError(f"{name} gave {len(values)} rewards for {b.num_rows} completions")
                found.append(pa.array([None if v is None else float(v) for v in values], pa.float64()))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*b.columns, *found], arrow, strict=True)], schema=arrow)

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


#: A prompt with more completions is kept apart from the buckets.
HOT_PROMPT = 1_000_000


def store_completions(df: DataFrame, path: str, group_col: str, buckets: int = 64, hot: int = HOT_PROMPT) -> tuple[str, str | None]:
    """Scored completions stored for ``stored_advantage``: bucketed and sorted by prompt, as a table of the session's catalog
    under ``path``; prompts of more than ``hot`` completions in a plain table beside it, so that no task has to take one
    whole. Returns the two (the second: None where there is no such prompt)."""
    spark = df.sparkSession
    scored = written(df, "scored-completions")  # rewards are computed once
    large = written(scored.groupBy(F.col(group_col).alias("__g")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot).select("__g"), "hot-prompts")
    on = F.col(group_col).eqNullSafe(F.col("__g"))
    name = f"completions_{uuid.uuid4().hex[:12]}"
    rest = scored if large.isEmpty() else scored.join(F.broadcast(large), on, "left_anti")  # a share of 1 / hot of the rows at most
    (rest.repartition(buckets, group_col).write.format("parquet").bucketBy(buckets, group_col).sortBy(group_col)
     .option("path", f"{path}/bucketed").saveAsTable(name))
    if large.isEmpty():
        return name, None
    scored.join(F.broadcast(large), on, "left_semi").write.parquet(f"{path}/hot")
    return name, f"{path}/hot"


def stored_advantage(spark: SparkSession, stored: tuple[str, str | None], group_col: str, reward_col: str = "reward", eps: float = 1e-4) -> DataFrame:
    """``group_advantage`` from ``store_completions``: statistics and rows meet bucket by bucket, nothing is shuffled but
    the prompts kept apart."""
    table, hot = stored
    df = spark.table(table)
    st = _statistics(df, group_col, reward_col).withColumnRenamed(group_col, "__g")
    # both sides lie in the same buckets: a merge join moves nothing, a broadcast would
    out = _advantage(df.join(st.hint("merge"), F.col(group_col) == F.col("__g")).drop("__g"), reward_col, eps)
    nulls = df.filter(F.col(group_col).isNull())
    out = out.unionByName(group_advantage(nulls, group_col, reward_col, eps)) if not nulls.isEmpty() else out
    return out if hot is None else out.unionByName(group_advantage(spark.read.parquet(hot), group_col, reward_col, eps))


def _statistics(df: DataFrame, group_col: str, reward_col: str) -> DataFrame:
    return df.groupBy(group_col).agg(F.count(F.lit(1)).alias("group_n"), F.avg(reward_col).alias("group_mean"),
                                     F.stddev_samp(reward_col).alias("group_std"))


def _advantage(joined: DataFrame, reward_col: str, eps: float) -> DataFrame:
    adv = F.when(F.col("group_n") > 1,
                 (F.col(reward_col) - F.col("group_mean")) / (F.col("group_std") + F.lit(eps))).otherwise(F.lit(0.0))
    return joined.withColumn("advantage", adv)


def group_advantage(df: DataFrame, group_col: str, reward_col: str = "reward", eps: float = 1e-4) -> DataFrame:
    """``(r − mean_g) / (std_g + eps)`` with the sample std of the group;
    a single-completion group gets 0.

    Group statistics come from a partial-aggregated groupBy, are written to the
    shared folder and joined back on the group key: broadcast when they are small,
    otherwise a shuffle join. Because the statistics are a table of their own
    there, AQE can split a hot group's rows over many tasks (a join straight on the
    aggregate shares its partitioning and cannot be split).
    """
    st = written(_statistics(df, group_col, reward_col), "group-stats").withColumnRenamed(group_col, "__g")
    joined = df.join(st, F.col(group_col).eqNullSafe(F.col("__g"))).drop("__g")
    return _advantage(joined, reward_col, eps)
