"""Reply collection and attempt resolution.

``collect_responses`` is the only JVM↔Python boundary of a grid run: a
``mapInPandas`` that hands Arrow batches of prompts to a user-supplied
responder (built once per task), re-asking the prompts whose reply carries no
valid rating, up to ``max_attempts``. It emits one row per attempt, so a
retried task can be resolved idempotently by ``resolve_attempts``.
"""

from __future__ import annotations

import http.client
import re
import socket
import time
import urllib.error
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitgrid import storage
from traitgrid.functions.ratings import extract_number, rating_text
from traitgrid.operators.numbering import numbered
from traitgrid.schemas import DEFAULT_SCALE, RatingScale
from traitgrid.session import parallelism

#: What a call raises when the model cannot be reached; anything else (a missing file, a refused
#: permission) is a fault and ends the job. A client with errors of its own adds them.
TRANSIENT = (ConnectionError, TimeoutError, socket.gaierror, urllib.error.URLError, http.client.HTTPException)


def single_numbers(texts):
    """Default reply parser of the retry test (a pandas Series in and out): the one
    distinct number of each text, else missing."""
    import pandas as pd
    found = [set(re.findall(r"\d+", t)) for t in texts.astype("string").fillna("")]
    return pd.Series([f.pop() if len(f) == 1 else None for f in found], dtype="string")


def collect_responses(prompts: DataFrame, responder_factory: Callable[[], Callable], id_cols: list[str],
                      prompt_col: str = "prompt", max_attempts: int = 10,
                      scale: RatingScale = DEFAULT_SCALE, allowed: list[str] | None | str = "scale",
                      max_call_failures: int = 3, num_partitions: int | None = None,
                      retry_pause_s: float = 4.0, model_col: str | None = None,
                      parser: Callable | None = None, transient: tuple = TRANSIENT) -> DataFrame:
    """Ask every prompt until its reply holds a valid rating (or attempts run out).

    ``responder_factory()`` is called once per task and returns
    ``ask(prompts: pandas.Series, attempt: int)`` giving a pandas Series of
    reply texts, or a DataFrame with ``text`` and per-reply ``elapsed_s``
    (None text = failed call; a call that raises one of ``transient`` fails all its
    prompts, any other error ends the job; failed calls are retried up to
    ``max_call_failures`` times in a row, ``retry_pause_s`` apart, and do not count
    as attempts; a prompt that still has no reply is given up for this run and
    left without a successful row). ``allowed=None`` accepts the first reply;
    ``parser`` maps a Series of reply texts to rating texts (default: the single
    distinct number). With ``model_col`` the factory is called as
    ``responder_factory(model)`` once per model label a task meets, and each
    batch is asked model by model. Output: ``id_cols, attempt, ok,
    response_text, elapsed_s`` — one row per call.
    """
    ok_values = set(scale.allowed) if allowed == "scale" else (None if allowed is None else set(allowed))
    fields = [prompts.schema[c] for c in id_cols]
    schema = T.StructType(fields + [
        T.StructField("attempt", T.IntegerType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("response_text", T.StringType()),
        T.StructField("elapsed_s", T.DoubleType()),
    ])
    extra = [model_col] if model_col and model_col not in id_cols else []
    src = prompts.select(*id_cols, *extra, prompt_col)
    if num_partitions:
        src = src.repartition(num_partitions)

    def run(batches):
        responders: dict = {}

        def responder_for(model):
            if model not in responders:
                responders[model] = responder_factory(model) if model_col else responder_factory()
            return responders[model]

        for whole in batches:
            groups = whole.groupby(model_col, sort=False) if model_col else [(None, whole)]
            for model, pdf in groups:
                yield from ask_until_valid(responder_for(model), pdf)

    def ask_until_valid(ask, pdf):
        """Ask one batch of one model until every prompt has a valid reply or
        runs out of attempts; yields the attempt log of the batch."""
        import pandas as pd
        pending = pdf
        out = []
        for attempt in range(1, max_attempts + 1):
            todo, failures = pending, 0
            answered = []
            while len(todo) and failures <= max_call_failures:
                if failures and retry_pause_s:
                    time.sleep(retry_pause_s)
                t0 = time.perf_counter()
                try:
                    reply = ask(todo[prompt_col].reset_index(drop=True), attempt)
                except transient:  # the call failed as a whole: log it, pause, retry
                    reply = pd.Series([None] * len(todo), dtype=object)
                if isinstance(reply, pd.DataFrame):  # per-reply timings from the responder
                    texts, secs = reply["text"].astype(object), reply["elapsed_s"].astype(float).values
                else:                                # batch wall time shared evenly
                    texts = pd.Series(reply, dtype=object)
                    secs = (time.perf_counter() - t0) / max(len(todo), 1)
                got = todo.assign(response_text=texts.values, elapsed_s=secs, attempt=attempt)
                got["ok"] = got["response_text"].notna()
                out.append(got.loc[~got["ok"]])
                answered.append(got.loc[got["ok"]])
                todo, failures = todo.loc[~got["ok"].values], failures + 1
            done = pd.concat(answered) if answered else pending.iloc[0:0]
            out.append(done)
            if ok_values is None:
                valid = pd.Series(True, index=done.index)
            else:
                valid = pd.Series((parser or single_numbers)(done["response_text"]).isin(ok_values).to_numpy(dtype=bool), index=done.index)
            pending = done.loc[~valid, pending.columns]  # what got no reply at all is given up: see above
            if pending.empty:
                break
        res = pd.concat(out) if out else pdf.iloc[0:0]
        yield res[[f.name for f in schema.fields]]

    return src.mapInPandas(run, schema)


def resolve_attempts(attempts: DataFrame, key_cols: list[str], order_cols: list[str] | None = None,
                     max_attempts: int = 10, scale: RatingScale = DEFAULT_SCALE,
                     allowed: list[str] | None | str = "scale",
                     parser: Callable[[Column], Column] | None = None) -> DataFrame:
    """Attempt log → one reply per key: the first valid one among the first
    ``max_attempts`` successful calls; otherwise the last of them with ``'N/A'``
    (a key whose calls all failed gets ``'N/A'``, attempt 0, no text).
    ``parser`` turns the reply text into the rating string (default: the single
    distinct number in it; e.g. ``functions.first_char`` for one-token replies).

    The top-``max_attempts`` per key is a ``row_number() ≤ k`` window, which
    Spark plans as a partial WindowGroupLimit before the shuffle, so even a key
    holding a third of all rows ships at most k rows per map task.
    """
    order_cols = order_cols or ["attempt"]
    allowed_vals = scale.allowed if allowed == "scale" else allowed
    ok = F.coalesce(F.col("ok"), F.lit(True)) if "ok" in attempts.columns else F.lit(True)
    df = attempts.withColumn("__ok", ok)
    # successful calls sort first, so their row number is their attempt number and
    # the top-k still holds the first k of them; failed calls only fill the rest
    w = Window.partitionBy(*key_cols).orderBy(F.col("__ok").desc(), *order_cols)
    num = (parser or extract_number)(F.col("response_text"))
    valid = F.lit(True) if allowed_vals is None else F.coalesce(num.isin(*allowed_vals), F.lit(False))
    df = (df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= max_attempts)
          .select(*key_cols, "__n", "__ok", (F.col("__ok") & valid).alias("__valid"),
                  F.struct(F.col("__n").alias("attempt"), F.col("response_text"), num.alias("number"),
                           F.col("elapsed_s")).alias("__s")))
    agg = df.groupBy(*key_cols).agg(
        F.expr("min_by(__s, __n) FILTER (WHERE __valid)").alias("__first"),
        F.expr("max_by(__s, __n) FILTER (WHERE __ok)").alias("__last"),
        F.expr("count(*) FILTER (WHERE __ok)").alias("n_calls"))
    hit = F.col("__first").isNotNull()
    pick = F.when(hit, F.col("__first")).otherwise(F.col("__last"))
    return agg.select(
        *key_cols,
        F.coalesce(pick["attempt"], F.lit(0)).cast("int").alias("attempt"),
        F.col("n_calls").cast("int").alias("n_calls"),
        pick["response_text"].alias("response_text"),
        F.when(hit, rating_text(F.col("__first")["number"], scale)).otherwise(F.lit("N/A")).alias("rating_text"),
        pick["elapsed_s"].alias("elapsed_s"))


#: Prompts of one task of a durable collection: what a lost task asks again at most.
TASK_PROMPTS = 2_000
#: Batches that a durable collection is dealt into: a batch costs the driver about half a second, however few prompts it has.
BATCHES = 64


def collect_durably(prompts: DataFrame, out: str, work: str, responder_factory: Callable[[], Callable], id_cols: list[str],
                    prompt_col: str = "prompt", task_prompts: int = TASK_PROMPTS, tasks: int | None = None,
                    batch_name: str = "batch", **options) -> DataFrame:
    """``collect_responses`` batch by batch: replies are durable as soon as their batch is.

    The prompts are written under ``work`` once, ``task_prompts`` to a file, and read as a stream of files; a batch is
    ``tasks`` files (default: one for each task slot), or more where there would be more than ``BATCHES`` batches, asked by
    as many tasks, and written to ``out/<batch_name>=<number>``. The stream's log of offsets lies beside the prompts: called again with the same
    ``work`` after a crash, it goes on with the batch that was under way (which is asked again, and replaces what it
    may have left) and asks nothing else twice. Returns the attempt log in ``out``; ``options`` are those
    of ``collect_responses``."""
    spark = prompts.sparkSession
    wanted = [*id_cols, *([options["model_col"]] if options.get("model_col") and options["model_col"] not in id_cols else []), prompt_col]
    src = prompts.select(*wanted)
    if "prompts" not in storage.names(spark, work) or "done" not in storage.names(spark, work):
        src.write.mode("overwrite").option("maxRecordsPerFile", task_prompts).parquet(f"{work}/prompts")
        storage.put_record(spark.range(1), work, "done")
    slots = max(tasks or parallelism(spark), -(-storage.count_files(spark, f"{work}/prompts") // BATCHES))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", slots).parquet(f"{work}/prompts")

    def ask(batch: DataFrame, number: int) -> None:
        # a file of prompts is a task's; small files would otherwise be read by one task
        replies = collect_responses(batch, responder_factory, id_cols, prompt_col, num_partitions=slots, **options)
        replies.write.mode("overwrite").parquet(f"{out}/{batch_name}={number:06d}")

    query = (stream.writeStream.foreachBatch(ask).option("checkpointLocation", f"{work}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return read_attempts(spark, out, attempt_schema(prompts, id_cols))


def attempt_schema(prompts: DataFrame, id_cols: list[str]) -> T.StructType:
    """The columns of an attempt log."""
    more = [("attempt", T.IntegerType()), ("ok", T.BooleanType()), ("response_text", T.StringType()), ("elapsed_s", T.DoubleType())]
    return T.StructType([prompts.schema[c] for c in id_cols] + [T.StructField(n, t) for n, t in more])


def read_attempts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An attempt log written batch by batch; empty where no batch was written."""
    if not storage.names(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


STATE = "n_calls int, first struct<attempt:int,response_text:string,number:string,elapsed_s:double>, last struct<attempt:int,response_text:string,number:string,elapsed_s:double>"


def update_attempts(state: DataFrame | None, attempts: DataFrame, key_cols: list[str], order_cols: list[str] | None = None,
                    max_attempts: int = 10, scale: RatingScale = DEFAULT_SCALE, allowed: list[str] | None | str = "scale",
                    parser: Callable[[Column], Column] | None = None) -> DataFrame:
    """Attempt state after more attempts: for each key, ``STATE`` — the successful calls so far (up to
    ``max_attempts``), the first of them with a valid reply, and the last.

    ``attempts`` come after all that ``state`` (None: nothing yet) has seen, so folding a log in parts gives what
    ``resolve_attempts`` makes of the whole (see ``resolved_state``), and a part is read once. A key's calls are at
    most ``max_attempts`` rows here, as in ``resolve_attempts``."""
    order_cols = order_cols or ["attempt"]
    allowed_vals = scale.allowed if allowed == "scale" else allowed
    ok = F.coalesce(F.col("ok"), F.lit(True)) if "ok" in attempts.columns else F.lit(True)
    w = Window.partitionBy(*key_cols).orderBy(F.col("__ok").desc(), *order_cols)
    num = (parser or extract_number)(F.col("response_text"))
    valid = F.lit(True) if allowed_vals is None else F.coalesce(num.isin(*allowed_vals), F.lit(False))
    calls = (attempts.withColumn("__ok", ok).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= max_attempts)
             .select(*key_cols, F.when(F.col("__ok"), F.struct("__n", valid.alias("valid"), "response_text", num.alias("number"), "elapsed_s")).alias("__c")))
    fresh = calls.groupBy(*key_cols).agg(F.array_sort(F.collect_list("__c")).alias("__calls"))
    if state is None:
        both = fresh.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(STATE)])
    else:
        old = state.select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(key_cols)], "n_calls", "first", "last")
        on = [F.col(c).eqNullSafe(F.col(f"__o{i}")) for i, c in enumerate(key_cols)]
        both = fresh.join(old, on, "full")
        both = both.select(*[F.coalesce(c, f"__o{i}").alias(c) for i, c in enumerate(key_cols)], "__calls", "n_calls", "first", "last")
    seen = F.coalesce("n_calls", F.lit(0))
    both = both.withColumn("__take", F.slice(F.coalesce("__calls", F.array().cast(fresh.schema["__calls"].dataType)), F.lit(1), F.lit(max_attempts) - seen))
    take = F.col("__take")

    def entry(c: Column) -> Column:
        return F.struct((seen + c["__n"]).cast("int").alias("attempt"), c["response_text"].alias("response_text"), c["number"].alias("number"),
                        c["elapsed_s"].cast("double").alias("elapsed_s"))

    hit = F.get(F.filter(take, lambda c: c["valid"]), F.lit(0))
    last = F.get(take, F.size(take) - 1)
    return both.select(*key_cols, (seen + F.size(take)).cast("int").alias("n_calls"),
                       F.coalesce("first", F.when(hit.isNotNull(), entry(hit))).alias("first"),
                       F.when(F.size(take) > 0, entry(last)).otherwise(F.col("last")).alias("last"))


def resolved_state(state: DataFrame, key_cols: list[str], scale: RatingScale = DEFAULT_SCALE) -> DataFrame:
    """Attempt state → one reply per key, as ``resolve_attempts`` gives it."""
    hit = F.col("first").isNotNull()
    pick = F.when(hit, F.col("first")).otherwise(F.col("last"))
    return state.select(*key_cols, F.coalesce(pick["attempt"], F.lit(0)).alias("attempt"), "n_calls", pick["response_text"].alias("response_text"),
                        F.when(hit, rating_text(F.col("first")["number"], scale)).otherwise(F.lit("N/A")).alias("rating_text"),
                        pick["elapsed_s"].alias("elapsed_s"))


def batch_timing(responses: DataFrame, run_cols: list[str], position_col: str = "item_id",
                 batch_size: int = 20, elapsed_col: str = "elapsed_s") -> DataFrame:
    """Per run and batch of ``batch_size`` questions: number of questions, summed
    and slowest reply time. Batches go by a question's place among the run's own
    questions in the order of ``position_col`` (numeric), not by its id. Sums are
    exact (decimal).

    Places are counted on the run's distinct questions, dealt to tasks by sampled ranges of their ids
    (``operators.numbering``): no task sees a whole run, wherever its ids lie."""
    items = numbered(responses.select(*run_cols, position_col).distinct(), run_cols, [position_col], "__place")
    items = items.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*run_cols, position_col])],
                         F.floor(F.col("__place") / batch_size).cast("long").alias("batch"))
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate([*run_cols, position_col])]
    e = F.col(elapsed_col).cast("decimal(18,6)")
    return (responses.join(items, on).groupBy(*run_cols, "batch")
            .agg(F.count(F.lit(1)).alias("n_questions"),
                 F.sum(e).cast("double").alias("sum_elapsed_s"),
                 F.max(elapsed_col).alias("max_elapsed_s")))
