"""A full grid experiment as a chain of durable Spark jobs.

    pending cells (anti-join with the cells the commit log names)
      → prompt grid for those cells, less the questions that are answered (attempt state)
      → collect replies, batch by batch (the only Python step)  ──► attempts/run=…/batch=…
      → fold this run's attempts into the state, by bucket       ──► state/run=…/bucket=…, state_log/…
      → replies and trait scores of the cells that are whole      ──► responses/run=…, scores/run=…
      → one record that names these cells                         ──► commits/…

Nothing is read before the record that names it is there, and a record is one file. So a run may
stop anywhere: replies are durable batch by batch and never asked for again, a cell has both its
responses and its scores or is pending, and the next run removes what was left half written. A run
reads the state of its pending cells' buckets, never the attempts of runs folded in before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitgrid import storage
from traitgrid.operators.collect import (STATE, TASK_PROMPTS, TRANSIENT, attempt_schema, collect_durably, read_attempts, resolved_state,
                                         update_attempts)
from traitgrid.operators.grid import CELL, pending_cells, prompt_grid
from traitgrid.operators.scoring import cell_scores
from traitgrid.schemas import DEFAULT_SCALE, RatingScale
from traitgrid.sinks.commits import clean_up, committed_cells, publish, read_committed, write_run

IDS = ["model", "trait", "value", "repetition", "item_id"]
#: Buckets of the attempt state, and how many of them one cell's questions lie in.
BUCKETS = 64
SPREAD = 8
_IDS = "model string, trait string, value int, repetition int, item_id long"
_LOG = "run string, buckets map<string, string>"


def bucket_of() -> Column:
    """A question's bucket: its cell's, and a few after it."""
    return F.pmod(F.xxhash64(*CELL) + F.pmod(F.xxhash64("item_id", "repetition"), F.lit(SPREAD)), F.lit(BUCKETS)).cast("int")


def state_log(spark: SparkSession, root: str) -> tuple[str, dict[int, str]]:
    """The last run folded into the state, and the run that wrote each bucket last. One small file is read,
    however many runs there were."""
    path = f"{root}/state_log"
    found = storage.records(spark, path)
    if not found:
        return "", {}
    r = storage.read_records(spark, path, _LOG, found[-1:]).first()
    return r["run"], {int(b): w for b, w in r["buckets"].items()}


def attempt_state(spark: SparkSession, root: str, buckets: list[int] | None = None, fields: list | None = None) -> DataFrame:
    """The folded attempts (``IDS`` and ``collect.STATE``) of some buckets, or all."""
    paths = [f"{root}/state/run={run}/bucket={b}" for b, run in state_log(spark, root)[1].items() if buckets is None or b in buckets]
    schema = T.StructType((fields or list(T.StructType.fromDDL(_IDS))) + list(T.StructType.fromDDL(STATE)))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def fold(spark: SparkSession, root: str, runs: list[str], schema: T.StructType, max_attempts: int, scale: RatingScale,
         allowed, parser) -> None:
    """Adds the attempts of ``runs`` (later than all that the state has) to it. Only buckets that they have
    questions in are read and written anew; the record that names the new ones is written last."""
    last, where = state_log(spark, root)
    name = storage.new_name()
    log = None
    for run in runs:
        part = read_attempts(spark, f"{root}/attempts/run={run}", schema).withColumn("run", F.lit(run))
        log = part if log is None else log.unionByName(part)
    if log is None:
        return
    touched = sorted(r[0] for r in log.select(bucket_of()).distinct().collect())  # at most BUCKETS
    if touched:
        fields = [schema[c] for c in IDS]
        old = attempt_state(spark, root, touched, fields) if where else None
        new = update_attempts(old, log, IDS, ["run", "attempt"], max_attempts, scale, allowed, parser).withColumn("bucket", bucket_of())
        new.repartition("bucket", F.pmod(F.xxhash64(*IDS), F.lit(SPREAD))).write.partitionBy("bucket").parquet(f"{root}/state/run={name}")
        where |= dict.fromkeys(touched, name)
    storage.put_record(spark.createDataFrame([(max(runs), {str(b): w for b, w in where.items()})], _LOG), f"{root}/state_log", name)
    for old_name in storage.records(spark, f"{root}/state_log")[:-1]:
        storage.remove(spark, f"{root}/state_log/{old_name}")
    for written in storage.names(spark, f"{root}/state"):
        held = {b for b, r in where.items() if written == f"run={r}"}
        for b in storage.names(spark, f"{root}/state/{written}"):
            if int(b.removeprefix("bucket=")) not in held:
                storage.remove(spark, f"{root}/state/{written}/{b}")
        if not held:
            storage.remove(spark, f"{root}/state/{written}")


def run_experiment(spark: SparkSession, key: DataFrame, personas: DataFrame, models: list[str],
                   traits: list[str], out_root: str, responder_factory: Callable[[], Callable],
                   repetitions: int = 1, max_attempts: int = 10, scale: RatingScale = DEFAULT_SCALE,
                   style: str = "rating", num_partitions: int | None = None,
                   per_model: bool = False, max_call_failures: int = 3, retry_pause_s: float = 4.0,
                   allowed: list[str] | None | str = "scale", parser: Callable[[Column], Column] | None = None,
                   reply_parser: Callable | None = None, task_prompts: int = TASK_PROMPTS, transient: tuple = TRANSIENT,
                   before: Callable[[str], None] | None = None) -> dict[str, str]:
    """Run (or resume) the grid models × traits × persona values; returns the
    paths of the attempts, responses and scores tables under ``out_root`` (``results`` reads the last two as
    committed). With ``per_model`` the factory is called
    with the model label (one client per model, as a provider is chosen by label).

    A cell is published when each of its questions has a valid reply or has used up
    its attempts. Calls that fail use up none: a cell with a question left stays
    pending, and the next call asks only the questions that are open, on top of
    the attempts written before (by earlier calls, finished or not).

    ``allowed`` (None: any reply) and ``parser`` say which replies are valid, as in ``resolve_attempts``; ``reply_parser`` is the
    parser for the calls themselves (a pandas Series, see ``collect_responses``). Tasks get ``task_prompts`` prompts each,
    ``num_partitions`` of them a batch (default: the task slots). ``before`` is called with a step's name before each write:
    attempts, state, responses, scores, commit."""
    root = out_root.rstrip("/")
    paths = {n: f"{root}/{n}" for n in ("attempts", "responses", "scores")}
    tell = before or (lambda step: None)
    rules = (max_attempts, scale, allowed, parser)
    run = storage.new_name()
    clean_up(spark, root)
    cells = (personas.filter(F.col("domain").isin(*traits))
             .select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model"),
                     F.col("domain").alias("trait"), "value").distinct())
    todo = pending_cells(cells, committed_cells(spark, root)).checkpoint(eager=True)
    grid = prompt_grid(key, personas, models, repetitions, traits, style).join(todo, CELL, "left_semi")
    schema = attempt_schema(grid, IDS)
    fields = [schema[c] for c in IDS]

    def answered() -> DataFrame:
        """Replies of questions that are closed. The state names its buckets' questions, of any cell."""
        near = todo.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda i: F.pmod(F.xxhash64(*CELL) + i, F.lit(BUCKETS)).cast("int"))))
        buckets = [r[0] for r in near.distinct().collect()]  # at most BUCKETS
        state = attempt_state(spark, root, buckets, fields).join(todo, CELL, "left_semi")
        return resolved_state(state.filter(F.col("first").isNotNull() | (F.col("n_calls") >= max_attempts)), IDS, scale)

    # replies that a crash kept from the state
    late = [r for n in storage.names(spark, paths["attempts"]) if (r := n.removeprefix("run=")) > state_log(spark, root)[0]]
    if late:
        fold(spark, root, late, schema, *rules)
    ask = grid.join(answered().select(*IDS), IDS, "left_anti")
    tell("attempts")
    collect_durably(ask, f"{paths['attempts']}/run={run}", f"{root}/work/{run}", responder_factory, IDS, task_prompts=task_prompts,
                    tasks=num_partitions, max_attempts=max_attempts, scale=scale, allowed=allowed, parser=reply_parser,
                    model_col="model" if per_model else None, max_call_failures=max_call_failures, retry_pause_s=retry_pause_s, transient=transient)
    tell("state")
    if run in [n.removeprefix("run=") for n in storage.names(spark, paths["attempts"])]:
        fold(spark, root, [run], schema, *rules)
    for old in storage.names(spark, f"{root}/work"):
        storage.remove(spark, f"{root}/work/{old}")

    resolved = answered()
    need = grid.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_need"))
    have = resolved.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_have"))
    whole = need.join(have, CELL).filter("n_need = n_have").select(*CELL).checkpoint(eager=True)
    if whole.isEmpty():
        return paths
    fresh = resolved.join(whole, CELL, "left_semi")
    tell("responses")
    write_run(fresh, root, "responses", run)
    # a cell's own trait is the persona's domain; the other traits have no items in it
    tell("scores")
    write_run(cell_scores(fresh, key, ("model", "trait", "value", "repetition"), traits, scale), root, "scores", run)
    tell("commit")
    publish(spark, root, run)
    return paths


def results(spark: SparkSession, root: str, table: str, cells: DataFrame | None = None) -> DataFrame:
    """``responses`` or ``scores`` of the cells that are done (of ``cells``, if given)."""
    return read_committed(spark, root.rstrip("/"), table, cells)
