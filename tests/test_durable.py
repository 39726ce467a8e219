"""Runs that stop anywhere, tasks that are lost, state that is folded in parts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from traitgrid import storage
from traitgrid.functions import first_char
from traitgrid.operators.collect import collect_durably, collect_responses, resolve_attempts, resolved_state, update_attempts
from traitgrid.operators.grid import persona_catalogue
from traitgrid.plans import experiment
from traitgrid.session import shared_path
from traitgrid.sinks.commits import committed_cells, read_committed


def _grid(spark, items=12):
    key = spark.createDataFrame([(i, f"I do thing {i}.", "Openness" if i % 2 else "Agreeableness", 1.0 if i % 3 else -1.0) for i in range(items)],
                                "item_id long, question string, trait string, weight double")
    return key, persona_catalogue(spark, ["Openness", "Agreeableness"], values=[1, 9])


def _answers(prompts, attempt):
    return prompts.map(lambda p: "5" if "score 9" in p else ("maybe" if attempt == 1 else "1"))


def _rows(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("step", ["attempts", "state", "responses", "scores", "commit"])
def test_a_run_that_stops_before_a_write(spark, step):
    key, personas = _grid(spark)
    args = (spark, key, personas, ["007"], ["Openness", "Agreeableness"])
    whole, broken = shared_path(spark, "whole"), shared_path(spark, "broken")
    experiment.run_experiment(*args, whole, lambda: _answers, max_attempts=3)

    def stop(now):
        if now == step:
            raise InterruptedError
    with pytest.raises(InterruptedError):
        experiment.run_experiment(*args, broken, lambda: _answers, max_attempts=3, before=stop)
    assert committed_cells(spark, broken).count() == 0
    experiment.run_experiment(*args, broken, lambda: _answers, max_attempts=3)
    for t in ("responses", "scores"):
        a, b = (experiment.results(spark, r, t) for r in (whole, broken))
        assert _rows(a.drop("elapsed_s")) == _rows(b.drop("elapsed_s")) and a.count() in (4, 24)
        assert len(storage.names(spark, f"{broken}/{t}")) == 1  # what was half written is gone
    assert {r.model for r in b.collect()} == {"007"}
    # no reply was asked for twice
    assert spark.read.parquet(f"{broken}/attempts").count() == spark.read.parquet(f"{whole}/attempts").count()


def test_committed_rows_only_and_their_folders_only(spark):
    key, personas = _grid(spark)
    root = shared_path(spark, "pruned")
    experiment.run_experiment(spark, key, personas, ["m", "n"], ["Openness"], root, lambda: _answers, max_attempts=3)
    experiment.write_run(experiment.results(spark, root, "scores").withColumn("mean", F.lit(9.9)), root, "scores", "99-lost")
    assert experiment.results(spark, root, "scores").filter("mean = 9.9").isEmpty()
    cells = spark.createDataFrame([("m", "Openness", 9)], "model string, trait string, value int")
    one = read_committed(spark, root, "scores", cells)
    assert one.count() == 1
    assert "dynamicpruning" in one._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_killed_task_asks_one_batch_again(spark, tmp_path):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(200)], "item_id long, prompt string")
    out, work = shared_path(spark, "killed"), shared_path(spark, "killed-work")
    log = str(tmp_path)

    def factory():
        def ask(ps, attempt):
            for p in ps:
                with open(f"{log}/asked", "a") as f:
                    f.write(p + "\n")
            if "p120" in set(ps) and not os.path.exists(f"{log}/died"):
                open(f"{log}/died", "w").close()
                raise RuntimeError("the worker dies")
            return ps.map(lambda p: "4")
        return ask

    with pytest.raises(Exception, match="the worker dies"):
        collect_durably(prompts, out, work, factory, ["item_id"], task_prompts=10, tasks=2)
    before = [b for b in storage.names(spark, out)]
    got = collect_durably(prompts, out, work, factory, ["item_id"], task_prompts=10, tasks=2)
    assert sorted(r.item_id for r in got.collect()) == list(range(200))
    asked = open(f"{log}/asked").read().split()
    assert len(asked) - len(set(asked)) <= 2 * 10 and before  # a batch is two tasks of ten prompts
    again = collect_durably(prompts, out, work, factory, ["item_id"], task_prompts=10, tasks=2)
    assert again.count() == 200 and len(open(f"{log}/asked").read().split()) == len(asked)


def test_batches_grow_with_the_prompts(spark, monkeypatch):
    from traitgrid.operators import collect
    monkeypatch.setattr(collect, "BATCHES", 4)
    prompts = spark.range(90).selectExpr("id AS item_id", "concat('p', id) AS prompt").repartition(1)
    out = shared_path(spark, "batches")
    got = collect_durably(prompts, out, shared_path(spark, "batches-work"), lambda: _answers, ["item_id"], task_prompts=3, tasks=2, max_attempts=3)
    assert len(storage.names(spark, out)) <= 4
    assert sorted(got.groupBy("item_id").count().collect()) == [(i, 2) for i in range(90)]


def test_missing_file_is_no_outage(spark):
    prompts = spark.createDataFrame([(1, "a")], "item_id long, prompt string")

    def factory():
        return lambda ps, attempt: open("/no/such/file").read()
    with pytest.raises(Exception, match="No such file"):
        collect_responses(prompts, factory, ["item_id"], retry_pause_s=0.0).collect()

    class Own(OSError):
        pass

    def down():
        def ask(ps, attempt):
            raise Own("unreachable")
        return ask
    att = collect_responses(prompts, down, ["item_id"], retry_pause_s=0.0, max_call_failures=1, transient=(OSError,))
    assert att.filter("NOT ok").count() == 2


@pytest.mark.parametrize("rules", [{}, {"max_attempts": 3}, {"allowed": None}, {"allowed": ["1", "7"]}, {"parser": first_char}])
def test_folding_in_parts_is_resolving_the_whole(spark, rules):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(40)]), i, None if (bad := rng.random() < 0.2) else rng.choice(["4", "no", "7 of 9", " 3 x", "12"]), not bad) for i in range(900)]
    log = spark.createDataFrame(rows, "item_id long, call int, response_text string, ok boolean").withColumn("elapsed_s", F.col("call") / 8)
    state = None
    for low, high in ((0, 5), (5, 300), (300, 301), (301, 900)):
        state = update_attempts(state, log.filter(f"call >= {low} and call < {high}"), ["item_id"], ["call"], **rules).checkpoint()
    whole = resolve_attempts(log, ["item_id"], ["call"], **rules)
    assert _rows(resolved_state(state, ["item_id"])) == _rows(whole)


def test_resume_reads_no_more_after_many_runs(spark):
    key, personas = _grid(spark)
    args = (spark, key, personas, ["m"], ["Openness", "Agreeableness"])
    root = shared_path(spark, "many")

    def down():
        return lambda ps, attempt: ps.map(lambda p: None if "thing 3" in p else "4")
    sizes = []
    for _ in range(4):
        experiment.run_experiment(*args, root, down, max_attempts=3, max_call_failures=0, retry_pause_s=0.0)
        files = experiment.attempt_state(spark, root).inputFiles()
        sizes.append(sum(os.path.getsize(f.removeprefix("file://")) for f in files))
    assert len(set(sizes[1:])) == 1 and len(storage.names(spark, f"{root}/attempts")) == 4
    assert len(storage.names(spark, f"{root}/state_log")) == 1
    experiment.run_experiment(*args, root, lambda: _answers, max_attempts=3)
    assert experiment.results(spark, root, "responses").count() == 24


def test_runner_takes_a_parser_and_any_reply(spark):
    key, personas = _grid(spark, 4)
    args = (spark, key, personas, ["m"], ["Openness"])

    def echo():
        return lambda ps, attempt: ps.map(lambda p: f" {attempt + 2} of 9")
    root = shared_path(spark, "parser")
    experiment.run_experiment(*args, root, echo, max_attempts=3, parser=first_char, reply_parser=lambda s: s.str.strip().str[:1])
    assert {(r.rating_text, r.attempt) for r in experiment.results(spark, root, "responses").collect()} == {("3", 1)}
    root = shared_path(spark, "any")
    experiment.run_experiment(*args, root, echo, max_attempts=3, allowed=None)
    assert {(r.rating_text, r.attempt, r.n_calls) for r in experiment.results(spark, root, "responses").collect()} == {("N/A", 1, 1)}
