import pandas as pd
from pyspark.sql import functions as F

from traitgrid.operators.collect import batch_timing, collect_responses, resolve_attempts


def _attempts(spark, replies):
    rows = [(1, i + 1, r, 0.5) for i, r in enumerate(replies)]
    return spark.createDataFrame(rows, "item_id long, attempt int, response_text string, elapsed_s double")


def test_first_valid_reply_wins(spark):
    r = resolve_attempts(_attempts(spark, ["x", "3", "4"]), ["item_id"]).first()
    assert (r.attempt, r.rating_text, r.response_text) == (2, "3", "3")


def test_ten_invalid_then_valid(spark):
    r = resolve_attempts(_attempts(spark, ["no"] * 9 + ["last no", "4"]), ["item_id"]).first()
    assert (r.attempt, r.rating_text, r.response_text, r.n_calls) == (10, "N/A", "last no", 10)


def test_allowed_none_takes_first(spark):
    r = resolve_attempts(_attempts(spark, ["x", "3"]), ["item_id"], allowed=None).first()
    assert (r.attempt, r.response_text, r.rating_text) == (1, "x", "N/A")


def test_failed_calls_do_not_count(spark):
    rows = [(1, 1, False, None), (1, 2, True, "x"), (1, 3, False, None), (1, 4, True, "5")]
    df = spark.createDataFrame(rows, "item_id long, call int, ok boolean, response_text string")
    df = df.withColumn("elapsed_s", df.call * 1.0)
    r = resolve_attempts(df, ["item_id"], ["call"]).first()
    assert (r.attempt, r.rating_text, r.elapsed_s) == (2, "5", 4.0)


def test_resolving_twice_is_idempotent(spark):
    a = _attempts(spark, ["x", "7", "2", "4"])
    once = resolve_attempts(a, ["item_id"])
    twice = resolve_attempts(once.select("item_id", "attempt", "response_text", "elapsed_s"), ["item_id"])
    assert once.select("response_text", "rating_text").collect() == twice.select("response_text", "rating_text").collect()


def _flaky():
    def ask(prompts: pd.Series, attempt: int) -> pd.Series:
        out = []
        for p in prompts:
            if p == "fail-once" and attempt == 1 and not hasattr(ask, "failed"):
                ask.failed = True
                out.append(None)
            elif p == "never":
                out.append("hmm")
            else:
                out.append("2" if attempt >= 2 else "maybe")
        return pd.Series(out, dtype=object)
    return ask


def test_collect_retries_until_valid(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "never"), (3, "fail-once")], "item_id long, prompt string")
    att = collect_responses(prompts, _flaky, ["item_id"], max_attempts=4).cache()
    res = {r.item_id: r for r in resolve_attempts(att, ["item_id"], ["attempt"], max_attempts=4).collect()}
    assert (res[1].attempt, res[1].rating_text) == (2, "2")
    assert (res[2].attempt, res[2].rating_text, res[2].response_text) == (4, "N/A", "hmm")
    assert (res[3].attempt, res[3].rating_text) == (2, "2")
    assert att.filter("NOT ok").count() == 1  # the failed call is logged but not counted


def test_batch_timing(spark):
    df = spark.createDataFrame([(i, 0.1 * (i % 3)) for i in range(45)], "item_id long, elapsed_s double")
    rows = sorted(batch_timing(df, [], "item_id", 20).collect())
    assert [(r.batch, r.n_questions) for r in rows] == [(0, 20), (1, 20), (2, 5)]
    assert rows[2].max_elapsed_s == 0.2


def test_run_experiment_resumes(spark):
    from pyspark.sql import functions as F
    from traitgrid.operators.grid import persona_catalogue
    from traitgrid.plans.experiment import run_experiment
    from traitgrid.session import shared_path

    key = spark.createDataFrame([(i, f"I do thing {i}.", "Openness" if i % 2 else "Agreeableness", 1.0 if i % 3 else -1.0)
                                 for i in range(12)], "item_id long, question string, trait string, weight double")
    personas = persona_catalogue(spark, ["Openness", "Agreeableness"], values=[1, 9])

    def factory():
        def ask(prompts, attempt):
            return prompts.map(lambda p: "5" if "score 9" in p else ("maybe" if attempt == 1 else "1"))
        return ask

    root = shared_path(spark, "exp")
    paths = run_experiment(spark, key, personas, ["m1"], ["Openness", "Agreeableness"], root, factory, max_attempts=3)
    scores = {(r.trait, r.value): r for r in spark.read.parquet(paths["scores"]).collect()}
    assert len(scores) == 4
    assert scores[("Openness", 9)].n_valid == 6 and scores[("Openness", 1)].n_valid == 6
    n_att = spark.read.parquet(paths["attempts"]).count()
    assert n_att == 12 * 1 + 12 * 2  # value 9 answers at once, value 1 needs a second attempt
    run_experiment(spark, key, personas, ["m1"], ["Openness", "Agreeableness"], root, factory, max_attempts=3)
    assert spark.read.parquet(paths["attempts"]).count() == n_att  # nothing re-asked
    assert spark.read.parquet(paths["responses"]).count() == 24


def test_item_with_only_failed_calls_is_na(spark):
    rows = [(1, 1, False, None), (1, 2, False, None), (2, 1, True, "4")]
    df = spark.createDataFrame(rows, "item_id long, call int, ok boolean, response_text string").withColumn("elapsed_s", F.lit(1.0))
    res = {r.item_id: r for r in resolve_attempts(df, ["item_id"], ["call"]).collect()}
    assert (res[1].attempt, res[1].rating_text, res[1].response_text, res[1].n_calls) == (0, "N/A", None, 0)
    assert (res[2].attempt, res[2].rating_text) == (1, "4")


def test_failed_calls_do_not_use_up_attempts(spark):
    rows = [(1, i, i % 2 == 0, "x" if i % 2 == 0 else None) for i in range(1, 21)] + [(1, 21, True, "3")]
    df = spark.createDataFrame(rows, "item_id long, call int, ok boolean, response_text string").withColumn("elapsed_s", F.lit(1.0))
    r = resolve_attempts(df, ["item_id"], ["call"], max_attempts=11).first()
    assert (r.attempt, r.rating_text, r.n_calls) == (11, "3", 11)


def test_local_runner_flow_first_character(spark):
    from traitgrid.functions import first_char, strip_echo
    prompts = spark.createDataFrame([(1, "P1: "), (2, "P2: ")], "item_id long, prompt string")

    def factory():
        # the model echoes the prompt before its answer
        return lambda ps, attempt: ps.map(lambda p: p + (" 4 because" if p.startswith("P1") else " maybe 5"))
    att = collect_responses(prompts, factory, ["item_id"], max_attempts=1, allowed=None)
    att = att.join(prompts, "item_id").withColumn("response_text", strip_echo("response_text", "prompt"))
    res = {r.item_id: r for r in resolve_attempts(att, ["item_id"], max_attempts=1, parser=first_char).collect()}
    assert (res[1].rating_text, res[1].response_text) == ("4", "4 because")
    assert res[2].rating_text == "N/A"


def test_responder_with_per_reply_timings(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(25)], "item_id long, prompt string")

    def factory():
        def ask(ps, attempt):
            return pd.DataFrame({"text": ["3"] * len(ps), "elapsed_s": [0.25 * (1 + int(p[1:]) % 2) for p in ps]})
        return ask
    att = collect_responses(prompts, factory, ["item_id"], max_attempts=2)
    res = resolve_attempts(att, ["item_id"])
    timing = sorted(batch_timing(res, [], "item_id", 20).collect())
    assert [(r.batch, r.n_questions, r.sum_elapsed_s, r.max_elapsed_s) for r in timing] == [(0, 20, 7.5, 0.5), (1, 5, 1.75, 0.5)]


def test_raising_responder_counts_as_failed_calls(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "item_id long, prompt string")

    def factory():
        state = {"calls": 0}

        def ask(ps, attempt):
            state["calls"] += 1
            if state["calls"] == 1:
                raise ConnectionError("temporarily unavailable")
            return ps.map(lambda p: "4")
        return ask
    att = collect_responses(prompts, factory, ["item_id"], max_attempts=3, num_partitions=1).cache()
    assert att.filter("NOT ok").count() == 2 and att.filter("ok").count() == 2
    res = {r.item_id: (r.attempt, r.rating_text) for r in resolve_attempts(att, ["item_id"]).collect()}
    assert res == {1: (1, "4"), 2: (1, "4")}


def test_one_responder_per_model(spark):
    prompts = spark.createDataFrame([(m, i, f"q{i}") for m in ("gpt-x", "claude-y") for i in range(6)],
                                    "model string, item_id long, prompt string")
    made = []

    def factory(model):
        made.append(model)
        return lambda ps, attempt: ps.map(lambda p: "5" if model.startswith("claude") else "2")
    att = collect_responses(prompts, factory, ["model", "item_id"], num_partitions=2, model_col="model")
    got = {(r.model, r.rating_text) for r in resolve_attempts(att, ["model", "item_id"]).collect()}
    assert got == {("gpt-x", "2"), ("claude-y", "5")}
