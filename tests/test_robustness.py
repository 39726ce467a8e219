"""Faults that must not lose or change results in silence."""

import json
import os
import subprocess
import sys
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from traitgrid.functions import cohorts_of, rating_value
from traitgrid.operators.collect import batch_timing, collect_responses, single_numbers
from traitgrid.operators.grid import persona_catalogue, persona_prefix, prompt_grid
from traitgrid.operators.training import group_advantage, train_eval_split
from traitgrid.plans.experiment import run_experiment
from traitgrid.session import shared_path
from traitgrid.sinks.writers import write_columns_json
from traitgrid.sources.columns_json import read_responses, read_score_cards
from tests.conftest import ROOT
from tests.helpers import col_values


def test_outage_leaves_cells_pending_and_asks_only_what_is_open(spark):
    key = spark.createDataFrame([(i, f"I do thing {i}.", "Openness", 1.0) for i in range(6)],
                                "item_id long, question string, trait string, weight double")
    personas = persona_catalogue(spark, ["Openness"], values=[1, 9])
    root = shared_path(spark, "outage-test")

    def down():
        return lambda prompts, attempt: prompts.map(lambda p: None if "thing 3" in p and "score 9" in p else "4")

    def up():
        return lambda prompts, attempt: prompts.map(lambda p: "4")

    args = (spark, key, personas, ["m"], ["Openness"], root)
    paths = run_experiment(*args, down, max_attempts=3, max_call_failures=2, retry_pause_s=0.0)
    got = spark.read.parquet(paths["responses"])
    assert [(r["value"], r["count"]) for r in got.groupBy("value").count().collect()] == [(1, 6)]
    before = spark.read.parquet(paths["attempts"]).count()
    run_experiment(*args, up, max_attempts=3)
    assert spark.read.parquet(paths["attempts"]).count() == before + 1
    got = spark.read.parquet(paths["responses"])
    assert got.count() == 12 and got.filter("rating_text = 'N/A'").count() == 0
    assert spark.read.parquet(paths["scores"]).count() == 2


def test_a_fault_in_the_responder_is_no_outage(spark):
    prompts = spark.createDataFrame([(1, "a")], "item_id long, prompt string")

    def factory():
        def ask(ps, attempt):
            raise KeyError("a bug")
        return ask
    with pytest.raises(Exception, match="a bug"):
        collect_responses(prompts, factory, ["item_id"]).collect()


def test_collection_takes_a_parser(spark):
    prompts = spark.createDataFrame([(1, "a")], "item_id long, prompt string")

    def factory():
        return lambda ps, attempt: ps.map(lambda p: "4 or 5")
    first = collect_responses(prompts, factory, ["item_id"], max_attempts=3, parser=lambda s: s.str[:1])
    assert first.count() == 1
    assert collect_responses(prompts, factory, ["item_id"], max_attempts=3).count() == 3


def test_single_numbers():
    got = single_numbers(pd.Series(["3", "a 4 b 4", "1 2", "none", None, "٣"], index=[9, 9, 1, 2, 3, 4]))
    assert [None if pd.isna(x) else x for x in got] == ["3", "4", None, None, None, "٣"]


def test_unreadable_files_and_missing_personas_fail_with_their_name(spark):
    d = tempfile.mkdtemp(prefix="tg-bad-")
    with open(f"{d}/good.json", "w") as f:
        json.dump({"Neuroticism": {"0": "3.0+-1.0"}, "N/A": {"0": 0.0}}, f)
    with open(f"{d}/cut.json", "w") as f:
        f.write('{"Neuroticism": {"0": "3.0')
    with pytest.raises(Exception, match="cut.json"):
        read_score_cards(spark, d, ["Neuroticism"]).collect()
    with pytest.raises(Exception, match="extremly"):
        persona_prefix(persona_catalogue(spark), "Neuroticism", "high", "extremly").collect()


def test_default_readers_find_what_the_writers_write(spark):
    path = shared_path(spark, "fit")
    rows = spark.createDataFrame([(0, "I a.", 1.0, "5", "5", 0.5), (1, "I b.", -1.0, "x", "N/A", None)],
                                 "item_id long, question string, Openness double, responses string, numbers_extracted string, elapsed_times double")
    write_columns_json(rows, path, "item_id")
    got = {r.item_id: r for r in read_responses(spark, path, ["Openness"]).collect()}
    assert (got[0].rating_text, got[1].rating_text, got[1].elapsed_s) == ("5", "N/A", None)


def test_batches_go_by_position(spark):
    df = spark.createDataFrame([(m, 5 * i + 3, 0.1) for m in "ab" for i in range(60)], "model string, item_id long, elapsed_s double")
    one = sorted((r.batch, r.n_questions) for r in batch_timing(df.filter("model = 'a'"), [], "item_id", 5).collect())
    assert one == [(b, 5) for b in range(12)]
    assert batch_timing(df.withColumn("item_id", F.col("item_id") * 997), ["model"], "item_id", 5).count() == 24


def test_exact_eval_size_on_ties(spark):
    same = spark.createDataFrame([(1, "x")] * 40 + [(2, "y")] * 3, "k int, t string")
    got = train_eval_split(same, ["k"], 16).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"eval": 16, "train": 27}
    per = train_eval_split(same, ["k"], 16, by=["t"]).groupBy("t", "split").count().collect()
    assert {(r["t"], r["split"]): r["count"] for r in per} == {("x", "eval"): 16, ("x", "train"): 24, ("y", "eval"): 3}


def test_no_repetition_no_prompt(spark):
    key = spark.createDataFrame([(1, "I a.", "Openness", 1.0)], "item_id long, question string, trait string, weight double")
    assert prompt_grid(key, persona_catalogue(spark), ["m"], repetitions=0).count() == 0


def test_rating_of_a_numeric_column_with_a_gap(spark):
    assert col_values(spark, ["5.0", "5", "5.5", "N/A", None, "0"], rating_value) == [5, 5, None, None, None, None]


def test_overlapping_cohorts(spark):
    names = ["Qwen-1.5B__neuroticism-GRPO.json", "Qwen-1.5B_Neuroticism_x.json", "Qwen-3B__x.json"]
    assert col_values(spark, names, cohorts_of) == [["neuroticism/grpo", "base/grpo"], ["neuroticism/plain"], []]


def test_hot_group_is_split(spark):
    """Half of all rows share one prompt: with broadcast off, the join back splits them."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(400_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("g"), (F.col("id") % 5).cast("double").alias("reward"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
        out = group_advantage(df, "g").withColumn("task", F.spark_partition_id())
        tasks = out.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.max("text"), F.sum("advantage")).collect()
        most = max(r["n"] for r in tasks)
        assert most < 400_000 * 0.2
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_workers_find_the_package_from_another_folder():
    code = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {os.path.join(ROOT, "__spark_entry__.py")!r})
e = importlib.util.module_from_spec(spec); spec.loader.exec_module(e)
from traitgrid.session import build_session
s = build_session("local[2]", 2)
print("ROWS", e.queries()["collect_responses"](s, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(prefix="tg-away-"), env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS" in r.stdout, r.stderr[-2000:]


def test_scratch_is_removed_when_the_driver_ends(tmp_path):
    """What intermediate steps wrote to the shared folder goes with the application."""
    import subprocess
    import sys
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}').getOrCreate()
from traitgrid.operators.numbering import written
import os
written(spark.range(5), 'x').count()
print('held', sum(len(f) for _, _, f in os.walk('{tmp_path}')))
spark.stop()
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert "held" in out.stdout and "held 0" not in out.stdout, out.stderr[-2000:]
    assert not [p for p in tmp_path.rglob("*.parquet")]
