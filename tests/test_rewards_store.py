import pytest
from pyspark.sql import functions as F

from traitgrid.functions.ratings import rating_value
from traitgrid.operators.training import BatchReward, group_advantage, score_completions, store_completions, stored_advantage, train_eval_split
from traitgrid.session import shared_path
from tests.helpers import col_values


def _scored(spark):
    rows = [(None if i % 97 == 0 else i % 40 if i % 3 else 7, i, f"{i % 5 + 1}") for i in range(3000)]
    df = spark.createDataFrame(rows, "prompt_id long, completion_id long, completion string").repartition(6)
    return score_completions(df, {"n": (F.col("completion").cast("double"), 1.0)})


def _rows(df):
    return sorted(((r.prompt_id, r.completion_id, round(r.advantage, 9)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot", [10**6, 200])
def test_stored_completions_are_not_shuffled(spark, hot):
    df = _scored(spark)
    stored = store_completions(df, shared_path(spark, "store"), "prompt_id", buckets=4, hot=hot)
    out = stored_advantage(spark, stored, "prompt_id")
    assert _rows(out) == _rows(group_advantage(df, "prompt_id")) and out.count() == 3000
    named = stored_advantage(spark, (stored[0], None), "prompt_id").filter("prompt_id is not null")
    plan = named._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Union")[0] if "Union" in plan and plan.index("Union") > 400 else plan
    assert "SortMergeJoin" in main and "Exchange" not in main.split("SortMergeJoin")[1].split("group_std")[0]
    assert (stored[1] is None) == (hot > 2000)


def test_batch_rewards(spark):
    df = spark.createDataFrame([(i, f"{i % 7}", f"a{i}", None if i % 5 == 0 else i) for i in range(500)], "k long, completion string, answer string, extra int").repartition(3)
    calls = {"length": (BatchReward(lambda completions, answer: [len(a) for a in answer], ("answer",)), 0.5),
             "some": (BatchReward(lambda completions, extra: extra, ("extra",)), 1.0), "five": (lambda c: (c == "5").cast("double"), 2.0)}
    for r in score_completions(df, calls).collect():
        assert (r.length, r.some, r.five) == (len(r.answer), r.extra, float(r.completion == "5"))
        assert r.reward is None if r.extra is None else r.reward == 0.5 * r.length + r.some + 2 * r.five
    assert "MapInArrow" in str(score_completions(df, calls)._jdf.queryExecution().executedPlan().toString()) and \
        score_completions(df, calls)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    with pytest.raises(Exception, match="gave 1 rewards"):
        score_completions(df, {"bad": (BatchReward(lambda completions: [1.0]), 1.0)}).collect()


def test_a_suffix_makes_no_number(spark):
    texts = ["5", "5.0", " 4 ", "+3", "5d", "5f", "5D", "0x5", "1e0", "5.5", "05", "N/A", None, "", "٥", "5.", "3.00 "]
    got = col_values(spark, texts, rating_value)
    assert got == [5, 5, 4, 3, None, None, None, None, None, None, 5, None, None, None, None, 5, 3]


def test_copies_of_due_rows_are_counted(spark):
    df = spark.createDataFrame([("a", 1)] * 5000 + [("a", 2)] * 3 + [("b", 9)], "g string, x int").repartition(4)
    got = {(r.g, r.x, r.split): r["count"] for r in train_eval_split(df, ["x"], 16, by=["g"]).groupBy("g", "x", "split").count().collect()}
    assert got == {("a", 1, "eval"): 16, ("a", 1, "train"): 4984, ("a", 2, "train"): 3, ("b", 9, "eval"): 1}
