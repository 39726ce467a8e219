from pyspark.sql import functions as F

from tests.helpers import key_df
from traitgrid.functions import format_reward, rating_reward
from traitgrid.operators.training import group_advantage, score_completions, train_eval_split, training_examples


def test_split_sizes(spark):
    df33 = spark.range(33).withColumnRenamed("id", "item_id")
    c = {r.split: r["count"] for r in train_eval_split(df33, ["item_id"], 16).groupBy("split").count().collect()}
    assert c == {"eval": 16, "train": 17}
    df10 = spark.range(10).withColumnRenamed("id", "item_id")
    assert {r.split for r in train_eval_split(df10, ["item_id"], 16).collect()} == {"eval"}
    first = train_eval_split(df33.repartition(5), ["item_id"], 16).filter("split = 'eval'")
    assert sorted(r.item_id for r in first.collect()) == list(range(16))


def test_training_examples(spark):
    k = key_df(spark, [(0, "I worry.", "Neuroticism", 1.0), (1, "I relax.", "Neuroticism", -1.0)])
    rows = training_examples(k).collect()
    assert len(rows) == 1 and rows[0].answer == "5"
    assert rows[0].question == 'Statement: "I worry."\nYour agreement level (1-5): '
    assert rows[0].prompt.endswith(rows[0].question)


def test_rewards_and_advantage(spark):
    df = spark.createDataFrame([(1, "5"), (1, "3"), (2, "4"), (3, "no"), (3, "no")], "prompt_id long, completion string")
    rw = score_completions(df, {"a": (rating_reward, 1.0), "b": (format_reward, 0.2)})
    adv = {(r.prompt_id, r.completion): r for r in group_advantage(rw, "prompt_id").collect()}
    assert adv[(1, "5")].reward == 1.0 + 0.2 * 1.0
    assert adv[(2, "4")].advantage == 0.0            # single completion
    assert adv[(3, "no")].advantage == 0.0           # equal rewards
    a, b = adv[(1, "5")].advantage, adv[(1, "3")].advantage
    assert a > 0 > b and abs(a + b) < 1e-12


def test_group_advantage_with_a_hot_prompt(spark):
    """A third of all completions share one prompt; results equal a pandas groupby."""
    from tests.conftest import SF_SMALL
    from traitgrid.plans import fixtures as fx
    from traitgrid.plans.queries import REWARDS
    d = fx.d7_completions(spark, SF_SMALL)
    d = d.withColumn("order_id", F.col("prompt_id"))
    d = d.withColumn("prompt_id", F.when(F.col("part_id") % 3 == 0, F.lit(-1)).otherwise(F.col("prompt_id")))
    scored = score_completions(d, REWARDS)
    ids = ["order_id", "line_no", "part_id", "supp_id"]
    got = group_advantage(scored, "prompt_id", "reward").select(*ids, "advantage")
    pdf = scored.select("prompt_id", *ids, "reward").toPandas()
    hot = (pdf.prompt_id == -1).mean()
    assert 0.25 < hot < 0.4
    g = pdf.groupby("prompt_id")["reward"]
    mean, std, n = g.transform("mean"), g.transform("std"), g.transform("count")
    pdf["expect"] = ((pdf.reward - mean) / (std + 1e-4)).where(n > 1, 0.0)
    expect = sorted((*r[:4], round(r[4], 9)) for r in pdf[ids + ["expect"]].itertuples(index=False))
    actual = sorted((*r[:4], round(r[4], 9)) for r in got.collect())
    assert expect == actual
