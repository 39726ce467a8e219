import random

from pyspark.sql import functions as F

from traitgrid.operators.numbering import numbered


def test_groups_ties_and_nulls(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, *range(50)])) for _ in range(3000)]
    rows += [("a", 7)] * 2000  # a third of all rows are one
    df = spark.createDataFrame(rows, "g string, x int").repartition(5)
    got = numbered(df, ["g"], ["x"]).collect()
    assert sorted((r.g or "", -1 if r.x is None else r.x) for r in got) == sorted((g or "", -1 if x is None else x) for g, x in rows)
    for g in (None, "a", "b", "c"):
        mine = sorted((r.pos, -1 if r.x is None else r.x) for r in got if r.g == g)
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert [x for _, x in mine] == sorted(x for _, x in mine)


def test_whole_table_and_empty(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    assert sorted((r.pos, r.x) for r in numbered(df, [], ["x"]).collect()) == [(i, i) for i in range(1000)]
    assert numbered(df.filter("x < 0"), [], ["x"]).count() == 0
    assert numbered(df.filter("x < 0").withColumn("g", F.lit("a")), ["g"], ["x"]).columns == ["x", "g", "pos"]


def test_a_hot_value_is_spread(spark):
    df = spark.range(20000).select(F.lit(1).alias("x"), "id").repartition(8, "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(df, [], ["x"])
        shares = got.groupBy(F.spark_partition_id()).count().count()
        assert shares > 1 and got.select("pos").distinct().count() == 20000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_batches_of_skewed_ids_without_a_global_window(spark):
    """Ids in clusters, far apart, null and repeated: places go by order, and no window spans all rows."""
    from traitgrid.operators.collect import batch_timing

    ids = [*range(5000), *range(10**12, 10**12 + 30), -7, None, 10**15]
    df = spark.createDataFrame([(i, 0.5) for i in ids + ids[:100]], "item_id long, elapsed_s double").repartition(6)
    out = batch_timing(df, [], "item_id", 20)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    got = {r.batch: r.n_questions for r in out.collect()}
    order = sorted(ids, key=lambda x: (x is not None, x or 0))
    want = {}
    for i in ids + ids[:100]:
        b = order.index(i) // 20
        want[b] = want.get(b, 0) + 1
    assert got == want
