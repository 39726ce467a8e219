from pyspark.sql import functions as F

from tests.helpers import key_df, responses_df
from traitgrid.operators.scoring import rating_counts, score_card, target_mse, trait_scores

RUN = ["model", "value"]


def _key(spark):
    # item 0: E+, item 1: E-, item 2: A+, item 3: keyed to E and A (multi-keyed), item 4: unkeyed
    return key_df(spark, [(0, "q0", "Extraversion", 1.0), (1, "q1", "Extraversion", -1.0),
                          (2, "q2", "Agreeableness", 1.0), (3, "q3", "Extraversion", 1.0),
                          (3, "q3", "Agreeableness", 1.0), (4, "q4", "Openness", 0.0)])


def test_reverse_keying_and_counts(spark):
    resp = responses_df(spark, [("m", 1, 0, "2"), ("m", 1, 1, "2"), ("m", 1, 2, "7"), ("m", 1, 4, "5")])
    s = {r.trait: r for r in trait_scores(resp, _key(spark), RUN).collect()}
    e = s["Extraversion"]
    assert (e.n_keyed, e.n_valid, e.n_na, e.mean, e.std) == (2, 2, 0, 3.0, 1.0)  # 2 and 6-2=4
    a = s["Agreeableness"]
    assert (a.n_keyed, a.n_valid, a.n_na, a.mean, a.std) == (1, 0, 1, None, None)
    assert s["Openness"].n_keyed == 0
    assert e.n_rows == 4 and e.na_share == 0.25


def test_na_share_can_exceed_one(spark):
    resp = responses_df(spark, [("m", 1, 3, "N/A")])
    card = score_card(resp, _key(spark), RUN).first()
    assert card.na_share == 2.0 and card.na_share_rounded == 2.0 and card.n_na == 2
    assert card.Extraversion == "N/A" and card.Openness == "N/A"


def test_std_population_and_rounding(spark):
    k = key_df(spark, [(i, f"q{i}", "Extraversion", 1.0) for i in range(300)])
    rows = [("a", 1, 0, "3"), ("b", 1, 0, "1"), ("b", 1, 1, "5")]
    rows += [("c", 1, i, "2") for i in range(7)] + [("c", 1, 7, "3")]                      # mean 2.125
    rows += [("d", 1, i, "1") for i in range(197)] + [("d", 1, 197 + i, "2") for i in range(3)]  # mean 1.015
    s = {r.model: r for r in trait_scores(responses_df(spark, rows), k, RUN).filter("trait = 'Extraversion'").collect()}
    assert (s["a"].mean, s["a"].std) == (3.0, 0.0)
    assert (s["b"].mean, s["b"].std) == (3.0, 2.0)
    assert s["c"].mean == 2.12
    assert s["d"].mean == 1.01
    card = {r.model: r for r in score_card(responses_df(spark, rows), k, RUN).collect()}
    assert card["a"].Extraversion == "3.0+-0.0"


def test_reversing_all_weights_mirrors_mean(spark):
    import random
    rnd = random.Random(7)
    k = key_df(spark, [(i, f"q{i}", "Neuroticism", 1.0) for i in range(50)])
    k_rev = k.withColumn("weight", F.lit(-1.0))
    resp = responses_df(spark, [("m", v, rnd.randrange(50), str(rnd.randint(1, 5))) for v in range(1, 4) for _ in range(40)])
    a = {r.value: r for r in trait_scores(resp, k, RUN).filter("trait='Neuroticism'").collect()}
    b = {r.value: r for r in trait_scores(resp, k_rev, RUN).filter("trait='Neuroticism'").collect()}
    for v in a:
        assert abs((6 - a[v].mean) - b[v].mean) < 0.0100001 and a[v].std == b[v].std
        assert a[v].n_valid + a[v].n_na == a[v].n_keyed


def test_independent_of_partitioning(spark):
    from tests.conftest import SF_SMALL
    from traitgrid.plans.fixtures import d1_responses, d2_key
    resp, key = d1_responses(spark, SF_SMALL), d2_key(spark, SF_SMALL)
    a = sorted(trait_scores(resp, key, RUN).collect())
    b = sorted(trait_scores(resp.repartition(13, "item_id"), key.repartition(3), RUN).collect())
    assert a == b


def test_rating_counts_and_mse(spark):
    resp = responses_df(spark, [("m", 1, 0, "2"), ("m", 1, 1, "2"), ("m", 1, 2, "N/A")])
    rc = {r.rating_text: r for r in rating_counts(resp, RUN).collect()}
    assert rc["2"].n == 2 and rc["2"].rating == 2 and rc["N/A"].rating is None and rc["2"].n_total == 3
    scores = trait_scores(resp, _key(spark), RUN)
    m = target_mse(scores, F.lit(4.0), RUN).first()
    assert m.n_traits == 1 and m.mse == 1.0  # Extraversion mean 3.0 vs 4.0


def test_seven_point_scale(spark):
    from traitgrid.operators.collect import resolve_attempts
    from traitgrid.schemas import RatingScale
    seven = RatingScale(1, 7)
    att = spark.createDataFrame([(0, 1, "7 of 7"), (1, 1, "9"), (1, 2, "6"), (2, 1, "2")],
                                "item_id long, attempt int, response_text string").withColumn("elapsed_s", F.lit(0.1))
    res = resolve_attempts(att, ["item_id"], scale=seven).withColumn("model", F.lit("m")).withColumn("value", F.lit(1))
    key = key_df(spark, [(0, "q0", "Openness", 1.0), (1, "q1", "Openness", -1.0), (2, "q2", "Openness", 1.0)])
    s = trait_scores(res, key, RUN, scale=seven).filter("trait = 'Openness'").first()
    assert (s.n_keyed, s.n_valid, s.mean) == (3, 3, round((7 + (8 - 6) + 2) / 3, 2))
