
from traitgrid.operators.scoring import trait_scores
from traitgrid.plans.fixtures import d1_responses, d2_key
from traitgrid.session import shared_path
from traitgrid.streaming import start_live_scores

RUN = ["model", "value"]


def test_live_scores_equal_batch(spark):
    from tests.conftest import SF_SMALL
    resp, key = d1_responses(spark, SF_SMALL), d2_key(spark, SF_SMALL)
    src = shared_path(spark, "stream-src")
    resp.repartition(3, "model").write.parquet(src)  # three files land
    out = shared_path(spark, "stream-out")
    q = start_live_scores(spark, src, resp.schema, key, RUN, out, max_files_per_trigger=1, available_now=True)
    q.awaitTermination(120)
    live = spark.read.parquet(out).select("model", "value", "trait", "n_keyed", "n_valid", "n_na", "mean", "std")
    batch = trait_scores(resp, key, RUN).select("model", "value", "trait", "n_keyed", "n_valid", "n_na", "mean", "std")
    assert sorted(live.collect()) == sorted(batch.collect())
