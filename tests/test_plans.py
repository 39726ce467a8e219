"""Plan-shape checks: the properties that matter at scale, asserted on the
physical plans of the registered queries."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

FILE_BASED = {"columns_json_roundtrip", "live_trait_scores", "experiment_scores", "result_tree_scores",
              "score_card_files", "persona_file_prompts", "training_split_files", "crash_between_writes", "parsed_experiment",
              "card_union", "run_file_list", "inventory_files", "listed_cells", "bucketed_advantage"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {n: plan_of(q(spark, SF_SMALL)) for n, q in E.queries().items() if n not in FILE_BASED}


def test_no_cartesian_or_nested_loop_joins(plans):
    bad = {n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p}
    assert not bad


def test_no_row_at_a_time_python(plans):
    bad = {n for n, p in plans.items() if "BatchEvalPython" in p or "ArrowEvalPython" in p}
    assert not bad
    py = {n for n, p in plans.items() if "MapInPandas" in p}
    assert py == {"collect_responses"}


def test_scans_are_pruned(spark):
    from traitgrid.plans.queries import trait_scores
    p = trait_scores(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_returnflag:string>" in p
    assert "ReadSchema: struct<p_partkey:bigint>" in p


def test_scoring_is_broadcast_join_plus_one_run_aggregate(plans):
    p = plans["trait_scores"]
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    assert "partial_count" in p and "partial_sum" in p  # map-side combine before the exchange


def test_attempt_resolution_limits_before_shuffle(plans):
    p = plans["resolve_attempts"]
    assert "WindowGroupLimit" in p and "Partial" in p


def test_split_uses_top_k(plans):
    assert "TakeOrderedAndProject" in plans["train_eval_split"]


def test_results_unchanged_under_scale_settings(spark):
    from traitgrid.plans.queries import resolve_attempts, trait_scores
    from traitgrid.session import tune_for_scale
    tuned = tune_for_scale(spark.newSession(), total_cores=4)
    for q in (trait_scores, resolve_attempts):
        assert sorted(q(tuned, SF_SMALL).collect()) == sorted(q(spark, SF_SMALL).collect())


def test_fits_guards_partition_count(spark):
    from traitgrid.operators.joins import fits
    small = spark.range(0, 10, 1, 1)
    assert fits(small, 10) and not fits(small, 9)
    assert not fits(spark.range(0, 10, 1, 20), 100, max_partitions=16)  # decided without a job


def test_grid_broadcasts_personas(plans):
    p = plans["prompt_grid"]
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_size_check_by_bytes_gathers_no_rows(spark, tmp_path):
    from traitgrid.operators.joins import estimated_bytes, fits
    path = str(tmp_path / "wide")
    spark.range(2000).selectExpr("id", "repeat(cast(rand() as string), 200) AS text").write.parquet(path)
    wide = spark.read.parquet(path)
    assert estimated_bytes(wide) > 100_000 and not fits(wide, 300)  # few rows allowed, many bytes
    assert fits(wide, 1_000_000)
    rows = spark.createDataFrame([(i,) for i in range(50)], "x int")
    assert estimated_bytes(rows.repartition(3)) is None or fits(rows, 50)
    assert fits(rows, 50) and not fits(rows, 49)
