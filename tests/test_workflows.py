"""The README's workflow snippet, run end to end on small invented files."""

import json
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from traitgrid import sinks as K
from traitgrid import sources as S
from traitgrid.functions import cohort_of, first_char, format_reward, parse_score, rating_reward, strip_echo
from traitgrid.operators import collect, grid, instrument, report, scoring, training
from traitgrid.plans.experiment import run_experiment
from traitgrid.session import shared_path

TRAITS3 = ["Agreeableness", "Openness", "Conscientiousness"]
TEXT = "\n\n".join([
    "A1: TRUST (Alpha = .82)\n+ keyed\tTrust others.\n \tBelieve people mean well.\n\n– keyed\tDistrust people.",
    "O1: IMAGINATION (.83)\n+ keyed\tHave a vivid imagination.\n\n– keyed\tSeldom daydream.\n \tHave few ideas.",
    "C1: ORDER (.79)\n+ keyed\tLike order.\n\n– keyed\tLeave a mess.",
    "N1: ANXIETY (.83)\n+ keyed\tWorry about things.\n \tFear for the worst.\n\n– keyed\tRarely worry.",
])


def test_readme_workflows(spark):
    d = tempfile.mkdtemp(prefix="tg-wf-")
    with open(f"{d}/inventory.txt", "w") as f:
        f.write(TEXT)
    items = instrument.parse_inventory(S.read_inventory_text(spark, f"{d}/inventory.txt"))
    key = instrument.key_wide(instrument.key_from_inventory(items))
    key_dir = shared_path(spark, "key")
    K.write_columns_json(key, key_dir, index_col="item_id")
    key = S.read_key(spark, key_dir)
    assert key.count() == 11 and key.columns[:2] == ["item_id", "question"]

    rows = [(t, q, "", v, f"You are {v} on {t}.") for t in TRAITS3 + ["Neuroticism", "Extraversion"]
            for v, q in [(1, "low"), (9, "high")]]
    with open(f"{d}/personas.json", "w") as f:
        json.dump({c: {str(i): r[j] for i, r in enumerate(rows)}
                   for j, c in enumerate(["Domain", "QualifierType", "Qualifier", "Value", "Description"])}, f)
    personas = S.read_personas(spark, f"{d}/personas.json")
    long_key = instrument.key_long(key, keyed_only=True)

    def api_model():
        return lambda ps, attempt: ps.map(lambda p: "5" if "You are 9" in p else ("hmm" if attempt == 1 else "2"))
    paths = run_experiment(spark, long_key, personas, ["my-model"], TRAITS3, shared_path(spark, "results"), api_model)
    scores = {(r.trait, r.value): r.mean for r in spark.read.parquet(paths["scores"]).collect()}
    assert len(scores) == 6 and scores[("Agreeableness", 9)] in (5.0, 3.67)

    # result tree written cell by cell, then analysed
    tree_rows = spark.read.parquet(paths["responses"]).join(key, "item_id").select(
        "model", "trait", "value", "item_id", "question", *[c for c in key.columns if c not in ("item_id", "question")],
        F.col("response_text").alias("responses"), F.col("rating_text").alias("numbers_extracted"),
        F.col("elapsed_s").alias("elapsed_times"))
    root = shared_path(spark, "tree")
    K.write_columns_json(tree_rows, root, index_col="item_id", chunk_cols=["model", "trait", "value"])
    cells = scoring.cell_scores(S.read_result_tree(spark, root), None, ("model", "trait", "value"))
    assert sorted((r.trait, r.value) for r in cells.collect()) == sorted(scores)
    table = report.dose_response_table(cells, ["model"], "value")
    md = report.markdown_lines(table, ["model"], "value", TRAITS3)
    K.write_markdown(md, shared_path(spark, "report"), ["model"])
    assert md.count() == 4

    # local model flow
    prompts = grid.prompt_grid(long_key, personas, ["local"], style="agreement")

    def local_model():
        return lambda ps, attempt: ps.map(lambda p: p + " 4\n")
    ids = ["model", "trait", "value", "repetition", "item_id"]
    att = collect.collect_responses(prompts, local_model, ids, max_attempts=1, allowed=None)
    resolved = collect.resolve_attempts(att.join(prompts.select(*ids, "prompt"), ids)
                                        .withColumn("response_text", strip_echo("response_text", "prompt")),
                                        ids, parser=first_char)
    card = scoring.score_card(resolved, key, ["model", "repetition"])
    card_dir = shared_path(spark, "cards")
    K.write_score_card(card, card_dir)
    r = card.first()
    assert r.na_share_rounded == 0.0 and r.Neuroticism == "3.33+-0.94"  # 4, 4 and reverse-keyed 2

    # cohorts of cards by file name
    cd = tempfile.mkdtemp(prefix="tg-cards-")
    for name, v in [("m-1.5B__20250101_120000.json", "3.1+-0.9"), ("m-1.5B_Neuroticism_20250101_120001.json", "4.4+-0.5")]:
        with open(f"{cd}/{name}", "w") as f:
            json.dump({"Neuroticism": {"0": v}, "N/A": {"0": 0.0}}, f)
    cards = S.read_score_cards(spark, cd)
    levels = cards.select(cohort_of("file_name").alias("cohort"), parse_score("Neuroticism", 1).alias("level"))
    hist = report.cohort_histogram(levels, "cohort", "level", bins=5)
    assert {(r.cohort, r.n) for r in hist.filter("n > 0").collect()} == {("base/plain", 1), ("neuroticism/plain", 1)}

    # training set and rewards
    ex = training.train_eval_split(training.training_examples(long_key), ["item_id"], 16)
    assert ex.count() == 2 and {r.split for r in ex.collect()} == {"eval"}
    completions = spark.createDataFrame([(1, "5"), (1, " 3 maybe"), (2, "4")], "prompt_id long, completion string")
    scored = training.score_completions(completions, {"rating": (rating_reward, 1.0), "format": (format_reward, 0.2)})
    adv = {r.completion: r.advantage for r in training.group_advantage(scored, "prompt_id", "reward").collect()}
    assert adv["4"] == 0.0 and adv["5"] > 0 > adv[" 3 maybe"]
    assert isinstance(pd.__version__, str) and os.path.isdir(d)
