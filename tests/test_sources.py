import json
import os
import tempfile

from pyspark.sql import functions as F

from traitgrid.operators.grid import grid_cells, pending_cells, persona_catalogue, persona_prefix, present_cells, prompt_grid
from traitgrid.sinks.writers import write_cells, write_columns_json, write_markdown, write_score_card
from traitgrid.sources.columns_json import read_columns_json, read_key, read_personas, read_responses, read_score_cards
from traitgrid.sources.results import read_cells, read_run_files
from traitgrid.session import shared_path


def _write(path, obj):
    with open(path, "w") as f:
        json.dump(obj, f)


def test_read_column_json_key_and_personas(spark):
    d = tempfile.mkdtemp(prefix="tg-src-")
    _write(f"{d}/key.json", {"question": {"0": "I a.", "1": "I b."}, "Extraversion": {"0": "1.0", "1": "0.0"},
                             "Agreeableness": {"0": "0.0", "1": "-1.0"}, "Conscientiousness": {"0": "0.0", "1": "0.0"},
                             "Neuroticism": {"0": "0.0", "1": "0.0"}, "Openness": {"0": "0.0", "1": "0.0"}})
    k = {r.item_id: r for r in read_key(spark, f"{d}/key.json").collect()}
    assert k[0].Extraversion == 1.0 and k[1].Agreeableness == -1.0 and k[1].question == "I b."
    _write(f"{d}/p.json", {"Domain": {"0": "Openness", "1": "Openness"}, "QualifierType": {"0": "high", "1": "high"},
                           "Qualifier": {"0": "", "1": "very"}, "Value": {"0": 7, "1": 8},
                           "Description": {"0": "You are open.", "1": "You are very open."}})
    p = read_personas(spark, f"{d}/p.json")
    assert sorted((r.value, r.qualifier) for r in p.collect()) == [(7, ""), (8, "very")]
    assert persona_prefix(p, "Openness", "high", "").first()[0] == "You are open."
    assert persona_prefix(p, "", "high", "").first()[0] == ""


def test_read_responses_mixed_numbers(spark):
    d = tempfile.mkdtemp(prefix="tg-resp-")
    os.makedirs(f"{d}/m1")
    _write(f"{d}/m1/Openness_1.json", {"question": {"0": "I a.", "1": "I b."}, "Openness": {"0": 1, "1": -1},
                                       "responses": {"0": "5", "1": "hmm"}, "numbers_extracted": {"0": 5, "1": "N/A"},
                                       "elapsed_times": {"0": 0.5, "1": 1.25}})
    r = {x.item_id: x for x in read_responses(spark, d, traits=["Openness"]).collect()}
    assert r[0].rating_text == "5" and r[1].rating_text == "N/A" and r[1].elapsed_s == 1.25 and r[1].Openness == -1.0


def test_columns_json_roundtrip(spark):
    df = spark.range(0, 2500).select(F.col("id").alias("item_id"), F.concat(F.lit("I "), F.col("id").cast("string")).alias("question"),
                                     (F.col("id") % 3 - 1).cast("double").alias("Openness"))
    path = shared_path(spark, "rt")
    write_columns_json(df, path, "item_id", rows_per_file=1000)
    back = read_columns_json(spark, path, {"question": "string", "Openness": "double"}, "item_id", recursive=True)
    assert back.select("file_path").distinct().count() == 3
    assert sorted(back.drop("file_path", "file_name").collect()) == sorted(df.collect())


def test_score_cards_directory(spark):
    d = tempfile.mkdtemp(prefix="tg-cards-")
    for name, v in [("Qwen2.5-1.5B__20250101_120000.json", "3.22+-0.95"), ("Qwen2.5-1.5B_Neuroticism_20250101_120001.json", "4.1+-0.3")]:
        _write(f"{d}/{name}", {"Neuroticism": {"0": v}, "N/A": {"0": 0.0}})
    os.makedirs(f"{d}/sub")
    cards = read_score_cards(spark, d, ["Neuroticism"])
    got = {r.file_name: r for r in cards.collect()}
    assert set(got) == {"Qwen2.5-1.5B__20250101_120000.json", "Qwen2.5-1.5B_Neuroticism_20250101_120001.json"}
    assert got["Qwen2.5-1.5B__20250101_120000.json"].Neuroticism == "3.22+-0.95"
    assert got["Qwen2.5-1.5B__20250101_120000.json"].na_share == 0.0
    runs = {r.file_name: r for r in read_run_files(spark, d).collect()}
    assert runs["Qwen2.5-1.5B__20250101_120000.json"].trait == ""


def test_cells_layout_and_resume(spark):
    key = spark.createDataFrame([(i, f"I q{i}.", "Openness", 1.0 if i % 2 else -1.0) for i in range(6)],
                                "item_id long, question string, trait string, weight double")
    personas = persona_catalogue(spark, ["Openness"], values=[1, 2])
    g = prompt_grid(key, personas, ["m1"])
    assert g.count() == 12
    local = prompt_grid(key, personas, ["m1"], repetitions=2, style="agreement").filter("value = 1 AND item_id = 1")
    rows = local.orderBy("repetition").collect()
    assert [r.repetition for r in rows] == [0, 1]
    assert rows[0].prompt.startswith("You score 1 on Openness. \n\nYou will be given a statement.")
    assert rows[0].prompt.endswith('Statement: "I q1."\nYour agreement level (1-5): ')
    resp = g.select("model", "trait", "value", "item_id", F.lit("3").alias("rating_text")).filter("value = 1")
    root = shared_path(spark, "cells")
    write_cells(resp, root)
    cells = read_cells(spark, root)
    assert cells.filter("value = 1").count() == 6
    done = cells.select("model", "trait", "value").distinct()
    allc = grid_cells(spark, ["m1"], ["Openness"], [1, 2])
    assert [tuple(r) for r in pending_cells(allc, done).collect()] == [("m1", "Openness", 2)]
    assert [tuple(r) for r in present_cells(allc, done).collect()] == [("m1", "Openness", 1)]
    # a full run leaves nothing pending
    write_cells(g.select("model", "trait", "value", "item_id", F.lit("4").alias("rating_text")), root)
    assert pending_cells(allc, read_cells(spark, root).select("model", "trait", "value").distinct()).count() == 0


def test_markdown_and_card_writers(spark):
    lines = spark.createDataFrame([("m", 0, "| h |"), ("m", 1, "|--:|"), ("n", 0, "| x |")], "model string, line_no int, line string")
    out = shared_path(spark, "md")
    write_markdown(lines, out, ["model"])
    assert [r.value for r in spark.read.text(f"{out}/model=m").collect()] == ["| h |", "|--:|"]
    card = spark.createDataFrame([("m", 3, "3.0+-0.0", 0.0)], "model string, value int, Openness string, na_share double")
    cp = shared_path(spark, "card")
    write_score_card(card, cp)
    back = read_score_cards(spark, cp, ["Openness"], path_glob=None).collect()
    assert [(r.model, r.value, r.Openness, r.na_share) for r in back] == [("m", 3, "3.0+-0.0", 0.0)]


def test_result_tree_reference_layout(spark):
    from traitgrid.operators.scoring import cell_scores
    from traitgrid.sources.columns_json import read_result_tree
    d = tempfile.mkdtemp(prefix="tg-tree-")
    for model in ["m1", "m2"]:
        os.makedirs(f"{d}/{model}")
        for v, ratings in [(1, [5, 4]), (9, [1, "N/A"])]:
            _write(f"{d}/{model}/Openness_{v}.json", {
                "question": {"3": "I a.", "7": "I b."}, "Openness": {"3": "1.0", "7": "-1.0"},
                "Extraversion": {"3": "0.0", "7": "0.0"},
                "responses": {"3": "x", "7": "y"}, "numbers_extracted": {"3": ratings[0], "7": ratings[1]},
                "elapsed_times": {"3": 0.1, "7": 0.2}})
    tree = read_result_tree(spark, d, ["Extraversion", "Openness"])
    assert sorted({(r.model, r.trait, r.value) for r in tree.collect()}) == [
        ("m1", "Openness", 1), ("m1", "Openness", 9), ("m2", "Openness", 1), ("m2", "Openness", 9)]
    s = {(r.model, r.value): r for r in cell_scores(tree, None, ("model", "trait", "value"),
                                                       ["Extraversion", "Openness"]).collect()}
    assert (s[("m1", 1)].mean, s[("m1", 1)].std) == (3.5, 1.5)   # 5 and 6-4=2
    assert (s[("m2", 9)].n_valid, s[("m2", 9)].n_na, s[("m2", 9)].mean) == (1, 1, 1.0)
    assert len(s) == 4  # only the cell's own trait is scored


def test_inventory_file_split_models_and_training_rows(spark):
    from traitgrid.operators.instrument import parse_inventory
    from traitgrid.sinks.writers import training_dataset, write_table
    from traitgrid.sources.inventory import read_inventory_text
    from traitgrid.sources.results import list_models, read_split
    d = tempfile.mkdtemp(prefix="tg-inv-")
    with open(f"{d}/inv.txt", "w") as f:
        f.write("O1: IMAGINATION (Alpha = .83)\n+ keyed\tHave a vivid imagination.\n\n– keyed\tSeldom daydream.")
    items = parse_inventory(read_inventory_text(spark, f"{d}/inv.txt")).orderBy("item_no").collect()
    assert [(i.trait, i.sign, i.question) for i in items] == [
        ("Openness", 1, "I have a vivid imagination."), ("Openness", -1, "I seldom daydream.")]
    corpus = spark.createDataFrame([("q1", "#### 4", "train"), ("q2", "#### 5", "test")], "question string, answer string, split string")
    path = shared_path(spark, "corpus")
    corpus.write.partitionBy("split").parquet(path)
    assert [r.question for r in read_split(spark, path, "test").collect()] == ["q2"]
    cells = spark.createDataFrame([("m1", "O", 1), ("m2", "O", 1), ("m1", "A", 2)], "model string, trait string, value int")
    assert sorted(r.model for r in list_models(cells).collect()) == ["m1", "m2"]
    ex = spark.createDataFrame([(1, "Q?", "P", "5")], "item_id long, question string, prompt string, answer string")
    out = shared_path(spark, "train")
    write_table(training_dataset(ex), out)
    assert spark.read.parquet(out).columns == ["question", "prompt", "answer"]


def test_published_score_card_format(spark):
    from traitgrid.operators.report import score_series
    d = tempfile.mkdtemp(prefix="tg-card-")
    # fixed values: a published score card
    text = ('{"Extraversion":{"0":"3.22+-0.95"},"Agreeableness":{"0":"3.03+-0.97"},"Conscientiousness":{"0":"3.17+-0.86"},'
            '"Neuroticism":{"0":"2.83+-0.9"},"Openness":{"0":"3.07+-0.95"},"N\\/A":{"0":0.0}}')
    with open(f"{d}/Qwen2.5-1.5B__20250101_120000.json", "w") as f:
        f.write(text)
    card = read_score_cards(spark, d)
    r = card.first()
    assert (r.Neuroticism, r.na_share) == ("2.83+-0.9", 0.0)
    s = {x.trait: (x.mean, x.std) for x in score_series(card, ["file_name"]).collect()}
    assert s == {"Extraversion": (3.22, 0.95), "Agreeableness": (3.03, 0.97), "Conscientiousness": (3.17, 0.86),
                 "Neuroticism": (2.83, 0.9), "Openness": (3.07, 0.95)}


def test_column_json_with_misaligned_columns(spark):
    d = tempfile.mkdtemp(prefix="tg-mis-")
    _write(f"{d}/a.json", {"a": {"0": "x", "1": "y"}, "b": {"0": 1, "5": 2}})
    _write(f"{d}/b.json", {"a": {"3": "z"}, "b": {"3": 7}})
    _write(f"{d}/c.json", {})
    rows = read_columns_json(spark, d, {"a": "string", "b": "int"}, "i").select("file_name", "i", "a", "b").collect()
    assert sorted(tuple(r) for r in rows) == [("a.json", 0, "x", 1), ("a.json", 1, "y", None), ("a.json", 5, None, 2),
                                             ("b.json", 3, "z", 7)]
