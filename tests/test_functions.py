
from pyspark.sql import functions as F

from tests.helpers import col_values
from traitgrid.functions import (
    extract_number, first_char, format_reward, format_score, hash_answer, parse_score, rating_reward,
    rating_text, rating_value, reverse_key, round_half_even, strip_echo, xml_answer, py_strip,
    normalize_item, parse_run_file, cohort_of, provider, api_model_name, run_file_name,
)
from traitgrid.functions.prompts import rating_prompt, agreement_prompt, chat_prompt, RATING_PREFIX


def test_extract_number(spark):
    got = col_values(spark, ["5 out of 5", "3.0", "", "05", "10", "I'd say 4.", None, "٥"], extract_number)
    assert got == ["5", None, None, "05", "10", "4", None, "٥"]


def test_rating_text_and_value(spark):
    got = col_values(spark, ["5", "05", "10", None, "3"], lambda c: rating_text(c))
    assert got == ["5", "N/A", "N/A", "N/A", "3"]
    assert col_values(spark, ["5", "N/A", "7", "1"], rating_value) == [5, None, None, 1]


def test_reverse_key(spark):
    df = spark.createDataFrame([(2, -1.0), (2, 1.0), (2, -2.0)], "r int, w double")
    assert [r[0] for r in df.select(reverse_key("r", "w")).collect()] == [4, 2, 2]


def test_round_half_even_matches_numpy_style(spark):
    import numpy as np
    vals = [2.125, 1.015, 3.0, 0.125, 2.675, 4.005, 1.235, 3.3349999]
    got = col_values(spark, vals, round_half_even, "double")
    assert got[:4] == [2.12, 1.01, 3.0, 0.12]
    assert got == [float(np.round(np.float64(v), 2)) for v in vals]


def test_format_and_parse(spark):
    df = spark.createDataFrame([(3.0, 0.0), (3.22, 0.95), (None, None)], "m double, s double")
    assert [r[0] for r in df.select(format_score("m", "s")).collect()] == ["3.0+-0.0", "3.22+-0.95", "N/A"]
    df = spark.createDataFrame([("3.22+-0.95",), ("N/A",)], "t string")
    assert [tuple(r) for r in df.select(parse_score("t", 1), parse_score("t", 2)).collect()] == [(3.22, 0.95), (None, None)]


def test_strip_like_python(spark):
    vals = [" \t a b \n", "　x ", "", "   "]
    assert col_values(spark, vals, py_strip) == [v.strip() for v in vals]
    assert col_values(spark, ["  Worry about things. "], normalize_item) == ["I worry about things."]


def test_rewards(spark):
    assert col_values(spark, [" 5 yes", "6", "no", "", "4", "\n3"], rating_reward) == [1.0, -1.0, -1.0, -1.0, 0.7, 0.2]
    assert col_values(spark, ["5", "05", "5 ", "5\n", "6", "0", "2"], format_reward) == [1.0, 1.0, -0.5, -0.5, -0.5, -0.5, 1.0]
    assert col_values(spark, ["5"], lambda c: format_reward(c, 0.2, -0.1)) == [0.2]
    # Unicode decimal digits count like int() reads them; other "digits" (superscripts) do not
    assert col_values(spark, ["٥ yes", "²", "߃"], rating_reward) == [1.0, -1.0, 0.2]
    assert col_values(spark, ["٠٤", "²", "४"], format_reward) == [1.0, -0.5, 1.0]


def test_answer_extractors(spark):
    assert col_values(spark, ["  plain  ", "<answer>1</answer> x <answer> 2 </answer>"], xml_answer) == ["plain", "2"]
    assert col_values(spark, ["no hash", "so #### $1,200", "a####b####c"], hash_answer) == [None, "1200", "b"]


def test_first_char_and_echo(spark):
    assert col_values(spark, ["  5 because", "", " \n"], first_char) == ["5", "", ""]
    df = spark.createDataFrame([("PROMPT", "PROMPT  4 \n")], "p string, r string")
    assert df.select(strip_echo("r", "p")).first()[0] == "4"


def test_run_names_and_cohorts(spark):
    df = spark.createDataFrame([("Qwen2.5-1.5B__20250101_120000.json",), ("Qwen-1.5B-GRPO_Neuroticism_20250101_120001.json",),
                                ("Qwen2.5-3B__20250101_120002.json",), ("bad.json",)], "f string")
    rows = df.select(parse_run_file("f").alias("p"), cohort_of("f").alias("c")).select("p.model", "p.trait", "p.stamp", "c").collect()
    assert tuple(rows[0]) == ("Qwen2.5-1.5B", "", "20250101_120000", "base/plain")
    assert tuple(rows[1]) == ("Qwen-1.5B-GRPO", "Neuroticism", "20250101_120001", "neuroticism/grpo")
    assert rows[2][3] is None
    assert tuple(rows[3]) == (None, None, None, None)


def test_run_file_name(spark):
    df = spark.sql("select 'Qwen/Qwen2.5-1.5B' as m, '' as t, timestamp'2025-01-01 12:00:05' as ts")
    assert df.select(run_file_name("m", "t", "ts")).first()[0] == "Qwen2.5-1.5B__20250101_120005.json"


def test_provider_rules(spark):
    labels = ["claude-3-5-sonnet", "hyperbolic-meta-llama", "my-Hyperbolic-x-hyperbolic-y", "gpt-4o"]
    assert col_values(spark, labels, provider) == ["anthropic", "hyperbolic", "hyperbolic", "openai"]
    assert col_values(spark, labels, api_model_name) == ["claude-3-5-sonnet", "meta-llama", "my-Hyperbolic-x-y", "gpt-4o"]


def test_prompts(spark):
    df = spark.createDataFrame([("You are calm.", "I worry 100% {x}.")], "p string, q string")
    r = df.select(rating_prompt("p", "q"), agreement_prompt("q", F.col("p")), agreement_prompt("q")).first()
    assert r[0].startswith("You are calm." + RATING_PREFIX + "I worry 100% {x}.")
    assert r[1].startswith("You are calm.\n\nYou will be given a statement.")
    assert r[2].startswith("\nYou will be given") and r[2].endswith('Statement: "I worry 100% {x}."\nYour agreement level (1-5): ')
    msgs = df.select(chat_prompt("q", "SYS")).first()[0]
    assert [(m.role, m.content) for m in msgs] == [("system", "SYS"), ("user", "I worry 100% {x}.")]


def test_python_round_ratio_matches_python(spark):
    import random
    from traitgrid.functions.ratings import python_round_ratio
    rnd = random.Random(5)
    pairs = [(n, d) for d in (1, 2, 3, 7, 8, 40, 200, 300, 1000) for n in range(0, 2 * d + 1)]
    pairs += [(rnd.randrange(0, 5000), rnd.randrange(1, 3000)) for _ in range(3000)]
    pairs += [(1, 200), (3, 200), (29, 200), (57, 200), (1, 8), (3, 8), (5, 8), (7, 8)]  # decimal ties
    df = spark.createDataFrame(pairs + [(1, 0)], "n long, d long")
    cols = [python_round_ratio("n", "d").alias("x"), python_round_ratio("n", "d", max_value=40.0).alias("y")]
    got = {(r.n, r.d): (r.x, r.y) for r in df.select("n", "d", *cols).collect()}
    assert got[(1, 0)] == (None, None)
    bad = [(n, d, got[(n, d)], round(n / d, 2)) for n, d in pairs
           if got[(n, d)][1] != round(n / d, 2) or (n / d < 10 and got[(n, d)][0] != round(n / d, 2))]
    assert not bad, bad[:5]


def test_cohort_labels_cover_cohort_of(spark):
    from traitgrid.functions.files import cohort_labels
    names = [f"{m}_{t}_20250101_1200{s:02d}.json" for m in ("Qwen-1.5B", "Qwen-1.5B-GRPO", "x-3b", "GRPO-1.5b-neuroticism")
             for t in ("", "Neuroticism") for s in range(2)]
    got = {v for v in col_values(spark, names, cohort_of) if v is not None}
    assert got and got <= set(cohort_labels())
