import numpy as np

from traitgrid.operators.report import cohort_histogram, markdown_lines, score_series


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    vals = {"a": list(rng.normal(3, 1, 500)), "b": [1.0, 2.0, 3.0, 4.0, 5.0], "c": [2.0] * 4,
            "d": list(np.round(rng.uniform(0, 1, 200), 2))}
    rows = [(k, float(x)) for k, xs in vals.items() for x in xs]
    h = cohort_histogram(spark.createDataFrame(rows, "k string, x double"), "k", "x", 5).collect()
    for k, xs in vals.items():
        got = [r.n for r in sorted((r for r in h if r.cohort == k), key=lambda r: r.bin)]
        assert got == list(np.histogram(xs, bins=5)[0]), k
    assert [r.n for r in sorted((r for r in h if r.cohort == "c"), key=lambda r: r.bin)] == [0, 0, 4, 0, 0]


def test_markdown_lines(spark):
    df = spark.createDataFrame([("m", 1, "1.0+-0.0", "1.07+-0.31", "1.05+-0.22"),
                                ("m", 2, "1.0+-0.0", "1.1+-0.35", "N/A")],
                               "model string, value int, Agreeableness string, Openness string, Conscientiousness string")
    lines = [r.line for r in markdown_lines(df, ["model"], "value", ["Agreeableness", "Openness", "Conscientiousness"])
             .orderBy("line_no").collect()]
    assert lines == [
        "|    | Agreeableness   | Openness   | Conscientiousness   |",
        "|---:|:----------------|:-----------|:--------------------|",
        "|  1 | 1.0+-0.0        | 1.07+-0.31 | 1.05+-0.22          |",
        "|  2 | 1.0+-0.0        | 1.1+-0.35  | N/A                 |",
    ]


def test_score_series(spark):
    card = spark.createDataFrame([("m", 3, "3.22+-0.95", "N/A")], "model string, value int, Extraversion string, Openness string")
    rows = {r.trait: r for r in score_series(card, ["model", "value"], ["Extraversion", "Openness"]).collect()}
    assert (rows["Extraversion"].mean, rows["Extraversion"].std) == (3.22, 0.95)
    assert (rows["Openness"].mean, rows["Openness"].std) == (None, None)


# Published dose-response tables (mean+-std per prompted value 1..9 for
# Agreeableness, Openness, Conscientiousness). PRINTED_A is the published
# Markdown verbatim. The second table was published with "±" after a hand edit
# that left its last column one character short of its header; PRINTED_B is
# that table as the width rule lays it out.
PRINTED_A = """|    | Agreeableness   | Openness   | Conscientiousness   |
|---:|:----------------|:-----------|:--------------------|
|  1 | 1.0+-0.0        | 1.07+-0.31 | 1.05+-0.22          |
|  2 | 1.0+-0.0        | 1.1+-0.35  | 1.12+-0.32          |
|  3 | 1.02+-0.13      | 1.2+-0.44  | 1.25+-0.43          |
|  4 | 1.98+-0.13      | 1.88+-0.41 | 2.12+-0.61          |
|  5 | 3.0+-0.0        | 3.0+-0.0   | 3.0+-0.0            |
|  6 | 3.97+-0.18      | 4.2+-0.44  | 3.93+-0.25          |
|  7 | 4.8+-0.6        | 4.87+-0.39 | 4.95+-0.22          |
|  8 | 4.85+-0.51      | 4.93+-0.25 | 5.0+-0.0            |
|  9 | 4.85+-0.6       | 4.95+-0.22 | 5.0+-0.0            |"""
PRINTED_B = """|    | Agreeableness   | Openness   | Conscientiousness   |
|---:|:----------------|:-----------|:--------------------|
|  1 | 1.0±0.0         | 1.0±0.0    | 1.05±0.22           |
|  2 | 1.0±0.0         | 1.0±0.0    | 1.07±0.31           |
|  3 | 1.02±0.13       | 1.02±0.13  | 1.1±0.3             |
|  4 | 1.58±0.53       | 1.43±0.53  | 1.42±0.56           |
|  5 | 3.0±0.0         | 3.0±0.0    | 3.0±0.0             |
|  6 | 4.23±0.53       | 4.37±0.58  | 4.07±0.31           |
|  7 | 4.82±0.59       | 4.87±0.39  | 4.97±0.18           |
|  8 | 4.85±0.63       | 4.93±0.31  | 5.0±0.0             |
|  9 | 4.88±0.58       | 4.97±0.18  | 5.0±0.0             |"""


def _numbers(printed):
    """The (mean, std) triples of a printed table's rows."""
    return [tuple(tuple(float(x) for x in cell.replace("±", "+-").split("+-")) for cell in line.strip("|").replace(" ", "").split("|")[1:]) for line in printed.split("\n")[2:]]


PUBLISHED_A, PUBLISHED_B = _numbers(PRINTED_A), _numbers(PRINTED_B)


def test_published_table_reproduced_and_sep_variant(spark):
    from traitgrid.operators.report import dose_response_table
    traits = ["Agreeableness", "Openness", "Conscientiousness"]
    for published, printed, sep in [(PUBLISHED_A, PRINTED_A, "+-"), (PUBLISHED_B, PRINTED_B, "±")]:
        rows = [("m", v + 1, t, 60, m, s) for v, cells in enumerate(published) for t, (m, s) in zip(traits, cells)]
        scores = spark.createDataFrame(rows, "model string, value int, trait string, n_valid long, mean double, std double")
        table = dose_response_table(scores, ["model"], "value", traits, sep)
        lines = [r.line for r in markdown_lines(table, ["model"], "value", traits).orderBy("line_no").collect()]
        assert lines == printed.split("\n")
