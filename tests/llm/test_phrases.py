import random

import numpy as np
import pytest

from tests.llm import brute
from traitgrid.llm import phrases
from traitgrid.llm.queries import QUERIES

SCHEMA = "doc_id long, lang string, text string, word int, n string, id int, key int"


def texts(seed=1, n=300):
    rng = random.Random(seed)
    fixed = ["over the hill and far", "New York City", "a a a a", "été Là", "as well as", "in ORDER to"]
    out = []
    for _ in range(n):
        w = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice("a b c the of i j".split() + [f"w{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 40))]
        out.append((rng.choice(["en", "en", "fr", None, "und", ""]), "".join(x + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b"]) for x in w)))
    odd = [("en", None), (None, None), ("en", ""), ("fr", " .,\n"), ("en", "x" * 100_000), ("en", "over the hill " * 3000), ("en", " the of a b \x1c a")]
    return out + odd + [out[0]] * 40


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, *r, 1, "x", 2, 3) for i, r in enumerate(rows)], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


@pytest.mark.parametrize("options", [{"min_count": 20}, {"min_count": 3, "top": 50}, {"min_count": 20, "inside": 80}, {"min_count": 5, "longest": 3}])
def test_against_plain_counting(spark, options):
    rows = texts()
    got = run(spark, rows, **options)
    assert got == brute.collocations(rows, **options) and any(len(r[2].split(" ")) > 2 for r in got)


def test_small_tiles_flushes_and_joined_lookups(spark):
    """Many dense and sparse tiles, several flushes a task, split tiles and bundles, no broadcast."""
    small = phrases.Sizes(side=4, band=2, flush=50, words=30, per_cell=8, merged=20, broadcast=0)
    rows = texts(2, 120)
    got = run(spark, rows, min_count=5, z=small)
    assert got == run(spark, rows, min_count=5) == brute.collocations(rows, min_count=5)


def test_tiles():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 9, 5000) << 32 | rng.integers(0, 9, 5000)
    found = {}
    for t, at, n in phrases.tiled(keys, [(0, 0), (1, 0), (7, 7)], 4):
        for x, c in zip(at.tolist(), n.tolist(), strict=True):
            k = x if t is None else (t[0] * 4 + x // 4) << 32 | (t[1] * 4 + x % 4)
            assert k not in found
            found[k] = c
    values, counts = np.unique(keys, return_counts=True)
    assert found == dict(zip(values.tolist(), counts.tolist(), strict=True))


def test_rows_of_text_are_short_and_read_a_few_at_a_time(spark, monkeypatch):
    """Rows as long as their slice of text (megabytes), read a file at a time, filled an executor's memory. No row outgrows its
    bound by more than a piece, batches have one, and the session's settings stay."""
    small = phrases.Sizes(ids=100, rows=4, batch=4096)
    rows = [("en", "a b c d " * 5 + ".")] * 400 + [("fr", "a b . c d, " * 900)]
    sizes, held = [], ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = [spark.conf.get(k) for k in held]

    def noted(df, name, f=phrases.stored):
        out = f(df, name)
        if name == "phrase-ids":
            sizes.extend((r["lang"], len(r["w"]), len(r["cur"])) for r in out.collect())
            assert [spark.conf.get(k) for k in held] == ["4096", "4"]
        return out

    monkeypatch.setattr(phrases, "stored", noted)
    assert run(spark, rows, min_count=20, z=small) == brute.collocations(rows, min_count=20)
    assert {g for g, *_ in sizes} == {"en", "fr"} and len(sizes) > 50
    assert max(max(n) for _, *n in sizes) <= 4 * (100 + 21)
    assert [spark.conf.get(k) for k in held] == before


def test_scores_past_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, left, right = 987_654_321_012, 8_999_999_999_999_999_999, 999_999_999_999_989, 99_999_999_999_971
    x = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    got = x.select(F.expr("cast(1000 * cast(a as decimal(15,0)) * cast(n as decimal(19,0)) as decimal(38,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")).first()[0]
    assert got == 1000 * a * n // (left * right)


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert run(spark, [("en", None), (None, "one two")]) == []


def test_query(spark):
    import duckdb

    rows = duckdb.sql("SELECT lang, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    got = sorted(tuple(r) for r in QUERIES["op12_phrase_mining"](spark, "/root/testdata/sf0.01").collect())
    assert got == brute.collocations(rows) and got
