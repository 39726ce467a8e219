import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from traitgrid.llm import merkle
from traitgrid.llm.queries import QUERIES

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest(df):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest(df, altered={"text": lowered}, where=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


def same(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int, tree string, digest int").repartition(3)
    got = [tuple(r) for r in manifest(df).collect()]
    assert sorted(got, key=repr) == sorted(brute.merkle(rows), key=repr)
    return got


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 600])
def test_tree_sizes(spark, n):
    same(spark, [(i, "s", "en", 3, f"Text {i}") for i in range(n)])


def test_odd_rows(spark):
    rows = [(i, "é" if i % 2 else None, lang, i if i % 3 else None, t) for i, (lang, t) in enumerate(
        (lang, t) for lang in (None, "en", "", "ü", "EN", "zz") for t in (None, "", "abc", "ABC", "é" * 50_000, "A b\n"))]
    rows += [rows[3]] * 70 + [(None, None, None, None, None), (None, None, "en", 1, "X"), (5, "other", "en", 1, "Another"), (5, "other", "en", 1, "Row")]
    got = same(spark, rows)
    assert {r[-1] for r in got} == {True, False}


def test_many_trees(spark):
    same(spark, [(i, None, f"l{i % 97}", None, "T") for i in range(300)])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest(df).count() == 0


def test_query(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM '{path}/documents.parquet'").fetchall()
    got = [tuple(r) for r in QUERIES["op13_merkle_manifest"](spark, path).collect()]
    assert sorted(got, key=repr) == sorted(brute.merkle(rows), key=repr)


def test_only_every_second_level_is_stored(spark):
    leaves = spark.range(5000).select(F.lit("a").alias("tree"), F.lit(5000).cast("long").alias("n"), F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    levels = merkle.build(leaves)
    assert [x.count() for x in levels] == [5000, 79, 2, 1]  # 8 and 512 of each level are not there
