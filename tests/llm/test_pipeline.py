"""The pipeline's stages, each judged on its own input, and the SQL twins."""

import corpus_pipeline
import pytest
from tests.llm import brute
from tests.oracle_compare import compare, duck_conn
from traitgrid.llm import quality, simhash
from traitgrid.llm.oracle import SQL
from traitgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, name):
    r = compare(spark, duck_conn(SF), name, QUERIES[name], SQL[name], SF)
    assert r.get("ok"), r


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in kept.select("doc_id", "text").collect()]
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        after = {r.doc_id: r.text for r in kept.collect()}
        assert kept.columns == docs.columns and len(after) == kept.count()
        if name == "quality rules":
            good = [quality.mask(quality.POLICIES["standard-v1"])]
            led = quality.ledger(docs).collect()
            assert set(after) == {r.doc_id for r in led if not r.fail_bits & good[0]}
        elif name == "simhash near-dedup":
            assert set(after) == {c for _, _, c in brute.near_components(before)}
        elif name == "substring dedup":
            expect = {d: sha for d, n, gone, sha in brute.dedup(before) if not (n and n == gone)}
            import hashlib
            assert {d: hashlib.sha256(b" ".join(t.encode().split())).hexdigest() for d, t in after.items()} == expect
        else:
            assert set(after) < {d for d, _ in before} and len(after) > 0.5 * len(before)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == set(after)


def test_one_document_of_a_group_stays(spark):
    rows = [(2, "a b c d"), (1, "a b c d"), (1, "a b c d"), (5, "quite another text here"), (None, "a b c d")]
    d = spark.createDataFrame([(i, t, None, None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup_stage(spark, d, "").collect()) == ["1", "5", "None"]
    assert simhash.fingerprint(b"") == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    copied = "seven green boats sail over the quiet lake tonight"
    clean, other = "entirely unlike words stand in this one line", "wholly separate matter is told of here instead"
    rows = [(3, copied), (7, clean), (7, copied), (8, clean + " x y z"), (8, other), (None, copied), (None, "no id here at all friends"), (None, "no id here at all friends"),
            (9, "a lone row"), (9, "a lone row")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    expect = {(3, copied), (7, clean), (8, clean + " x y z"), (8, other), (None, "no id here at all friends"), (9, "a lone row")}
    for some in (rows, rows[:-1]):  # a repeated row elsewhere changes nothing
        for order in (some, some[::-1]):
            out = stage(spark, spark.createDataFrame([(i, t, None, str(n), 1) for n, (i, t) in enumerate(order)], schema), "").collect()
            assert len(out) == len(expect) and {(r.doc_id, r.text) for r in out} == expect


def test_passages_of_rows_without_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [(1, a), (None, "p q " + a), (None, "r s " + b), (None, "t u " + b)]
    d = spark.createDataFrame([(i, t, None, None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r.doc_id, r.text) for r in corpus_pipeline.substring_stage(spark, d, "").collect()]
    assert (1, a) in out and (None, "p q") in out and sum(b in t for _, t in out) == 1 and len(out) == 4
