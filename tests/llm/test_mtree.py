import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from traitgrid.llm import mtree
from traitgrid.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, uid long, region string, score int"


def run(spark, rows, k=5, **options):
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = mtree.top_products(df, F.col("vec_id") % 50 == 0, k, **options)
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()), key=repr)


def vectors(n, dim, seed=1):
    return [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(seed).standard_normal((n, dim)).astype("float32"))]


@pytest.mark.parametrize("options", [{}, {"roots": 7, "tree": 100}])
def test_against_brute_force(spark, options):
    rows = vectors(900, 12) + [(2000 + i, v) for i, v in vectors(40, 3)]  # another length
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # copies of a query's vector: ties
    rows += [(1, None), (2, []), (50, []), (3, [None] * 12), (4, [float("nan")] * 12), (5, [float("inf")] * 12), (None, rows[3][1]), (None, rows[3][1]),
             (6, [0.0] * 12), (100, [0.0] * 12), (100, rows[9][1]), (100, rows[9][1]), (150, [1000.0] * 12), (7, [-1e6] * 12)]
    assert run(spark, rows, **options) == brute.top_products(rows, lambda i: i % 50 == 0)


def test_few_rows_and_none(spark):
    assert run(spark, []) == [] and run(spark, [(50, [1.0])]) == [] and run(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert run(spark, [(50, [1.0]), (3, [0.5]), (2, [0.5])]) == [(50, 1, 2, 32768), (50, 2, 3, 32768)]


def test_all_equal(spark):
    rows = [(i, [0.25, -0.5]) for i in range(1000)]
    assert run(spark, rows, tree=128) == brute.top_products(rows, lambda i: i % 50 == 0)


def test_large_components(spark):
    rows = [(i, [float(2 ** (i % 50)), -float(i)]) for i in range(102)]
    assert run(spark, [r for r in rows if r[0] % 50 < 23]) == brute.top_products([r for r in rows if r[0] % 50 < 23], lambda i: i % 50 == 0)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(50, [1e30]), (1, [1.0])])
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(50, [1e15]), (1, [1e15])])


def test_bounds_save_work_where_vectors_cluster():
    """Pages beyond the bound are not read; the answers stay those of a full scan."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (60, 16))
    v = (centres[rng.integers(0, 60, 6000)] + rng.integers(-40, 40, (6000, 16))).astype(np.int64)
    import pandas as pd

    most = float((v.astype(float) ** 2).sum(axis=1).max())
    rows = pd.DataFrame({"dim": 16, "region": 0, "tree": 0, "uid": np.arange(6000), "vec_id": np.arange(6000), "v": list(v)})
    t = mtree.Tree(mtree._pages(rows, most), most)
    spent = 0
    for i in range(0, 6000, 300):
        best, computed = t.search(i, v[i], 5)
        s = v @ v[i]
        want = [j for j in np.lexsort((np.arange(6000), -s)) if j != i][:5]
        assert [b[2] for b in best] == want and [-b[0] for b in best] == s[want].tolist()
        spent += computed
    assert spent < 20 * 6000 / 3


def test_pages_cover_their_rows():
    v = np.random.default_rng(2).integers(-300, 300, (3000, 8))
    x = mtree.lifted(v, float((v * v).sum(axis=1).max()))
    pages = mtree.build(x)

    def rows(p):
        return [r for a, c in zip(pages[p]["at"], pages[p]["child"], strict=True) for r in ([a] if c < 0 else rows(c))]

    assert sorted(rows(0)) == list(range(3000))
    for p in pages:
        assert len(p["at"]) <= mtree.PAGE
        assert np.allclose(p["parent"], np.linalg.norm(x[p["at"]] - x[p["pivot"]], axis=1), atol=1e-3)
        for at, child, radius in zip(p["at"], p["child"], p["radius"], strict=True):
            if child >= 0:
                assert pages[child]["pivot"] == at and np.linalg.norm(x[rows(child)] - x[at], axis=1).max() <= radius + 1e-3


def test_query(spark):
    import duckdb

    for sf in ("sf0.01", "sf0.1"):
        rows = duckdb.sql(f"SELECT vec_id, embedding FROM '/root/testdata/{sf}/embeddings.parquet'").fetchall()
        got = sorted((tuple(r) for r in QUERIES["op11_exact_top_k"](spark, f"/root/testdata/{sf}").collect()), key=repr)
        assert got == brute.top_products(rows, lambda i: i % 50 == 0)


def test_queries_go_down_a_tree_together(monkeypatch):
    """Many queries read a leaf in one step, whether bounds leave much out or nothing; each gets what a full scan finds, ties and copies included."""
    import pandas as pd

    rng = np.random.default_rng(4)
    alike = rng.integers(-300, 300, (1, 16)) + np.zeros((700, 16), dtype=np.int64)
    far = rng.integers(-4000, 4000, (40, 16))[rng.integers(0, 40, 3000)] + rng.integers(-30, 30, (3000, 16))
    for v in (rng.integers(-300, 300, (3000, 16)), far, np.vstack([alike, rng.integers(-300, 300, (300, 16))]), far << 16, far * 220_000):
        v = v.astype(np.int64)
        n = len(v)
        most = float((v.astype(float) ** 2).sum(axis=1).max())
        ids = pd.array(rng.integers(0, n // 2, n), dtype="Int64")
        ids[rng.integers(0, n, 20)] = pd.NA
        t = mtree.Tree(mtree._pages(pd.DataFrame({"dim": 16, "region": 0, "tree": 0, "uid": np.arange(n), "vec_id": ids, "v": list(v)}), most), most)
        calls, once = [], mtree.multiplied
        monkeypatch.setattr(mtree, "multiplied", lambda *a: calls.append(1) or once(*a))  # noqa: B023
        asks = np.arange(0, n, 3)
        best = mtree.Best(asks, v[asks], 5, most, np.full(len(asks), np.inf))
        t.search_all(best, np.arange(len(asks)))
        monkeypatch.undo()
        assert len(calls) < len(asks)  # one product for each query and leaf before
        big = v.astype(object) if np.abs(v).max() > 1 << 25 else v  # far: products of 32, 64 and more bits
        for i in range(0, len(asks), 37):
            score = big @ big[asks[i]]
            want = sorted((-int(s), x is pd.NA, 0 if x is pd.NA else int(x), u) for u, (s, x) in enumerate(zip(score, ids, strict=True)) if u != asks[i])[:5]
            at = best.rows[0] == i
            assert [(-s, bool(z), x, u) for s, z, x, u in best.rows[1:, at].T.tolist()] == want
            assert t.search(int(asks[i]), v[asks[i]], 5)[0] == want


def test_plots_hold_whole_trees(spark):
    count = np.array([10, 0, 9000, 200_000, 5, 70_000, 3, 4000, 50])
    trees = np.maximum(-(-count // mtree.TREE), 1)
    every = [(r, t) for r, n in enumerate(trees) for t in range(n)]
    rows = spark.createDataFrame(every, "region int, tree int")
    for dim, slots, most in ((64, 1, 65_536), (64, 8, 9_000), (2048, 8, 8_192), (0, 100, 9_000)):
        of = mtree._plots(count, trees, dim, mtree.TREE, slots)
        held = {}
        for r in rows.withColumn("plot", of(F.col("region"), F.col("tree"))).collect():
            held.setdefault(r["plot"], []).append((r["region"], r["tree"]))
        assert sorted(held) == list(range(len(held)))  # none is empty
        assert all(sum(count[r] / trees[r] for r, _ in part) <= most for part in held.values())
        assert len(held) < len(every)


def test_a_query_is_sent_once_to_a_plot(spark, monkeypatch):
    """Of many small trees a task searches a plot, with each query once; before, each query was sent to each tree."""
    sent = []
    ask = mtree._ask
    monkeypatch.setattr(mtree, "_ask", lambda pages, queries, *a, **b: sent.append(queries.count()) or ask(pages, queries, *a, **b))
    rows = vectors(3000, 12)
    assert run(spark, rows) == brute.top_products(rows, lambda i: i % 50 == 0)
    assert sent == [60, 60]
