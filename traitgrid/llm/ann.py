"""Approximate nearest neighbours: an inverted-file index whose lists are scanned
by adaptive dimension sampling.

Vectors are rotated at random; inside a probed list, partial distances grow
block of columns by block of columns, and after each block a hypothesis test
drops the candidates whose distance is, at that confidence, beyond the query's
current k-th. What survives is measured exactly on the original vectors. Each query
scans its nearest list first; the k-th distance found there bounds the scans of its other
lists from their start, and each scan tightens it as it goes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitgrid.llm.common import stored
from traitgrid.session import ship_package

#: Rows the centroids are learned from (every row is indexed), and of these for each centroid.
SAMPLE = 20_000
PER_LIST = 8
#: Vectors and queries of one scan task's block; rows between two looks at the bound.
BLOCK = 8_192
QUERIES = 1_024
STEP = 1_024
COLUMNS = 16
#: The test's slack: a candidate goes if its scaled partial distance exceeds (1 + SLACK / sqrt(columns seen)) times the k-th.
SLACK = 2.1
#: Squared distances of rotated vectors may be off by so much of the squared lengths.
ROUNDING = 1e-9


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v`` (array<double>) of vectors that take part: not null or empty, no
    null or non-finite component, not all zero, an id."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))))


def centroids(vectors: DataFrame, lists: int, sample: int = SAMPLE, turns: int = 12, seed: int = 5) -> np.ndarray:
    """k-means on the ``sample`` rows of smallest id hash."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    x = np.array([r["v"] for r in rows], dtype=np.float64)
    c = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(turns):
        at = nearest(x, c)[:, 0]
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, count: int = 1) -> np.ndarray:
    """The ``count`` nearest centroids of each row, nearest first."""
    d = (c * c).sum(axis=1) - 2 * x @ c.T
    if count == 1:
        return d.argmin(axis=1)[:, None]
    return np.argsort(d, axis=1, kind="stable")[:, :count]


def scan(uids: np.ndarray, ids: np.ndarray, x: np.ndarray, xr: np.ndarray, own: int, q: np.ndarray, qr: np.ndarray, k: int,
         bound: float = np.inf, columns: int = COLUMNS, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``uids, ids, distances`` of the k nearest rows of a block to a query (the row ``own`` left out) within ``bound``,
    nearest first, ties to the smaller id, by the adaptive scan over rotated columns.

    What the bound was taken from is held apart and never dropped by it; a candidate goes only if it is beyond the
    bound by more than rounding, so copies of the query stay at a bound of 0."""
    dim = x.shape[1]
    best = (uids[:0], ids[:0], np.empty(0))
    limit = bound * bound
    for start in range(0, len(ids), STEP):
        alive = start + np.flatnonzero(uids[start:start + STEP] != own)
        if np.isfinite(limit) and len(alive):
            blur = ROUNDING * (q @ q + (x[alive] ** 2).sum(axis=1).max())
            partial = np.zeros(len(alive))
            for i in range(0, dim, columns):
                j = min(i + columns, dim)
                partial += ((xr[alive, i:j] - qr[i:j]) ** 2).sum(axis=1)
                keep = partial * (dim / j) <= limit * (1 + slack / np.sqrt(j)) ** 2 + blur
                alive, partial = alive[keep], partial[keep]
                if not len(alive):
                    break
        if not len(alive):
            continue
        exact = np.sqrt(((x[alive] - q) ** 2).sum(axis=1))
        found = tuple(np.concatenate(c) for c in zip(best, (uids[alive], ids[alive], exact), strict=True))
        order = np.lexsort((found[0], found[1], found[2]))[:k]
        best = tuple(c[order] for c in found)
        if len(order) == k:
            limit = min(limit, best[2][-1] ** 2)
    within = best[2] <= bound
    return tuple(c[within] for c in best)


RESULT = "query_id long, rank int, vec_id long, score double"
NEAR = "asked long, query_id long, uid long, vec_id long, score double"


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, probes: float = 0.7, lists: int | None = None,
           id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score`` (Euclidean distance in double precision):
    each query's k nearest found, every vector but its own row being a candidate.
    ``queries`` are rows of the same columns; a repeated one is one query. Where ``vectors`` has the query (the same
    id and vector), one such row is its own; others of its id or vector are candidates.

    ``probes`` is the share of lists probed; nearer lists first and always
    so many that they hold k candidates, so a query with k candidates or fewer gets
    them all. Ties go to the smaller id. Unusable vectors (see ``usable``) take no part; a query meets the vectors of its own
    length, each length being an index of its own. Lists of any size are dealt out in blocks. Extra columns take no
    part; an empty table, or no query, gives no rows."""
    spark = ship_package(vectors.sparkSession)
    v = stored(usable(vectors, id_col, vec_col).withColumn("uid", F.monotonically_increasing_id()), "ann-vectors")
    first = v.groupBy(F.col("vec_id").alias("i"), F.col("v").alias("x")).agg(F.min("uid").alias("own"))
    q = usable(queries, id_col, vec_col).distinct()
    q = q.join(first, (F.col("vec_id") == F.col("i")) & (F.col("v") == F.col("x")), "left")
    q = stored(q.select(F.col("vec_id").alias("query_id"), "v", F.coalesce("own", F.lit(-1)).alias("own")).withColumn("asked", F.monotonically_increasing_id()), "ann-queries")
    out = None
    for r in sorted(v.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()):  # one row for each vector length
        same = F.size("v") == r["dim"]
        found = _search(v.filter(same), q.filter(same), r["n"], r["dim"], k, probes, lists, sample)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], RESULT)
    w = Window.partitionBy("asked").orderBy("score", "vec_id", "uid")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(v: DataFrame, q: DataFrame, n: int, dim: int, k: int, probes: float, lists: int | None, sample: int) -> DataFrame:
    """``NEAR`` rows among vectors of one length: each probed list's nearest."""
    # an index of a few rows would be all overhead: lists follow the square root of the rows, the sample the lists
    want = max(1, lists or round(n**0.5 / 2))
    c = centroids(v, want, max(sample, PER_LIST * want))
    turn = rotation(dim)

    def index(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(list=nearest(np.stack(pdf["v"].to_numpy()), c)[:, 0].astype(np.int32))

    placed = stored(v.mapInPandas(index, "vec_id long, v array<double>, uid long, list int"), "ann-index")
    sizes = np.zeros(len(c), dtype=np.int64)
    for r in placed.groupBy("list").count().collect():  # one row per list
        sizes[r["list"]] = r["count"]
    few = max(1, round(probes * len(c)))

    def probe(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            order = nearest(np.stack(pdf["v"].to_numpy()), c, len(c)) if len(c) > 1 else np.zeros((len(pdf), 1), dtype=np.int64)
            held = np.cumsum(sizes[order], axis=1)
            # the query itself may be among those held: leave room for one
            need = np.maximum(few, (held < k + 1).sum(axis=1) + 1)
            yield pdf.assign(lists=[o[:m].astype(np.int32) for o, m in zip(order, need, strict=True)])

    routed = q.mapInPandas(probe, "query_id long, v array<double>, own long, asked long, lists array<int>")
    routed = stored(routed.select("asked", "query_id", "own", "v", F.posexplode("lists").alias("turn", "list")), "ann-probes")
    infinite = F.lit(float("inf"))
    home = stored(_scan(placed, routed.filter("turn = 0").withColumn("bound", infinite), sizes, turn, k), "ann-home")
    kth = home.withColumn("o", F.row_number().over(Window.partitionBy("asked").orderBy("score", "vec_id", "uid"))).filter(F.col("o") == k)
    kth = kth.select(F.col("asked").alias("a"), F.col("score").alias("kth"))
    rest = routed.filter("turn > 0").join(kth, F.col("asked") == F.col("a"), "left").withColumn("bound", F.coalesce("kth", infinite)).drop("a", "kth")
    return home.union(_scan(placed, rest, sizes, turn, k))


def _scan(placed: DataFrame, routed: DataFrame, sizes: np.ndarray, turn: np.ndarray, k: int) -> DataFrame:
    """Scans lists for the queries routed to them: a list in blocks of rows, its queries in turns."""
    blocks = F.element_at(F.lit([int(max(1, -(-s // BLOCK))) for s in sizes]), F.col("list") + 1)
    routed = stored(routed.select("asked", "query_id", "own", "v", "list", "bound"), "ann-routed")
    turns = stored(routed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("turns")), "ann-turns")
    one, two = (turns.select(F.col("list").alias("l"), F.col("turns").alias("t")) for _ in range(2))
    left = (placed.join(one, F.col("list") == F.col("l"))
            .select("vec_id", "v", "uid", "list", F.pmod(F.xxhash64("uid", F.lit(3)), blocks).cast("int").alias("block"),
                    F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("turn")))
    right = (routed.join(two, F.col("list") == F.col("l"))
             .select("asked", "query_id", "own", "v", "bound", "list", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
                     F.pmod(F.xxhash64("asked", F.lit(4)), F.col("t")).cast("int").alias("turn")))

    def block(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            uids, ids, x = rows["uid"].to_numpy(), rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy())
            xr = x @ turn
            for a, qid, own, qv, bound in zip(asks["asked"], asks["query_id"], asks["own"], asks["v"], asks["bound"], strict=True):
                uid, found, score = scan(uids, ids, x, xr, own, qv, qv @ turn, k, bound)
                out.append(pd.DataFrame({"asked": a, "query_id": qid, "uid": uid, "vec_id": found, "score": score}))
        none = pd.DataFrame({"asked": [], "query_id": [], "uid": [], "vec_id": [], "score": []}).astype(dict.fromkeys(["asked", "query_id", "uid", "vec_id"], "int64"))
        return pd.concat(out) if out else none

    key = ["list", "block", "turn"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(block, NEAR)
