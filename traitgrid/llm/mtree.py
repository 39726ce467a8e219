"""Exact top-k by inner product: best-first search of a forest of M-trees.

Inner products are no metric. Every vector x gets one more component, sqrt(M - x.x) with M
the largest x.x, and queries get 0 there: then the squared Euclidean distance between
query and vector is q.q + M - 2 q.x, so the nearest are those of the highest inner product, and the
triangle inequality holds.

Rows are dealt to regions by their nearest routing object (a bounded number of rows), large regions
to several trees by row. A tree is built in one task and stored as pages of entries: an
entry has its distance to the page's pivot, an inner one also its pivot and covering radius. A search takes
the page with the least possible distance first, leaves out entries by their stored
distances alone where it can, and ends where no page can hold anything better. Each query asks its
own region's tree first; what it finds there bounds the others, and regions and trees beyond the bound are skipped.

Trees lie together in plots, and a plot's queries go down its trees together: each reads its nearest leaf first, then its next 4,
16, …, as long as they may hold something better, and a leaf meets all the queries that read it now in one product of matrices. Where the bounds
leave out less than half of what is left of a tree, many leaves are read at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitgrid.llm.common import stored
from traitgrid.session import parallelism, ship_package

#: Routing objects: so many rows, those of the least hash. Every row is indexed.
ROOTS = 128
#: Rows of a tree, entries of a page, queries that go down a tree together, and of a search task.
TREE = 8_192
PAGE = 64
QUERIES = 4_096
TURN = 16_384
#: A plot's rows, and a search task's queries, have at most so many bytes as 64-bit numbers (but a tree and 1,024 queries at least).
PLOT_BYTES = 32 << 20
#: Rows that are read at once where little can be left out.
BLOCK = 512
#: Rows that may be among a query's best are gathered up to so many, then sorted.
WAITING = 500_000
#: Distances may be off by so much of the largest possible one; bounds are widened by it.
SLACK = 1e-6


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``uid, vec_id, v`` (array<long>) of the vectors that take part, scaled and rounded down; a
    component too large for 64 bits ends the job."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    large = F.raise_error("a scaled component passes 64 bits").cast("bigint")
    v = F.transform(x, lambda c: F.when(F.abs(scale * c) < 2.0**63, F.floor(scale * c)).otherwise(large))
    rows = vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return stored(rows.withColumn("uid", F.monotonically_increasing_id()), "mtree-vectors")


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of integer ``x`` with ``q`` (a vector, or columns), exact."""
    return multiplied(x, q, exact(_top(x), _top(q), x.shape[1]))


def _top(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def exact(x: int, q: int, dim: int):
    """The type in which inner products of vectors with components up to ``x`` and ``q`` are exact, whatever the order of their sums."""
    most = float(x) * float(q) * max(1, dim)
    return np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64 if most < 2.0**62 else object


def multiplied(x: np.ndarray, q: np.ndarray, kind) -> np.ndarray:
    """``x @ q`` in the type ``kind``; whole numbers of 64 bits, or of a float type that holds them."""
    out = x.astype(kind, copy=False) @ q.astype(kind, copy=False)
    if kind is not object:
        return out
    if out.size and max(abs(b) for b in out.flat) >= 1 << 63:
        raise OverflowError("an inner product passes 64 bits")
    return out.astype(np.int64)


def _narrow(v: np.ndarray) -> np.ndarray:
    """Integers in the least of three types that holds them all."""
    top = _top(v)
    return v.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8")


def _wide(raw: bytes, rows: int, dim: int) -> np.ndarray:
    """What ``_narrow`` has made of so many numbers, from its bytes."""
    return np.frombuffer(raw, f"<i{len(raw) // (rows * dim) if rows * dim else 8}").reshape(rows, dim)


def _matrix(rows: pd.DataFrame, dim: int) -> np.ndarray:
    """The vectors in ``v`` (arrays, or the bytes of each), one below the other."""
    v = rows["v"].tolist()
    if v and isinstance(v[0], bytes):
        if len(set(map(len, v))) == 1:
            return _wide(b"".join(v), len(v), dim).astype(np.int64)
        v = [_wide(x, 1, dim)[0] for x in v]
    return np.array(v, dtype=np.int64).reshape(len(rows), dim)


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    """Vectors on the sphere of radius sqrt(``most``), by one more component."""
    x = v.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))])


def asked(v: np.ndarray) -> np.ndarray:
    x = v.astype(np.float64)
    return np.column_stack([x, np.zeros(len(x))])


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of every row of ``x`` to every row of ``p``."""
    d = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * x @ p.T
    return np.sqrt(np.maximum(0.0, d))


# --- building -----------------------------------------------------------------------------------


def build(x: np.ndarray, page: int = PAGE, seed: int = 7) -> list[dict]:
    """The pages of an M-tree over the rows of ``x``, built from the top: pivots are drawn among a page's
    rows, each row goes to its nearest. Page 0 is the root. An entry: ``child`` (a page; -1: a row of ``x``), ``at``
    (its pivot, or the row itself, as a row of ``x``), ``radius``, ``parent`` (distance to its page's pivot)."""
    rng = np.random.default_rng(seed)
    pages: list[dict] = []
    work = [(np.arange(len(x)), int(0), None)]
    while work:
        rows, pivot, entry = work.pop()
        number = len(pages)
        if entry is not None:
            pages[entry[0]]["child"][entry[1]] = number
        far = distances(x[rows], x[pivot:pivot + 1])[:, 0]
        if len(rows) <= page:
            pages.append({"pivot": pivot, "at": rows, "child": np.full(len(rows), -1), "radius": np.zeros(len(rows)), "parent": far})
            continue
        want = min(page, -(-len(rows) // (page // 2)))
        seeds = rows[rng.choice(len(rows), want, replace=False)]
        near = distances(x[rows], x[seeds])
        to = near.argmin(axis=1)
        if np.bincount(to).max() == len(rows):  # rows that do not differ: cut anywhere
            to = np.arange(len(rows)) * want // len(rows)
        own = near[np.arange(len(rows)), to]
        used = np.unique(to)
        at = seeds[used]
        pages.append({"pivot": pivot, "at": at, "child": np.full(len(used), -1), "radius": np.array([own[to == t].max() for t in used]),
                      "parent": distances(x[at], x[pivot:pivot + 1])[:, 0]})
        for i, t in enumerate(used):
            work.append((rows[to == t], int(at[i]), (number, i)))
    return pages


PAGES = ("dim int, region int, tree int, page int, leaf boolean, dims int, uid array<long>, vec_id array<long>, no_id array<boolean>, v binary, "
         "child array<int>, radius array<double>, parent array<double>")


def _pages(rows: pd.DataFrame, most: float) -> pd.DataFrame:
    """The stored pages of one tree."""
    v = _matrix(rows, int(rows["dim"].iat[0]))
    ids = rows["vec_id"].astype("Int64")
    null, ids = ids.isna().to_numpy(), ids.to_numpy(dtype=np.int64, na_value=0)
    out = []
    for i, p in enumerate(build(lifted(v, most))):
        leaf = bool((p["child"] < 0).all())
        out.append({"dim": rows["dim"].iat[0], "region": rows["region"].iat[0], "tree": rows["tree"].iat[0], "page": i, "leaf": leaf, "dims": v.shape[1],
                    "uid": rows["uid"].to_numpy()[p["at"]], "vec_id": ids[p["at"]] if leaf else ids[:0], "no_id": null[p["at"]] if leaf else null[:0],
                    "v": _narrow(v[p["at"]]).tobytes(), "child": p["child"].astype(np.int32), "radius": p["radius"], "parent": p["parent"]})
    return pd.DataFrame(out)


# --- searching ----------------------------------------------------------------------------------


class Best:
    """The ``k`` best rows of each of some queries so far: higher scores first, then smaller ids, a null one last, then smaller
    ``uid``. ``bound``: only rows within this distance are wanted; it shrinks as rows are found."""

    def __init__(self, uid: np.ndarray, q: np.ndarray, k: int, most: float, bound: np.ndarray):
        self.uid, self.q, self.k, self.most = uid, q, k, most
        self.point, self.square = asked(q), (q.astype(np.float64) ** 2).sum(axis=1)
        self.slack = SLACK * (np.sqrt(most) + np.sqrt(self.square) + 1)
        self.limit = bound + self.slack
        self.computed = np.zeros(len(q), dtype=np.int64)
        self.full = np.zeros(len(q), dtype=bool)
        self.last = np.zeros((4, len(q)), dtype=np.int64)  # the worst row kept, of a query that has k
        self.rows = np.zeros((5, 0), dtype=np.int64)  # query, score, id is null, id, uid
        self.waiting: list[np.ndarray] = []

    def least(self, kind) -> np.ndarray:
        """No row of a lower score is wanted."""
        low = np.floor((self.square + self.most - self.limit**2) / 2)
        if kind in (np.float32, np.float64):
            return np.where(self.full, np.maximum(self.last[0], low), low).astype(kind)
        low = np.where(low < -(2.0**62), -(2.0**62), np.minimum(low, 2.0**62)).astype(np.int64)
        return np.where(self.full, self.last[0], np.where(low <= -(1 << 62), np.iinfo(np.int64).min, low))

    def offer(self, query: np.ndarray, *row: np.ndarray) -> None:
        """Rows for queries: ``row`` is score, id is null, id and uid."""
        better, alike = np.zeros(len(query), dtype=bool), np.ones(len(query), dtype=bool)
        for i, x in enumerate(row):
            other = self.last[i][query]
            better |= alike & ((x > other) if i == 0 else (x < other))
            alike &= x == other
        keep = (better | ~self.full[query]) & (row[3] != self.uid[query])
        if keep.any():
            self.waiting.append(np.array([x[keep] for x in (query, *row)], dtype=np.int64))
        if sum(w.shape[1] for w in self.waiting) > WAITING:
            self.sort()

    def sort(self) -> None:
        if not self.waiting:
            return
        rows = np.concatenate([self.rows, *self.waiting], axis=1)
        query, score, null, ids, uid = rows
        rows = rows[:, np.lexsort((uid, ids, null, -score, query))]
        rows = rows[:, np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)]]  # a block may hold leaves that are read already
        place = _places(rows[0])
        self.rows, self.waiting = rows[:, place < self.k], []
        query, *last = rows[:, place == self.k - 1]
        self.full[query], self.last[:, query] = True, last
        near = np.sqrt(np.maximum(0.0, self.square[query] + self.most - 2.0 * last[0]))
        self.limit[query] = np.minimum(self.limit[query], near + self.slack[query])


def _places(sorted_: np.ndarray) -> np.ndarray:
    """0, 1, 2 … within each run of equal numbers."""
    at = np.arange(len(sorted_))
    new = np.ones(len(sorted_), dtype=bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _runs(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal numbers begins and ends."""
    at = [0, *(np.flatnonzero(np.diff(sorted_)) + 1).tolist(), len(sorted_)]
    return list(zip(at[:-1], at[1:], strict=True)) if len(sorted_) else []


class Tree:
    """One tree's pages, as arrays; a leaf's rows lie in the order of their distances to its pivot."""

    def __init__(self, pages: pd.DataFrame, most: float):
        self.most = most
        self.inner, self.leaves, rows = {}, {}, []
        for r in pages.itertuples():
            parent = np.asarray(r.parent, dtype=np.float64)
            v = _wide(r.v, len(r.uid), r.dims)
            if r.leaf:
                by = np.argsort(parent, kind="stable")
                rows.append([np.asarray(x)[by] for x in (v, r.uid, r.vec_id, r.no_id, parent)])
                self.leaves[r.page] = len(self.leaves)
            else:
                self.inner[r.page] = (np.asarray(r.child), lifted(v, most), np.asarray(r.radius), parent)
        self.ends = np.cumsum([0, *[len(r[1]) for r in rows]])  # where a leaf's rows begin, and the next one's
        self.v, self.uid, self.ids, self.null, self.parent = (np.concatenate(c) for c in zip(*rows, strict=True))
        self.top = _top(self.v)

    def search(self, uid: int, q: np.ndarray, k: int, bound: float = np.inf) -> tuple[list, int]:
        """The tree's ``k`` best rows for a query (its own ``uid`` left out) that may lie within ``bound`` (a
        distance), as ``(-score, id is null, id, uid)``, best first; and how many distances it has computed."""
        best = Best(np.array([uid]), q[None], k, self.most, np.array([bound]))
        self.search_all(best, np.arange(1))
        return [(-int(s), bool(null), int(i), int(u)) for _, s, null, i, u in best.rows.T], int(best.computed[0])

    def search_all(self, best: Best, queries: np.ndarray) -> None:
        """Puts the tree's rows among the best of those of its queries that are named."""
        kind = exact(self.top, _top(best.q), self.v.shape[1])
        v, q = self.v.astype(kind), best.q[queries].astype(kind)
        low, to = self._reached(best, queries)
        row, n = np.arange(len(queries)), 1
        while (open_ := (low <= best.limit[queries][:, None]) & (low < np.inf)).any():
            if n > 4 and 2 * open_.sum() > open_.size:
                return self._blocks(best, queries, low, v, q, kind)
            leaf = low.argmin(axis=1)[:, None] if n == 1 else np.argpartition(low, min(n, low.shape[1]) - 1, axis=1)[:, :n]
            i, j = np.nonzero(open_[row[:, None], leaf])
            leaf = leaf[i, j]
            by = np.argsort(leaf, kind="stable")
            leaf, i = leaf[by], i[by]
            least = best.least(kind)[queries]
            for a, b in _runs(leaf):
                self._leaf(best, int(leaf[a]), queries, i[a:b], to, v, q, least, kind)
            best.sort()
            low[i, leaf] = np.inf  # read
            n *= 4

    def _reached(self, best: Best, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row for each query, a column for each leaf: the least possible distance of what the leaf holds (infinite where it cannot hold anything wanted), and
        the distance to the leaf's pivot (NaN: not known)."""
        low = np.full((len(queries), len(self.ends) - 1), np.inf)
        to = np.full(low.shape, np.nan)
        limits = best.limit[queries][:, None]
        work = [(0, np.arange(len(queries)), np.zeros(len(queries)), np.full(len(queries), np.nan))]
        while work:
            number, at, least, far = work.pop()
            if number in self.leaves:
                low[at, self.leaves[number]], to[at, self.leaves[number]] = least, far
                continue
            child, pivots, radius, parent = self.inner[number]
            # |d(q, pivot) - d(entry, pivot)| is at most d(q, entry)
            open_ = ~(np.abs(far[:, None] - parent) - radius > limits[at])
            some, entries = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
            best.computed[queries[at[some]]] += len(entries)
            d = distances(best.point[queries[at[some]]], pivots[entries])
            lower = np.maximum(d - radius[entries], least[some][:, None])
            go = open_[some][:, entries] & (lower <= limits[at[some]])
            for j, entry in enumerate(entries):
                i = np.flatnonzero(go[:, j])
                if len(i):
                    work.append((int(child[entry]), at[some[i]], lower[i, j], d[i, j]))
        return low, to

    def _leaf(self, best: Best, leaf: int, queries: np.ndarray, at: np.ndarray, to: np.ndarray, v: np.ndarray, q: np.ndarray, least: np.ndarray, kind) -> None:
        """Reads those rows of a leaf whose distance to its pivot does not leave them out for all the queries ``at``."""
        a, b = self.ends[leaf], self.ends[leaf + 1]
        far, limit = to[at, leaf], best.limit[queries[at]]
        known = ~np.isnan(far)
        start = np.where(known, np.searchsorted(self.parent[a:b], far - limit, "left"), 0)
        stop = np.where(known, np.searchsorted(self.parent[a:b], far + limit, "right"), b - a)
        some = start < stop
        if some.any():
            self._rows(best, a + int(start[some].min()), a + int(stop[some].max()), queries, at[some], v, q, least, kind)

    def _blocks(self, best: Best, queries: np.ndarray, low: np.ndarray, v: np.ndarray, q: np.ndarray, kind) -> None:
        """Reads all leaves that may hold something wanted, some neighbours at once."""
        block = (self.ends[1:] - 1) // BLOCK
        for a, b in _runs(block):
            at = np.flatnonzero(((low[:, a:b] <= best.limit[queries][:, None]) & (low[:, a:b] < np.inf)).any(axis=1))
            if len(at):
                self._rows(best, self.ends[a], self.ends[b], queries, at, v, q, best.least(kind)[queries], kind)
                best.sort()

    def _rows(self, best: Best, a: int, b: int, queries: np.ndarray, at: np.ndarray, v: np.ndarray, q: np.ndarray, least: np.ndarray, kind) -> None:
        best.computed[queries[at]] += b - a
        scores = multiplied(q if len(at) == len(q) else q[at], v[a:b].T, kind)
        hit = np.flatnonzero(scores >= (least if len(at) == len(q) else least[at])[:, None])
        if len(hit):
            i, j = np.divmod(hit, b - a)
            rows = a + j
            best.offer(queries[at[i]], scores.ravel()[hit].astype(np.int64), self.null[rows], self.ids[rows], self.uid[rows])


FOUND = "query_uid long, query_id long, vec_id long, uid long, score long, computed long"


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding",
                 roots: int = ROOTS, tree: int = TREE) -> DataFrame:
    """``query_id, rank, vec_id, score, computed``: for each row where ``is_query`` (over ``vec_id``) holds, the ``k`` rows
    of the highest integer inner product, every other row being a candidate; ``computed`` distances it took.

    Components are rounded down after ``scale``. Vectors that are null or hold a null or non-finite component take no
    part; an empty table or no query gives no rows. Only vectors of one length have an inner product: a query meets those of its own.
    Ties go to the smaller ``vec_id``, a null one last. A repeated row (or id) is a row of its own, as query and as
    candidate: only the query's own row is left out. Extra columns take no part. A product past 64 bits is an error."""
    spark = ship_package(vectors.sparkSession)
    rows = usable(vectors, id_col, vec_col, scale)
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.max(square).alias("most"), F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("dim", F.size("v"))
    out = None
    for r in sorted(sizes.collect()):  # one row for each vector length
        found = _search(rows.filter(F.col("dim") == r["dim"]), r["most"], is_query, k, r["dim"], roots, tree)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, computed long")
    w = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "uid")
    total = F.sum("computed").over(Window.partitionBy("query_uid"))
    ranks = out.withColumns({"rank": F.row_number().over(w), "computed": total}).filter(F.col("uid").isNotNull() & (F.col("rank") <= k))
    return ranks.select("query_id", "rank", "vec_id", "score", "computed")


def _search(rows: DataFrame, most: float, is_query: Column, k: int, dim: int, roots: int, tree: int) -> DataFrame:
    """``FOUND`` rows among vectors of one length; each tree that was asked gives its best, and one row without
    a vector that has its count of distances."""
    pivots = lifted(_matrix(rows.orderBy(F.xxhash64("uid"), "uid").limit(roots).select("v").toPandas(), dim), most)

    def place(batches):
        for b in batches:
            if b.num_rows:
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
                d = distances(lifted(v, most), pivots)
                at = d.argmin(axis=1)
                raw, step = (n := _narrow(v)).tobytes(), n.itemsize * dim
                yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("vec_id"), pa.array([raw[i * step:(i + 1) * step] for i in range(len(v))], pa.binary()),
                                                  pa.array(at, pa.int32()), pa.array(d[np.arange(len(at)), at], pa.float64())], ["uid", "vec_id", "v", "region", "far"])

    placed = stored(rows.select("uid", "vec_id", "v").mapInArrow(place, "uid long, vec_id long, v binary, region int, far double"), "mtree-placed")
    count, radius = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))
    for r in placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # a row for each routing object
        count[r["region"]], radius[r["region"]] = r["n"], r["far"]
    trees = np.maximum(-(-count // tree), 1)
    plot_of = _plots(count, trees, dim, tree, parallelism(rows.sparkSession))
    dealt = placed.drop("far").withColumn("dim", F.lit(dim)).withColumn("tree", F.pmod(F.xxhash64("uid", F.lit(3)), _of(trees, F.col("region"))).cast("int"))
    pages = stored(dealt.groupBy("dim", "region", "tree").applyInPandas(lambda pdf: _pages(pdf, most), PAGES), "mtree-pages")
    pages = pages.withColumn("plot", plot_of(F.col("region"), F.col("tree")))

    queries = placed.filter(is_query).select("uid", F.col("vec_id").alias("query_id"), "v", F.col("region").alias("home"))
    queries = stored(queries.withColumn("own", F.pmod(F.xxhash64("uid", F.lit(4)), _of(trees, F.col("home"))).cast("int")), "mtree-queries")
    at_home = queries.withColumns({"bound": F.lit(float("inf")), "plot": plot_of(F.col("home"), F.col("own"))})
    first = stored(_ask(pages, at_home, most, k, dim, pivots, radius, home=True), "mtree-first")

    # what a query has found in its own tree bounds all others
    reach = first.filter("uid is not null").groupBy(F.col("query_uid").alias("u")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found"))
    open_ = queries.join(reach, F.col("uid") == F.col("u"), "left").withColumn("least", F.when(F.col("found") >= k, F.col("least").cast("double"))).drop("u", "found")

    def reached(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            q, least = asked(_matrix(pdf, dim)), pdf["least"].to_numpy()
            square = (q * q).sum(axis=1)
            bound = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(0.0, square + most - 2.0 * least)))
            slack = SLACK * (np.sqrt(most) + np.sqrt(square) + 1)
            within = distances(q, pivots) - radius <= (bound + slack)[:, None]
            yield pdf.drop(columns="least").assign(bound=bound, regions=[np.flatnonzero(w & (count > 0)).astype(np.int32) for w in within])

    more = open_.mapInPandas(reached, "uid long, query_id long, v binary, home int, own int, bound double, regions array<int>")
    plots = F.transform("regions", lambda r: F.sequence(plot_of(r, F.lit(0)), plot_of(r, _of(trees, r) - 1)))
    more = stored(more.withColumn("plot", F.explode(F.array_distinct(F.flatten(plots)))).drop("regions"), "mtree-more")
    return first.union(_ask(pages, more, most, k, dim, pivots, radius, home=False))


def _of(per_region: np.ndarray, region: Column) -> Column:
    """The number that a region has."""
    return F.element_at(F.lit([int(n) for n in per_region]), region + 1)


def _plots(count: np.ndarray, trees: np.ndarray, dim: int, tree: int, slots: int) -> Callable[[Column, Column], Column]:
    """The plot of a region's tree. A plot has whole trees, of one region or of several small ones; there are some four for each task slot, or more where
    rows are too many for a plot, or fewer where rows are few."""
    held = max(1, PLOT_BYTES // (8 * max(1, dim)) // tree)
    rows = max(min(held * tree, -(-int(count.sum()) // (4 * slots))), PAGE * PAGE)
    held = max(1, min(held, rows // tree))
    base, plot, left = [], -1, 0
    for n, t in zip(count, trees, strict=True):
        if t > held:
            base.append(plot + 1)
            plot, left = plot - (-t // held), 0
        else:
            if n > left:
                plot, left = plot + 1, rows
            base.append(max(plot, 0))
            left -= n
    return lambda region, at: (_of(np.array(base), region) + F.floor(at / held)).cast("int")


def _ask(pages: DataFrame, queries: DataFrame, most: float, k: int, dim: int, pivots: np.ndarray, radius: np.ndarray, home: bool) -> DataFrame:
    """Searches plots: ``queries`` has a row for each query and plot; of its trees those are asked that may hold something within the query's bound, without its own
    tree, or with ``home`` its own alone. A plot's queries are dealt to tasks of about ``TURN``, each with the plot's pages."""
    size = min(TURN, max(1_024, PLOT_BYTES // (8 * max(1, dim))))
    turns = queries.groupBy(F.col("plot").alias("p")).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("turns"))
    turns = stored(turns, "mtree-turns")

    def with_turns(df: DataFrame, turn: Column) -> DataFrame:
        return df.join(turns, F.col("plot") == F.col("p")).select(*df.columns, turn.alias("turn"))

    left = with_turns(pages, F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    right = with_turns(queries, F.pmod(F.xxhash64("uid", F.lit(5)), F.col("turns")).cast("int"))

    def search(page: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        trees = [(*at, Tree(part, most)) for at, part in page.groupby(["region", "tree"])] if len(asks) else []
        for a in range(0, len(asks), QUERIES):
            part = asks.iloc[a:a + QUERIES]
            best = Best(part["uid"].to_numpy(), _matrix(part, dim), k, most, part["bound"].to_numpy())
            least = distances(best.point, pivots) - radius  # distance of a region
            for region, tree, t in trees:
                own = (part["home"].to_numpy() == region) & (part["own"].to_numpy() == tree)
                to = np.flatnonzero(own if home else ~own & (least[:, region] <= best.limit))
                if len(to):
                    t.search_all(best, to)
            query, score, null, ids, uid = best.rows
            n, some = len(part), np.r_[np.arange(len(part)), query]
            gone = np.arange(n + len(query)) < n
            whole = lambda x, mask=gone: pd.arrays.IntegerArray(np.r_[np.zeros(n, dtype=np.int64), x], mask)
            out.append(pd.DataFrame({"query_uid": part["uid"].to_numpy()[some], "query_id": part["query_id"].astype("Int64").array[some],
                                     "vec_id": whole(ids, gone | np.r_[gone[:n], null.astype(bool)]), "uid": whole(uid), "score": whole(score),
                                     "computed": np.r_[best.computed, np.zeros(len(query), dtype=np.int64)]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: pd.array([], "Int64") for c in ("query_uid", "query_id", "vec_id", "uid", "score", "computed")})

    key = ["plot", "turn"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, FOUND)
