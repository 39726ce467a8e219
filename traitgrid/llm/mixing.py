"""Mixing sources to target weights by iterative proportional fitting.

Token weights of (source, language, topic) cells are raked to target marginals;
documents are then sampled with the calibrated probability of their cell.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitgrid.llm.common import cut, map_text, stored
from traitgrid.session import parallelism

DIMS = ["source", "lang", "topic"]
TOPICS = 8
#: Hashed buckets of words.
TERMS = 512
#: Steps of a coordinate of 1. On whole numbers all products and sums of the fit are exact, so its result does not
#: depend on how rows are dealt to tasks.
GRID = 1 << 22
#: Fits from other first centres, and turns of each; the fit that leaves least counts.
TRIES, TURNS = 8, 20
#: Vectors that a task has at a time, and distinct ones that make another task of the fit.
ROWS, TASK_ROWS = 512, 50_000
#: Expected share of all tokens that a mixture keeps.
KEEP = 0.8
#: Cells (counted) up to which documents look their probability up in a broadcast; more cells are joined by shuffle.
BROADCAST_CELLS = 100_000


#: Bytes of the longest words that are hashed by table, and how many are at a time.
LONG, HASHED = 64, 1 << 16
_LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b" " * 5)
# crc32 is affine: a word's is that of as many zeros, xor what each byte adds by its distance from the word's end
_ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(LONG + 1)], dtype=np.uint32)
_ADDED = np.array([[zlib.crc32(bytes([v, *bytes(d)])) for v in range(256)] for d in range(LONG)], dtype=np.uint32) ^ _ZEROS[1:, None]


def _hashes(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of the words of ``text`` (between blanks)."""
    out = np.zeros(len(start), dtype=np.uint32)
    long = size > LONG
    for i in np.flatnonzero(long).tolist():
        word = text[start[i]:start[i] + size[i]]
        out[i] = zlib.crc32(word)
        word[:] = 32
    short = np.flatnonzero(~long)
    for i in range(0, len(short), HASHED):
        at = short[i:i + HASHED]
        n = size[at]
        run = text[start[at[0]]:start[at[-1]] + n[-1]]
        upto = np.cumsum(n)
        back = np.repeat(upto - 1, n) - np.arange(upto[-1])
        out[at] = np.bitwise_xor.reduceat(_ADDED.reshape(-1)[back * 256 + run[run != 32]], upto - n) ^ _ZEROS[n]
    return out


def counted(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Of each text the counts of its words of four bytes or more, lower-cased, in ``TERMS`` hashed buckets: the buckets that
    have any (two bytes each), then their counts (four); and the number of all its words. Many words are hashed at once."""
    text = np.frombuffer(bytearray(b" ".join([b"", *texts, b""]).translate(_LOWER)), dtype=np.uint8)
    edge = np.flatnonzero(np.diff(text != 32)) + 1
    start, size = edge[::2], edge[1::2] - edge[::2]
    first = np.searchsorted(start, np.cumsum([1, *(len(x) + 1 for x in texts)]))
    tokens = np.diff(first)
    bucket, big = (_hashes(text, start, size) % TERMS).astype(np.int64), size > 3
    packs = []
    for i in range(0, len(texts), ROWS):
        n = tokens[i:i + ROWS]
        words = slice(first[i], first[i] + n.sum())
        row = np.repeat(np.arange(len(n)) * TERMS, n)[big[words]]
        cells = np.bincount(row + bucket[words][big[words]], minlength=len(n) * TERMS)
        at = np.flatnonzero(cells)
        ends = np.searchsorted(at, np.arange(1, len(n) + 1) * TERMS).tolist()
        terms, counts = (at % TERMS).astype("<u2").tobytes(), cells[at].astype("<u4").tobytes()
        packs += [terms[2 * j:2 * k] + counts[4 * j:4 * k] for j, k in zip([0, *ends], ends, strict=False)]
    return packs, tokens


def term_counts(words: list[bytes]) -> bytes:
    """``counted`` of one text's words."""
    return counted([b" ".join(words)])[0][0]


def _terms(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of ``term_counts`` as ``row, bucket, count`` of each bucket that a row has."""
    size = np.array([len(p) // 6 for p in packs], dtype=np.int64)
    at = np.frombuffer(b"".join([p[:2 * n] for p, n in zip(packs, size, strict=True)]), dtype="<u2")
    count = np.frombuffer(b"".join([p[2 * n:] for p, n in zip(packs, size, strict=True)]), dtype="<u4")
    return np.repeat(np.arange(len(packs)), size), at, count


class Topics:
    """Centres of topics over hashed term weights.

    Weights are log counts, rarer terms more, on unit length (in ``GRID`` steps), less the mean of the document's
    language: without that the topics would be the languages. A document goes to the centre it is most like; one
    without a term to topic 0. A few centres, and a mean (4 KB) for each language: that is all a driver holds."""

    def __init__(self, weight: np.ndarray, langs: list[str | None]):
        self.weight, self.langs = weight, {g: i for i, g in enumerate(langs)}
        self.mean, self.centre = np.zeros((len(langs), TERMS)), np.zeros((1, TERMS))

    def units(self, packs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``row, bucket, coordinate`` (a whole number) of rows' vectors before the mean is taken off."""
        row, at, count = _terms(packs)
        x = np.log1p(count.astype(np.float64)) * self.weight[at]
        norm = np.sqrt(np.bincount(row, x * x, minlength=len(packs)))
        return row, at, np.rint(GRID * x / np.maximum(norm, 1e-12)[row])

    def assign(self, langs: list[str | None], packs: list[bytes]) -> np.ndarray:
        out = np.zeros(len(packs), dtype=np.int32)
        for i in range(0, len(packs), ROWS):
            part = packs[i:i + ROWS]
            x = -self.mean[[self.langs[g] for g in langs[i:i + ROWS]]]
            row, at, unit = self.units(part)
            x[row, at] += unit
            out[i:i + ROWS] = np.where([len(p) > 0 for p in part], _apart(x, self.centre).argmin(axis=1), 0)
        return out


def _apart(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centres."""
    d = x @ (-2 * centre).T
    d += np.einsum("ij,ij->i", x, x)[:, None]
    d += (centre**2).sum(axis=1)
    return d


def _chance(mark: np.ndarray, number: int) -> np.ndarray:
    """A number over 0, up to 1, for each mark: hashed (splitmix64), other ones for another ``number``."""
    z = mark + np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)


def _table(rows: DataFrame, held: Topics) -> DataFrame:
    """The distinct rows (``lang, terms``; copies count once) as vectors without their language's mean, one to a row, so that
    no batch grows with the input: ``g`` (the language's number), ``mark`` (a hash), ``n`` (copies), ``at`` and ``x`` (bytes of
    its buckets and coordinates)."""
    distinct = rows.groupBy("lang", "terms").agg(F.count(F.lit(1)).alias("n")).withColumn("mark", F.xxhash64("lang", "terms"))
    tasks = max(parallelism(rows.sparkSession), rows.count() // TASK_ROWS)

    def run(part):
        packs = part.column("terms").to_pylist()
        row, at, x = held.units(packs)
        ends = np.cumsum(np.bincount(row, minlength=len(packs)))[:-1]
        yield [[held.langs[v] for v in part.column("lang").to_pylist()], part.column("mark"), part.column("n"),
               [v.tobytes() for v in np.split(at.astype("<u2"), ends)], [v.tobytes() for v in np.split(x.astype("<i4"), ends)]]

    return map_text(distinct.repartition(tasks, "mark"), run, "g int, mark long, n long, at binary, x binary", "terms")


def _vectors(batches, mean: np.ndarray):
    """``g, mark, n, x`` of up to ``ROWS`` rows of the table at a time."""
    less = -mean
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            g, mark, n = (part.column(c).to_numpy() for c in ("g", "mark", "n"))
            packs = part.column("at").to_pylist()
            at = np.frombuffer(b"".join(packs), dtype="<u2")
            x = np.frombuffer(b"".join(part.column("x").to_pylist()), dtype="<i4")
            out = less[g]
            out.reshape(-1)[np.repeat(np.arange(len(g)) * TERMS, [len(p) // 2 for p in packs]) + at] += x
            yield g, mark.view(np.uint64), n, out


def _sums(table: DataFrame, run: Callable[[Iterator], tuple[np.ndarray, np.ndarray]], mean: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all vectors of a row of ``TERMS`` whole numbers, and of one of two more, for each of ``keys``. Tasks add up their own, Spark theirs."""
    import pyarrow as pa

    def task(batches):
        sums = np.hstack(run(_vectors(batches, mean))).astype(np.int64)
        key, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[key, at])], names=["key", "at", "s"])

    got = table.mapInArrow(task, "key int, at int, s long").groupBy("key", "at").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros((keys, TERMS + 2))
    out[got["key"].to_numpy(), got["at"].to_numpy()] = got["s"].to_numpy()
    return out[:, :TERMS], out[:, TERMS:]


def _means(table: DataFrame, langs: int) -> tuple[np.ndarray, int]:
    """The mean vector of each language (copies count), and the number of distinct vectors."""
    def run(vectors):
        sums, more = np.zeros((langs, TERMS)), np.zeros((langs, 2))
        for g, _, n, x in vectors:
            for v in np.unique(g):
                sums[v] += n[g == v] @ x[g == v]
                more[v] += (n[g == v].sum(), (g == v).sum())
        return sums, more

    sums, more = _sums(table, run, np.zeros((langs, TERMS)), langs)
    return np.rint(sums / more[:, :1]), int(more[:, 1].sum())


def _first_centres(table: DataFrame, mean: np.ndarray, k: int) -> np.ndarray:
    """``TRIES`` times ``k`` vectors far apart: each drawn from all by its squared distance to those before (the least of
    exponential draws with that rate is such a draw)."""
    import pyarrow as pa

    centres = np.zeros((TRIES, 0, TERMS))
    for turn in range(k):
        def task(batches, turn=turn, centres=centres):
            best: dict[int, tuple] = {}
            for _, mark, _, x in _vectors(batches, mean):
                far = _apart(x, centres.reshape(-1, TERMS)).reshape(len(x), TRIES, turn).min(axis=2) if turn else np.ones((len(x), TRIES))
                for t in range(TRIES):
                    with np.errstate(divide="ignore"):
                        key = -np.log(_chance(mark, 1 + turn * TRIES + t)) / far[:, t]
                    i = int(np.lexsort((mark, key))[0])
                    best[t] = min(best.get(t, (np.inf, 1 << 64, b"")), (float(key[i]), int(mark[i]), x[i].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([v[0] for v in best.values()], pa.float64()),
                                              pa.array([v[2] for v in best.values()], pa.binary())], names=["t", "key", "x"])

        got = table.mapInArrow(task, "t int, key double, x binary").groupBy("t").agg(F.min(F.struct("key", "x"))["x"].alias("x")).collect()
        drawn = np.stack([np.frombuffer(r["x"], dtype=np.int32) for r in sorted(got, key=lambda r: r["t"])])
        centres = np.concatenate([centres, drawn[:, None].astype(np.float64)], axis=1)
    return centres


def _fitted(table: DataFrame, mean: np.ndarray, k: int) -> np.ndarray:
    """K-means over all vectors: of ``TRIES`` fits the centres that leave the least squared distances. A fit whose centres stay is done."""
    centres = _first_centres(table, mean, k)
    left, going = np.full(TRIES, np.inf), list(range(TRIES))
    for _ in range(TURNS):
        flat = centres[going].reshape(-1, TERMS)

        def run(vectors, flat=flat):
            sums, more = np.zeros(flat.shape), np.zeros((len(flat), 2))
            first = np.arange(0, len(flat), k)
            for _, _, _, x in vectors:
                d = _apart(x, flat).reshape(len(x), -1, k)
                hot = np.zeros((len(x), len(flat)))
                hot[np.arange(len(x))[:, None], first + d.argmin(axis=2)] = 1
                sums += hot.T @ x
                more[:, 0] += hot.sum(axis=0)
                more[first, 1] += (d.min(axis=2) // GRID).sum(axis=0)
            return sums, more

        sums, more = _sums(table, run, mean, len(flat))
        new = np.where(more[:, :1] > 0, np.rint(sums / np.maximum(more[:, :1], 1)), flat).reshape(-1, k, TERMS)
        left[going] = more[::k, 1]
        stay = [(new[i] == centres[t]).all() for i, t in enumerate(going)]
        centres[going] = new
        going = [t for t, s in zip(going, stay, strict=True) if not s]
        if not going:
            break
    return centres[int(left.argmin())]


def fit_topics(rows: DataFrame, topics: int = TOPICS) -> Topics:
    """``Topics`` of all ``rows`` (``lang, terms`` of ``term_counts``): weights and means of every row, centres by k-means over every
    distinct one. ``rows`` are read twice, their vectors once a turn."""
    def run(part):
        row, at, _ = _terms(part.column("terms").to_pylist())
        langs = part.column("lang").to_pylist()
        names = list(dict.fromkeys(langs))
        n = np.bincount(at, minlength=TERMS)
        yield [[None] * TERMS + names, [*range(TERMS)] + [-1] * len(names), [*n, *(langs.count(g) for g in names)]]

    found = map_text(rows.select("lang", "terms"), run, "lang string, at int, n long", "terms").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()
    langs = sorted((r["lang"] for r in found if r["at"] == -1), key=lambda g: (g is not None, g or ""))
    has = np.zeros(TERMS)
    for r in found:
        if r["at"] >= 0:
            has[r["at"]] = r["n"]
    held = Topics(np.log((1 + sum(r["n"] for r in found if r["at"] == -1)) / (1 + has)), langs)
    if langs:
        vectors = stored(_table(rows, held), "mixing-vectors")
        held.mean, n = _means(vectors, len(langs))
        held.centre = _fitted(vectors, held.mean, min(topics, n))
    return held


def with_topics(docs: DataFrame, carry: list[str], topics: int = TOPICS) -> DataFrame:
    """The ``carry`` columns and ``topic, n_tokens, mark`` of every row: topics are fitted on all rows and every row is assigned
    to one, tokens are words
    of the whole text (null: 0), ``mark`` is a hash of id and text that sampling draws by. Texts are read once; their terms are
    stored with the rows."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def count(part):
        packs, tokens = counted([x or b"" for x in part.column("__text").to_pylist()])
        yield [*(part.column(c) for c in carry), part.column("__lang").cast("string"), packs, tokens, part.column("mark")]

    src = docs.select(*carry, F.col("lang").alias("__lang"), F.col("text").cast("binary").alias("__text"), F.xxhash64("doc_id", "text").alias("mark"))
    rows = stored(map_text(src, count, kinds + ", __lang string, __terms binary, n_tokens long, mark long", "__text"), "mixing-terms")
    held = rows.sparkSession.sparkContext.broadcast(fit_topics(rows.select(F.col("__lang").alias("lang"), F.col("__terms").alias("terms")), topics))

    def run(part):
        at = held.value.assign(part.column("__lang").to_pylist(), part.column("__terms").to_pylist())
        yield [*(part.column(c) for c in carry), at, part.column("n_tokens"), part.column("mark")]

    return map_text(rows, run, kinds + ", topic int, n_tokens long, mark long", "__terms")


def tempered_targets(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """``value, share``: each value's token share to ``power`` (1: as it is, 0: even), scaled to 1."""
    t = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").cast("double").alias("n")).filter("n > 0")
    total = t.agg(F.sum(F.pow("n", F.lit(power)))).first()[0] or 1.0
    return t.select("value", (F.pow("n", F.lit(power)) / F.lit(total)).alias("share"))


def _goals(cells: DataFrame, dim: str, target: DataFrame, total: float, keep: float | None) -> DataFrame:
    """``v, goal``: tokens that each value is to have. With ``keep`` they add up to that part of
    all tokens, and what a value would need over the tokens it has is dealt to the others."""
    goal = target.select(F.col("value").alias("v"), (F.col("share") * F.lit(total)).alias("goal"))
    if keep is None:
        return cut(goal)
    have = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").cast("double").alias("most"))
    goal = cut(goal.join(have, F.col("v").eqNullSafe(F.col("value"))).select("v", "goal", "most"))
    scale = 0.0
    while True:
        full = F.col("goal") * F.lit(scale) >= F.col("most")
        over, rest = goal.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("goal")))).first()
        new = (keep * total - (over or 0.0)) / rest if rest else scale
        if new <= scale * (1 + 1e-12):
            return cut(goal.select("v", F.least("most", F.col("goal") * F.lit(scale)).alias("goal")))
        scale = new


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 25, tolerance: float = 1e-6, keep: float | None = None) -> DataFrame:
    """Adds ``weight`` to cells with ``tokens``: for each dimension in turn, weights
    are scaled so that its sums are the target shares of all tokens, until no sum
    is off by more than ``tolerance``. Where the deviation does not halve within
    ``rounds`` rounds, the targets contradict each other: a warning names what is left of it.

    With ``keep`` the weights are that part of all tokens, none is over its cell's
    tokens, and what full cells cannot take goes to the others of their value.

    Works on one row per combination of values, however many documents each has. The cells carry their values' goals
    and factors, so that a turn of one dimension is one join, whatever the number of dimensions.
    Sums are pre-aggregated and written before they are joined back, so the cells of a common value
    never meet in one task. A null value is a value of its own. A value without a target gets weight 0;
    targets of values that hold no token cannot be met, the rest is scaled alike."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    dims = list(targets)
    # a cell's weight is its tokens times x, the product of its values' factors; with keep, x over 1 counts as 1
    state = cells.withColumns({f"__f{i}": F.lit(1.0) for i in range(len(dims))} | {"__off": F.lit(0.0)})
    x = reduce(lambda a, i: a * F.col(f"__f{i}"), range(len(dims)), F.lit(float(keep or 1)))
    for i, d in enumerate(dims):
        goal = _goals(cells, d, targets[d], total, keep).select(F.col("v").alias("__v"), F.col("goal").alias(f"__g{i}"))
        state = state.join(goal, F.col(d).eqNullSafe(F.col("__v")), "left").drop("__v").fillna(0.0, [f"__g{i}"])
    state = cut(state)
    full = F.lit(False) if keep is None else x >= 1
    have, g = F.col("__full") + F.col("__free"), F.col("__g")
    step = F.when((g >= F.col("__full")) & (F.col("__free") > 0), (g - F.col("__full")) / F.col("__free")).when(
        g < F.col("__full"), g / have).otherwise(1.0)
    off = F.when(have > 0, F.abs(g - have) / have).otherwise(0.0)
    least, since = float("inf"), 0
    while True:
        for i, d in enumerate(dims):
            sums = state.groupBy(F.col(d).alias("__v")).agg(
                F.first(f"__g{i}").alias("__g"),
                F.sum(F.when(full, F.col("tokens")).otherwise(0).cast("double")).alias("__full"),
                F.sum(F.when(~full, F.col("tokens") * x).otherwise(0.0)).alias("__free"))
            sums = cut(sums.select("__v", step.alias("__step"), off.alias("__o")))
            state = state.join(sums, F.col(d).eqNullSafe(F.col("__v")))
            state = cut(state.withColumns({f"__f{i}": F.col(f"__f{i}") * F.col("__step"), "__off": F.greatest("__off", "__o") if i else F.col("__o")})
                        .drop("__v", "__step", "__o"))
        most = state.agg(F.max("__off")).first()[0]
        if most is None or most <= tolerance:
            break
        least, since = (most, 0) if most < least / 2 else (least, since + 1)
        if since >= rounds:
            warnings.warn(f"raking stopped with sums up to {most:.2g} of themselves off their targets", stacklevel=2)
            break
    return state.select(*cells.columns, (F.col("tokens") * (x if keep is None else F.least(F.lit(1.0), x))).alias("weight"))


def mixture(docs: DataFrame, power: float = 0.85, topics: int = TOPICS, seed: int = 17, carry: list[str] | None = None,
            keep: float = KEEP) -> DataFrame:
    """Per row: ``doc_id, source, lang`` and the ``carry`` columns, ``topic, n_tokens,
    probability, sampled``.

    Targets are the tempered token shares of each dimension, of an expected ``keep`` of
    all tokens. A cell's probability is weight over tokens, at most 1: a value with too
    few tokens for its share is taken whole and the others make up for it, so no small
    cell sets the rate of the rest. Expected tokens have the raked shares to ``rake``'s tolerance (or
    the deviation that it warns of). The draw is a hash of id and text, so the same input gives the same sample.
    Documents without a word carry no tokens: they are kept with their cell's
    probability, or 1 if the cell has no token at all. An empty table gives no rows."""
    own = list(dict.fromkeys(["doc_id", "source", "lang", *(carry or [])]))
    rows = with_topics(docs, own, topics)
    if not carry:  # a few short columns: read the texts once
        rows = stored(rows, "mixing-rows")
    cells = cut(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))
    raked = rake(cells, {d: tempered_targets(cells, d, power) for d in DIMS}, keep=keep)
    ratio = cut(raked.select(*[F.col(d).alias(f"__{d}") for d in DIMS], F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).alias("__r")))
    n = ratio.count()
    p = F.round(F.coalesce(F.col("__r"), F.lit(1.0)), 9)
    on = [F.col(d).eqNullSafe(F.col(f"__{d}")) for d in DIMS]
    draw = F.shiftrightunsigned(F.xxhash64("mark", F.lit(seed)), 11) / F.lit(float(1 << 53))
    small = F.broadcast(ratio) if n <= BROADCAST_CELLS else ratio
    return rows.join(small, on).withColumn("probability", p).withColumn("sampled", draw < F.col("probability")).select(
        *own, "topic", "n_tokens", "probability", "sampled")
