"""Phrase mining by direct-address tiling.

Words get ids by frequency rank, so the common ones lie close together. A phrase of m
words is a pair: the id of its first m - 1 words and the id of its last. The plane of
pairs is cut into tiles of ``side`` x ``side``; the few tiles that rank says are
crowded are counted densely (``bincount`` over the tile's cells), all others as sorted
coordinates with counts. Each task counts what it has read and sends sums; pairs that
occur often enough are ranked by frequency again, their ids replace them in the text,
and the next level counts them against the word that follows.

The text is stored as ids in short rows, read a few at a time, and shrinks from level to level to the places where a
longer frequent phrase can still begin.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitgrid.llm.common import as_bytes, cut, slices, small_batches, stored
from traitgrid.operators.numbering import numbered
from traitgrid.session import ship_package


@dataclass(frozen=True)
class Sizes:
    """None of them changes results."""

    side: int = 1_024  #: ids along a tile's side
    band: int = 64  #: rows of a tile that travel together
    flush: int = 1 << 21  #: pairs that a task holds before it sums them up and sends the sums
    words: int = 1 << 20  #: distinct words, likewise
    ids: int = 1 << 14  #: ids of text in a row; more if no piece ends
    rows: int = 64  #: rows of text read at once
    batch: int = 8 << 20  #: bytes that a task hands to Python at once
    merged: int = 512  #: flushes of a dense tile that one task adds up; more are split over tasks, and the sums added by Spark
    per_cell: int = 16  #: a tile is dense if a flush is expected to hit it once for so many cells
    broadcast: int = 64 << 20  #: a lookup table of more bytes is joined


_KEY = np.dtype("<i8")
TEXT = pa.schema([("lang", pa.string()), ("w", pa.binary()), ("cur", pa.binary())])

_FROM = bytes(range(65, 91)) + b"\t,;:!?\n\x0b\x0c\r"
_TO = bytes(range(97, 123)) + b" ........."
_LOWER = bytes.maketrans(_FROM, _TO)


def words_of(text: bytes) -> list[bytes]:
    """A text's words, A-Z in lower case; ``.`` (never in a word) where a piece ends."""
    return text.translate(_LOWER).replace(b".", b" . ").split()


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def count_words(docs: DataFrame, min_count: int, z: Sizes) -> DataFrame:
    """``lang, word, n`` of words that occur ``min_count`` times; the row without a word
    has the number of all word occurrences of its lang. ``docs``: ``lang, text`` (bytes)."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def sums(found):
        for lang, c in found.items():
            c.pop(b".", None)
            yield _batch(schema, [[lang] * (len(c) + 1), [*c, None], [*c.values(), c.total()]])

    def run(batches):
        found: dict[str, Counter] = {}
        for part in slices(batches, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text or b""))
            if sum(map(len, found.values())) > z.words:
                yield from sums(found)
                found = {}
        yield from sums(found)

    counts = docs.mapInArrow(run, "lang string, word binary, n long")
    return counts.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter((F.col("n") >= min_count) | F.col("word").isNull())


def ranked(counts: DataFrame, key: str) -> DataFrame:
    """``lang, key, n, id``: ids 0, 1, 2 … of each lang, the most frequent first."""
    return stored(numbered(counts, ["lang"], [-F.col("n"), key], "id"), "phrase-ranks")


# --- text to ids -------------------------------------------------------------------------------


def _encode(texts: list[bytes], ids: dict[bytes, int]) -> np.ndarray:
    """Word ids one after the other, -1 where a pair of frequent words ends; words in no pair are left out."""
    get = ids.get
    x = np.array([get(w, -1) for t in texts for w in (*words_of(t), b".")], dtype=np.int32)
    return _runs(x, x, 2)[0]


def _runs(w: np.ndarray, cur: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and phrase ids of the places that a phrase of ``m`` words can cover: where the phrases
    (of ``m - 1`` words) of two neighbouring places are frequent. -1 stands between runs."""
    start = np.zeros(len(w), dtype=bool)
    if len(w) > 1:
        start[:-1] = (cur[:-1] >= 0) & (cur[1:] >= 0)
    keep = start.copy()
    for j in range(1, m):
        keep[j:] |= start[:len(w) - j]
    edge = np.zeros_like(keep)
    edge[1:] = keep[:-1] & ~keep[1:]
    w, cur = np.where(keep, w, -1), np.where(keep, cur, -1)
    return w[keep | edge].astype(np.int32), cur[keep | edge].astype(np.int32)


def _pairs(w: np.ndarray, cur: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a phrase of ``m`` words may begin, and its key: the id of its first
    ``m - 1`` words, and of its last."""
    if len(w) < m:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero((cur[:len(w) - m + 1] >= 0) & (cur[1:len(w) - m + 2] >= 0))
    return at, cur[at].astype(np.int64) << 32 | w[at + m - 1]


def _rows(lang: str, w: np.ndarray, cur: np.ndarray, z: Sizes):
    """Rows of about ``z.ids`` ids, each up to the end of a run: what a row holds does not follow the slice of text it comes from.
    All end in -1, so any that lie behind one another are a text again."""
    ends = np.flatnonzero(w < 0) + 1
    last = np.append(np.diff(ends // z.ids) > 0, True)[:len(ends)]
    i = 0
    for j in ends[last].tolist():
        yield _batch(TEXT, [[lang], [w[i:j].tobytes()], [cur[i:j].tobytes()]])
        i = j


def _texts(b: pa.RecordBatch):
    """``lang, w, cur`` of all of a batch's text in each lang."""
    langs = b.column("lang").to_pylist()
    parts = [b.column(c).to_pylist() for c in ("w", "cur")]
    for lang in dict.fromkeys(langs):
        yield lang, *(np.frombuffer(b"".join([x for g, x in zip(langs, c, strict=True) if g == lang]), np.int32) for c in parts)


def _by_lang(part: pa.RecordBatch):
    langs = part.column("lang").to_pylist()
    texts = part.column("text").to_pylist()
    for lang in dict.fromkeys(langs):
        yield lang, [t for x, t in zip(langs, texts, strict=True) if x == lang and t]


def encoded(docs: DataFrame, vocab: DataFrame, z: Sizes) -> DataFrame:
    """``row, lang, w, cur``: the texts as ids, each row of one lang."""
    spark = docs.sparkSession
    schema = "lang string, w binary, cur binary"
    if _small(vocab, F.octet_length("word") + 1, z):
        held = spark.sparkContext.broadcast({k: b"\n".join(t.sort_by("id")["word"].to_pylist()) for k, t in _langs(vocab)})

        def run(batches):
            ids: dict[str, dict] = {}
            for part in slices(batches, "text"):
                for lang, texts in _by_lang(part):
                    if lang not in held.value:
                        continue
                    if lang not in ids:
                        ids[lang] = {w: i for i, w in enumerate(held.value[lang].split(b"\n"))}
                    x = _encode(texts, ids[lang])
                    yield from _rows(lang, x, x, z)

        rows = docs.mapInArrow(run, schema)
    else:
        parts = pa.schema([("lang", pa.string()), ("texts", pa.list_(pa.binary()))])

        def deal(batches):
            for part in slices(batches, "text"):
                for lang, texts in _by_lang(part):
                    yield _batch(parts, [[lang], [texts]])

        held = stored(docs.mapInArrow(deal, "lang string, texts array<binary>").withColumn("row", F.monotonically_increasing_id()), "phrase-texts")
        asked = pa.schema([("row", pa.int64()), ("lang", pa.string()), ("word", pa.binary())])

        def ask(batches):
            for b in batches:
                for r in b.to_pylist():
                    found = sorted({w for t in r["texts"] for w in words_of(t)})
                    yield _batch(asked, [[r["row"]] * len(found), [r["lang"]] * len(found), found])

        def answer(batches):
            for b in batches:
                for r in b.to_pylist():
                    x = _encode(r["texts"], {y["word"]: y["id"] for y in r["found"]})
                    yield from _rows(r["lang"], x, x, z)

        rows = _with_answers(held, held.select("row", "lang", "texts").mapInArrow(ask, "row long, lang string, word binary"), vocab, "word").mapInArrow(answer, schema)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "phrase-ids")


def _small(table: DataFrame, size: Column, z: Sizes) -> bool:
    return (table.agg(F.sum(F.lit(16) + size)).first()[0] or 0) <= z.broadcast


def _langs(table: DataFrame):
    """Each lang's rows of a table that ``_small`` has let through."""
    rows = table.toArrow()
    for lang in rows["lang"].unique().to_pylist():
        yield lang, rows.filter(pc.equal(rows["lang"], lang))


def _with_answers(held: DataFrame, asks: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``held`` rows with ``found``: the keys that their row asked for and the table has, with ids
    (no more than a row of text has words)."""
    t = table.select(F.col("lang").alias("l"), F.col(key).alias("k"), "id")
    found = asks.join(t, (F.col("lang") == F.col("l")) & (F.col(key) == F.col("k"))).groupBy(F.col("row").alias("r")).agg(
        F.collect_list(F.struct(F.col(key).alias(key), "id")).alias("found"))
    return held.join(found, F.col("row") == F.col("r")).drop("r")


def advanced(text: DataFrame, table: DataFrame, m: int, z: Sizes) -> DataFrame:
    """``text`` with the ids of frequent phrases of ``m`` words (``table``) in ``cur``, shrunk to where one of
    ``m + 1`` words can be."""
    spark = text.sparkSession
    schema = "lang string, w binary, cur binary"

    def step(lang, w, cur, keys, ids):
        at, key = _pairs(w, cur, m)
        new = np.full(len(w), -1, dtype=np.int32)
        i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[i] == key
        new[at[hit]] = ids[i[hit]]
        yield from _rows(lang, *_runs(w, new, m + 1), z)

    if _small(table, F.lit(0), z):
        held = spark.sparkContext.broadcast({k: tuple(t.sort_by("key")[c].to_numpy() for c in ("key", "id")) for k, t in _langs(table)})

        def run(batches):
            for b in batches:
                for lang, w, cur in _texts(b):
                    if lang in held.value:
                        yield from step(lang, w, cur, *held.value[lang])

        rows = text.mapInArrow(run, schema)
    else:
        asked = pa.schema([("row", pa.int64()), ("lang", pa.string()), ("key", pa.int64())])

        def ask(batches):
            for b in batches:
                for r in b.to_pylist():
                    found = np.unique(_pairs(np.frombuffer(r["w"], np.int32), np.frombuffer(r["cur"], np.int32), m)[1])
                    yield _batch(asked, [[r["row"]] * len(found), [r["lang"]] * len(found), found])

        def answer(batches):
            for b in batches:
                for r in b.to_pylist():
                    found = np.array(sorted((x["key"], x["id"]) for x in r["found"]), dtype=np.int64).T
                    yield from step(r["lang"], np.frombuffer(r["w"], np.int32), np.frombuffer(r["cur"], np.int32), *found)

        rows = _with_answers(text, text.select("row", "lang", "w", "cur").mapInArrow(ask, "row long, lang string, key long"), table, "key").mapInArrow(answer, schema)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "phrase-ids")


# --- counting -----------------------------------------------------------------------------------


def dense_tiles(left: DataFrame, vocab: DataFrame, total: int, z: Sizes) -> dict[str, list[tuple[int, int]]]:
    """The tiles (by lang) that a flush is expected to hit at least once for every ``per_cell`` cells, if the
    two parts of a phrase were independent. Expected shares add up to at most 1, so there are no more
    than ``flush * per_cell / side ** 2``, whatever the data."""
    least = z.side**2 / z.per_cell / z.flush

    def blocks(table):
        """Blocks of ids that may be part of a dense tile: no tile is likelier than its blocks."""
        return table.groupBy("lang", F.floor(F.col("id") / z.side).alias("block")).agg(F.sum("n").alias("n")).filter(F.col("n") >= least * total).collect()

    n = {r["lang"]: r["n"] for r in vocab.groupBy("lang").agg(F.sum("n").alias("n")).filter(F.col("n") >= least * total).collect()}
    a, b = blocks(left), blocks(vocab)
    out: dict[str, list] = {}
    for x in a:
        for y in b:
            if x["lang"] == y["lang"] and x["n"] * y["n"] / n[x["lang"]] >= least * total:
                out.setdefault(x["lang"], []).append((x["block"], y["block"]))
    return out


def tiled(keys: np.ndarray, tiles: list[tuple[int, int]], side: int):
    """Sums of pair occurrences: ``(tile, cells, counts)`` for each dense tile that was hit, and
    ``(None, keys, counts)``, sorted, for what lies in other tiles."""
    a, b = keys >> 32, keys & 0xFFFFFFFF
    block = (a // side) << 32 | b // side
    rest = np.ones(len(keys), dtype=bool)
    for t in tiles:
        hit = block == (t[0] << 32 | t[1])
        if hit.any():
            rest &= ~hit
            cells = np.bincount((a[hit] % side) * side + b[hit] % side, minlength=side * side)
            at = np.flatnonzero(cells)
            yield t, at, cells[at]
    if rest.any():
        yield None, *np.unique(keys[rest], return_counts=True)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(31)


SUMS = "lang string, dense boolean, a long, b long, band int, salt int, at binary, n binary"


def count_pairs(text: DataFrame, m: int, min_count: int, dense: dict[str, list[tuple[int, int]]], total: int, z: Sizes) -> DataFrame:
    """``lang, key, n`` of the phrases of ``m`` words that occur ``min_count`` times. ``total`` (occurrences
    of words) sets how many bundles the sparse tiles are dealt to, and how often a dense one is split."""
    bundles = max(1, min(1 << 14, total // z.flush))
    salts = max(1, round(total / z.flush / z.merged))
    out = pa.schema([("lang", pa.string()), ("dense", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("band", pa.int32()),
                     ("salt", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])

    def sums(lang, keys, salt):
        for t, at, n in tiled(np.concatenate(keys), dense.get(lang, []), z.side):
            # a tile travels in bands of cells; sparse tiles in bundles, each whole
            where = at // (z.side * z.band) if t else _mix((at >> 32) // z.side << 32 | (at & 0xFFFFFFFF) // z.side) % np.uint64(bundles)
            order = np.argsort(where, kind="stable")
            where, at, n = where[order], at[order], n[order]
            for i, j in zip(*(lambda s: (s, [*s[1:], len(where)]))(np.flatnonzero(np.r_[True, np.diff(where) != 0])), strict=True):
                x = int(where[i])
                yield _batch(out, [[lang], [t is not None], [t[0] if t else x], [t[1] if t else 0], [x if t else 0], [salt % salts if t else 0],
                                   [at[i:j].astype(_KEY).tobytes()], [n[i:j].astype(_KEY).tobytes()]])

    def run(batches):
        from pyspark import TaskContext

        held: dict[str, list] = {}
        many, salt = 0, TaskContext.get().partitionId()
        for b in batches:
            for lang, w, cur in _texts(b):
                key = _pairs(w, cur, m)[1]
                held.setdefault(lang, []).append(key)
                many += len(key)
                if many >= z.flush:
                    for x, keys in held.items():
                        yield from sums(x, keys, salt)
                    held, many, salt = {}, 0, salt + 1
        for x, keys in held.items():
            yield from sums(x, keys, salt)

    group = ["lang", "dense", "a", "b", "band", "salt"]
    sent = text.select("lang", "w", "cur").mapInArrow(run, SUMS)
    merged = sent.repartition(*group).sortWithinPartitions(*group).mapInArrow(_merge(min_count, salts, z), "lang string, key long, n long")
    return merged.groupBy("lang", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _merge(min_count: int, salts: int, z: Sizes):
    """Adds up the sums of each tile's band or bundle, which come one after the other. What surely stays below
    ``min_count`` is left out; a split tile, or a bundle that a task could not hold at once, is passed on in full."""
    out = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64())])

    def emit(group, keys, n, whole):
        if whole:
            keys, n = keys[n >= min_count], n[n >= min_count]
        if len(keys):
            yield _batch(out, [[group[0]] * len(keys), keys, n])

    def added(held):
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(keys), dtype=np.int64)
        np.add.at(total, at, n)
        return keys, total

    def finish(group, held, cells, whole):
        if group is None:
            return
        if group[1]:
            at = np.flatnonzero(cells)
            cell = at + group[4] * z.side * z.band
            keys = (group[2] * z.side + cell // z.side) << 32 | (group[3] * z.side + cell % z.side)
            yield from emit(group, keys, cells[at], salts == 1)
        elif held:
            yield from emit(group, *added(held), whole)

    def run(batches):
        group, held, cells, many, whole = None, [], None, 0, True
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if r[:6] != group:
                    yield from finish(group, held, cells, whole)
                    group, held, many, whole = r[:6], [], 0, True
                    cells = np.zeros(z.side * z.band, dtype=np.int64) if group[1] else None
                at, n = np.frombuffer(r[6], _KEY), np.frombuffer(r[7], _KEY)
                if group[1]:
                    cells[at - group[4] * z.side * z.band] += n
                    continue
                held.append((at, n))
                many += len(at)
                if many > 2 * z.flush:
                    held = [added(held)]
                    many = len(held[0][0])
                    if many > z.flush:
                        yield from emit(group, *held[0], False)
                        held, many, whole = [], 0, False
        yield from finish(group, held, cells, whole)

    return run


# --- phrases ------------------------------------------------------------------------------------


def frequent_phrases(docs: DataFrame, min_count: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang",
                     z: Sizes = Sizes()) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, m, f`` of every phrase of 1 to ``longest`` words that occurs ``min_count`` times in its
    lang, and ``lang, n`` (all word occurrences)."""
    ship_package(docs.sparkSession)
    with small_batches(docs.sparkSession, z.batch, z.rows):
        return _frequent(docs, min_count, longest, text_col, lang_col, z)


def _frequent(docs: DataFrame, min_count: int, longest: int, text_col: str, lang_col: str, z: Sizes) -> tuple[DataFrame, DataFrame]:
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), as_bytes(text_col).alias("text"))
    counts = stored(count_words(docs, min_count, z), "phrase-words")
    n = cut(counts.filter("word is null").select("lang", "n"))
    total = n.agg(F.sum("n")).first()[0] or 0
    vocab = ranked(counts.filter("word is not null"), "word")
    words = vocab.select("lang", "id", F.col("word").cast("string").alias("phrase"), "n")
    known = [words.select("lang", "phrase", F.lit(1).alias("m"), F.col("n").alias("f"))]
    text, left, upto = encoded(docs, vocab, z), vocab, words
    for m in range(2, longest + 1):
        if text.isEmpty():
            break
        pairs = ranked(count_pairs(text, m, min_count, dense_tiles(left, vocab, total, z), total, z), "key")
        if pairs.isEmpty():
            break
        if pairs.agg(F.max("id")).first()[0] >= 1 << 31:
            raise OverflowError(f"more than 2**31 frequent phrases of {m} words in one lang")
        first = upto.select(F.col("lang").alias("l0"), F.col("id").alias("i0"), F.col("phrase").alias("p0"))
        last = words.select(F.col("lang").alias("l1"), F.col("id").alias("i1"), F.col("phrase").alias("p1"))
        upto = stored(pairs.join(first, (F.col("lang") == F.col("l0")) & (F.shiftright("key", 32) == F.col("i0")))
                      .join(last, (F.col("lang") == F.col("l1")) & (F.col("key").bitwiseAND(0xFFFFFFFF) == F.col("i1")))
                      .select("lang", "id", F.concat_ws(" ", "p0", "p1").alias("phrase"), "n"), "phrase-texts")
        known.append(upto.select("lang", "phrase", F.lit(m).alias("m"), F.col("n").alias("f")))
        if m < longest:
            text, left = advanced(text, pairs, m, z), pairs
    out = known[0]
    for x in known[1:]:
        out = out.union(x)
    return stored(out, "phrase-known"), n


def collocations(docs: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000, inside: int = 100,
                 text_col: str = "text", lang_col: str = "lang", z: Sizes = Sizes()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each lang's ``top`` phrases of 2 to ``longest`` words.

    Pieces end at ``. , ; : ! ?`` and line breaks; words are what blanks and tabs part, A-Z in
    lower case. ``a`` is the phrase's count (``min_count`` at least), ``n`` that of all words of the
    lang, ``score`` the least ``floor(1000 a n / (l r))`` over the cuts of the phrase into a first
    part (``l``) and a rest (``r``); of equal cuts the earliest. Phrases inside a longer one that occurs at least
    ``inside`` percent as often are left out. Order: score, then ``a``, both falling, then
    the phrase's bytes.

    A null lang is ``und``, a null or empty text has no words, very long texts are read whole, repeated rows
    count each, extra columns take no part; an empty table has no phrases."""
    known, n = frequent_phrases(docs, min_count, longest, text_col, lang_col, z)
    part = F.split("phrase", " ")

    def words(i, k):
        return F.array_join(F.slice(part, i, k), " ")

    f = known.select(F.col("lang").alias("fl"), F.col("phrase").alias("fp"), F.col("f").alias("count"))
    found = known.filter("m >= 2").withColumnRenamed("f", "a")
    ends = known.filter("m >= 3").select("lang", "f", F.explode(F.array(words(F.lit(1), F.col("m") - 1), words(F.lit(2), F.col("m") - 1))).alias("inner"))
    # a part is never rarer than the whole, so what any longer phrase holds down one of the next length does, too
    longer = cut(ends.groupBy(F.col("lang").alias("ll"), "inner").agg(F.max("f").alias("longer")))
    found = (found.join(longer, (F.col("lang") == F.col("ll")) & (F.col("phrase") == F.col("inner")), "left")
             .filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))).select("lang", "phrase", "m", "a"))
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", words(F.lit(1), F.col("k")).alias("one"), words(F.col("k") + 1, F.col("m") - F.col("k")).alias("two"))
    for side, count in (("one", "l"), ("two", "r")):
        cuts = cuts.join(f.withColumnRenamed("count", count), (F.col("lang") == F.col("fl")) & (F.col(side) == F.col("fp"))).drop("fl", "fp", side)
    cuts = cuts.join(n.withColumnRenamed("lang", "nl"), F.col("lang") == F.col("nl")).drop("nl")
    score = F.expr("cast(1000 * cast(a as decimal(15,0)) * cast(n as decimal(19,0)) as decimal(38,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = best.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
