"""Substring dedup by level-wise doubling.

A passage of ``size`` words can only repeat across documents if its shorter
windows do. The first level takes windows of ``(size + 1) // 2`` words, and of
those the one with the smallest hash inside each passage (equal passages choose
alike, so nothing is lost and about a quarter of the windows are compared). Only
passages whose chosen window occurs in two documents are extended to twice that length, less the
word in the middle that both halves share: 7 words, then 13. Longer passages cover no
word that their 13-word windows do not, so the removal stops there; ``longest_passages`` goes on
doubling until no candidates survive.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from traitgrid.llm.common import cut, map_text, stored
from traitgrid.session import ship_package

SIZE = 13
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TAG = 0x7FFFFFFF
OCC = "h long, g long, doc_id long, pos long, sure boolean, salt long"


def _tag(raw: bytes) -> int:
    """Tells texts of one id apart where ids are not unique; stands above the word position."""
    return (zlib.crc32(raw) & _TAG) << 32


def _tag_column(raw: Column | str) -> Column:
    """``_tag`` of a binary column."""
    return F.shiftleft(F.crc32(raw).bitwiseAND(F.lit(_TAG)), 32)


class Words:
    """The words of a slice of texts, one after the other, as arrays."""

    def __init__(self, texts: list[bytes]):
        self.lists = [t.split() for t in texts]
        self.n = np.array([len(x) for x in self.lists], dtype=np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        self.first = np.cumsum(self.n) - self.n
        ids: dict[bytes, int] = {}
        self.ids = np.array([ids.setdefault(w, len(ids)) for x in self.lists for w in x], dtype=np.int64)
        self.words = list(ids)

    def marked(self, at: list[list[int] | None], tags: np.ndarray) -> np.ndarray:
        """A mask of the words at the positions given for each text (those with its tag)."""
        out = np.zeros(len(self.doc), dtype=bool)
        for i, p in enumerate(at):
            p = np.array(p or [], dtype=np.int64)
            out[self.first[i] + (p[p >> 32 == tags[i] >> 32] & 0xFFFFFFFF)] = True
        return out

    def hashes(self, size: int, seed: int) -> np.ndarray:
        """A mixed 64-bit hash of the ``size`` words from each word on (windows that
        cross a document's end included: see ``inside``)."""
        one = np.array([xxh64_intdigest(w, seed) for w in self.words], dtype=np.uint64)[self.ids]
        m = max(0, len(one) - size + 1)
        h = np.zeros(m, dtype=np.uint64)
        for j in range(size):
            h = h * _BASE + one[j:j + m]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)

    def inside(self, size: int) -> np.ndarray:
        m = max(0, len(self.doc) - size + 1)
        return self.doc[:m] == self.doc[size - 1:size - 1 + m]

    def chosen(self, size: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each passage of ``size`` words that lies in one document: its start, and
        where its chosen ``part``-word window is; and the hashes of all such windows."""
        h = self.hashes(part, 1)
        ok = self.inside(size)
        if not ok.any():
            return np.empty(0, np.int64), np.empty(0, np.int64), h
        at = np.lib.stride_tricks.sliding_window_view(h, size - part + 1).argmin(axis=1)
        start = np.flatnonzero(ok)
        return start, start + at[start], h


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new value of the sorted key columns begins."""
    return np.r_[True, np.logical_or.reduce([np.diff(k) != 0 for k in keys])]


def _alike(doc: np.ndarray, h: np.ndarray, g: np.ndarray, live: np.ndarray) -> np.ndarray:
    """``live``, spread to windows of the same document with the same key."""
    order = np.lexsort((g, h, doc))
    new = _runs(doc[order], h[order], g[order])
    out = np.empty_like(live)
    out[order] = np.logical_or.reduceat(live[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def _collapse(h: np.ndarray, g: np.ndarray, doc: np.ndarray, pos: np.ndarray, first_too: bool) -> list[np.ndarray]:
    """Occurrences of one slice, as columns of ``OCC``: one for each key and document
    (the first; those like it are found again from the text, see ``_alike``). Those in
    a later document than the slice's first are known to be repeats here; they get a
    salt, so a passage of very many documents sends each slice's first only to its key."""
    order = np.lexsort((pos, doc, g, h))
    order = order[_runs(h[order], g[order], doc[order], pos[order] >> 32)]
    h, g, doc, pos = h[order], g[order], doc[order], pos[order]
    new = _runs(h, g)
    run = np.cumsum(new) - 1
    later = doc != doc[new][run]
    sure = later | (np.bincount(run, weights=later)[run] > 0) if first_too else later
    return [h, g, doc, pos, sure, np.where(later, (pos * 31 + doc) % 1021 + 1, 0)]


def _flag(first_too: bool):
    """Over occurrences sorted by (h, g, doc_id): ``doc_id, pos`` of those that have
    an earlier document with the same key (``first_too``: or a later one)."""
    schema = pa.schema([("doc_id", pa.int64()), ("pos", pa.int64())])

    def go(batches):
        state, wait = None, None  # the last key, its first document, whether another had it; its first document's rows
        for b in batches:
            if not b.num_rows:
                continue
            h, g, doc, pos = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            sure = b.column(4).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(np.r_[True, (np.diff(h) != 0) | (np.diff(g) != 0)])
            run = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(h)]))
            least, many = doc[start].copy(), np.zeros(len(start), dtype=bool)
            goes_on = state is not None and state[:2] == (h[0], g[0])
            if goes_on:
                least[0], many[0] = state[2], state[3]
            later = doc != least[run]
            many |= np.bincount(run, weights=later, minlength=len(start)) > 0
            out = sure | later | (many[run] if first_too else False)
            got_doc, got_pos = [doc[out]], [pos[out]]
            if wait is not None and goes_on and many[0]:
                got_doc.append(wait[0])
                got_pos.append(wait[1])
            if wait is not None and (not goes_on or many[0]):
                wait = None
            if first_too and not many[-1]:  # the first document's rows wait for another document
                rest = (run == len(start) - 1) & ~out
                more = (doc[rest], pos[rest])
                wait = more if wait is None else tuple(np.concatenate(x) for x in zip(wait, more, strict=True))
            state = (h[-1], g[-1], least[-1], many[-1])
            got = np.concatenate(got_doc)
            if len(got):
                yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(np.concatenate(got_pos))], schema=schema)

    return go


def repeated(occurrences: DataFrame, first_too: bool) -> DataFrame:
    """``doc_id, pos`` of the occurrences (``OCC``) whose key is in an earlier document too."""
    ship_package(occurrences.sparkSession)
    dealt = occurrences.repartition("h", "salt").sortWithinPartitions("h", "g", "doc_id")
    return dealt.mapInArrow(_flag(first_too), "doc_id long, pos long")


def _first_level(size: int, tagged: bool):
    part = (size + 1) // 2

    def run(rows):
        texts = rows.column("text").to_pylist()
        w = Words(texts)
        _, at, h = w.chosen(size, part)
        at = np.unique(at)
        if len(at):
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            d = w.doc[at]
            key = h[at].view(np.int64)
            yield _collapse(key, np.zeros_like(key), ids[d], _tags(texts, tagged)[d] | (at - w.first[d]), True)

    return run


def _second_level(size: int, tagged: bool):
    part = (size + 1) // 2

    def run(rows):
        texts = rows.column("text").to_pylist()
        w = Words(texts)
        start, at, h = w.chosen(size, part)
        if not len(start):
            return
        tags = _tags(texts, tagged)
        ids = rows.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        live = w.marked(rows.column("at").to_pylist(), tags)
        one = np.unique(at)
        live[one] = _alike(w.doc[one], h[one], np.zeros_like(h[one]), live[one])
        start = start[live[at]]
        if len(start):
            d = w.doc[start]
            yield _collapse(w.hashes(size, 2)[start].view(np.int64), w.hashes(size, 3)[start].view(np.int64), ids[d],
                            tags[d] | (start - w.first[d]), False)

    return run


def _tags(texts: list[bytes], tagged: bool) -> np.ndarray:
    return np.array([_tag(t) if tagged else 0 for t in texts], dtype=np.int64)


def gone_words(texts: list[bytes], at: list[list[int] | None], size: int, tagged: bool) -> list[np.ndarray]:
    """Of each text, which words lie in a passage of ``size`` words that is one of its
    repeated ones (``at`` has the first start of each)."""
    w = Words(texts)
    start = np.flatnonzero(w.inside(size))
    edge = np.zeros(len(w.doc) + 1, dtype=np.int64)
    if len(start):
        live = _alike(w.doc[start], w.hashes(size, 2)[start], w.hashes(size, 3)[start], w.marked(at, _tags(texts, tagged))[start])
        edge[start[live]] += 1
        np.add.at(edge, start[live] + size, -1)
    return np.split(np.cumsum(edge[:-1]) > 0, w.first[1:])


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, n_words, sha``: of all words, one space between (null: no words)."""
    def run(part):
        raw = part.column("text").to_pylist()
        words = [(x or b"").split() for x in raw]
        yield [part.column("doc_id"), [_tag(x or b"") for x in raw], [len(x) for x in words],
               [hashlib.sha256(b" ".join(x)).hexdigest() for x in words]]

    return map_text(_texts(docs), run, "doc_id long, tag long, n_words long, sha string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def shared_ids(marks: DataFrame) -> bool:
    """Whether some id has different texts (positions then carry a tag of the text)."""
    return not marks.groupBy("doc_id").agg(F.min("tag").alias("a"), F.max("tag").alias("b")).filter("a != b").isEmpty()


def repeated_starts(docs: DataFrame, whole: DataFrame, size: int, tagged: bool) -> DataFrame:
    """``doc_id, at``: the first start (tag | word position) of each passage of ``size``
    words that also starts in a document with a smaller id. ``whole`` (see ``copies``) are left out.

    Each level is stored, so that its shuffles are gone before the next begins: what lies on disk at one time is one level's
    windows and, where texts are joined to what is known of them, the texts once.
    An id and text that is in the table twice counts once; rows without an id take no part."""
    texts = _texts(docs).filter("doc_id is not null and text is not null")
    gone = whole.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"))
    own = texts.join(gone, (F.col("doc_id") == F.col("d")) & (_tag_column("text") == F.col("t")), "left_anti")
    first = map_text(own, _first_level(size, tagged), OCC)
    live = _stored_starts(repeated(first, True))
    held = texts.join(live.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d")).select("doc_id", "text", "at")
    second = map_text(held, _second_level(size, tagged), OCC)
    return _stored_starts(repeated(second, False))


def _stored_starts(found: DataFrame) -> DataFrame:
    return stored(found.groupBy("doc_id").agg(F.collect_set("pos").alias("at")), "substring-starts")


def copies(marks: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, tag`` of documents all of whose words (``size`` or more) are those
    of a document with a smaller id. The classes are cut off before the join back, so
    that Spark can split the rows of a text with very many copies."""
    long = marks.filter((F.col("n_words") >= size) & F.col("doc_id").isNotNull())
    least = long.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    return (long.join(cut(least).withColumnRenamed("sha", "s"), F.col("sha") == F.col("s"))
            .filter("doc_id > least").select("doc_id", "tag").distinct())


def dedup_digest(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_sha256``. A word goes if a
    passage of ``size`` words that covers it also starts in a document with a
    smaller id; passages are judged on the input. Null and empty texts have no
    words; a row without id loses nothing; repeated rows count as one document."""
    marks = stored(digests(docs), "substring-marks")
    tagged, whole = shared_ids(marks), cut(copies(marks, size))

    def run(part):
        out = []
        texts = part.column("text").to_pylist()
        for raw, gone in zip(texts, gone_words(texts, part.column("at").to_pylist(), size, tagged), strict=True):
            kept = [w for w, x in zip(raw.split(), gone, strict=True) if not x]
            out.append((_tag(raw), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield [part.column("doc_id"), *(list(c) for c in zip(*out, strict=True))]

    hit = repeated_starts(docs, whole, size, tagged).withColumnRenamed("doc_id", "d")
    texts = _texts(docs).filter("doc_id is not null")
    changed = map_text(texts.join(hit, F.col("doc_id") == F.col("d")).select("doc_id", "text", "at"), run,
                       "doc_id long, tag long, n_removed long, kept string").distinct()
    empty = hashlib.sha256(b"").hexdigest()
    gone = whole.withColumn("whole", F.lit(True))
    return marks.join(gone, ["doc_id", "tag"], "left").join(changed, ["doc_id", "tag"], "left").select(
        "doc_id", "n_words", F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), F.lit(empty)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def remove_repeated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text`` (kept stretches stay as
    written, one space where something was cut) and ``n_chars``, if there, set to
    match. Documents that keep no word of what they had are dropped; a text that
    loses nothing stays byte for byte."""
    marks = stored(digests(docs), "substring-marks")
    tagged, copied = shared_ids(marks), cut(copies(marks, size))
    hit = repeated_starts(docs, copied, size, tagged).select(F.col("doc_id").alias("__d"), F.col("at").alias("__at"))
    whole = copied.select(F.col("doc_id").alias("__c"), F.col("tag").alias("__t"))

    def run(part):
        import re

        out = part.column("text").to_pylist()
        at = part.column("__at").to_pylist()
        some = [i for i, x in enumerate(at) if x]
        for i, gone in zip(some, gone_words([out[i] for i in some], [at[i] for i in some], size, tagged) if some else [], strict=True):
            if not gone.any():
                continue
            raw = out[i]
            spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
            keep = np.flatnonzero(~gone)
            runs = np.split(keep, np.flatnonzero(np.diff(keep) > 1) + 1) if len(keep) else []
            out[i] = b" ".join(raw[spans[r[0]][0]:spans[r[-1]][1]] for r in runs) if runs else None
        yield [*(part.column(c) for c in rest), out, [len(raw.decode("utf-8", "replace")) if raw is not None else None for raw in out],
               [x is None and y is not None for x, y in zip(out, part.column("text").to_pylist(), strict=True)]]

    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    if marks.groupBy("doc_id").count().filter("count > 1").isEmpty():
        # one row an id: texts are shuffled once, all else is short
        short = docs.select(F.col("doc_id").cast("long").alias("__k"), *[F.col(c).alias(f"__c_{c}") for c in rest])
        short = short.join(whole, F.col("__k") == F.col("__c"), "left_anti").join(hit, F.col("__k") == F.col("__d"), "left")
        d = _texts(docs).filter("doc_id is not null").join(short, F.col("doc_id") == F.col("__k")).select(
            *[F.col(f"__c_{c}").alias(c) for c in rest], "text", "__at")
        lone = docs.filter("doc_id is null").select(*rest, F.col("text").cast("binary").alias("text"), F.lit(None).cast("array<long>").alias("__at"))
        d = d.unionByName(lone)
    else:
        tag = _tag_column(F.coalesce("text", F.lit("")).cast("binary"))
        d = docs.withColumn("__tag", tag).join(whole, (F.col("doc_id") == F.col("__c")) & (F.col("__tag") == F.col("__t")), "left_anti")
        d = d.join(hit, F.col("doc_id").cast("long") == F.col("__d"), "left").select(*rest, F.col("text").cast("binary").alias("text"), "__at")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    out = map_text(d, run, schema + ", text binary, __n long, __gone boolean").filter("not __gone")
    cols = {c: F.col(c) for c in rest} | {"text": F.col("text").cast("string").alias("text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.col("__n").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[cols[c] for c in docs.columns])


def longest_passages(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, longest``: the longest length ``size · 2^i`` at which a passage of
    the document also starts in one with a smaller id (copies: at least ``size``).

    Each level pairs the starts that are repeats at the last length and lie that
    length apart, and keeps those whose pair of keys is again in a smaller id. It
    takes both documents' windows, so it runs over all windows that repeat, and
    ends when none survive. Rows of one id and different texts are told apart by their tag."""
    texts = _texts(docs).filter("doc_id is not null and text is not null")

    def windows(rows):
        raw = rows.column("text").to_pylist()
        w = Words(raw)
        start = np.flatnonzero(w.inside(size))
        if len(start):
            tags = np.array([_tag(t) for t in raw], dtype=np.int64)
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            d = w.doc[start]
            yield [w.hashes(size, 2)[start].view(np.int64), w.hashes(size, 3)[start].view(np.int64), ids[d], tags[d], start - w.first[d]]

    level = map_text(texts, windows, "h long, g long, doc_id long, tag long, pos long")
    length, found = size, None
    while True:
        groups = level.groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
        groups = groups.select(F.col("h").alias("h2"), F.col("g").alias("g2"), "least")
        live = cut(level.join(groups, (F.col("h") == F.col("h2")) & (F.col("g") == F.col("g2"))).select("h", "g", "doc_id", "tag", "pos", "least"))
        got = live.filter("doc_id > least").select("doc_id").distinct().withColumn("longest", F.lit(length).cast("long"))
        if got.isEmpty():
            break
        found = got if found is None else found.union(got)
        right = live.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("doc_id").alias("d2"), F.col("tag").alias("t2"),
                            (F.col("pos") - length).alias("p2"))
        level = live.join(right, (F.col("doc_id") == F.col("d2")) & (F.col("tag") == F.col("t2")) & (F.col("pos") == F.col("p2"))).select(
            F.xxhash64("h", "g", "h2", "g2").alias("h"), F.xxhash64("g2", "h2", "g", "h").alias("g"), "doc_id", "tag", "pos")
        length *= 2
    if found is None:
        return texts.sparkSession.createDataFrame([], "doc_id long, longest long")
    return found.groupBy("doc_id").agg(F.max("longest").alias("longest"))
