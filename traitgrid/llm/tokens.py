"""Exact token counts by a two-tier map-side lookup.

A text is cut where no merge can cross (before each run of spaces), so its
count is the sum of its pieces' counts. Frequent pieces are looked up in a
broadcast table of lengths; the rest are encoded once per worker and kept in a
bounded cache. No piece is shuffled with its text: to build the table, each task keeps one
bounded sketch of its frequent pieces over all its texts, and only these sketches
(``PROPOSED`` rows a task) are added up.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitgrid.llm.common import map_text, slices
from traitgrid.session import ship_package

#: Entries of the broadcast table and characters of a key: together they bound the broadcast (16 MB at
#: most). Entries a task may propose, and holds while it reads.
TABLE = 65_536
PROPOSED = 16_384
SKETCH = 131_072
KEY = 64
CACHE = 200_000
PIECE = re.compile(" *[^ ]+| +")
_models: dict = {}


def model(path: str):
    """The SentencePiece model, loaded once per process; only models whose pieces
    never span a space after other characters can be cut before spaces."""
    if path not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        if any("▁" in p.lstrip("▁") for p in pieces) or sp.encode("") or sp.encode(" ", out_type=str) != ["▁▁"]:
            raise ValueError("this model's pieces or white-space rules do not allow the cut before spaces")
        _models[path] = sp
    return _models[path]


def pieces(text: str) -> list[str]:
    """The text as the model sees it (one space put before it, U+2581 is a space),
    cut before each run of spaces; no piece for an empty text."""
    return PIECE.findall(" " + text.replace("▁", " ")) if text else []


def encode_lengths(path: str, keys: list[str]) -> list[int]:
    """Tokens of each piece: the library puts back the one space taken off. A piece
    of one space alone has nothing left to encode and is one token."""
    return [len(x) if k != " " else 1 for k, x in zip(keys, model(path).encode([k[1:] for k in keys], num_threads=1), strict=True)]


class Sketch:
    """Counts of at most about ``size`` frequent keys: when there are twice as many, the rarer half is dropped, and what
    was dropped last is the most that a count may be too low by."""

    def __init__(self, size: int):
        self.size, self.seen, self.low = size, Counter(), 0

    def add(self, keys: list[str]) -> None:
        self.seen.update(k for k in keys if len(k) <= KEY)
        if len(self.seen) > 2 * self.size:
            kept = self.seen.most_common(self.size + 1)
            self.low = max(self.low, kept.pop()[1])
            self.seen = Counter(dict(kept))

    def top(self, n: int) -> list[tuple[str, int]]:
        return [(k, c) for k, c in self.seen.most_common(n) if c > 1]


def frequent_lengths(docs: DataFrame, path: str, size: int = TABLE) -> dict[str, int]:
    """Token counts of the corpus' most frequent pieces. Each task proposes those most frequent in all its texts
    (``Sketch``), added up by Spark; the table decides
    speed only, so approximate frequencies do."""
    schema = pa.schema([("piece", pa.string()), ("n", pa.int64())])

    def propose(batches):
        seen = Sketch(SKETCH)
        for part in slices(batches, "text"):
            for x in part.column("text").to_pylist():
                seen.add(pieces(x))
        got = seen.top(PROPOSED)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema)

    ship_package(docs.sparkSession)
    found = docs.select("text").filter("text is not null").mapInArrow(propose, "piece string, n long")
    rows = found.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "piece").limit(size).collect()
    keys = [r["piece"] for r in rows]
    return dict(zip(keys, encode_lengths(path, keys), strict=True)) if keys else {}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = TABLE) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row's whole text, exactly as the
    library counts them without begin or end tokens. Null: empty, 0 and 0.

    Pieces over ``KEY`` characters are encoded but not kept; the cache is emptied
    at ``CACHE`` entries, so a worker's memory is bounded."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = src.sparkSession.sparkContext.broadcast(frequent_lengths(src, path, size))

    def run(part):
        known, cache = table.value, _cache(path)
        texts = [pieces(x or "") for x in part.column("text").to_pylist()]
        new = list({p for t in texts for p in t if p not in known and p not in cache})
        length = dict(zip(new, encode_lengths(path, new), strict=True)) if new else {}
        if len(cache) + len(new) > CACHE:
            length |= {p: cache[p] for t in texts for p in t if p in cache}
            cache.clear()
        totals = []
        for t in texts:
            n = 0
            for p, k in Counter(t).items():
                n += k * (known.get(p) or cache.get(p) or length[p])
            totals.append(n)
        cache.update((p, n) for p, n in length.items() if len(p) <= KEY and len(cache) < CACHE)
        yield [part.column("doc_id"), part.column("n_bytes"), totals]

    src = src.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return map_text(src, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")


def _cache(path: str, caches: dict = {}) -> dict[str, int]:  # noqa: B006  one per worker process
    return caches.setdefault(path, {})
