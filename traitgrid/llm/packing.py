"""Packing documents into fixed-length sequences: first-fit decreasing by a
tournament tree of bin capacities, independently in randomised groups."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitgrid.llm.common import map_text, stored
from traitgrid.session import ship_package

LENGTH = 4096
END = 2
#: Pieces a group has on average: the memory of one packing task.
GROUP = 16_384
#: Words of a worker's cache, bytes of one, and words encoded as one text.
CACHE = 500_000
KEY = 64
JOINED = 2_000
LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_models: dict = {}


def _tokenizer(path: str):
    """The tokenizer, which of its ids end a word, and this worker's cache."""
    if path not in _models:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        ends = np.zeros(t.get_vocab_size() + 1, dtype=bool)
        ends[[i for w, i in t.get_vocab().items() if w.endswith("</w>")]] = True
        _models[path] = (t, ends, {})
    return _models[path]


def _encode_words(words: list[bytes], tokenizer, ends: np.ndarray) -> dict[bytes, bytes]:
    """Ids of distinct words. Words of letters only are one pre-token each, so many are
    encoded as one text and told apart by the ids that end a word; if a text
    has more ends than words, and for all other words, each is encoded alone."""
    out: dict[bytes, bytes] = {}
    text = [w.decode("utf-8", "replace") for w in words]
    plain = [i for i, x in enumerate(text) if x.isalpha()]
    alone = [i for i, x in enumerate(text) if not x.isalpha()]
    chunks = [plain[i:i + JOINED] for i in range(0, len(plain), JOINED)]
    for chunk, e in zip(chunks, tokenizer.encode_batch_fast([" ".join([text[i] for i in c]) for c in chunks], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, dtype="<u4")
        at = np.flatnonzero(ends[ids]) + 1
        if len(at) != len(chunk):
            alone += chunk
            continue
        raw, at = ids.tobytes(), (4 * at).tolist()
        out.update((words[i], raw[s:t]) for i, s, t in zip(chunk, [0, *at[:-1]], at, strict=True))
    for i, e in zip(alone, tokenizer.encode_batch_fast([text[i] for i in alone], add_special_tokens=False), strict=True):
        out[words[i]] = np.array(e.ids, dtype="<u4").tobytes()
    return out


def encode_ids(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Ids of each whole text as little-endian unsigned 32-bit integers.

    The tokenizer lower-cases and turns white space into a separator that no token
    holds, so a text's ids are those of its lower-cased words one after the other (special
    tokens' strings are told by case: texts with their opening are left as written). A
    full stop or comma after an ASCII letter ends a word's first pre-token. Words are kept in a
    bounded cache; once it is full, new ones are encoded once per slice of texts."""
    tokenizer, ends, cache = _tokenizer(path)
    words = [(x if b"<|" in x else x.lower()).split() for x in texts]
    new = {w for t in words for w in t}.difference(cache)
    halves = {w: (w[:-1], w[-1:]) for w in new if w[-1] in b".," and len(w) > 1 and w[-2] in LETTERS}
    base = {x for pair in halves.values() for x in pair}.union(new.difference(halves)).difference(cache)
    ids = _encode_words(list(base), tokenizer, ends)
    for w, x in ids.items():
        if len(cache) >= CACHE:
            break
        if len(w) <= KEY:
            cache[w] = x
    for w, (x, y) in halves.items():
        ids[w] = (cache[x] if x in cache else ids[x]) + (cache[y] if y in cache else ids[y])
    for t in words:
        yield b"".join([cache[w] if w in cache else ids[w] for w in t])


def cut_pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Each document's ids and ``end``, cut into pieces of ``length`` (the last is
    shorter): ``doc_id, start, length, ids_crc32, doc_tokens``."""
    tail = np.array([end], dtype="<u4").tobytes()

    def run(part):
        at: list[int] = []
        rows: list[tuple[int, int, int, int]] = []
        for i, x in enumerate(encode_ids([t or b"" for t in part.column("text").to_pylist()], path)):
            x += tail
            n = len(x) // 4
            for s in range(0, n, length):
                rows.append((s, min(length, n - s), zlib.crc32(x[4 * s:4 * (s + length)]), n))
                at.append(i)
        yield [part.column("doc_id").take(at_array(at)), *(list(c) for c in zip(*rows, strict=True))]

    def at_array(at):
        import pyarrow as pa

        return pa.array(at, type=pa.int64())

    src = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_text(src, run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, longest items first, each into the first bin with
    room. A tournament tree holds the most room under each node, so the leftmost
    bin that fits is found in a walk from the root: O(n log n)."""
    leaves = 1 << max(0, (len(sizes) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k, need = 1, sizes[i]
        while k < leaves:
            k *= 2
            if room[k] < need:
                k += 1
        out[i] = k - leaves
        room[k] -= need
        while k > 1:
            k //= 2
            most = max(room[2 * k], room[2 * k + 1])
            if room[k] == most:
                break
            room[k] = most
    return out


def pack(pieces: DataFrame, capacity: int = LENGTH, group: int = GROUP, seed: int = 11) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to
    ``capacity``. Rows go to groups at random (not by any key, so no hot key can
    fill a group); the number of groups follows the number of rows."""
    ship_package(pieces.sparkSession)
    dealt = stored(pieces.withColumn("__u", F.rand(seed)), "packing-pieces")
    n = max(1, -(-dealt.count() // group))
    schema = pieces.schema.simpleString()[7:-1].replace(":", " ")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "__u"], ascending=[False, True], kind="stable", ignore_index=True)
        bins = np.array(first_fit_decreasing(pdf["length"].tolist(), capacity), dtype=np.int64)
        order = np.argsort(bins, kind="stable")
        pdf, bins = pdf.iloc[order], bins[order]
        size = pdf["length"].to_numpy()
        before = np.cumsum(size) - size
        first = np.r_[True, np.diff(bins) != 0]
        offset = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(bins)]))
        return pdf.assign(sequence_id=pdf["__g"].to_numpy() * (1 << 32) + bins, offset=offset).drop(columns=["__g", "__u"])

    grouped = dealt.withColumn("__g", F.floor(F.col("__u") * n).cast("long"))
    return grouped.groupBy("__g").applyInPandas(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = LENGTH, end: int = END, group: int = GROUP) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``. Null and empty texts are one piece of the end id alone;
    repeated rows are packed each; no document is shortened."""
    return pack(cut_pieces(docs, path, capacity, end), capacity, group)
