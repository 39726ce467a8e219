"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into ``max_bits // 2 + 1`` blocks, so two fingerprints at
distance ``max_bits`` or less differ by one bit at most in some block. Anchors
of a block are the words of the perfect Hamming code on it (covering radius 1).
Every fingerprint is replicated to all anchors within radius 1 + 1 = 2 of its
block (16 of 2^26 for 31 bits); linked fingerprints then share the anchor
nearest to either, and are compared there on all 64 bits.
"""

from __future__ import annotations

from itertools import accumulate, chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from traitgrid.llm.common import map_text, stored
from traitgrid.llm.graph import components, stars
from traitgrid.session import ship_package

#: Members of one anchor that are compared in place; larger anchors are dealt to a finer code.
RUN = 256
PIECE = 1 << 16


def fingerprint(raw: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of a whole text (UTF-8): A-Z lower-cased, words without
    ASCII white space, space-joined shingles with repeats (fewer words: all of
    them), XXH64 seed 42; a bit is 1 if set in over half of the hashes. No word: 0."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = [x - 1 for x in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(x + 1 for x in ends[:-1])]
    ends = ends[shingle - 1:] or ends[-1:]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(ends), PIECE):
        h = np.array([xxh64_intdigest(line[s:e], 42) for s, e in zip(starts[i:i + PIECE], ends[i:i + PIECE])], dtype=">u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        # sums of bytes as bytes do not overflow over 255 rows; then add those up
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(ends)).tobytes(), "big", signed=True)


def text_hashes(text_col: str = "text") -> tuple[Column, Column]:
    """Two 64-bit hashes that, with the id, tell a row's text from others."""
    return F.xxhash64(text_col), F.xxhash64(F.lit(1), text_col)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, hashes: bool = False) -> DataFrame:
    """``doc_id, fp`` (long) of every row, with ``hashes`` also ``h, g`` (``text_hashes``);
    null and empty texts have fingerprint 0."""
    more = ["h", "g"] if hashes else []

    def run(part):
        yield [part.column("doc_id"), [fingerprint(x, shingle) for x in part.column("text").to_pylist()], *(part.column(c) for c in more)]

    own = [c.alias(n) for c, n in zip(text_hashes(text_col), more, strict=False)]
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *own)
    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(src, run, f"doc_id {kind}, fp long" + "".join(f", {c} long" for c in more))


def _array(values: list[int]) -> str:
    return f"array({','.join(f'{v}L' for v in values)})"


def anchors(fp: Column, max_bits: int) -> Column:
    """Array of ``(block, anchor)`` structs: every code word within radius 2 of the fingerprint's block."""
    blocks = max_bits // 2 + 1
    width = 64 // blocks
    r = (width + 1).bit_length() - 1
    length = 2**r - 1
    # by syndrome: the bit patterns of weight 1 and 2 that lead to a code word; position p is bit p - 1
    flips = [[0]] + [[1 << (s - 1)] + [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, length + 1) if i < i ^ s] for s in range(1, 2**r)]
    table = F.expr(f"array({','.join(_array(f) for f in flips)})")
    out = []
    for b in range(blocks):
        x = F.shiftrightunsigned(fp, b * width).bitwiseAND(F.lit((1 << length) - 1))
        syndrome: Column = F.lit(0)
        for k in range(r):
            odd = sum(1 << (p - 1) for p in range(1, length + 1) if p >> k & 1)
            syndrome = syndrome + F.bit_count(x.bitwiseAND(F.lit(odd))).bitwiseAND(F.lit(1)) * (1 << k)
        out.append(F.transform(F.element_at(table, syndrome + 1), _at(b, x)))
    return F.concat(*out)


def _at(block: int, x: Column):
    return lambda flip: F.struct(F.lit(block).alias("block"), x.bitwiseXOR(flip).alias("anchor"))


def _compare(max_bits: int, run: int):
    """Over batches sorted by (block, anchor, fp): the links found inside anchors,
    as stars, and ``(fp, null)`` for each member of an anchor with over ``run`` members."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def go(batches):
        left = [np.empty(0, np.int64)] * 3
        hot = None  # key of an anchor found too large, while its rows go on
        for batch in chain(_each(batches), [None]):
            block, anchor, fp = left if batch is None else (np.concatenate(x) for x in zip(left, batch, strict=True))
            if not len(fp):
                continue
            start = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(block) != 0)])
            size = np.diff(np.r_[start, len(fp)])
            key = np.repeat(np.arange(len(start)), size)
            big = size > run
            if hot is not None and (block[0], anchor[0]) == hot:
                big[0] = True
            whole = np.ones(len(start), dtype=bool)
            if batch is not None:
                whole[-1] = big[-1]  # the last anchor may go on in the next batch
            hot = (block[-1], anchor[-1]) if big[-1] else None
            out = fp[big[key]]
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(out), pa.nulls(len(out), pa.int64())], schema=schema)
            stay = ~whole[key]
            left = [x[stay] for x in (block, anchor, fp)]
            use = np.flatnonzero((whole & ~big)[key])
            i, step, found = use, 1, []
            while len(i := i[i + step < len(fp)]) and len(i := i[key[i] == key[i + step]]):
                near = i[np.bitwise_count((fp[i] ^ fp[i + step]).view(np.uint64)) <= max_bits]
                if len(near):
                    found.append((fp[near], fp[near + step]))
                step += 1
            if found:
                a, b = stars(*(np.concatenate(x) for x in zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    def _each(batches):
        for x in batches:
            yield [x.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]

    def lazily(batches):
        yield from go(batches)

    return lazily


def _finer(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links among members of overfull anchors, by the finest code (every 64-bit
    word, covering radius 0): words within half the distance of both. A group holds
    few words by construction, and those linked to its least are stars, not pairs."""
    inner, outer = max_bits // 2, (max_bits + 1) // 2
    flips = [sum(1 << i for i in c) for w in range(outer + 1) for c in combinations(range(64), w)]
    signed = [x - (1 << 64) if x >> 63 else x for x in flips]
    # -2^63 has no long literal
    text = ",".join("shiftleft(1L, 63)" if x == -(1 << 63) else f"{x}L" for x in signed)
    n_inner = sum(1 for x in flips if x.bit_count() <= inner)
    m = fps.select("fp", F.posexplode(F.expr(f"array({text})")).alias("k", "flip"))
    m = m.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("anchor"), (F.col("k") < n_inner).alias("inner"))
    least = m.groupBy("anchor").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1 and b is not null")
    return m.join(least.select(F.col("anchor").alias("at"), "b"), F.col("anchor") == F.col("at")).select(F.col("fp").alias("a"), "b").filter("a != b")


def links(fps: DataFrame, max_bits: int = 2, run: int = RUN) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``, no repeats)
    whose closure is that of all pairs at ``max_bits`` differing bits or fewer.
    Every link given is such a chain; pairs are not expanded."""
    members = fps.select("fp", F.explode(anchors(F.col("fp"), max_bits)).alias("m")).select("m.block", "m.anchor", "fp")
    ship_package(fps.sparkSession)
    dealt = members.select(F.col("block").cast("long"), "anchor", "fp").repartition("block", "anchor").sortWithinPartitions("block", "anchor", "fp")
    found = stored(dealt.mapInArrow(_compare(max_bits, run), "a long, b long"), "simhash-links")
    edges = found.filter("b is not null")
    hot = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    return edges if hot.isEmpty() else edges.union(_finer(hot, max_bits))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: the smallest id whose text is
    reachable over links of ``max_bits`` or fewer differing bits, its own included.

    Null and empty texts have fingerprint 0 and link to each other. Equal
    fingerprints are one node, so copies never meet as pairs; rows repeated keep
    one output row each; a null id is never a component's id unless there is no other."""
    marks = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    nodes = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = components(links(nodes.select("fp"), max_bits))
    labelled = nodes.join(parts, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("part"))
    owner = labelled.groupBy("part").agg(F.min("least").alias("component_id"))
    by_fp = labelled.join(owner.withColumnRenamed("part", "p"), F.col("part") == F.col("p")).select(F.col("fp").alias("f"), "component_id")
    return marks.join(by_fp, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def chosen(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2,
           apart: bool = False) -> DataFrame:
    """``doc_id, h, g, chosen`` for every row: true for the one row key (id and text) that
    stays of a component, the smallest id, then the smallest hashes (rows that repeat the
    key are all true). Null ids come after all others; with ``apart`` one row with a
    null id is chosen besides."""
    marks = stored(fingerprints(docs, id_col, text_col, shingle, hashes=True), "simhash-fp")
    key = F.struct("doc_id", "h", "g")
    picks = [F.min(F.when(F.col("doc_id").isNotNull(), key)).alias("named"), F.min(F.when(F.col("doc_id").isNull(), key)).alias("unnamed")]
    nodes = marks.groupBy("fp").agg(*picks)
    parts = components(links(nodes.select("fp"), max_bits))
    labelled = nodes.join(parts, F.col("fp") == F.col("node"), "left").select(
        "fp", "named", "unnamed", F.coalesce("component", "fp").alias("part"))
    least = labelled.groupBy(F.col("part").alias("p")).agg(F.min("named").alias("named"), F.min("unnamed").alias("unnamed"))
    if not apart:
        least = least.withColumn("unnamed", F.when(F.col("named").isNull(), F.col("unnamed")))
    by_fp = labelled.select(F.col("fp").alias("f"), "part").join(least, F.col("part") == F.col("p")).select("f", "named", "unnamed")
    hit = key.eqNullSafe(F.col("named")) | key.eqNullSafe(F.col("unnamed"))
    return marks.join(by_fp, F.col("fp") == F.col("f")).select("doc_id", "h", "g", hit.alias("chosen"))
