"""A Merkle manifest of a table: checkpoint and recompute.

Every row is a leaf; the leaves of a partition form a tree with ``FANOUT`` children a
node, and the partitions' roots form one more tree of the same kind. Only every
``STRIDE``-th level is stored. A proof needs the siblings on the levels between, too:
each aligned subtree regenerates them from its stored descendants (at most
``FANOUT ** STRIDE`` of them), emits the siblings and drops them again. Proofs of inner
nodes are handed down, so what the subtrees above have found is found once.

All of it is built-in functions; digests are lowercase hex text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitgrid.llm.common import cut, stored
from traitgrid.operators.numbering import numbered

FANOUT = 8
STRIDE = 2
_PATH = "array<struct<left:string,right:string>>"


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def field(c: str | Column) -> Column:
    """``-`` if null, else the value's UTF-8 byte count, ``:`` and the value."""
    v = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf(columns: list[str | Column]) -> Column:
    return digest(F.concat(*[field(c) for c in columns]))


def folded(nodes: Column) -> Column:
    """The level above an array of digests: every ``FANOUT`` of them (the last: fewer) hashed as one."""
    runs = F.ceil(F.size(nodes) / FANOUT).cast("int")
    return F.transform(F.sequence(F.lit(1), runs), lambda i: digest(F.array_join(F.slice(nodes, (i - 1) * FANOUT + 1, FANOUT), "")))


def levels_above(n: Column) -> Column:
    """Levels up to the next stored one (or the root), over ``n`` nodes of a tree."""
    out = F.lit(STRIDE)
    for k in reversed(range(STRIDE)):
        out = F.when(n <= FANOUT**k, F.lit(k)).otherwise(out)
    return out


def _subtrees(nodes: DataFrame, carry: list[str] = ()) -> DataFrame:
    """``tree, n, at, up, s`` and the levels ``l0`` (stored) to ``l<STRIDE>`` of each aligned subtree;
    ``s`` has its stored nodes in order. Levels above a tree's root repeat the root."""
    size = FANOUT**STRIDE
    out = (nodes.groupBy("tree", "n", F.floor(F.col("pos") / size).alias("at"))
           .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", *carry))).alias("s"))
           .withColumns({"up": levels_above(F.col("n")), "l0": F.transform("s", lambda x: x["digest"])}))
    for k in range(1, STRIDE + 1):
        out = out.withColumn(f"l{k}", F.when(F.col("up") >= k, folded(F.col(f"l{k - 1}"))).otherwise(F.col(f"l{k - 1}")))
    return out


def build(leaves: DataFrame) -> list[DataFrame]:
    """The stored levels ``tree, n, pos, digest`` (0, ``STRIDE``, 2 ``STRIDE`` …), of leaves of
    the same columns (``n``: nodes of the tree on this level). The last one holds the roots."""
    out = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        above = _subtrees(out[-1]).select("tree", F.ceil(F.col("n") / FANOUT**STRIDE).cast("long").alias("n"),
                                          F.col("at").alias("pos"), F.col(f"l{STRIDE}")[0].alias("digest"))
        out.append(cut(above))
        most = -(-most // FANOUT**STRIDE)
    return out


def _paths(level: DataFrame, above: DataFrame | None, carry: list[str]) -> DataFrame:
    """``tree, pos, digest, path`` (and ``carry``) of a stored level's nodes: the siblings (left of
    the node and right of it, joined) on each level from here to the root. ``above``: ``tree,
    pos, path`` of the next stored level."""
    subs = _subtrees(level, carry)
    if above is None:
        subs = subs.withColumn("rest", F.array().cast(_PATH))
    else:
        a = above.select(F.col("tree").alias("t"), F.col("pos").alias("p"), F.col("path").alias("rest"))
        subs = subs.join(a, F.col("tree").eqNullSafe(F.col("t")) & (F.col("at") == F.col("p")))

    def siblings(k: int) -> Column:
        nodes, i = F.col(f"l{k}"), F.floor(F.col("i") / FANOUT**k).cast("int")
        first = F.floor(i / FANOUT).cast("int") * FANOUT
        left = F.array_join(F.slice(nodes, first + 1, i - first), "")
        right = F.array_join(F.slice(nodes, i + 2, first + FANOUT - 1 - i), "")
        one = F.array(F.struct(left.alias("left"), right.alias("right")))
        return F.when(F.col("up") > k, one).otherwise(F.array().cast(_PATH))

    nodes = subs.select("*", F.posexplode("s").alias("i", "x"))
    path = F.concat(*[siblings(k) for k in range(STRIDE)], "rest")
    return nodes.select("tree", *[F.col("x")[c].alias(c) for c in ("pos", "digest", *carry)], path.alias("path"))


def proofs(levels: list[DataFrame], above: DataFrame | None = None, carry: list[str] = ()) -> DataFrame:
    """``tree, pos, digest, path`` (and ``carry``, columns of the leaves) of the leaves of ``build``'s
    levels; ``above`` (``tree, path``) goes on from each tree's root. Inner paths are written
    level by level, from the root down; those of the leaves are not stored or moved."""
    found = None if above is None else above.select("tree", F.lit(0).cast("long").alias("pos"), "path")
    for k in range(max(0, len(levels) - 2), -1, -1):
        found = _paths(levels[k], found, [] if k else list(carry))
        if k:
            found = cut(found)
    return found


def climb(value: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, value, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def manifest(docs: DataFrame, columns: list[str] | None = None, tree_col: str = "lang", id_col: str = "doc_id",
             altered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    A leaf is the digest of ``columns``; one tree for each value of ``tree_col`` (null is a
    value), its leaves in the order of ``id_col`` (nulls first; rows of one id by leaf), the
    trees' roots in byte order (null first) under ``root``. ``proof_sha256`` is the digest of the leaf's
    siblings, joined from the leaf up to the root, left to right. ``folded_root`` climbs from the leaf
    as it is now to the root: ``altered`` replaces columns in rows where ``where`` holds (null:
    does not hold), so that ``verified`` tells whether the manifest notices.

    Nulls in any column are part of a leaf; empty and very long texts are values like others (texts are
    hashed in place and never shuffled); repeated rows are leaves of their own; an empty table
    has no rows and no root; extra columns take no part."""
    columns = columns or ["doc_id", "source", "lang", "n_chars", "text"]
    now = [(altered or {}).get(c, F.col(c)) for c in columns]
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(False)
    hashed = docs.select(F.col(id_col).alias("id"), F.col(tree_col).alias("tree"), leaf(columns).alias("digest"),
                         F.when(hit, leaf(now)).alias("now"))
    leaves = numbered(stored(hashed, "merkle-hashes"), ["tree"], ["id", "digest"])
    n = cut(leaves.groupBy(F.col("tree").alias("t")).agg(F.count(F.lit(1)).alias("n")))
    leaves = stored(leaves.join(n, F.col("tree").eqNullSafe(F.col("t"))).drop("t"), "merkle-leaves")

    inner = build(leaves)
    subroots = cut(numbered(inner[-1].select("tree", "digest"), [], ["tree"]))
    outer = build(subroots.select(F.lit(0).alias("tree"), F.lit(subroots.count()).alias("n"), "pos", "digest", F.col("tree").alias("of")))
    root = outer[-1].select("digest").first()
    root = F.lit(root["digest"] if root else None)
    over = cut(proofs(outer, carry=["of"]).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "path"))

    found = proofs(inner, over.select("tree", "path"), carry=["id", "now"])
    proof = digest(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), ""))
    found = found.select("tree", "id", F.col("digest").alias("leaf"), proof.alias("proof_sha256"),
                         climb(F.coalesce("now", "digest"), F.col("path")).alias("folded_root"))
    sub = over.select(F.col("tree").alias("t"), "subroot")
    out = found.join(sub, F.col("tree").eqNullSafe(F.col("t")))
    return (out.select(F.col("id").alias(id_col), "leaf", "subroot", root.cast("string").alias("root"), "proof_sha256", "folded_root")
            .withColumn("verified", F.col("folded_root") == F.col("root")))
