"""Sharding by balanced label propagation. DataFrame operations only.

Documents of one group (equal texts) are linked. Every linked document starts in
some shard, dealt out evenly; round by round, documents propose to move to the
shard that holds most of their neighbours, and moves are granted under capacity
quotas (largest gain first): as many as go the other way between two shards,
and as many more as the target has room for. Documents of a group in one shard are
alike, so the state is one counted row per group and shard, however large a
group is; unlinked documents fill what is left. Counts end at most one apart.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitgrid.llm.common import cut, running, stored

SHARDS = 24
ROUNDS = 12
BUCKETS = 256
#: Rows without a neighbour are numbered in buckets of about so many.
BUCKET_ROWS = 50_000


def _quota(rows: int, shards: int):
    s = F.col("shard")
    return F.lit(rows // shards).cast("long") + F.when(s < rows % shards, 1).otherwise(0)


def _start(groups: DataFrame, shards: int) -> DataFrame:
    """Linked documents are numbered group after group and dealt out in turn:
    ``hub, shard, cnt`` follow from a group's first number and size."""
    placed = running(groups, [], [F.pmod(F.xxhash64("hub"), F.lit(BUCKETS))], [F.col("hub")], F.col("n"))
    s = placed.select("hub", "n", "before", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    cnt = F.expr(f"(before + n - 1 - shard + {shards}) div {shards} - (before - 1 - shard + {shards}) div {shards}")
    return s.select("hub", "shard", cnt.alias("cnt")).filter("cnt > 0")


def _round(state: DataFrame, rows: int, shards: int, open_only: bool) -> DataFrame:
    """One round of proposals and granted moves. ``open_only``: shards without room
    are no targets, so groups that found their first choice full turn elsewhere."""
    load = state.groupBy(F.col("shard").alias("s")).agg(F.sum("cnt").alias("load"))
    room = (state.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
            .join(load, F.col("shard") == F.col("s"), "left")
            .select("shard", (_quota(rows, shards) - F.coalesce("load", F.lit(0))).alias("room")))
    room = cut(room.coalesce(1))  # one row per shard
    near = state.join(F.broadcast(room), "shard")
    can = (F.col("room") > 0) if open_only else F.lit(True)
    rank = F.struct("cnt", F.xxhash64("hub", "shard").alias("tie"), "shard")
    hub = Window.partitionBy("hub")  # at most one row per shard
    best = near.withColumn("rank", rank).withColumn("best", F.max(F.when(can, F.col("rank"))).over(hub))
    asks = cut(best.filter(F.col("best").isNotNull() & (F.col("rank") < F.col("best"))).select(
        "hub", F.col("shard").alias("src"), F.col("best.shard").alias("dst"), F.col("cnt").alias("amount"),
        (F.col("best.cnt") - F.col("cnt")).alias("gain")))
    # at most shards x shards rows from here to `allowed`
    c = asks.groupBy("src", "dst").agg(F.sum("amount").alias("c"))
    back = c.select(F.col("src").alias("d2"), F.col("dst").alias("s2"), F.col("c").alias("c2"))
    flow = (c.join(back, (F.col("src") == F.col("s2")) & (F.col("dst") == F.col("d2")), "left")
            .withColumn("swap", F.least("c", F.coalesce("c2", F.lit(0)))).withColumn("rest", F.col("c") - F.col("swap"))
            .join(F.broadcast(room.withColumnRenamed("shard", "dst")), "dst"))
    prior = F.sum("rest").over(Window.partitionBy("dst").orderBy("src")) - F.col("rest")
    allowed = flow.select(F.col("src").alias("s3"), F.col("dst").alias("d3"),
                          (F.col("swap") + F.greatest(F.lit(0), F.least("rest", F.col("room") - prior))).alias("allowed"))
    level = -F.floor(F.log2(F.col("gain") + 1)).cast("int")
    asked = running(asks, ["src", "dst"], [level, F.pmod(F.xxhash64("hub"), F.lit(32))], [F.col("gain").desc(), F.col("hub")], F.col("amount"))
    granted = (asked.join(F.broadcast(allowed), (F.col("src") == F.col("s3")) & (F.col("dst") == F.col("d3")))
               .withColumn("moved", F.least("amount", F.col("allowed") - F.col("before"))).filter("moved > 0"))
    change = granted.select("hub", F.explode(F.array(
        F.struct(F.col("src").alias("shard"), (-F.col("moved")).alias("cnt")),
        F.struct(F.col("dst").alias("shard"), F.col("moved").alias("cnt")))).alias("c")).select("hub", "c.shard", "c.cnt")
    return state.union(change).groupBy("hub", "shard").agg(F.sum("cnt").alias("cnt")).filter("cnt > 0")


def propagate(groups: DataFrame, rows: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``hub, shard, cnt``: how many documents of each group (``hub, n``, n of 2 or
    more) each shard takes. Stops when neither kind of round brings more of a
    group together; after ``rounds`` it warns that groups may still be coming together, with the links it leaves cut."""
    state, value, idle = cut(_start(groups, shards)), None, 0
    for t in range(rounds):
        now = state.agg(F.sum(F.col("cnt").cast("decimal(38,0)") * F.col("cnt"))).first()[0]
        idle = idle + 1 if now == value else 0
        if now is None or idle == 2:
            return state
        value = now
        state = cut(_round(state, rows, shards, t % 2 == 1))
    warnings.warn(f"sharding had not settled after {rounds} rounds: {cut_links(state).first()['cut']} links lie between shards", stacklevel=2)
    return state


def cut_links(state: DataFrame) -> DataFrame:
    """One row ``links, cut``: pairs of documents of one group, and those of them in different shards (exact)."""
    d = F.col("cnt").cast("decimal(38,0)")
    groups = state.groupBy("hub").agg(F.sum(d).alias("n"), F.sum(d * (d - 1)).alias("together"))
    n = F.col("n").cast("decimal(19,0)")
    whole = F.coalesce(F.sum(n * (n - 1)), F.lit(0))
    return groups.agg((whole / 2).cast("decimal(38,0)").alias("links"), ((whole - F.coalesce(F.sum("together"), F.lit(0))) / 2).cast("decimal(38,0)").alias("cut"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Every row gets ``shard`` and ``slot`` (gapless in its shard): ``doc_id, size,
    text_crc32, law, shard, slot, grown_shard``. Law ``rows``: counts of shards are at
    most one apart. Documents with equal texts share a shard as far as its
    capacity allows. A null text has size 8, crc32 0 and no neighbours; an empty
    text is a text like any other; repeated rows are placed each."""
    rows = stored(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("hub"), F.xxhash64("doc_id", "text").alias("u")), "sharding-rows")
    n = rows.count()
    groups = cut(rows.filter("hub is not null").groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    state = propagate(groups, n, shards, rounds)
    spread = running(state, ["shard"], [F.pmod(F.xxhash64("hub"), F.lit(BUCKETS))], [F.col("hub")], F.col("cnt"))
    start = F.sum("cnt").over(Window.partitionBy("hub").orderBy("shard")) - F.col("cnt")  # at most one row per shard
    # a table of its own: Spark can then split the rows of a text that very many documents have
    plan = cut(spread.withColumn("start", start).groupBy(F.col("hub").alias("h"))
            .agg(F.sort_array(F.collect_list(F.struct("start", F.col("shard").cast("int").alias("shard"), F.col("before").alias("base")))).alias("plan")))
    load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("cnt").alias("n")).collect()}  # one row per shard
    free, at = [], 0
    for j in range(shards):
        has, quota = load.get(j, 0), n // shards + (j < n % shards)
        if quota > has:
            free.append(f"named_struct('start', {at}L, 'shard', {j}, 'base', {has}L)")
            at += quota - has
    rest = F.expr(f"array({', '.join(free)})") if free else F.lit(None)
    joined = rows.join(plan, F.col("hub") == F.col("h"), "left").withColumn("grp", F.col("h"))
    buckets = max(BUCKETS, n // BUCKET_ROWS)
    placed = running(joined, ["grp"], [F.pmod(F.xxhash64("u"), F.lit(buckets))], [F.col("u"), F.col("doc_id")], F.lit(1).cast("long"))
    placed = placed.withColumn("p", F.element_at(F.filter(F.coalesce("plan", rest), lambda x: x["start"] <= F.col("before")), -1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("p.shard").alias("shard"),
                         (F.col("p.base") + F.col("before") - F.col("p.start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
