"""Scale-up check: time core operators on k copies of the sf0.1 line items.

Copies shift the order and part keys (so groups stay distinct and the key
grows with the data) and are written as many files to the shared scratch
folder, so scans run in parallel. Prints one JSON line per size.
Usage: python tools/scaleup.py [k=10] [sf_dir=/root/testdata/sf0.1]
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from traitgrid.operators import collect, scoring, training  # noqa: E402
from traitgrid.plans import fixtures as fx  # noqa: E402
from traitgrid.plans.queries import REWARDS  # noqa: E402
from traitgrid.session import build_session, shared_path  # noqa: E402


def copies(spark, sf_dir: str, k: int, name: str, shifts: dict[str, int]) -> str:
    t = fx.table(spark, sf_dir, name)
    c = t.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("__copy"))
    for col, step in shifts.items():
        c = c.withColumn(col, F.col(col) + F.col("__copy").cast("long") * F.lit(step))
    out = shared_path(spark, f"scale-{name}-{k}")
    c.drop("__copy").repartition(8 * k).write.parquet(out)
    return out


def shuffle_records(log_dir: str, description: str) -> int:
    """Shuffle records written by the jobs with this description (from the event log)."""
    stages, written = set(), 0
    events = []
    for base, _dirs, files in os.walk(log_dir):  # rolling logs: a folder of parts
        for name in sorted(files):
            if name.startswith(("events", "eventlog", "app", "local")) and not name.endswith(".inprogress"):
                with open(os.path.join(base, name)) as f:
                    events += [json.loads(line) for line in f if line.startswith("{")]
    if events:
        for e in events:
            if e.get("Event") == "SparkListenerJobStart" and \
                    (e.get("Properties") or {}).get("spark.job.description") == description:
                stages.update(e.get("Stage IDs", []))
        for e in events:
            if e.get("Event") == "SparkListenerTaskEnd" and e.get("Stage ID") in stages:
                m = (e.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                written += m.get("Shuffle Records Written", 0)
    return written


def run(spark, li_path: str, part_path: str, ev_path: str) -> dict[str, float]:
    li, part, ev = spark.read.parquet(li_path), spark.read.parquet(part_path), spark.read.parquet(ev_path)
    resp = li.select(F.col("l_returnflag").alias("model"), (F.lit(1) + F.col("l_suppkey") % 9).cast("int").alias("value"),
                     F.col("l_partkey").alias("item_id"),
                     F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber").cast("string")).otherwise(F.lit("N/A")).alias("rating_text"))
    k = F.col("p_partkey")
    key = part.select(k.alias("item_id"), F.element_at(F.array(*[F.lit(t) for t in fx.TRAITS]), (k % 5).cast("int") + 1).alias("trait"),
                      F.when(k % 11 == 0, 0.0).when(k % 2 == 0, 1.0).otherwise(-1.0).alias("weight"))
    att = ev.select(F.col("user_id").alias("item_id"), "ts", F.col("event_id").alias("call_id"),
                    F.col("props").alias("response_text"), F.col("value").alias("elapsed_s"))
    comp = li.select(F.col("l_orderkey").alias("prompt_id"), F.col("l_linenumber").cast("string").alias("completion"))
    jobs = {
        "trait_scores": lambda: scoring.trait_scores(resp, key, ["model", "value"]),
        "resolve_attempts": lambda: collect.resolve_attempts(att, ["item_id"], ["ts", "call_id"]),
        "group_advantage": lambda: training.group_advantage(training.score_completions(comp, REWARDS), "prompt_id"),
    }
    out = {}
    for name, job in jobs.items():
        spark.sparkContext.setJobDescription(f"{name}@{li_path}")
        t0 = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        out[name] = round(time.perf_counter() - t0, 2)
    spark.sparkContext.setJobDescription(None)
    out["rows_lineitem"] = li.count()
    out["rows_events"] = ev.count()
    return out


def main() -> None:
    k = int(sys.argv[1]) if len(sys.argv) > 1 else 10
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="traitgrid-eventlog-")  # local scratch for this measurement only
    spark = build_session("local[8]", 64, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                                       "spark.eventLog.compress": "false"})
    results = []
    for n in (1, k):
        li = copies(spark, sf_dir, n, "lineitem", {"l_orderkey": 10**9, "l_partkey": 10**8})
        part = copies(spark, sf_dir, n, "part", {"p_partkey": 10**8})
        ev = copies(spark, sf_dir, n, "events", {"event_id": 10**9})  # same users: hot keys grow
        run(spark, li, part, ev)  # warm-up
        results.append((n, li, run(spark, li, part, ev)))
    spark.stop()  # flushes the event log
    for n, li, r in results:
        for job in ("trait_scores", "resolve_attempts", "group_advantage"):  # each ran twice (warm-up)
            r[f"{job}_shuffled_rows"] = shuffle_records(log_dir, f"{job}@{li}") // 2
        print(json.dumps({"copies": n, **r}), flush=True)


if __name__ == "__main__":
    main()
