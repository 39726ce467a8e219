"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores the measurements
and one long of failure bits. Policies (named, versioned sets of rules) are
masks over those bits, so verdicts and ablations never read a text again:
``verdicts`` is one bitwise AND, ``ablation`` aggregates by distinct bitmask.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitgrid.llm.common import map_text, stored

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_bangs"]


@dataclass(frozen=True)
class Rule:
    """A failed rule sets ``1 << bit``. ``fails`` is a SQL condition on the measurements (integers only)."""
    name: str
    bit: int
    fails: str


RULES = [
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > 2 * n_words"),
    Rule("repeated_lines", 3, "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", 4, "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("capitals", 5, "2 * n_upper > n_letters AND n_letters > 0"),
    Rule("bangs", 6, "10 * n_bangs > 3 * n_words"),
    Rule("few_letters", 7, "2 * n_letters < word_chars"),
]
BASE = ["few_words", "repeated_windows"]
#: Versioned policies: a document is kept if none of the policy's rules failed.
POLICIES = {
    "base-v1": BASE,
    "standard-v1": [r.name for r in RULES],
    "no-case-v2": [r.name for r in RULES if r.name not in ("capitals", "bangs")],
}


def mask(names: list[str], rules: list[Rule] = RULES) -> int:
    by = {r.name: 1 << r.bit for r in rules}
    return sum(by[n] for n in set(names))


def repeat_words(words: list[bytes], size: int = WINDOW) -> int:
    """How many words lie in a ``size``-word window (a power of two) that occurs
    at least twice. Exact: windows get ranks by doubling (the rank of 2k words
    is that of a pair of ranks of k words), no hashing."""
    if len(words) < size + 1:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    k = 1
    while k < size:
        pair = rank[:-k] * (int(rank.max()) + 1) + rank[k:]
        if 2 * k < size:
            rank = np.unique(pair, return_inverse=True)[1]
        k *= 2
    order = np.argsort(pair, kind="stable")
    same = np.diff(pair[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(len(pair), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(raw: bytes | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES`` (all 0 for null)."""
    if raw is None:
        return (0,) * len(MEASURES)
    text, words = raw.decode("utf-8", "replace"), raw.split()
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    n_upper = sum(map(str.isupper, text))
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), lines, dup,
            repeat_words(words), n_upper, sum(map(str.isalpha, text)), text.count("!"))


def ledger(docs: DataFrame, carry: list[str] | None = None, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """One row per input row: the ``carry`` columns (``doc_id``), the measurements,
    ``fail_bits`` (long). Carried columns may not be named like those.

    Null text: all measurements 0 (so ``few_words`` fails). Repeated rows are
    measured each on its own. No shuffle; memory is bounded by one slice of texts."""
    carry = ["doc_id"] if carry is None else carry

    def run(part):
        got = [measure(x) for x in part.column("__text").to_pylist()]
        yield [*(part.column(c) for c in carry), *(list(c) for c in zip(*got, strict=True))]

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    src = docs.select(*carry, F.col(text_col).cast("binary").alias("__text"))
    out = map_text(src, run, kinds + ", " + ", ".join(f"{m} long" for m in MEASURES), "__text")
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")) for r in rules]
    total: Column = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return out.withColumn("fail_bits", total)


def stored_ledger(docs: DataFrame, carry: list[str] | None = None, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``ledger``, written to the shared folder once: every rule is evaluated once, policies and ablations read
    the bits, and rejected rows stay on record with theirs."""
    return stored(ledger(docs, carry, text_col, rules), "quality-ledger")


def verdicts(led: DataFrame, policy: str = "standard-v1", policies: dict[str, list[str]] = POLICIES,
             rules: list[Rule] = RULES) -> DataFrame:
    """Adds ``kept`` under one policy and ``policy``: a mask over the stored bits."""
    m = F.lit(mask(policies[policy], rules)).cast("long")
    return led.withColumns({"policy": F.lit(policy), "kept": F.col("fail_bits").bitwiseAND(m) == 0})


def ablation(led: DataFrame, policies: dict[str, list[str]] = POLICIES, rules: list[Rule] = RULES) -> DataFrame:
    """Per policy and rule: ``n_failed`` (the rule failed), ``n_only`` (no other
    rule of the policy failed: dropping the rule would keep these rows).

    Aggregates to one row per distinct bitmask first (at most 2^rules rows)."""
    counts = led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    plan = [(p, r.name, mask(names, rules), 1 << r.bit) for p, names in policies.items() for r in rules if r.name in names]
    entries = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(n).alias("rule"), F.lit(m).cast("long").alias("m"),
                                           F.lit(b).cast("long").alias("b")) for p, n, m, b in plan]))
    x = counts.select("fail_bits", "n", entries.alias("e")).select("fail_bits", "n", "e.*")
    hit, inside = F.col("fail_bits").bitwiseAND(F.col("b")) != 0, F.col("fail_bits").bitwiseAND(F.col("m"))
    return x.groupBy("policy", "rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & (inside == F.col("b")), F.col("n")).otherwise(0)).alias("n_only"))
