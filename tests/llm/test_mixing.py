"""Topics, raking and sampling against plain restatements."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from traitgrid.llm import mixing


def _themed(n=400):
    rng = random.Random(8)
    themes = [[f"{a}{t}word{i}" for i in range(30)] for t, a in enumerate(("sea", "law", "art"))]
    out = []
    for i in range(n):
        t, lang = i % 3, "en" if i % 2 else "fr"
        glue = [f"{lang}glue{j}" for j in range(8)]
        out.append((i, " ".join(rng.choice(themes[t] if rng.random() < 0.7 else glue) for _ in range(60)), lang, f"s{i % 4}", t))
    return out


def test_topics_are_themes_not_languages(spark):
    rows = _themed()
    df = spark.createDataFrame([r[:4] for r in rows] + [(900, None, "en", "s1"), (901, "", None, None), (902, "a b c", "xx", "s1")],
                               "doc_id long, text string, lang string, source string").repartition(4)
    got = {r.doc_id: r.topic for r in mixing.with_topics(df, ["doc_id"], topics=3).collect()}
    assert (got[900], got[901], got[902]) == (0, 0, 0) and len(got) == len(rows) + 3
    by = [{got[r[0]] for r in rows if r[4] == t} for t in range(3)]
    most = [max(range(3), key=lambda k, t=t: sum(got[r[0]] == k for r in rows if r[4] == t)) for t in range(3)]
    agree = sum(got[r[0]] == most[r[4]] for r in rows) / len(rows)
    assert sorted(most) == [0, 1, 2] and agree > 0.95, by
    assert {(got[r[0]], r[2]) for r in rows} >= {(k, g) for k in range(3) for g in ("en", "fr")}


def test_raking_equals_plain_proportional_fitting(spark):
    rng = np.random.default_rng(4)
    t = rng.integers(1, 500, (5, 4)).astype(float)
    cells = [(f"s{i}", f"l{j}", int(t[i, j])) for i in range(5) for j in range(4)]
    rows, cols = rng.dirichlet(np.ones(5) * 5), rng.dirichlet(np.ones(4) * 5)
    w = t.copy()
    for _ in range(500):
        w *= (rows * t.sum() / w.sum(axis=1))[:, None]
        w *= cols * t.sum() / w.sum(axis=0)
    goal = {"source": spark.createDataFrame([(f"s{i}", float(x)) for i, x in enumerate(rows)], "value string, share double"),
            "lang": spark.createDataFrame([(f"l{j}", float(x)) for j, x in enumerate(cols)], "value string, share double")}
    got = mixing.rake(spark.createDataFrame(cells, "source string, lang string, tokens long"), goal, tolerance=1e-9).collect()
    for r in got:
        assert r.weight == pytest.approx(w[int(r.source[1]), int(r.lang[1])], rel=1e-6)


def test_rows_are_sampled_at_their_probability(spark):
    rows = _themed(3000)
    df = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string").repartition(4)
    got = mixing.mixture(df).collect()
    want = sum(r.probability for r in got)
    spread = sum(r.probability * (1 - r.probability) for r in got) ** 0.5
    assert abs(sum(r.sampled for r in got) - want) < 4 * spread + 1
    assert {r.doc_id for r in got if r.sampled} == {r.doc_id for r in mixing.mixture(df.repartition(2)).collect() if r.sampled}


def test_topics_are_fitted_on_every_row(spark, monkeypatch):
    """Plain k-means from the same first centres over all distinct rows, copies counted in weights and means alone."""
    rows = [(i, t, g, "s") for i, (_, t, g, _, _) in enumerate(_themed(300))]
    rows += [(1000 + i, rows[0][1], "en", "s") for i in range(50)] + [(2000, None, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    packs = [(r[2], mixing.term_counts((r[1] or "").encode().split())) for r in rows]
    table = spark.createDataFrame(packs, "lang string, terms binary")
    first = []
    monkeypatch.setattr(mixing, "_first_centres", lambda *a, f=mixing._first_centres: first.append(f(*a)) or first[-1].copy())
    held = mixing.fit_topics(table.repartition(5), 3)

    counts = np.zeros((len(packs), mixing.TERMS))
    row, at, n = mixing._terms([p for _, p in packs])
    counts[row, at] = n
    weight = np.log((1 + len(packs)) / (1 + (counts > 0).sum(axis=0)))
    x = np.log1p(counts) * weight
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for g in {g for g, _ in packs}:
        mine = [a == g for a, _ in packs]
        x[mine] -= x[mine].mean(axis=0)
    x = x[[i for i, p in enumerate(packs) if p not in packs[:i]]]
    fits = []
    for centre in first[0] / mixing.GRID:
        assert all(np.abs(x - c).max(axis=1).min() < 1e-5 for c in centre)  # a row each
        for _ in range(mixing.TURNS):
            d = ((x[:, None] - centre) ** 2).sum(axis=2)
            centre = np.stack([x[d.argmin(axis=1) == j].mean(axis=0) for j in range(3)])
        fits.append((d.min(axis=1).sum(), centre))
    want = min(fits, key=lambda f: f[0])
    got = held.centre / mixing.GRID
    assert ((x[:, None] - got) ** 2).sum(axis=2).min(axis=1).sum() == pytest.approx(want[0], rel=1e-4)
    again = mixing.fit_topics(table.repartition(2), 3)
    assert (again.centre == held.centre).all() and (again.mean == held.mean).all()
    assert not hasattr(mixing, "SAMPLE") and {r.topic for r in mixing.with_topics(df, ["doc_id"], 3).collect()} <= {0, 1, 2}


def test_vectors_are_stored_one_to_a_row(spark):
    """No value of the table that each turn reads grows with the input: distinct rows are a row each, copies are counted."""
    packs = [("en" if i % 2 else None, mixing.term_counts(f"word{i} other{i % 7} glue".encode().split())) for i in range(600)] + [("en", b"")] * 9
    rows = spark.createDataFrame(packs, "lang string, terms binary").repartition(2)
    held = mixing.Topics(np.ones(mixing.TERMS), [None, "en"])
    got = mixing._table(rows, held).collect()
    assert len(got) == len(set(packs)) and sum(r.n for r in got) == len(packs)
    assert max(len(r.x) for r in got) <= 4 * 3 and all(len(r.x) == 2 * len(r.at) for r in got)
    assert {r.n for r in got if not r.at} == {9}


def test_a_turn_of_raking_is_one_join(spark, monkeypatch):
    """Each join of a turn is a broadcast that the driver builds and holds; cells without a target end with weight 0."""
    cells = [(f"s{i}", None if j == 3 else f"l{j}", k, 10 + i * j + 3 * k) for i in range(3) for j in range(4) for k in range(2)]
    df = spark.createDataFrame(cells, "source string, lang string, topic int, tokens long")
    goal = {d: mixing.tempered_targets(df, d, 0.5) for d in mixing.DIMS}
    goal["source"] = goal["source"].filter("value != 's2'")
    joins = []
    monkeypatch.setattr(mixing, "cut", lambda d, f=mixing.cut: joins.append(d._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or f(d))
    got = mixing.rake(df, goal, keep=0.5).collect()
    assert len(joins) > 12 and max(joins) <= len(goal) and set(joins[8:]) == {0, 1}
    assert {r.weight for r in got if r.source == "s2"} == {0.0} and len(got) == len(cells)
    assert sum(r.weight for r in got) == pytest.approx(0.5 * sum(c[3] for c in cells), rel=1e-5)


def test_words_are_hashed_many_at_once(monkeypatch):
    """A loop over words took most of the stage that reads the texts: no call is made for each of them. Counts are those of plain
    counting, also of blanks of all kinds, long words, texts without words, many short ones."""
    rng = random.Random(5)
    some = ["A", "the", "HOUSE", "house", "\u00c9t\u00e9", "na\x1cme", "x\u00a0y", "\x00\x00\x00\x00", "z" * 64, "Z" * 65, "q" * 3000] + [f"Word{i}" for i in range(300)]
    texts = ["".join(rng.choice(some) + rng.choice([" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c"]) for _ in range(rng.randint(0, 90))) for _ in range(300)]
    texts = [t.encode() for t in [*texts, "", " \t\n", "end", " lead", " ".join(f"many{i}" for i in range(70_000))] + ["word a"] * 1200] + [b"\xff\xfe\xff\xfe bad"]

    def plain(text):
        n = Counter()
        for w in text.split():
            if len(w) > 3:
                n[zlib.crc32(w.lower()) % mixing.TERMS] += 1
        at = sorted(n)
        return np.array(at, dtype="<u2").tobytes() + np.array([n[i] for i in at], dtype="<u4").tobytes()

    want, words = [plain(t) for t in texts], [t.split() for t in texts]
    calls = []
    monkeypatch.setattr(mixing.zlib, "crc32", lambda w, f=zlib.crc32: calls.append(w) or f(w))
    assert [mixing.term_counts(w) for w in words[:310]] == want[:310]
    assert all(len(w) > 64 for w in calls)
    packs, tokens = mixing.counted(texts)
    assert packs == want and tokens.tolist() == [len(w) for w in words]
    assert all(len(w) > 64 for w in calls) and mixing.counted([])[0] == []
