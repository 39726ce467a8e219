"""Profiles and distances against a plain restatement."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from traitgrid.llm import langid, tokens


def _plain(rows, texts, size):
    counts = defaultdict(Counter)
    for lang, text in rows:
        if lang is not None and text is not None:
            grams, n = langid.ngrams(text)
            counts[lang].update(dict(zip(grams.tolist(), n.tolist(), strict=True)))
    profile = {x: {g: r for r, (g, _) in enumerate(sorted(c.items(), key=lambda y: (-y[1], y[0]))[:size])} for x, c in counts.items() if c}
    out = []
    for text in texts:
        grams, n = langid.ngrams(text or "")
        mine = [g for g, _ in sorted(zip(grams.tolist(), n.tolist(), strict=True), key=lambda y: (-y[1], y[0]))[:size]]
        if not mine or not profile:
            out.append(("und", 0.0))
            continue
        away = {x: sum(abs(p[g] - i) if g in p else size for i, g in enumerate(mine)) for x, p in profile.items()}
        best = min(sorted(away), key=lambda x: away[x])
        out.append((best, 1.0 - away[best] / (size * len(mine))))
    return out


@pytest.mark.parametrize("size", [5, 300])
def test_against_plain_profiles(spark, size):
    import duckdb

    rows = duckdb.sql("SELECT doc_id, lang, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    rows += [(9001, "aa", "same words here"), (9002, "bb", "same words here"), (9003, None, "some text"), (9004, "cc", None), (9005, "dd", ""), (9006, "en", "12 3"), (9001, "aa", "same words here")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    profiles = langid.learn_profiles(df, size=size)
    got = {(r.doc_id, r.text_): (r.lang_pred, r.score) for r in langid.predict_language(df.selectExpr("doc_id", "text", "text AS text_"), profiles, ["doc_id", "text_"], size=size).collect()}
    want = _plain([(x, t) for _, x, t in rows], [t for _, _, t in rows], size)
    for (d, _, t), (lang, score) in zip(rows, want, strict=True):
        assert got[d, t][0] == lang and got[d, t][1] == pytest.approx(score, abs=1e-12)
    assert got[9001, "same words here"][0] == "aa"  # a tie goes to the first label


def test_profiles_are_sparse_and_bounded(spark, monkeypatch):
    rows = [{"lang": f"l{i}", "gram": i * 300 + j, "rank": j} for i in range(1000) for j in range(300)]
    assert langid.Profiles(rows, 300).nbytes < 10 << 20  # a dense table of these has 2.4 GB
    monkeypatch.setattr(langid, "MAX_BYTES", 10)
    df = spark.createDataFrame([(1, "en", "some words")], "doc_id long, lang string, text string")
    with pytest.raises(ValueError, match="more than 10"):
        langid.predict_language(df, langid.learn_profiles(df), ["doc_id"])


def test_sketch_keeps_the_frequent():
    rng = np.random.default_rng(1)
    keys = [f"k{x}" for x in np.minimum(rng.zipf(1.3, 50_000), 20_000)]
    s, true = tokens.Sketch(500), Counter(keys)
    for i in range(0, len(keys), 700):
        s.add(keys[i:i + 700])
        assert len(s.seen) <= 1700
    found = dict(s.top(200))
    assert set(found) >= {k for k, _ in true.most_common(100)} and all(true[k] - n <= 50 * s.low and n <= true[k] for k, n in found.items())
