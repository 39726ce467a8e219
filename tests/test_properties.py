"""Randomised checks against straightforward Python implementations of the
scoring and resolution rules (small inputs, many shapes)."""

import math
import random

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from traitgrid.operators.collect import resolve_attempts
from traitgrid.operators.scoring import score_card, trait_scores

TRAITS = ["Extraversion", "Agreeableness", "Neuroticism"]
RUN = ["model", "value"]


def brute_scores(responses, key):
    """responses: [(model, value, item, rating_text)]; key: {item: {trait: weight}}."""
    out = {}
    runs = sorted({(m, v) for m, v, _, _ in responses})
    for run in runs:
        rows = [r for r in responses if (r[0], r[1]) == run]
        na = 0
        for t in TRAITS:
            xs = []
            keyed = 0
            for _, _, item, rt in rows:
                w = key.get(item, {}).get(t, 0.0)
                if w == 0:
                    continue
                keyed += 1
                if rt in ("1", "2", "3", "4", "5"):
                    x = int(rt)
                    xs.append(6 - x if w == -1 else x)
                else:
                    na += 1
            if xs:
                a = np.array(xs)
                mean, std = float(np.round(a.mean(), 2)), float(np.round(a.std(), 2))
            else:
                mean = std = None
            out[(run, t)] = (keyed, len(xs), mean, std)
        out[(run, "share")] = na / len(rows)
    return out


rating = st.sampled_from(["1", "2", "3", "4", "5", "N/A", "7", "0"])
weight = st.sampled_from([0.0, 1.0, -1.0, 2.0, -2.0])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_scores_match_brute_force(spark, data):
    n_items = data.draw(st.integers(1, 8))
    key = {i: {t: data.draw(weight) for t in data.draw(st.lists(st.sampled_from(TRAITS), min_size=0, max_size=3, unique=True))}
           for i in range(n_items)}
    responses = data.draw(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(1, 2),
                                             st.integers(0, n_items + 1), rating), min_size=1, max_size=40))
    key_rows = [(i, f"q{i}", t, w) for i, ws in key.items() for t, w in ws.items()]
    kdf = spark.createDataFrame(key_rows or [(999, "q", TRAITS[0], 0.0)], "item_id long, question string, trait string, weight double")
    rdf = spark.createDataFrame(responses, "model string, value int, item_id long, rating_text string")
    expect = brute_scores(responses, key)
    got = trait_scores(rdf, kdf, RUN, TRAITS).collect()
    for r in got:
        e = expect[((r.model, r.value), r.trait)]
        assert (r.n_keyed, r.n_valid, r.mean, r.std) == e
        assert r.mean is None or 1.0 <= r.mean <= 5.0
        assert r.n_valid + r.n_na == r.n_keyed
        assert math.isclose(r.na_share, expect[((r.model, r.value), "share")])
    card = {(c.model, c.value): c for c in score_card(rdf, kdf, RUN, TRAITS).collect()}
    for (run, t), e in expect.items():
        if t != "share":
            assert card[run][t] == ("N/A" if e[2] is None else f"{e[2]}+-{e[3]}")


def brute_resolve(replies, k=10, allowed=("1", "2", "3", "4", "5")):
    import re
    for i, text in enumerate(replies[:k]):
        found = set(re.findall(r"\d+", text))
        num = found.pop() if len(found) == 1 else None
        if num in allowed:
            return i + 1, num
    last = min(len(replies), k)
    return last, "N/A"


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["x", "3", "9", "2 or 4", "5 of 5", "I pick 1", "0", "٣"]),
                         min_size=1, max_size=14), min_size=1, max_size=6))
def test_resolution_matches_brute_force(spark, logs):
    rows = [(item, a + 1, text, 0.1) for item, replies in enumerate(logs) for a, text in enumerate(replies)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "item_id long, attempt int, response_text string, elapsed_s double")
    got = {r.item_id: (r.attempt, r.rating_text) for r in resolve_attempts(df, ["item_id"]).collect()}
    assert got == {i: brute_resolve(replies) for i, replies in enumerate(logs)}
