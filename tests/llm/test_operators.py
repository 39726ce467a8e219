"""Each operator against brute force on a small table with every odd case in it."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from traitgrid.llm import ann, chat, graph, langid, mixing, packing, quality, sharding, simhash, substring, tokens
from traitgrid.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, tag string, before int, at string"


def _texts():
    rng = random.Random(3)
    vocab = ["the", "of", "Wood", "river,", "stone.", "été", "naïve", "x1", "***", "a"] + [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(5, 90))) for _ in range(40)]
    near = [base[0] + " extra", base[1].replace("w1", "w2"), base[2] + "\n" + base[3], base[0], base[0]]
    odd = [None, "", "   \t\n", "word", "two words", "same line here\nsame line here\n" * 9, "ab " * 400, base[4] + " " + base[4],
           "<|endoftext|> <s> ▁x  y", "İstanbul ΣΑΣ. it's, don't.", "n" * 5000, " ".join(f"u{i}" for i in range(9000)) + " " + base[5]]
    return base + near + odd


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en" if i % 2 else "fr", "s" if i % 3 else None, 1, 7, "x", 1, "y") for i, t in enumerate(_texts())]
    out += [out[0], out[0], out[7], (None, out[1][1], None, "s", None, 7, "x", 1, "y"), (None, None, None, None, None, 7, "x", 1, "y"),
            (3, "another text under an id that is there already " * 3, "en", "s", 1, 7, "x", 1, "y"),
            (90, "another text under an id that is there already " * 3, "en", "s", 1, 7, "x", 1, "y")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _sorted(x):
    return sorted((tuple(r) for r in x), key=repr)


def test_language_id(spark, docs, empty):
    got = langid.identify(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and brute.held_out(r.doc_id))
        assert r.lang_pred in ("en", "fr", "und")
    assert {r.lang_pred for r in got if r.doc_id in (45, 46, 47)} == {"und"}  # null, empty, blank
    assert langid.identify(empty).count() == 0


def test_ngrams_in_chunks(monkeypatch):
    text = " ".join(_texts()[:20]) + " été"
    whole = langid.ngrams(text)
    monkeypatch.setattr(langid, "CHUNK", 17)
    parts = langid.ngrams(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred != 'und'")
    assert got.filter("lang_pred = lang").count() / got.count() > 0.98


def test_sharding(spark, docs, empty):
    got = sharding.shard_documents(docs, shards=5).collect()
    assert len(got) == docs.count()
    by = {j: sorted(r.slot for r in got if r["shard"] == j) for j in range(5)}
    sizes = [len(x) for x in by.values()]
    assert max(sizes) - min(sizes) <= 1 and all(x == list(range(len(x))) for x in by.values())
    text = {i: t for i, t, *_ in docs.collect() if i is not None and i not in (0, 3)}
    for r in got:
        if r.doc_id in text:
            raw = (text[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_keeps_groups_and_fills_whole_shards(spark):
    """A group of a third of all rows fills shards one after the other; small groups stay whole."""
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 2}") for i in range(600)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=12).collect()
    text = dict(rows)
    where: dict = {}
    for r in got:
        where.setdefault(text[r.doc_id], set()).add(r["shard"])
    assert len(where["hot"]) <= 6
    split = sum(len(x) > 1 for t, x in where.items() if t != "hot")
    assert split <= 0.05 * len(where)


def test_simhash(spark, docs, rows, empty):
    got = [(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert _sorted(got) == _sorted(brute.near_components([x[:2] for x in rows]))
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bits,run", [(2, 256), (2, 3), (3, 256), (3, 2), (0, 256), (5, 256)])
def test_links_lose_no_pair(spark, bits, run):
    rng = random.Random(bits)
    seeds = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    fps = {f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for f in seeds for _ in range(8)}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    got = graph.components(simhash.links(spark.createDataFrame([(x,) for x in signed.values()], "fp long"), bits, run)).collect()
    label = {f: f for f in signed.values()} | {r.node: r.component for r in got}
    expect = {f: f for f in fps}

    def root(x):
        while expect[x] != x:
            x = expect[x]
        return x
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= bits:
                expect[root(a)] = root(b)
    ours, theirs = {}, {}
    for f in fps:
        ours.setdefault(label[signed[f]], set()).add(f)
        theirs.setdefault(root(f), set()).add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(90, 130)] + [(7, 7), (200, 201), (201, 200), (300, 310), (305, 310)]
    got = graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    least = {x: x for p in pairs for x in p}
    for _ in pairs:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert sorted(map(tuple, got)) == sorted(least.items())
    assert graph.components(spark.createDataFrame([(5, 5)], "a long, b long")).isEmpty()


@pytest.mark.parametrize("chunk", [1, 7])
def test_components_when_tasks_contract_little(spark, chunk):
    rng = random.Random(chunk)
    ids = rng.sample(range(-10**6, 10**6), 300)
    pairs = [(ids[i], ids[i + 1]) for i in range(120)] + [tuple(rng.sample(ids[130:], 2)) for _ in range(110)]
    pairs += pairs[:50]
    got = graph.components(spark.createDataFrame(pairs, "a long, b long").repartition(7), chunk).collect()
    least = {x: x for p in pairs for x in p}
    for _ in ids:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert sorted(map(tuple, got)) == sorted(least.items())


def test_token_counts(spark, docs, rows, empty):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = [(r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs, path).collect()]
    assert _sorted(got) == _sorted((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t, *_ in rows)
    assert tokens.count_tokens(empty, path).count() == 0


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, group=16).collect()
    ids = [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], dtype="<u4")) for i, x, *_ in rows]
    expect = [(i, s, len(x[s:s + 4096]), zlib.crc32(x[s:s + 4096].tobytes()), len(x)) for i, x in ids for s in range(0, len(x), 4096)]
    assert _sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == _sorted(expect)
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in seqs.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and x[-1][0] + x[-1][1] <= 4096
    assert packing.pack_documents(empty, path).count() == 0


def test_first_fit_decreasing():
    rng = random.Random(1)
    for n in (0, 1, 2, 57):
        sizes = [rng.randint(1, 100) for _ in range(n)]
        room, expect = [100] * n, [0] * n
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            b = next(b for b in range(n) if room[b] >= sizes[i])
            room[b] -= sizes[i]
            expect[i] = b
        assert packing.first_fit_decreasing(sizes, 100) == expect


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.standard_normal(16).astype("float32").tolist() for i in range(600)}
    vectors |= {i: vectors[0] for i in range(600, 640)}  # ties
    bad = [(700, None), (800, [0.0] * 16), (701, [float("nan")] * 16), (702, [None] * 16), (703, [1.0]), (704, [float("inf")] * 16), (None, vectors[1])]
    df = spark.createDataFrame([*vectors.items(), *bad], "vec_id long, embedding array<float>")
    queries = df.filter("vec_id % 100 = 0")
    expect = brute.nearest(vectors)
    got = {(r.query_id, r.vec_id): r.score for r in ann.search(df, queries, probes=0.7).collect()}
    hit = [x for x in expect if (x[0], x[2]) in got]
    assert len(hit) / len(expect) >= 0.9 and all(abs(got[q, v] - s) < 1e-12 for q, _, v, s in hit)
    whole = [tuple(r) for r in ann.search(df, queries, probes=1.0, lists=3).collect()]
    assert [(q, r, v) for q, r, v, _ in sorted(whole) if q == 0] == [(q, r, v) for q, r, v, _ in expect if q == 0]
    few = df.filter("vec_id in (0, 5, 6)")
    assert ann.search(few, few.filter("vec_id = 0")).count() == 2
    assert ann.search(df.filter("false"), df.filter("false")).count() == 0


def test_quality_ledger(spark, docs, rows, empty):
    led = quality.ledger(docs).cache()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in led.collect()]
    assert _sorted(got) == _sorted((i, *brute.quality(t)) for i, t, *_ in rows)
    bits = [r.fail_bits for r in led.collect()]
    for p, names in quality.POLICIES.items():
        m = quality.mask(names)
        assert quality.verdicts(led, p).filter("kept").count() == sum(not b & m for b in bits)
    for r in quality.ablation(led).collect():
        bit, m = next(1 << x.bit for x in quality.RULES if x.name == r.rule), quality.mask(quality.POLICIES[r.policy])
        assert (r.n_failed, r.n_only) == (sum(b & bit > 0 for b in bits), sum(b & m == bit for b in bits))
    assert quality.ledger(empty).count() == 0


def test_mixing(spark, docs, empty):
    got = mixing.mixture(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.probability <= 1 for r in got) and max(r.probability for r in got) == 1
    assert mixing.mixture(empty).count() == 0
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 40), ("b", "y", 20), (None, "x", 5)], "source string, lang string, tokens long")
    goal = {"source": [("a", 0.5), ("b", 0.4), (None, 0.1)], "lang": [("x", 0.6), ("y", 0.4)]}
    w = mixing.rake(cells, {d: spark.createDataFrame(t, "value string, share double") for d, t in goal.items()}).collect()
    for d, t in goal.items():
        for v, share in t:
            assert abs(sum(r.weight for r in w if r[d] == v) / 105 - share) < 1e-4


def test_a_source_of_one_document_does_not_set_the_rate(spark):
    rng = random.Random(5)
    many = [(i, " ".join(f"word{rng.randint(0, 400)}" for _ in range(40)), "fr" if i % 4 else "en", "big" if i % 2 else f"s{i % 3}") for i in range(2000)]
    d = spark.createDataFrame([*many, (9999, "one two word", "en", "lone")], "doc_id long, text string, lang string, source string").repartition(4)
    got = mixing.mixture(d).collect()
    total = sum(r.n_tokens for r in got)
    assert sum(r.probability * r.n_tokens for r in got) / total == pytest.approx(mixing.KEEP, abs=1e-5)
    assert next(r.probability for r in got if r.source == "lone") == pytest.approx(1) and max(r.probability for r in got) <= 1
    # shares of the values that are not taken whole are as their targets are
    part = {s: (sum(r.probability * r.n_tokens for r in got if r.source == s), sum(r.n_tokens for r in got if r.source == s)) for s in ("big", "s0", "s1")}
    for s in ("s0", "s1"):
        assert part[s][0] / part["big"][0] == pytest.approx((part[s][1] / part["big"][1]) ** 0.85, rel=1e-4)


def test_raking_goes_on_until_it_is_met_or_says_so(spark):
    def made(cells, **goal):
        c = spark.createDataFrame(cells, "source string, lang string, tokens long")
        return c, {d: spark.createDataFrame(t, "value string, share double") for d, t in goal.items()}

    c, goal = made([("a", "x", 1500), ("a", "y", 1), ("b", "x", 1), ("b", "y", 1500)], source=[("a", 0.5), ("b", 0.5)], lang=[("x", 0.3), ("y", 0.7)])
    w = mixing.rake(c, goal, rounds=10, tolerance=1e-3).collect()  # 17 are needed
    for d, v, share in (("source", "a", 0.5), ("lang", "x", 0.3), ("lang", "y", 0.7)):
        assert sum(r.weight for r in w if r[d] == v) / 3002 == pytest.approx(share, rel=2e-3)
    c, goal = made([("a", "x", 10), ("b", "y", 10)], source=[("a", 0.5), ("b", 0.5)], lang=[("x", 0.3), ("y", 0.7)])
    with pytest.warns(UserWarning, match="off their targets"):
        mixing.rake(c, goal, rounds=2)


def test_substring_dedup(spark, docs, rows, empty):
    got = [tuple(r) for r in substring.dedup_digest(docs).collect()]
    assert _sorted(got) == _sorted(brute.dedup([x[:2] for x in rows]))
    assert substring.dedup_digest(empty).count() == 0


def test_substring_dedup_of_unique_ids_and_texts_kept(spark, rows):
    own = [x for x in rows if x[0] not in (0, 3, 7)]
    d = spark.createDataFrame(own, SCHEMA)
    assert _sorted(map(tuple, substring.dedup_digest(d).collect())) == _sorted(brute.dedup([x[:2] for x in own]))
    for df, some in ((d, own), (spark.createDataFrame(rows, SCHEMA), rows)):
        out = substring.remove_repeated(df).collect()
        left = [x for x in brute.dedup([x[:2] for x in some]) if not (x[1] and x[1] == x[2])]
        import hashlib
        assert _sorted((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in out) == _sorted((x[0], x[3]) for x in left)
        assert out[0].asDict().keys() == set(d.columns)


def test_longest_passages(spark):
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(1, a), (2, "x " + " ".join(a.split()[5:35]) + " y"), (3, "p " + " ".join(a.split()[:14])), (4, "nothing of it")]
    got = substring.longest_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.longest for r in got} == {2: 26, 3: 13}


def test_viterbi_is_the_best_path():
    import itertools

    model = chat.Model({(6, 2): 5, (2, 3): 3, (3, 4): 4, (4, 5): 2, (5, 2): 2}, {(2, 7): 5, (4, 11): 6, (3, 19): 4, (5, 19): 3})
    seen = [7, 19, 11, 19, 16]
    best = max(itertools.product(range(6), repeat=5), key=lambda p: chat.log_likelihood(model, p, seen))
    assert chat.log_likelihood(model, model.viterbi(seen), seen) == pytest.approx(chat.log_likelihood(model, best, seen))


def test_chat(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = chat.format_conversations(d).filter("held_out").selectExpr("sum(n_right) / sum(n_true) as a").first().a
    assert got > 0.85
    rows = [(1, 0, "user", "Hi?"), (1, 1, "assistant", "Yes.\nMore."), (1, 1, "assistant", "Yes.\nMore."), (None, 0, "user", "x"), (2, None, "user", None), (3, 0, "robot", "y")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id for r in out} == {1, 2, 3, None}
    assert chat.format_conversations(d.filter("false")).count() == 0


def test_chat_keeps_every_conversation_and_turn(spark):
    rows = [(1, 0, "Human", "Hi?"), (1, 1, "tool", "looked up"), (1, 2, " ai ", "Yes."), (2, None, "user", None), (3, 0, "robot", "yes indeed"), (4, 0, None, None),
            (5, 0, "bot", "a reply"), (6, 0, "customer", "where is it?"), (None, 0, "agent", "here")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(d).collect()}
    assert set(out) == {1, 2, 3, 4, 5, 6, None}
    assert all(x in out[1].rendered for x in ("Hi?", "looked up", "Yes.")) and "yes indeed" in out[3].rendered
    assert out[1].n_true == 2 and out[3].n_true == 0 and out[4].n_turns == 0 and out[5].n_true == out[6].n_true == 1


def test_query_keeps_every_conversation(spark, tmp_path):
    from traitgrid.llm.queries import QUERIES

    spark.createDataFrame([(1, 0, "robot", "x"), (2, 0, "user", "y")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.conv_id for r in QUERIES["op5_chat_formatting"](spark, str(tmp_path)).collect()} == {1, 2}


def test_long_chat_is_decoded_as_a_whole(spark, monkeypatch):
    rng = random.Random(11)
    said = ["Is it so?", "It is.", "word " * 30, "a: no\nand more", "Q? A!", "x\n\ny"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "user", "assistant", None]), rng.choice(said) + f" {t % 9}") for c, n in ((1, 700), (2, 3), (3, 200)) for t in range(n)]
    rows += [(4, None, "user", f"equal {i}") for i in range(150)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    raw = chat.written(d).withColumn("held_out", F.lit(False))
    model = chat.learn(chat.ordered(raw))
    got = chat.parse_turns(chat.ordered(raw), model).orderBy("part").collect()
    turns = chat.ordered(raw).collect()
    for c in (1, 2, 3, 4):
        own = [x for x in turns if x.conv_id == c]
        whole = chat.parse(model, "\n".join(x.marked for x in own))
        parts = [r for r in got if r.conv_id == c]
        assert "".join(r.rendered for r in parts) == chat.render(whole)
        assert [r.part for r in parts] == list(range(len(parts))) and all(r.n_turns <= chat.PART for r in parts)
        assert sum(r.n_right for r in parts) == sum(a.r == b for a, (b, _) in zip(own, whole))
        assert sum(r.n_true for r in parts) == sum(x.r is not None for x in own) and sum(r.n_lines for r in parts) == sum(x.marked.count("\n") + 1 for x in own)
    assert sum(r.conv_id == 1 for r in got) > 5


def test_decoder_gives_the_undivided_path():
    model = chat.Model({(6, 2): 5, (2, 3): 3, (3, 4): 4, (4, 5): 2, (5, 2): 2}, {(2, 7): 5, (4, 11): 6, (3, 19): 4, (5, 19): 3})
    rng = random.Random(2)
    lines = [rng.choice(["User: x", "Assistant: y", "plain", "why?", "", "Foo: z", "long " * 40]) for _ in range(900)]
    for look in (1, 7, 512):
        decoder = chat.Decoder(model, look)
        some = [x for line in lines for x in decoder.add(line)]
        assert len(some) > 0
        assert [s for s, *_ in [*some, *decoder.end()]] == model.viterbi([chat.observe(x)[0] for x in lines])


def _shuffle_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    files = env.blockManager().diskBlockManager().getAllFiles()
    return sum(1 for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_a_stored_table_leaves_no_shuffle_files(spark):
    from traitgrid.llm.common import CLEANUP, stored

    setting, before = spark.conf.get(CLEANUP), _shuffle_files(spark)
    got = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test-stored")
    end = time.time() + 20
    while _shuffle_files(spark) > before and time.time() < end:
        time.sleep(0.2)
    assert _shuffle_files(spark) <= before and spark.conf.get(CLEANUP) == setting
    assert sorted(r["count"] for r in got.collect()) == [142] + [143] * 6


def test_levels_of_substring_dedup_are_stored(spark):
    """Windows of both levels and the texts never lie in shuffle files together: what is left to run holds no level."""
    words = [f"w{i}" for i in range(40)]
    rows = [(2, " ".join(words[10:30] + ["own"]), "en", "s", 1), (1, " ".join(words), "en", "s", 1), (3, " ".join(words), "en", "s", 1), (4, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for run, column, want in ((substring.dedup_digest, "n_removed", {1: 0, 2: 20, 3: 40, 4: 0}), (substring.remove_repeated, "text", {1: " ".join(words), 2: "own", 4: None})):
        out = run(docs)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert {r.doc_id: r[column] for r in out.collect()} == want
