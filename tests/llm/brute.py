"""Plain restatements of the operators' results, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def words(text):
    return (text or "").encode().split()


def simhash(text):
    w = words((text or "").encode().lower().decode())
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g, seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def near_components(rows, bits=2):
    """{row index: component id} over (doc_id, text) rows."""
    fp = [simhash(t) for _, t in rows]
    distinct = sorted(set(fp))
    parent = {f: f for f in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for (d, _), f in zip(rows, fp, strict=True):
        if d is not None:
            least[root(f)].append(d)
    return [(d, f"{f:016x}", min(least[root(f)], default=None)) for (d, _), f in zip(rows, fp, strict=True)]


def dedup(rows, size=13):
    owner = {}
    for d, t in rows:
        if d is None:
            continue
        w = words(t)
        for i in range(len(w) - size + 1):
            k = tuple(w[i:i + size])
            owner[k] = min(owner.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - size + 1):
                if owner[tuple(w[i:i + size])] < d:
                    gone[i:i + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def quality(text):
    t, w = text or "", words(text)
    wins = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if wins[tuple(w[i:i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in t.split("\n") if x.encode().split()]
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


def nearest(vectors, k=10):
    """[(query, rank, id, distance)] over {id: vector}; queries are ids divisible by 100."""
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], dtype=np.float64)
    out = []
    for i, q in zip(ids, x, strict=True):
        if i % 100 == 0:
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out += [(int(i), r + 1, int(ids[j]), float(d[j])) for r, j in enumerate(order)]
    return out


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def _sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def merkle_leaf(row):
    return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(nodes):
    """The levels of a tree of digests, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def _siblings(levels, i):
    for nodes in levels[:-1]:
        a = i // 8 * 8
        yield nodes[a:i], nodes[i + 1:a + 8]
        i //= 8


def merkle(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, merkle_leaf(r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: _tree([y[2] for y in sorted(by[x], key=lambda y: y[:3])]) for x in langs}
    top = _tree([trees[x][-1][0] for x in langs])
    out = []
    for j, x in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(sorted(by[x], key=lambda y: y[:3])):
            path = [*_siblings(trees[x], i), *_siblings(top, j)]
            value = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                value = merkle_leaf((*r[:4], r[4].encode().lower().decode()))
            for left, right in path:
                value = _sha("".join([*left, value, *right]))
            proof = _sha("".join(d for left, right in path for d in [*left, *right]))
            out.append((r[0], leaf, trees[x][-1][0], top[-1][0], proof, value, value == top[-1][0]))
    return out


def collocations(rows, min_count=100, longest=5, top=2000, inside=100):
    """Sorted (lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if a >= min_count and len(p) > 1}
        held = {p[i:j] for p, a in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if j - i < len(p) and 100 * a >= inside * c[p[i:j]]}
        best = []
        for p, a in cand.items():
            if p in held:
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, b" ".join(p), c[p[:k]], c[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(best)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def top_products(rows, is_query, k=5):
    """Sorted (query, rank, id, score) over (id, vector) rows; a vector without a null or non-finite component."""
    fine = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(fine):
        if i is None or not is_query(i):
            continue
        found = [(-sum(x * y for x, y in zip(q, v, strict=True)), j is None, j or 0, j) for b, (j, v) in enumerate(fine) if a != b and len(v) == len(q)]
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)
