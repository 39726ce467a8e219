"""Language identification by rank-order n-gram profiles (out-of-place distance).

N-grams are runs of one to three letters inside blank-padded words, packed into
one 63-bit integer each (21 bits a code point), so that counting is sorting of
integer arrays and their order is that of the strings.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitgrid.llm.common import cut, map_text

PROFILE = 300
#: A profile table is collected and shipped to tasks; more labels than this is an error, not a cut.
MAX_LANGUAGES = 10_000
#: Bytes of the profile table in each worker.
MAX_BYTES = 64 << 20
CHUNK = 1 << 18
BLANK = 32


@cache
def _letters() -> np.ndarray:
    """Code point → lower-case letter, or a blank for all that is no letter."""
    out = np.full(0x110000, BLANK, dtype=np.int64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed n-grams (sorted) of the whole text and their counts. Long texts
    are counted in chunks of ``CHUNK`` characters that overlap by two."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    c = _letters()[codes]
    blank = c == BLANK
    if blank.all():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keep = np.ones(len(c), dtype=bool)   # one blank between words, one before and one after
    keep[1:] = ~(blank[1:] & blank[:-1])
    c = np.concatenate(([BLANK], c[keep], [BLANK]))
    parts = []
    for i in range(0, len(c), CHUNK):
        x = c[i:i + CHUNK + 2]
        word = x != BLANK
        m = min(CHUNK, len(x))
        one = x[:m][word[:m]] << 42
        k = min(CHUNK, len(x) - 1)
        two = ((x[:k] << 42) | (x[1:k + 1] << 21))[word[:k] | word[1:k + 1]]
        k = max(0, min(CHUNK, len(x) - 2))
        three = ((x[:k] << 42) | (x[1:k + 1] << 21) | x[2:k + 2])[word[1:k + 1]]
        parts.append(np.unique(np.concatenate((one, two, three)), return_counts=True))
    return parts[0] if len(parts) == 1 else _merge(parts)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(inverse, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties to the smaller n-gram."""
    return grams[np.lexsort((grams, -counts))[:size]]


def learn_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """Rows ``lang, gram, rank`` (0 = most frequent): the ``size`` most frequent
    n-grams of each language over all labelled texts (rows with a null text or
    label teach nothing). Counts are pre-aggregated in the task; the top of each
    language is a grouped limit that Spark applies before its shuffle too."""
    def count(part):
        by: dict[str, list] = {}
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            g = ngrams(text)
            if len(g[0]):
                by.setdefault(lang, []).append(g)
        for lang, got in by.items():
            grams, n = _merge(got)
            yield [[lang] * len(grams), grams, n]

    src = (labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
           .filter(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    counts = map_text(src, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return (counts.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < size)
            .select("lang", "gram", "rank"))


class Profiles:
    """The profiles, sparse: ``lang[k]`` and ``rank[k]`` for ``start[j] <= k < start[j + 1]`` are the languages that have
    ``grams[j]`` and its rank there (``size``: absent). No more than a row of the profile table each."""

    def __init__(self, rows: list, size: int):
        self.size = size
        self.langs = sorted({r["lang"] for r in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        gram = np.array([r["gram"] for r in rows], dtype=np.int64)
        order = np.argsort(gram, kind="stable")
        self.grams, first = np.unique(gram[order], return_index=True)
        self.start = np.append(first, len(rows)).astype(np.int64)
        self.lang = np.array([at[r["lang"]] for r in rows], dtype=np.int32)[order]
        self.rank = np.array([r["rank"] for r in rows], dtype=np.int32)[order]

    @property
    def nbytes(self) -> int:
        return self.grams.nbytes + self.start.nbytes + self.lang.nbytes + self.rank.nbytes + sum(len(x.encode()) for x in self.langs)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language of smallest out-of-place distance (ties: first label) and
        1 - distance / largest possible distance; ``und``, 0 without a letter."""
        grams = top(*ngrams(text or ""), self.size)
        if not len(grams) or not self.langs:
            return "und", 0.0
        j = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        place = np.flatnonzero(self.grams[j] == grams)
        j = j[place]
        n = self.start[j + 1] - self.start[j]
        k = np.repeat(self.start[j] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        # what a language's profile has is so much nearer than absent
        gain = self.size - np.abs(self.rank[k] - np.repeat(place, n))
        total = self.size * len(grams) - np.bincount(self.lang[k], weights=gain, minlength=len(self.langs))
        best = int(total.argmin())
        return self.langs[best], 1.0 - float(total[best]) / (self.size * len(grams))


def predict_language(docs: DataFrame, profiles: DataFrame, carry: list[str], text_col: str = "text",
                     size: int = PROFILE) -> DataFrame:
    """``carry`` columns, ``lang_pred`` and ``score`` (0 to 1) for every row.

    A null text or one without a letter is ``und`` with score 0, and so is
    everything when nothing was learned; equal distances go to the first label; a repeated row is predicted
    each time. Whole texts; the only thing shipped to
    tasks is the sparse profile table, broadcast (a row for each language and n-gram; more than ``MAX_BYTES``
    of it are an error)."""
    rows = profiles.limit(MAX_LANGUAGES * size + 1).collect()
    if len(rows) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    made = Profiles(rows, size)
    if made.nbytes > MAX_BYTES:
        raise ValueError(f"profiles of {made.nbytes} bytes, more than {MAX_BYTES}")
    held = docs.sparkSession.sparkContext.broadcast(made)

    def run(part):
        model = held.value
        got = [model.predict(x) for x in part.column("__text").to_pylist()]
        yield [*(part.column(c) for c in carry), [x for x, _ in got], [x for _, x in got]]

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return map_text(docs.select(*carry, F.col(text_col).alias("__text")), run,
                    schema + ", lang_pred string, score double", "__text")


def identify(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """Learn from the labelled three quarters and predict every row:
    ``doc_id, held_out, lang_pred, score``. Held out are the rows whose crc32 of
    the id's text leaves 2 modulo 4; a row without id is not held out, and not learned from."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    held = F.coalesce(fold == 2, F.lit(False))
    profiles = cut(learn_profiles(docs.filter(fold != 2), size=size))
    out = predict_language(docs.select("doc_id", "text").withColumn("held_out", held), profiles, ["doc_id", "held_out"], size=size)
    return out
