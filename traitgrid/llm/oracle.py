"""DuckDB twins of the operators' queries that SQL can express on whole tables.

The others are beyond SQL or too slow there (rank-order profiles, sharding by
propagation, SimHash closure, the tokenizers' merges, packing, approximate search,
raked sampling, 13-word windows); tests hold those against brute force.
"""

from traitgrid.llm import quality

_SPACE = r"[\x20\x09-\x0D]+"

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, [x FOR x IN regexp_split_to_array(t, '{_SPACE}') IF x <> ''] AS ws,
             [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
win AS (SELECT rid, i, list_slice(ws, i, i + 7) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^\p{{L}}]', '', 'g'))::BIGINT AS n_letters,
         length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_bangs
  FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
  + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > 2 * n_words THEN 4 ELSE 0 END
  + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
  + CASE WHEN 2 * n_upper > n_letters AND n_letters > 0 THEN 32 ELSE 0 END
  + CASE WHEN 10 * n_bangs > 3 * n_words THEN 64 ELSE 0 END
  + CASE WHEN 2 * n_letters < word_chars THEN 128 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

OP11 = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, c.rid AS crid, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.rid <> c.rid WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, crid) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP12 = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS ws FROM pieces),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
i AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) AS ms(m) WHERE len(ws) >= m),
f AS MATERIALIZED (SELECT lang, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS phrase, count(*) AS f FROM i GROUP BY ALL HAVING count(*) >= 100),
inside AS (SELECT lang, f, unnest([array_to_string(list_slice(string_split(phrase, ' '), 1, m - 1), ' '),
                                   array_to_string(list_slice(string_split(phrase, ' '), 2, m), ' ')]) AS phrase FROM f WHERE m > 2),
longer AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL),
c AS (SELECT f.lang, f.phrase, f.m, f.f AS a FROM f LEFT JOIN longer USING (lang, phrase) WHERE f.m > 1 AND (longer.f IS NULL OR longer.f < f.f)),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
cuts AS (SELECT lang, phrase, a, k, array_to_string(list_slice(string_split(phrase, ' '), 1, k), ' ') AS one,
                array_to_string(list_slice(string_split(phrase, ' '), k + 1, m), ' ') AS two FROM k),
scored AS (SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
           FROM cuts JOIN f x ON cuts.lang = x.lang AND one = x.phrase JOIN f y ON cuts.lang = y.lang AND two = y.phrase JOIN n ON cuts.lang = n.lang),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored) WHERE o = 1),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranks WHERE rank <= 2000
"""


def _levels(name: str, depth: int) -> str:
    """The levels of the trees ``g`` over ``<name>0 (g, pos, d)``, and each node's siblings. A tree
    of one node stays as it is (``up`` is false)."""
    out = []
    for i in range(depth):
        out.append(f"""{name}{i + 1} AS MATERIALIZED (SELECT g, pos // 8 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{i}) GROUP BY g, pos // 8),
{name}s{i} AS MATERIALIZED (SELECT x.g, x.pos, any_value(x.n) > 1 AS up, coalesce(string_agg(y.d, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l,
    coalesce(string_agg(y.d, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{i}) x JOIN {name}{i} y ON x.g = y.g AND x.pos // 8 = y.pos // 8 GROUP BY x.g, x.pos)""")
    return ",\n".join(out)


def _climb(rows: str, name: str, depth: int, g: str, pos: str) -> str:
    """``<name>r<depth>``: ``rows`` with the digest ``c`` climbed to its tree's root and the siblings on the way added to ``p``."""
    out, last = [], rows
    for i in range(depth):
        out.append(f"""{name}r{i + 1} AS (SELECT a.* EXCLUDE (c, p), CASE WHEN up THEN sha256(l || c || r) ELSE c END AS c, p || l || r AS p
  FROM {last} a JOIN {name}s{i} s ON a.{g} = s.g AND a.{pos} // {8**i} = s.pos)""")
        last = f"{name}r{i + 1}"
    return ",\n".join(out)


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Levels of a lang's tree and of the tree over langs: 16 million documents, 4,096 langs.
_IN, _OVER = 8, 4
_CRC = """xor(4294967295, list_reduce(flatten([[(unicode(c) >> b) & 1 FOR b IN range(8)] FOR c IN string_split(doc_id::VARCHAR, '')]),
    lambda acc, b: xor(acc >> 1, 3988292384 * (xor(acc, b) & 1)), 4294967295::BIGINT))"""

OP13 = f"""
WITH langs AS (SELECT lang AS k, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents)),
h AS MATERIALIZED (SELECT doc_id, g, {_leaf('text')} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS now
  FROM documents JOIN langs ON lang IS NOT DISTINCT FROM k),
rows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
t0 AS (SELECT g, pos, leaf AS d FROM rows),
{_levels("t", _IN)},
o0 AS MATERIALIZED (SELECT 0 AS g, g AS pos, d FROM t{_IN}),
{_levels("o", _OVER)},
start AS (SELECT rows.*, 0 AS zero, coalesce(now, leaf) AS c, '' AS p FROM rows),
{_climb("start", "t", _IN, "g", "pos")},
{_climb(f"tr{_IN}", "o", _OVER, "zero", "g")}
SELECT doc_id, leaf, sub.d AS subroot, top.d AS root, sha256(p) AS proof_sha256, c AS folded_root, c = top.d AS verified
FROM or{_OVER} a JOIN o0 sub ON a.g = sub.pos CROSS JOIN o{_OVER} top
"""

def _ablation() -> str:
    rows = ", ".join(f"('{p}', '{r.name}', {quality.mask(names)}, {1 << r.bit})" for p, names in quality.POLICIES.items() for r in quality.RULES if r.name in names)
    return f"""WITH led AS ({OP8}), e AS (SELECT * FROM (VALUES {rows}) AS v(policy, rule, m, b))
SELECT policy, rule, count(*) FILTER (WHERE fail_bits & b <> 0) AS n_failed, count(*) FILTER (WHERE fail_bits & m = b) AS n_only
FROM led CROSS JOIN e GROUP BY policy, rule"""


SQL = {"quality_ablation": _ablation(), "op8_quality_rules": OP8, "op11_exact_top_k": OP11, "op12_phrase_mining": OP12, "op13_merkle_manifest": OP13}
