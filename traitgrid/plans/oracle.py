"""DuckDB twins of the registered queries (tables pre-registered as views).

Each fixture CTE mirrors ``plans/fixtures.py``; each query mirrors
``plans/queries.py``. Integer results are cast to the Spark types, doubles
are produced by the same operations in the same order.
"""

from __future__ import annotations

from traitgrid.functions.prompts import AGREEMENT_INTRO, RATING_PREFIX, RATING_SUFFIX, STATEMENT_CLOSE, STATEMENT_OPEN
from traitgrid.functions.files import RUN_FILE_RE
from traitgrid.functions.ratings import tie_rounds_up
from traitgrid.functions.text import PY_WHITESPACE, PY_WHITESPACE_CHARS, decimal_digit_table
from traitgrid.operators.grid import QUALIFIERS
from traitgrid.plans.fixtures import D6_MODELS
from traitgrid.schemas import GRID_TRAITS, TRAITS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(xs) -> str:
    return "[" + ", ".join(lit(x) for x in xs) + "]"


def strip(e: str) -> str:
    return f"trim({e}, {lit(PY_WHITESPACE_CHARS)})"


ALLOWED = "('1', '2', '3', '4', '5')"


def ascii_digits(e: str) -> str:
    src, dst = decimal_digit_table()
    return f"translate({e}, {lit(src)}, {lit(dst)})"


def digit_char(e: str) -> str:
    """One character, with a non-ASCII decimal digit mapped to ASCII (translate only then)."""
    return (f"CASE WHEN regexp_full_match({e}, '\\p{{Nd}}') AND NOT regexp_full_match({e}, '[0-9]') "
            f"THEN {ascii_digits(e)} ELSE {e} END")

NL = "chr(10)"

D1 = """d1 AS (SELECT l_returnflag AS model, CAST(1 + l_suppkey % 9 AS INTEGER) AS value, l_partkey AS item_id,
  CASE WHEN l_linenumber <= 5 THEN CAST(l_linenumber AS VARCHAR) ELSE 'N/A' END AS rating_text FROM lineitem)"""

D2 = f"""d2 AS (SELECT p_partkey AS item_id, 'I ' || lower(p_name) AS question,
  {lst(TRAITS)}[CAST(p_partkey % 5 AS INTEGER) + 1] AS trait,
  CASE WHEN p_partkey % 11 = 0 THEN CAST(0 AS DOUBLE) WHEN p_partkey % 2 = 0 THEN CAST(1 AS DOUBLE)
       ELSE CAST(-1 AS DOUBLE) END AS weight FROM part)"""

TRAIT_LIST = f"tl AS (SELECT unnest({lst(TRAITS)}) AS trait)"

SCORES = f"""runs AS (SELECT model, value, count(*) AS n_rows FROM d1 GROUP BY model, value),
sx AS (SELECT d1.model, d1.value, d2.trait,
    CASE WHEN d1.rating_text IN {ALLOWED} THEN
      CASE WHEN d2.weight = -1 THEN 6 - CAST(d1.rating_text AS INTEGER) ELSE CAST(d1.rating_text AS INTEGER) END
    END AS x
  FROM d1 JOIN d2 ON d1.item_id = d2.item_id WHERE d2.weight <> 0 AND NOT isnan(d2.weight)),
sm AS (SELECT model, value, trait, count(*) AS n_keyed, count(x) AS n_valid,
    CAST(sum(x) AS BIGINT) AS s1, CAST(sum(x * x) AS BIGINT) AS s2 FROM sx GROUP BY model, value, trait),
scores AS (SELECT r.model, r.value, tl.trait, r.n_rows,
    CAST(coalesce(sm.n_keyed, 0) AS BIGINT) AS n_keyed, CAST(coalesce(sm.n_valid, 0) AS BIGINT) AS n_valid,
    CAST(coalesce(sm.n_keyed, 0) - coalesce(sm.n_valid, 0) AS BIGINT) AS n_na,
    round_even(CAST(sm.s1 AS DOUBLE) / sm.n_valid * 100, 0) / 100 AS mean,
    round_even(sqrt(CAST(CAST(sm.n_valid AS HUGEINT) * sm.s2 - CAST(sm.s1 AS HUGEINT) * sm.s1 AS DOUBLE))
               / sm.n_valid * 100, 0) / 100 AS std
  FROM runs r CROSS JOIN tl LEFT JOIN sm ON sm.model = r.model AND sm.value = r.value AND sm.trait = tl.trait),
fscores AS (SELECT *, CASE WHEN n_valid > 0 THEN CAST(mean AS VARCHAR) || '+-' || CAST(std AS VARCHAR)
    ELSE 'N/A' END AS score FROM scores)"""

BASE = f"WITH {D1},\n{D2},\n{TRAIT_LIST},\n{SCORES}"

def python_round_ratio(num: str, den: str) -> str:
    """SQL twin of functions.ratings.python_round_ratio (digits=2)."""
    ties = tie_rounds_up(2, 10.0)
    table = lit("".join("1" if x else "0" for x in ties))
    a, b = f"(CAST({num} AS BIGINT) * 200)", f"CAST({den} AS BIGINT)"
    quot = f"({a} // {b})"
    k = f"(({quot} - 1) // 2)"
    tie = f"({a} % {b} = 0 AND {quot} % 2 = 1)"
    up = f"CASE WHEN {k} < {len(ties)} THEN substr({table}, CAST({k} + 1 AS INTEGER), 1) = '1' ELSE {k} % 2 = 1 END"
    return (f"CAST(CASE WHEN {tie} THEN {k} + CASE WHEN {up} THEN 1 ELSE 0 END "
            f"ELSE ({a} + {b}) // (2 * {b}) END AS DOUBLE) / CAST(100 AS DOUBLE)")


CARD = "card AS (SELECT model, value, " + ", ".join(
    f"max(CASE WHEN trait = {lit(t)} THEN score END) AS {t}" for t in TRAITS) + f""",
    max(n_rows) AS n_rows, CAST(sum(n_na) AS BIGINT) AS n_na, CAST(sum(n_na) AS DOUBLE) / max(n_rows) AS na_share,
    {python_round_ratio("sum(n_na)", "max(n_rows)")} AS na_share_rounded
  FROM fscores GROUP BY model, value)"""

DOSE = "dose AS (SELECT model, value, " + ", ".join(
    f"max(CASE WHEN trait = {lit(t)} THEN score END) AS {t}" for t in GRID_TRAITS) + \
    f" FROM fscores WHERE trait IN ({', '.join(lit(t) for t in GRID_TRAITS)}) GROUP BY model, value)"


def _markdown() -> str:
    cols = GRID_TRAITS
    widths = ", ".join(
        f"CAST(greatest({len(c) + 2}, max(length(coalesce({c}, ''))) OVER (PARTITION BY model)) AS INTEGER) AS w{j}"
        for j, c in enumerate(cols))
    head = " || ".join([f"'| ' || lpad('', wi, ' ') || ' |'"] +
                       [f"' ' || rpad({lit(c)}, w{j}, ' ') || ' |'" for j, c in enumerate(cols)])
    align = " || ".join(["'|' || repeat('-', wi + 1) || ':|'"] +
                        [f"':' || repeat('-', w{j} + 1) || '|'" for j in range(len(cols))])
    row = " || ".join(["'| ' || lpad(i, wi, ' ') || ' |'"] +
                      [f"' ' || rpad(coalesce({c}, ''), w{j}, ' ') || ' |'" for j, c in enumerate(cols)])
    return f"""{BASE},
{DOSE},
mw AS (SELECT *, CAST(value AS VARCHAR) AS i,
    CAST(greatest(2, max(length(CAST(value AS VARCHAR))) OVER (PARTITION BY model)) AS INTEGER) AS wi, {widths},
    row_number() OVER (PARTITION BY model ORDER BY value) AS rn FROM dose)
SELECT model, CAST(0 AS INTEGER) AS line_no, {head} AS line FROM mw WHERE rn = 1
UNION ALL SELECT model, CAST(1 AS INTEGER), {align} FROM mw WHERE rn = 1
UNION ALL SELECT model, CAST(rn + 1 AS INTEGER), {row} FROM mw"""


def _number(e: str) -> str:
    return f"CASE WHEN len(list_distinct(regexp_extract_all({e}, '\\p{{Nd}}+'))) = 1 " \
           f"THEN list_distinct(regexp_extract_all({e}, '\\p{{Nd}}+'))[1] END"


RESOLVED = f"""att AS (SELECT user_id AS item_id, ts, event_id, props AS response_text, value AS elapsed_s,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
att2 AS (SELECT *, {_number('response_text')} AS number FROM att WHERE n <= 10),
pick AS (SELECT item_id, min(n) FILTER (WHERE number IN {ALLOWED}) AS first_ok, max(n) AS last_n,
    count(*) AS n_calls FROM att2 GROUP BY item_id),
resolved AS (SELECT p.item_id, CAST(coalesce(p.first_ok, p.last_n) AS INTEGER) AS attempt,
    CAST(p.n_calls AS INTEGER) AS n_calls, a.response_text,
    CASE WHEN p.first_ok IS NOT NULL THEN a.number ELSE 'N/A' END AS rating_text, a.elapsed_s
  FROM pick p JOIN att2 a ON a.item_id = p.item_id AND a.n = coalesce(p.first_ok, p.last_n))"""


def _inventory() -> str:
    codes = lst(list("EACNO"))
    trait_case = "CASE code " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in
                                         zip("EACNO", TRAITS)) + " END"
    header_re = lit(r"^(\S+?):\s*(.*?)\s*\((?:Alpha\s*=\s*)?(\.\d+)\)\s*$")
    return f"""WITH it AS (SELECT CAST(p_partkey // 500 AS BIGINT) AS file_id, p_partkey // 50 AS chunk,
    CAST(p_partkey % 5 AS INTEGER) AS t, {codes}[CAST(p_partkey % 5 AS INTEGER) + 1] AS code,
    p_partkey % 2 = 0 AS plus, p_partkey AS k, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS item FROM part),
blk AS (SELECT file_id, chunk, t, code, plus,
    CASE WHEN plus THEN '+ keyed' ELSE '– keyed' END || chr(9) || string_agg(item, {NL} || ' ' || chr(9) ORDER BY k) AS block
  FROM it GROUP BY file_id, chunk, t, code, plus),
fac AS (SELECT file_id, chunk, t,
    concat_ws({NL} || {NL},
      code || CAST(chunk AS VARCHAR) || ': FACET ' || CAST(chunk AS VARCHAR) ||
        CASE WHEN chunk % 10 = 0 THEN ' (Alpha = .8' || CAST(chunk % 10 AS VARCHAR) || ')'
             ELSE ' (.8' || CAST(chunk % 10 AS VARCHAR) || ')' END || {NL} || max(CASE WHEN plus THEN block END),
      max(CASE WHEN NOT plus THEN block END)) AS facet_text
  FROM blk GROUP BY file_id, chunk, t, code),
d4 AS (SELECT file_id, string_agg(facet_text, {NL} || {NL} ORDER BY chunk, t) AS text FROM fac GROUP BY file_id),
b0 AS (SELECT file_id, generate_subscripts(arr, 1) AS block_no, unnest(arr) AS block
  FROM (SELECT file_id, string_split(text, {NL} || {NL}) AS arr FROM d4)),
b1 AS (SELECT file_id, block_no, regexp_split_to_array(block, 'keyed|\\n') AS segs,
    NOT contains(split_part(block, {NL}, 1), 'keyed') AS has_header FROM b0),
b2 AS (SELECT file_id, block_no,
    CASE WHEN has_header THEN segs[1] END AS header,
    CASE WHEN has_header THEN segs[2] ELSE segs[1] END AS sign_seg,
    CASE WHEN has_header THEN segs[3:] ELSE segs[2:] END AS lines FROM b1),
b3 AS (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY block_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS facet,
    CASE WHEN substr({strip('sign_seg')}, 1, 1) = '+' THEN 1 ELSE -1 END AS sign FROM b2),
l0 AS (SELECT file_id, block_no, facet, sign, generate_subscripts(lines, 1) AS line_no, unnest(lines) AS line FROM b3),
l1 AS (SELECT *, substr({strip('substr(facet, 1, 1)')}, 1, 1) AS code FROM l0
  WHERE regexp_replace(line, {lit(PY_WHITESPACE + '+')}, '', 'g') <> '')
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY block_no, line_no) - 1 AS INTEGER) AS item_no,
  {trait_case} AS trait, CAST(sign AS INTEGER) AS sign,
  regexp_extract(facet, {header_re}, 1) AS facet_code, regexp_extract(facet, {header_re}, 2) AS facet_name,
  'I ' || lower({strip('line')}) AS question
FROM l1"""


PERSONAS = f"""pe AS (SELECT t.trait, CAST(v.value AS INTEGER) AS value,
    CASE v.value {' '.join(f'WHEN {k} THEN {lit(q[0])}' for k, q in QUALIFIERS.items())} END AS qualifier_type,
    CASE v.value {' '.join(f'WHEN {k} THEN {lit(q[1])}' for k, q in QUALIFIERS.items())} END AS qualifier,
    'You score ' || CAST(v.value AS VARCHAR) || ' on ' || t.trait || '. ' AS description
  FROM tl t, (SELECT unnest(range(1, 10)) AS value) v)"""


def _grid(models: list[str], traits: list[str] | None = None, repetitions: int = 1) -> str:
    only = "" if traits is None else f" AND d2.trait IN ({', '.join(lit(t) for t in traits)})"
    return f"""grid AS (SELECT m.model, d2.trait, pe.value, CAST(r.repetition AS INTEGER) AS repetition, d2.item_id,
    d2.question, pe.description || {lit(RATING_PREFIX)} || d2.question || {lit(RATING_SUFFIX)} AS prompt
  FROM d2 JOIN pe ON d2.trait = pe.trait, (SELECT unnest({lst(models)}) AS model) m,
    (SELECT unnest(range(0, {repetitions})) AS repetition) r
  WHERE d2.weight <> 0 AND NOT isnan(d2.weight){only})"""


CELLS = f"""cells AS (SELECT m.model, t.trait, CAST(v.value AS INTEGER) AS value
  FROM (SELECT unnest({lst(['A', 'N', 'O', 'R'])}) AS model) m, (SELECT unnest({lst(GRID_TRAITS)}) AS trait) t,
       (SELECT unnest(range(1, 10)) AS value) v),
done AS (SELECT DISTINCT d1.model, d2.trait, d1.value FROM d1 JOIN d2 ON d1.item_id = d2.item_id
  WHERE d2.weight <> 0 AND NOT isnan(d2.weight))"""


D6 = f"""d6 AS (SELECT event_id,
    {lst(D6_MODELS)}[CAST(event_id % {len(D6_MODELS)} AS INTEGER) + 1] || '_' ||
    CASE WHEN event_id % 2 = 0 THEN '' ELSE 'Neuroticism' END || '_20250101_1200' ||
    lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || '.json' AS file_name, value AS level FROM events)"""

COHORT = """CASE WHEN contains(lower(file_name), '1.5b') AND (contains(lower(file_name), 'neuroticism')
      OR contains(lower(file_name), '__')) THEN
    CASE WHEN contains(lower(file_name), 'neuroticism') THEN 'neuroticism' ELSE 'base' END || '/' ||
    CASE WHEN contains(lower(file_name), 'grpo') THEN 'grpo' ELSE 'plain' END END"""


def _hist() -> str:
    def edge(j: str) -> str:
        return f"(CASE WHEN {j} = 5 THEN hi ELSE CAST({j} AS DOUBLE) * step + lo END)"
    return f"""WITH {D6},
v AS (SELECT {COHORT} AS cohort, CAST(level AS DOUBLE) AS x FROM d6),
v2 AS (SELECT * FROM v WHERE cohort IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)),
st AS (SELECT cohort, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi
  FROM (SELECT cohort, min(x) AS mn, max(x) AS mx FROM v2 GROUP BY cohort)),
st2 AS (SELECT *, (hi - lo) / CAST(5 AS DOUBLE) AS step FROM st),
b0 AS (SELECT v2.x, st2.*, CAST(floor((x - lo) / (hi - lo) * CAST(5 AS DOUBLE)) AS INTEGER) AS i0 FROM v2 JOIN st2 USING (cohort)),
b1 AS (SELECT *, CASE WHEN i0 >= 5 THEN 4 ELSE i0 END AS i1 FROM b0),
b2 AS (SELECT *, CASE WHEN x < {edge('i1')} THEN i1 - 1 ELSE i1 END AS i2 FROM b1),
b3 AS (SELECT *, CASE WHEN x >= {edge('(i2 + 1)')} AND i2 <> 4 THEN i2 + 1 ELSE i2 END AS bin FROM b2),
cnt AS (SELECT cohort, bin, count(*) AS n FROM b3 GROUP BY cohort, bin),
g AS (SELECT cohort, lo, hi, step, unnest(range(0, 5)) AS bin FROM st2)
SELECT g.cohort, CAST(g.bin AS INTEGER) AS bin, {edge('g.bin')} AS bin_lo, {edge('(g.bin + 1)')} AS bin_hi,
  CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM g LEFT JOIN cnt ON cnt.cohort = g.cohort AND cnt.bin = g.bin"""


def _run_names() -> str:
    re_ = lit(RUN_FILE_RE)
    model = f"CASE WHEN regexp_matches(file_name, {re_}) THEN regexp_extract(file_name, {re_}, 1) END"
    return f"""WITH {D6},
p AS (SELECT event_id, file_name, {model} AS model,
    CASE WHEN regexp_matches(file_name, {re_}) THEN regexp_extract(file_name, {re_}, 2) END AS trait,
    CASE WHEN regexp_matches(file_name, {re_}) THEN regexp_extract(file_name, {re_}, 3) END AS stamp,
    {COHORT} AS cohort FROM d6),
q AS (SELECT *, CASE WHEN starts_with(model, 'claude') THEN 'anthropic'
    WHEN contains(lower(model), 'hyperbolic') THEN 'hyperbolic' ELSE 'openai' END AS provider FROM p)
SELECT event_id, file_name, model, trait, stamp,
  strftime(try_strptime(stamp, '%Y%m%d_%H%M%S'), '%Y-%m-%d %H:%M:%S') AS run_ts, provider,
  CASE WHEN provider = 'hyperbolic' THEN regexp_replace(model, 'hyperbolic-', '') ELSE model END AS api_model,
  cohort
FROM q"""


D7 = f"""d7 AS (SELECT l_orderkey AS prompt_id, l_linenumber AS line_no, l_partkey AS part_id, l_suppkey AS supp_id,
    'Q' || CAST(l_orderkey AS VARCHAR) || ': rate it' || {NL} AS prompt,
    CASE l_partkey % 6 WHEN 0 THEN n WHEN 1 THEN ' ' || n WHEN 2 THEN '0' || n WHEN 3 THEN n || ' because'
      WHEN 4 THEN '<answer> ' || n || ' </answer>' ELSE 'so #### $1,' || CAST(l_partkey AS VARCHAR) END AS completion
  FROM (SELECT *, CAST(l_linenumber AS VARCHAR) AS n FROM lineitem))"""

REWARDS = f"""rw AS (SELECT *,
    CASE {digit_char(f"substr({strip('completion')}, 1, 1)")} WHEN '5' THEN CAST(1.0 AS DOUBLE) WHEN '4' THEN CAST(0.7 AS DOUBLE)
      WHEN '3' THEN CAST(0.2 AS DOUBLE) WHEN '2' THEN CAST(0.0 AS DOUBLE) WHEN '1' THEN CAST(-0.5 AS DOUBLE)
      ELSE CAST(-1.0 AS DOUBLE) END AS rating_reward,
    CASE WHEN coalesce(regexp_full_match(completion, '0*[1-5]'), false) THEN CAST(1.0 AS DOUBLE)
      WHEN coalesce(regexp_full_match(completion, '\\p{{Nd}}+'), false)
           AND regexp_full_match({ascii_digits('completion')}, '0*[1-5]') THEN CAST(1.0 AS DOUBLE)
      ELSE CAST(-0.5 AS DOUBLE) END AS format_reward FROM d7),
rw2 AS (SELECT *, CAST(1.0 AS DOUBLE) * rating_reward + CAST(0.2 AS DOUBLE) * format_reward AS reward FROM rw)"""

IDS7 = "prompt_id, line_no, part_id, supp_id"


def _collect_ctes(traits: list[str] | None = None) -> str:
    return f"""WITH {D2},
{TRAIT_LIST},
{PERSONAS},
{_grid(['A'], traits)},
a AS (SELECT g.*, t.attempt,
    CASE WHEN length(prompt) % 13 = 0 THEN 'no idea'
      ELSE 'I would say ' || CAST((length(prompt) + 3 * t.attempt) % 7 AS VARCHAR) END AS response_text
  FROM grid g, (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS attempt) t),
a2 AS (SELECT *, {_number('response_text')} AS number FROM a),
f AS (SELECT model, trait, value, repetition, item_id,
    min(attempt) FILTER (WHERE number IN {ALLOWED}) AS first_ok FROM a2 GROUP BY ALL),
resolved AS (SELECT a2.model, a2.trait, a2.value, a2.repetition, a2.item_id,
  CAST(coalesce(f.first_ok, 10) AS INTEGER) AS attempt, CAST(coalesce(f.first_ok, 10) AS INTEGER) AS n_calls,
  a2.response_text, CASE WHEN f.first_ok IS NOT NULL THEN a2.number ELSE 'N/A' END AS rating_text
  FROM a2 JOIN f USING (model, trait, value, repetition, item_id)
  WHERE a2.attempt = coalesce(f.first_ok, 10))"""


def _collect() -> str:
    return _collect_ctes() + "\nSELECT * FROM resolved"


def _experiment() -> str:
    return _collect_ctes(GRID_TRAITS) + f""",
ex AS (SELECT r.model, r.trait, r.value, r.repetition,
    CASE WHEN r.rating_text IN {ALLOWED} THEN
      CASE WHEN d2.weight = -1 THEN 6 - CAST(r.rating_text AS INTEGER) ELSE CAST(r.rating_text AS INTEGER) END
    END AS x
  FROM resolved r JOIN d2 ON r.item_id = d2.item_id AND r.trait = d2.trait WHERE d2.weight <> 0),
em AS (SELECT model, trait, value, repetition, count(*) AS n_keyed, count(x) AS n_valid,
    CAST(sum(x) AS BIGINT) AS s1, CAST(sum(x * x) AS BIGINT) AS s2 FROM ex GROUP BY ALL)
SELECT model, trait, value, repetition, n_keyed, n_valid, CAST(n_keyed - n_valid AS BIGINT) AS n_na,
  round_even(CAST(s1 AS DOUBLE) / n_valid * 100, 0) / 100 AS mean,
  round_even(sqrt(CAST(CAST(n_valid AS HUGEINT) * s2 - CAST(s1 AS HUGEINT) * s1 AS DOUBLE)) / n_valid * 100, 0) / 100 AS std
FROM em"""


def _local_prompts() -> str:
    tmpl = f"{lit(AGREEMENT_INTRO)} || {lit(STATEMENT_OPEN)} || question || {lit(STATEMENT_CLOSE)}"
    persona = ("(SELECT description FROM pe WHERE trait = 'Neuroticism' AND qualifier_type = 'high' "
               "AND qualifier = 'extremely' ORDER BY value LIMIT 1)")
    return f"""WITH {D2},
{TRAIT_LIST},
{PERSONAS}
SELECT 'baseline' AS run, item_id, {tmpl} AS prompt FROM d2
UNION ALL
SELECT 'Neuroticism', item_id, {persona} || chr(10) || {tmpl} FROM d2"""


SQL: dict[str, str] = {
    "trait_scores": f"""{BASE}
SELECT model, value, trait, n_keyed, n_valid, n_na, mean, std FROM scores""",
    "score_card": f"""{BASE},
{CARD}
SELECT * FROM card""",
    "score_parse_series": f"""{BASE},
{CARD},
u AS (UNPIVOT (SELECT model, value, {', '.join(TRAITS)} FROM card) ON {', '.join(TRAITS)} INTO NAME trait VALUE score)
SELECT model, value, trait, score, TRY_CAST(split_part(score, '+-', 1) AS DOUBLE) AS mean,
  TRY_CAST(split_part(score, '+-', 2) AS DOUBLE) AS std FROM u""",
    "dose_response_report": f"""{BASE},
{DOSE}
SELECT * FROM dose""",
    "report_markdown": _markdown(),
    "rating_counts": f"""WITH {D1}
SELECT model, value, rating_text, TRY_CAST(rating_text AS INTEGER) AS rating, count(*) AS n,
  CAST(sum(count(*)) OVER (PARTITION BY model, value) AS BIGINT) AS n_total
FROM d1 GROUP BY model, value, rating_text""",
    "target_mse": f"""{BASE}
SELECT model, value, count(*) AS n_traits, CAST(sum(d * d) AS DOUBLE) / count(*) AS mse
FROM (SELECT model, value, CAST((value + 1) / 2.0 AS DECIMAL(12,4)) - CAST(mean AS DECIMAL(12,4)) AS d
      FROM scores WHERE mean IS NOT NULL) GROUP BY model, value""",
    "key_unpivot": f"""WITH {D2},
{TRAIT_LIST}
SELECT d2.item_id, d2.question, tl.trait, CASE WHEN tl.trait = d2.trait THEN d2.weight ELSE CAST(0 AS DOUBLE) END AS weight
FROM d2 CROSS JOIN tl""",
    "key_one_hot": f"""WITH {D2}
SELECT item_id, question, """ + ", ".join(
        f"CASE WHEN trait = {lit(t)} THEN weight ELSE CAST(0 AS DOUBLE) END AS {t}" for t in TRAITS) + " FROM d2",
    "trait_item_subsets": f"""WITH {D2}
SELECT item_id, question, trait, weight FROM d2
WHERE weight <> 0 AND NOT isnan(weight) AND trait IN ({', '.join(lit(t) for t in GRID_TRAITS)})""",
    "extract_ratings": f"""WITH x AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '\\p{{Nd}}+')) AS d FROM documents),
y AS (SELECT doc_id, CAST(len(d) AS INTEGER) AS n_numbers, CASE WHEN len(d) = 1 THEN d[1] END AS number_extracted FROM x)
SELECT doc_id, n_numbers, number_extracted,
  CASE WHEN number_extracted IN {ALLOWED} THEN number_extracted ELSE 'N/A' END AS rating_text,
  CASE WHEN number_extracted IN {ALLOWED} THEN CAST(number_extracted AS INTEGER) END AS rating FROM y""",
    "resolve_attempts": f"""WITH {RESOLVED}
SELECT * FROM resolved""",
    "batch_timing": f"""WITH {RESOLVED}
SELECT (row_no - 1) // 20 AS batch, count(*) AS n_questions,
  CAST(sum(CAST(elapsed_s AS DECIMAL(18,6))) AS DOUBLE) AS sum_elapsed_s, max(elapsed_s) AS max_elapsed_s
FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS row_no FROM resolved) GROUP BY 1""",
    "inventory_items": _inventory(),
    "prompt_grid": f"""WITH {D2},
{TRAIT_LIST},
{PERSONAS},
{_grid(['A', 'N', 'R'], repetitions=2)}
SELECT * FROM grid""",
    "pending_cells": f"""WITH {D1},
{D2},
{CELLS}
SELECT c.* FROM cells c ANTI JOIN done d ON c.model = d.model AND c.trait = d.trait AND c.value = d.value""",
    "present_cells": f"""WITH {D1},
{D2},
{CELLS}
SELECT c.* FROM cells c SEMI JOIN done d ON c.model = d.model AND c.trait = d.trait AND c.value = d.value""",
    "collect_responses": _collect(),
    "chat_messages": f"""SELECT conv_id, turn, CAST(0 AS INTEGER) AS msg_pos, 'system' AS role, {lit(AGREEMENT_INTRO)} AS content
FROM conversations
UNION ALL
SELECT conv_id, turn, CAST(1 AS INTEGER), 'user', text FROM conversations""",
    "cohort_histogram": _hist(),
    "run_names": _run_names(),
    "train_eval_split": f"""WITH {D2},
t AS (SELECT item_id, {lit(STATEMENT_OPEN)} || question || {lit(STATEMENT_CLOSE)} AS question FROM d2
  WHERE trait = 'Neuroticism' AND weight = 1)
SELECT item_id, question, {lit(AGREEMENT_INTRO)} || question AS prompt, '5' AS answer,
  CASE WHEN item_id <= (SELECT max(item_id) FROM (SELECT item_id FROM t ORDER BY item_id LIMIT 16))
       THEN 'eval' ELSE 'train' END AS split
FROM t""",
    "completion_rewards": f"""WITH {D7},
{REWARDS}
SELECT {IDS7}, completion, rating_reward, format_reward, reward FROM rw2""",
    "group_advantage": f"""WITH {D7},
{REWARDS},
st AS (SELECT prompt_id, count(*) AS n, avg(reward) AS mu, stddev_samp(reward) AS sd FROM rw2 GROUP BY prompt_id)
SELECT {IDS7}, reward,
  round(CASE WHEN n > 1 THEN (reward - mu) / (sd + CAST(0.0001 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END, 6)
    + CAST(0 AS DOUBLE) AS advantage
FROM rw2 JOIN st USING (prompt_id)""",
    "answer_extract": f"""WITH {D7}
SELECT {IDS7}, {strip("string_split(string_split(completion, '<answer>')[-1], '</answer>')[1]")} AS xml_answer,
  CASE WHEN contains(completion, '####') THEN translate({strip("split_part(completion, '####', 2)")}, ',$', '') END AS hash_answer
FROM d7""",
    "local_prompts": _local_prompts(),
    "experiment_scores": _experiment(),
    "echo_strip": f"""WITH {D7},
e AS (SELECT *, {strip('substr(prompt || completion, length(prompt) + 1)')} AS reply FROM d7)
SELECT {IDS7}, reply, substr({strip('reply')}, 1, 1) AS first_char FROM e""",
}
SQL["live_trait_scores"] = SQL["trait_scores"]
SQL["result_tree_scores"] = f"""{BASE}
SELECT model, trait, value, n_keyed, n_valid, n_na, mean, std FROM scores WHERE n_keyed > 0"""
SQL["columns_json_roundtrip"] = SQL["key_one_hot"]
SQL["score_card_files"] = SQL["score_parse_series"]
SQL["persona_file_prompts"] = SQL["local_prompts"]
SQL["training_split_files"] = f"""SELECT question, prompt, answer, split FROM ({SQL["train_eval_split"]}) t
WHERE split = 'train'"""
SQL["resume_after_outage"] = SQL["experiment_scores"]
SQL["crash_between_writes"] = SQL["experiment_scores"]
SQL["card_cohort_histogram"] = _hist().replace("v AS (SELECT", """cards AS (SELECT file_name,
    round_even(CAST(sum(CAST(level AS DECIMAL(18,6))) AS DOUBLE) / count(*) * 100, 0) / 100 AS level FROM d6 GROUP BY file_name),
v AS (SELECT""", 1).replace("AS x FROM d6)", "AS x FROM cards)", 1)


SQL["card_union"] = f"""{BASE},
{CARD},
named AS (SELECT s.*, s.model || '_mixed_202501' || lpad(CAST(s.value AS VARCHAR), 2, '0') || '_120000.json' AS file_name, c.na_share_rounded AS na_share
  FROM fscores s JOIN card c ON s.model = c.model AND s.value = c.value),
kept AS (SELECT file_name, na_share, trait, score, mean, std FROM named WHERE value % 2 = 1 AND trait IN ('Extraversion', 'Agreeableness', 'Conscientiousness')
  UNION ALL SELECT file_name, na_share, trait, score, mean, std FROM named WHERE value % 2 = 0 AND trait IN ('Neuroticism', 'Openness')
  UNION ALL SELECT file_name, na_share, 'Honesty', score, mean, std FROM named WHERE value % 2 = 0 AND trait = 'Neuroticism')
SELECT file_name, na_share, trait, score, mean, std FROM kept"""

SQL["inventory_files"] = SQL["inventory_items"]
SQL["bucketed_advantage"] = SQL["group_advantage"]
SQL["run_file_list"] = f"""WITH r AS ({SQL["run_names"]})
SELECT DISTINCT file_name, model, trait FROM r"""
SQL["listed_cells"] = SQL["present_cells"]
SQL["any_reply"] = f"""WITH att AS (SELECT user_id AS item_id, props AS response_text, value AS elapsed_s,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events),
f AS (SELECT *, {_number('response_text')} AS number FROM att WHERE n = 1)
SELECT item_id, CAST(1 AS INTEGER) AS attempt, CAST(least(c, 10) AS INTEGER) AS n_calls, response_text,
  CASE WHEN number IN {ALLOWED} THEN number ELSE 'N/A' END AS rating_text, elapsed_s FROM f"""
SQL["parsed_experiment"] = f"""WITH {D2},
{TRAIT_LIST},
{PERSONAS},
{_grid(['A'], ['Openness'])},
a AS (SELECT g.*, t.attempt, CAST((length(prompt) + 3 * t.attempt) % 7 AS VARCHAR) AS digit
  FROM grid g, (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS attempt) t),
f AS (SELECT model, trait, value, repetition, item_id, coalesce(min(attempt) FILTER (WHERE digit IN {ALLOWED}), 10) AS attempt FROM a GROUP BY ALL)
SELECT a.model, a.trait, a.value, a.repetition, a.item_id, a.attempt, a.attempt AS n_calls, ' ' || digit || ' of 9' AS response_text,
  CASE WHEN digit IN {ALLOWED} THEN digit ELSE 'N/A' END AS rating_text
FROM a JOIN f USING (model, trait, value, repetition, item_id, attempt)"""
SQL["split_by_trait"] = f"""WITH {D2}
SELECT trait, item_id, question, CASE WHEN row_number() OVER (PARTITION BY trait ORDER BY item_id) <= 16 THEN 'eval' ELSE 'train' END AS split
FROM d2 WHERE weight = 1"""
SQL["target_table_mse"] = f"""{BASE},
t AS (SELECT *, CAST(value AS DOUBLE) / 2.0 AS target FROM scores WHERE trait IN ({', '.join(lit(t) for t in GRID_TRAITS)}) AND mean IS NOT NULL)
SELECT model, value, count(*) AS n_traits,
  CAST(sum((CAST(target AS DECIMAL(18,6)) - CAST(mean AS DECIMAL(18,6))) * (CAST(target AS DECIMAL(18,6)) - CAST(mean AS DECIMAL(18,6)))) AS DOUBLE) / count(*) AS mse
FROM t GROUP BY model, value"""
SQL["mixed_rewards"] = f"""WITH {D7},
{REWARDS},
m AS (SELECT *, CAST(2 AS DOUBLE) - CAST(0.125 AS DOUBLE) * length(completion) - CAST(0.25 AS DOUBLE) * line_no AS brevity,
    CAST(length(regexp_replace(completion, '[^0-9]', '', 'g')) AS DOUBLE) AS digits FROM rw2)
SELECT {IDS7}, rating_reward, format_reward, brevity, digits,
  reward + CAST(0.5 AS DOUBLE) * brevity + CAST(-0.25 AS DOUBLE) * digits AS reward FROM m"""
