"""DuckDB SQL for the queries that SQL can express, by name."""

from __future__ import annotations

from inkwell import queries_exercises, queries_fleet, queries_structure
from inkwell.functions import fixed
from inkwell.operators.cards import KINDS, SCAFFOLDING
from inkwell.sources.adapters import TYPES

ORACLES: dict[str, str] = {}


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _map(values: dict[str, int], default: str) -> str:
    return "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"


def collapse(c: str) -> str:
    return rf"regexp_replace(lower({strip(c)}), '[ \t\n\x0B\f\r]+', ' ', 'g')"


def words(c: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower(regexp_replace(regexp_replace({c}, '\\[a-zA-Z]+\*?(\[[^\]]*\])?', ' ', 'g'), '[{{}}]', ' ', 'g')), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 1)"


CARDS = f"""
cards AS (
  SELECT d.source AS collection, d.doc_id AS ord, 'C-' || (d.doc_id % 700)::VARCHAR AS id,
         {_list(TYPES)}[d.doc_id % {len(TYPES)} + 1] AS type, split_part(d.text, chr(10), 1) AS front, d.text AS back,
         'L-' || l.quality::VARCHAR AS los_id
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

MARKED = f"""{CARDS},
marked AS (
  SELECT * REPLACE (CASE ord % 14
    WHEN 0 THEN back WHEN 1 THEN '' WHEN 2 THEN '...   ;;;' WHEN 3 THEN 'TODO: fill in' WHEN 4 THEN front WHEN 5 THEN 'Cut off here...'
    WHEN 6 THEN '**Approach:** think.' || chr(10) || '**Answer:** See solution above.' WHEN 7 THEN 'see Chapter 3.'
    WHEN 8 THEN '<b>Note</b> ' || back WHEN 9 THEN '**Core Insight:** ' || back || chr(10) || '**Why It Matters:** ' || front
    WHEN 10 THEN 'Self-check from: Module 1 Checkpoint' || chr(10) || chr(10) || '(Answer from memory, then verify against the chapter text.)'
    WHEN 11 THEN back || '?' WHEN 12 THEN '```python' || chr(10) || front || chr(10) || '```'
    ELSE '**Step 1:** a 1. Bee 2. Cee (a) x - Dee; e; f' || chr(10) || '**Key Insight:** ' || back || chr(10) || '**Answer:** ' || front END AS back)
  FROM cards
)"""

LINES = """
split AS (SELECT source AS collection, doc_id AS ord, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT collection, ord, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM split)"""

TERMS = f"""{LINES},
terms AS (
  SELECT collection, ord, line_no, lower(regexp_replace(split_part(line, ' ', 1), '[^A-Za-z]', '', 'g')) AS name,
         substr(line, strpos(line, ' ') + 1) AS definition
  FROM lines WHERE contains(line, ' ')
), named AS (SELECT * FROM terms WHERE name <> '')"""

ELEMENTS = r"""
li AS (SELECT l_orderkey AS doc, l_linenumber AS n, l_partkey AS k, l_returnflag AS f FROM lineitem)"""

ORACLES["card_quality_by_collection"] = f"""
WITH {CARDS}, q AS (
  SELECT collection, count(*) AS n_cards, count(*) FILTER (length(back) < 50) AS n_thin,
    count(*) FILTER (length(back) >= 50 AND length(back) < 200) AS n_moderate, count(*) FILTER (length(back) >= 200) AS n_rich,
    count(*) FILTER (contains(back, '\\begin{{figure}}') OR contains(back, '\\begin{{tikzpicture}}') OR contains(back, '\\includegraphics') OR contains(back, '\\cite{{') OR contains(back, '\\ref{{')) AS n_broken,
    count(los_id) AS n_with_los, sum(length(front))::BIGINT AS front_chars, sum(length(back))::BIGINT AS back_chars,
    count(*) FILTER (type = 'term') AS n_terms, count(*) - count(DISTINCT id) AS n_duplicate_ids
  FROM cards GROUP BY 1
), p AS (
  SELECT *, (n_thin * 100 <= n_cards * 5)::INT + (n_broken = 0)::INT + (n_with_los * 100 >= n_cards * 30)::INT + (n_terms * 100 < n_cards * 60)::INT + (n_rich * 2 >= n_cards)::INT AS points FROM q
)
SELECT *, CASE WHEN points >= 4 THEN 'PASS' WHEN points >= 3 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM p"""

ORACLES["id_collisions"] = f"""
WITH {CARDS}, g AS (SELECT id, count(*) AS n, count(DISTINCT collection) AS n_collections, min(ord) AS first_ord FROM cards GROUP BY id)
SELECT *, CASE WHEN n_collections > 1 THEN 'across' ELSE 'within' END AS scope FROM g WHERE n > 1"""

ORACLES["dedup_keep_first"] = f"WITH {CARDS} SELECT ord, id, collection FROM cards QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1"

ORACLES["counter_ids"] = f"""
WITH {CARDS}, r AS (SELECT ord, id, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM cards)
SELECT ord, CASE WHEN n = 1 THEN id ELSE id || '_' || n::VARCHAR END AS unique_id FROM r"""


def _slug(c: str) -> str:
    return rf"substr(upper(regexp_replace({strip(rf"regexp_replace({c}, '[^a-zA-Z0-9\s]', '', 'g')")}, '\s+', '_', 'g')), 1, 50)"


ORACLES["card_id_assignment"] = f"""
WITH {CARDS}, t AS (SELECT ord, collection, substr(front, 1, 12) AS title, front AS body, los_id FROM cards),
s AS (SELECT *, {_slug("title")} AS a, {_slug("body")} AS b, {_slug("coalesce(los_id, '')")} AS c, md5(title || body) AS h FROM t),
i AS (SELECT ord, h, collection || '_' || CASE WHEN length(a) >= 4 THEN a WHEN length(b) >= 8 THEN b WHEN length(c) >= 4 THEN c ELSE 'H' || upper(substr(h, 1, 8)) END AS base FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ord) AS k FROM i)
SELECT ord, CASE WHEN k = 1 THEN base ELSE base || '_H' || substr(h, 1, 6) END AS card_id FROM n"""

ORACLES["guid_assignment"] = f"WITH {CARDS} SELECT ord, ('0x' || substr(sha256('deck_' || id), 1, 10))::BIGINT AS guid, substr(md5(id), 1, 10) AS short_guid FROM cards"
ORACLES["deck_notes"] = f"WITH {CARDS} SELECT 'deck::' || regexp_extract(collection, '(\\d+)$', 1) AS deck, ('0x' || substr(sha256('deck_' || id), 1, 10))::BIGINT AS guid, id, type FROM cards"
ORACLES["cards_by_type"] = f"""
WITH {CARDS}, g AS (SELECT collection, type, count(*) AS n FROM cards GROUP BY ALL)
SELECT collection, sum(n)::BIGINT AS total, string_agg(type || '=' || n::VARCHAR, ',' ORDER BY type) AS by_type FROM g GROUP BY 1"""


def _header(name: str) -> str:
    name = name.replace(" ", r"\s+")
    return rf"(?:\*\*\s*{name}\s*[:.]?\s*\*\*|<b>\s*{name}\s*[:.]?\s*</b>|<strong>\s*{name}\s*[:.]?\s*</strong>|(?:^|\n)\s*{name}\s*:)"


def _has(c: str, *names: str) -> str:
    return f"regexp_matches({c}, {_q('(?i)' + '|'.join(_header(n) for n in names))})"


def _code(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '(?s)```[a-zA-Z]*\n.*?\n```', '', 'g'), '`[^`]+`', '', 'g')"


_ALNUM = r"regexp_replace({}, '[^\p{{L}}\p{{N}}]', '', 'g')"
_TODO = r"(?i)\b(?:TODO|TBD|FIXME|PLACEHOLDER|XXX)\b"
_EVASIVE = r"(?i)(?:see\s+(?:Chapter|Module|§)|refer\s+to)\b"
_ANY = r"(?:\*\*\s*[A-Z][^*\n]{1,40}\s*[:.]\s*\*\*|<b>\s*[A-Z][^<\n]{1,40}\s*[:.]\s*</b>|<strong>\s*[A-Z][^<\n]{1,40}\s*[:.]\s*</strong>|(?:^|\n)\s*[A-Z][A-Za-z][A-Za-z\s/()''-]{1,40}\s*:\s+\S)"
_STUBS = " OR ".join(f"contains(sa, '{s}')" for s in fixed.ANSWER_STUBS)

_BACK_CONDITIONS = {
    "C1": "type NOT IN ('cloze', 'clozeterm') AND length(bare) = 0",
    "C2": f"type NOT IN ('cloze', 'clozeterm') AND length(bare) > 0 AND length({_ALNUM.format('back')}) = 0",
    "C3": f"length(bare) > 0 AND CASE WHEN length(core) = 0 THEN regexp_matches(back, {_q(_TODO)}) ELSE regexp_matches(prose, {_q(_TODO)}) AND length(core) < 40 END",
    "C4": "type NOT IN ('cloze', 'clozeterm', 'term', 'termbi') AND length(nf) >= 20 AND length(nb) >= 20 AND (nf = nb OR len(list_intersect(bf, bb)) >= 0.85 * len(list_distinct(list_concat(bf, bb))))",
    "C5": r"regexp_matches(back, '\.\.\.\s*$') AND length(regexp_replace(back, '[ \t\n\x0B\f\r]+$', '')) < least_",
    "H1": "type NOT IN ('cloze', 'clozeterm') AND length(bare) > 0 AND length(bare) < least_",
    "H2": f"type = 'keyconcept' AND length(back) > 0 AND NOT ({_has('back', 'Core Insight')} AND {_has('back', 'Why It Matters', 'Decision Rule', 'When It Breaks')}) AND len(list_distinct(list_transform(regexp_extract_all(back, '{_ANY}'), lambda h: lower({strip('h')})))) < 2",
    "H3": rf"type = 'formula' AND length(back) > 0 AND NOT ((regexp_matches(back, '(?s)\\\(.*?\\\)|\\\[.*?\\\]|\$\$.*?\$\$') OR regexp_matches(back, '\$[^$\n]+\$')) AND {_has('back', 'Variables?', 'When to Use', 'Intuition')})",
    "H4": rf"type = 'drill' AND length(back) > 0 AND NOT (regexp_matches(back, '(?:^|\n)\s*[A-D]\.\s+\S') AND regexp_matches(back, '(?i)\*\*[A-D]\.\s+[^*]+\*\*|<b>\s*[A-D]\.\s+[^<]+</b>')) AND NOT {_has('back', 'Answer')}",
    "H5": r"type IN ('comparison', 'comparison3') AND length(back) > 0 AND NOT regexp_matches(back, '(?m)^\s*\|[\s\-:|]+\|\s*$')",
    "H6": f"type IN ('problem', 'vignette', 'drill') AND length(answer) <= 80 AND ({_STUBS})",
    "M1": r"length(bare) > 0 AND length(prose) = 0 AND regexp_matches(back, '(?s)```[a-zA-Z]*\n.*?\n```')",
    "M2": r"suffix(regexp_replace(back, '[ \t\n\x0B\f\r]+$', ''), '?')",
    "M3": "length(before_) < 80 AND len(regexp_extract_all(before_, '[A-Za-z0-9_]+')) < 12 AND length(after_) <= 20",
    "M4": r"regexp_matches(back, '(?i)\\textcolor\{|<font\b|<span\s+style|<i>|<b>')",
    "M5": r"regexp_matches(bare, '^\s*Self-check from:[^\n]*\n\s*\(Answer from memory, then verify against the chapter text\.\)\s*$|^\s*\(Answer from memory, then read the section to check\.\)\s*$')",
    "I1": "length(bare) > split_",
}
_BACK_RULES = f"""{MARKED},
b0 AS (
  SELECT ord, collection, type, front, back, {strip('back')} AS bare, {strip(_code('back'))} AS prose, {_map(fixed.LEAST_BACK, str(fixed.DEFAULT_LEAST))} AS least_,
    {_map(fixed.SPLIT_BACK, 'NULL')} AS split_, {collapse('front')} AS nf, {collapse('back')} AS nb,
    CASE WHEN {_has('back', 'Answer')} THEN {strip("regexp_replace(regexp_replace(back, " + _q('(?is)^.*?' + _header('Answer')) + ", ''), '(?s)(?:" + r"\*\*\s*[A-Z][^*\n]{1,40}\s*[:.]?\s*\*\*|<b>\s*[A-Z][^<\n]{1,40}\s*[:.]?\s*</b>|\\end\{solution\}" + ").*$', '')")} END AS answer,
    CASE WHEN regexp_matches(back, {_q(_EVASIVE)}) THEN {strip(_code("regexp_extract(back, " + _q('(?is)^(.*?)' + _EVASIVE[4:]) + ", 1)"))} END AS before_,
    CASE WHEN regexp_matches(back, {_q(_EVASIVE)}) THEN regexp_replace({strip("regexp_replace(back, " + _q('(?is)^.*?' + _EVASIVE[4:]) + ", '')")}, '^[\\s\\d.,;:§\\-–—]+', '') END AS after_
  FROM marked
), b1 AS (
  SELECT *, {_ALNUM.format('prose')} AS core, lower(regexp_replace(answer, '^[ .,;:]+|[ .,;:]+$', '', 'g')) AS sa,
    CASE WHEN length(nf) >= 20 AND length(nb) >= 20 THEN list_distinct(list_transform(list_zip(string_split(nf, '')[:-2], string_split(nf, '')[2:]), lambda p: p[1] || p[2])) END AS bf,
    CASE WHEN length(nf) >= 20 AND length(nb) >= 20 THEN list_distinct(list_transform(list_zip(string_split(nb, '')[:-2], string_split(nb, '')[2:]), lambda p: p[1] || p[2])) END AS bb
  FROM b0
), found AS (
  {" UNION ALL ".join(f"SELECT ord, collection, type, '{k}' AS rule, '{fixed.BACK_SEVERITY[k]}' AS severity FROM b1 WHERE {c}" for k, c in _BACK_CONDITIONS.items())}
)"""
ORACLES["back_rules"] = f"WITH {_BACK_RULES} SELECT ord, type, rule, severity FROM found"
ORACLES["back_rules_by_severity"] = f"WITH {_BACK_RULES} SELECT collection, severity, rule, count(*) AS n FROM found GROUP BY ROLLUP (collection, severity, rule)"
ORACLES["critical_top"] = f"WITH {_BACK_RULES} SELECT collection, count(*) AS n FROM found WHERE severity IN ('critical', 'high') GROUP BY 1 ORDER BY n DESC, collection LIMIT 10"

_TURNS = """
t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS answer, lead(turn) OVER w AS answer_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT * FROM t WHERE role = 'user' AND nr = 'assistant')"""
ORACLES["nearest_following_answer"] = f"WITH {_TURNS} SELECT conv_id, turn, answer_turn FROM pairs"
ORACLES["positional_pairing"] = """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)
SELECT q.conv_id, q.k, q.turn AS question_turn, a.turn AS answer_turn FROM (SELECT * FROM k WHERE role = 'user') q LEFT JOIN (SELECT * FROM k WHERE role = 'assistant') a USING (conv_id, k)"""


def _bigrams(c: str) -> str:
    return f"list_distinct(list_transform(list_zip(string_split({c}, '')[:-2], string_split({c}, '')[2:]), lambda p: p[1] || p[2]))"


ORACLES["front_back_similarity"] = f"""
WITH {_TURNS}, n AS (SELECT conv_id, turn, {collapse('text')} AS q, {collapse('answer')} AS a FROM pairs), g AS (SELECT conv_id, turn, {_bigrams('q')} AS x, {_bigrams('a')} AS y FROM n)
SELECT conv_id, turn, len(list_intersect(x, y))::INT AS "both", len(list_distinct(list_concat(x, y)))::INT AS either FROM g"""

_EXCLUDED = " OR ".join(f"regexp_matches({s}, {_q(p)})" for s in ("front", "back") for p in fixed.PRESENTATION_EXCLUDED)


def _presentation(side: str) -> dict[str, tuple[str, str]]:
    lines_ = f"string_split({side}, chr(10))"
    body = r"regexp_replace(l, '^[\s\-]+', '')"
    return {
        "run_on_numbered": ("P1", rf"regexp_matches({side}, '\S[^\n]*[ \t][1-9]\.\s+[A-Z]')"),
        "run_on_lettered": ("P1", rf"regexp_matches({side}, '\S[^\n]*[ \t]\([a-z]\)[ \t]+')"),
        "run_on_bullets": ("P1", rf"len(list_filter({lines_}, lambda l: regexp_matches({body}, '^.[^\n]* - [A-Z]') AND NOT regexp_matches(substr({body}, strpos(substr({body}, 2), ' - '), 1), '[\])|0-9}}]'))) > 0"),
        "wall_of_text": ("P2", rf"len(list_filter(string_split_regex({side}, '\n\s*\n'), lambda p: length({strip('p')}) > 500)) > 0"),
        "very_long_line": ("P2", f"len(list_filter({lines_}, lambda l: length({strip('l')}) > 200)) > 0"),
        "comma_list": ("P2", rf"regexp_matches({side}, '(?:[^,\n]{{1,30}},){{5}}')"),
        "semicolon_list": ("P3", f"regexp_matches({side}, '[^;]+;[^;]+;')"),
    }


ORACLES["presentation_issues"] = f"WITH {MARKED}, kept AS (SELECT * FROM marked WHERE NOT ({_EXCLUDED})) " + " UNION ALL ".join(
    f"SELECT ord, '{s}' AS side, '{k}' AS rule, '{p}' AS severity FROM kept WHERE {c}" for s in ("front", "back") for k, (p, c) in _presentation(s).items()
)


def _section(*names: str) -> str:
    n = "|".join(names)
    return rf"(?im)(?:\*\*(?:{n})\s*:?\s*\*\*|^\s*[-•]\s*(?:{n})\s*:|(?:{n})\s*:)"


ORACLES["solution_class"] = f"""
WITH {MARKED}, s AS (
  SELECT ord, type, length({strip('back')}) AS n, type = 'problem' AS p, NOT regexp_matches(back, {_q(_section('Key\\s+Insight[s]?'))}) AS ni, NOT regexp_matches(back, {_q(_section('Answer'))}) AS na,
    NOT regexp_matches(back, {_q(_section('Approach'))}) AS nap,
    NOT regexp_matches(back, '(?i)\\*\\*(?:Answer\\s*Rubric|Answer|Rubric|Solution|Response)\\s*:?\\s*\\*\\*|(?:^|\\n)\\s*(?:Answer\\s*Rubric|Answer|Rubric)\\s*:') AS nr
  FROM marked WHERE type IN ('problem', 'vignette')
), c AS (
  SELECT ord, type, (n < 50)::INT AS errors,
    ((p AND ni AND n > 300)::INT + (p AND na AND n > 300)::INT + (NOT p AND nr AND n > 300)::INT + (p AND n >= 50 AND n < 150)::INT) AS warnings,
    ((p AND ni AND n <= 300)::INT + (p AND na AND n <= 300)::INT + (NOT p AND nr AND n <= 300)::INT + (p AND nap)::INT + (n > 2000)::INT) AS notes FROM s
)
SELECT *, CASE WHEN errors > 0 OR warnings >= 3 THEN 'deficient' WHEN warnings > 0 OR notes > 0 THEN 'partial' ELSE 'complete' END AS class FROM c"""

ORACLES["atomicity_class"] = f"""
WITH {MARKED}, a AS (
  SELECT ord, type,
    CASE type WHEN 'problem' THEN len(regexp_extract_all(back, '\\*\\*Step\\s+\\d+')) > 5 WHEN 'vignette' THEN len(regexp_extract_all(back, '(?:\\*\\*Q\\d+|\\*\\*Question\\s+\\d+|\\bQuestion\\s+\\d+:)')) > 4
      WHEN 'keyconcept' THEN len(regexp_extract_all(back, '\\*\\*[A-Z][^*]+:\\*\\*')) > 4 ELSE false END AS many_parts,
    type IN ({", ".join(f"'{t}'" for t in fixed.ATOMIC_TYPES)}) AND length(back) > {_map(fixed.ATOMIC_BACK, str(fixed.ATOMIC_BACK_DEFAULT))} AS too_long FROM marked
)
SELECT *, CASE many_parts::INT + too_long::INT WHEN 0 THEN 'atomic' WHEN 1 THEN 'borderline' ELSE 'compound' END AS class FROM a"""

ORACLES["staleness_findings"] = """
WITH l AS (
  SELECT p_partkey AS ord, ['gpt-4-turbo', 'Llama 2', 'claude-3-opus', 'langchain>=0.1.5', 'gemini 1.5', 'nothing', '% gpt-3.5-turbo'][p_partkey % 7 + 1] || ' is used for ' || p_name || CASE WHEN p_size > 40 THEN ' % freshness-ok' ELSE '' END AS line FROM part
), live AS (SELECT * FROM l WHERE NOT starts_with(ltrim(line), '%') AND NOT contains(line, '\\warningmargin{') AND NOT contains(line, '% freshness-ok'))
""" + " UNION ALL ".join(f"SELECT ord, 'S{k + 1:02d}' AS rule, '{s}' AS severity FROM live WHERE regexp_matches(line, {_q('(?i)' + p)})" for k, (p, _, s) in enumerate(fixed.STALE))

_NOTES = r"""
li AS (SELECT l_orderkey AS doc, l_linenumber AS n, l_partkey AS k FROM lineitem WHERE l_linenumber % 4 = 3),
notes AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY n, k::VARCHAR || '}') - 1 AS ord, 'Key pattern from ' || k::VARCHAR AS base FROM li),
m AS (SELECT doc, ord, base || CASE WHEN ord = 1 THEN ' which is avoided when possible, and be careful' ELSE '' END AS note FROM notes)"""
ORACLES["margin_quality"] = f"""WITH {_NOTES}
SELECT doc, ord::INT AS ord, 'generic_2' AS rule, 'generic' AS severity FROM m WHERE regexp_matches(lower(note), '\\bbe careful\\b')
UNION ALL SELECT doc, ord::INT, 'template', 'template' FROM m WHERE NOT regexp_matches(note, {_q(fixed.MARGIN_VERBS)}) AND regexp_matches(note, {_q(fixed.MARGIN_TEMPLATES[1])})"""

ORACLES["density_status"] = f"""
WITH {LINES}, n AS (SELECT collection, ord, count(*) AS n FROM lines GROUP BY ALL),
d AS (SELECT collection, count(*) AS n_docs, count(*) FILTER (n < CASE WHEN ord % 2 = 0 THEN 8 ELSE 5 END) AS n_below FROM n GROUP BY 1)
SELECT *, CASE WHEN n_below * 100 <= n_docs * 15 THEN 'GREEN' WHEN n_below * 100 <= n_docs * 40 THEN 'YELLOW' ELSE 'RED' END AS status FROM d"""

ORACLES["leading_repeats"] = f"""
WITH {LINES}, s AS (SELECT ord, line_no, regexp_replace(line, '[.,]', '', 'g') AS t FROM lines),
w AS (SELECT ord, line_no, regexp_extract(t, '^\\s*([A-Za-z]+)\\s+([A-Za-z]+)(?:[^A-Za-z-]|$)', 1) AS a, regexp_extract(t, '^\\s*([A-Za-z]+)\\s+([A-Za-z]+)(?:[^A-Za-z-]|$)', 2) AS b FROM s)
SELECT ord, line_no::INT AS line_no FROM w WHERE a <> '' AND lower(a) = lower(b)"""

_CLONES = f"{LINES}, c AS (SELECT collection, ord, {collapse('line')} AS clone FROM lines)"
ORACLES["clone_groups"] = f"WITH {_CLONES} SELECT collection, clone, count(*) AS n, count(DISTINCT ord) AS n_docs FROM c WHERE clone <> '' GROUP BY ALL HAVING count(*) >= 2"
ORACLES["clone_rate"] = f"""
WITH {_CLONES}, g AS (SELECT collection, clone, count(*) AS n FROM c WHERE clone <> '' GROUP BY ALL),
r AS (SELECT collection, sum(n)::BIGINT AS n_notes, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS n_cloned FROM g GROUP BY 1)
SELECT *, n_cloned > 0.30 * n_notes AS flagged FROM r"""

_SUFFIX = f"w AS (SELECT source AS collection, doc_id AS ord, {words('text')} AS ws FROM documents), s AS (SELECT collection, ord, CASE WHEN len(ws) >= 10 THEN array_to_string(ws[-10:], ' ') END AS suffix FROM w)"
ORACLES["shared_suffix_clusters"] = f"WITH {_SUFFIX} SELECT collection, suffix, count(*) AS n FROM s WHERE suffix IS NOT NULL GROUP BY ALL HAVING count(*) >= 2"
ORACLES["suffix_frequency"] = f"WITH {_SUFFIX} SELECT suffix, count(*) AS n, count(DISTINCT collection) AS n_collections FROM s WHERE suffix IS NOT NULL GROUP BY ALL HAVING count(DISTINCT collection) >= 2"

_PROMPTS = f"""
p AS (SELECT source AS collection, doc_id AS ord, doc_id % 40 AS los_id, CASE WHEN doc_id % 5 = 0 THEN text || ' ' || {_list(fixed.KNOWN_TAILS)}[doc_id % 9 + 1] ELSE text END AS t FROM documents),
w AS (SELECT *, {words('t')} AS ws FROM p), s AS (SELECT *, CASE WHEN len(ws) >= 10 THEN array_to_string(ws[-10:], ' ') END AS suffix FROM w),
c AS (SELECT collection, suffix, count(*) AS n FROM s WHERE suffix IS NOT NULL GROUP BY ALL),
b AS (SELECT item_id, {words('text')} AS bw FROM benchmark),
r AS (
  SELECT ord, list_filter([CASE WHEN list_contains({_list(fixed.KNOWN_TAILS)}, s.suffix) THEN 'known-tail' END, CASE WHEN c.n >= 2 THEN 'shared-suffix(x' || c.n::VARCHAR || ')' END,
    CASE WHEN len(bw) >= 3 AND contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || array_to_string(bw, ' ') || ' ') THEN 'verbatim-los' END], lambda x: x IS NOT NULL) AS rs
  FROM s LEFT JOIN c ON s.collection = c.collection AND s.suffix = c.suffix LEFT JOIN b ON b.item_id = s.los_id
), found AS (SELECT ord, array_to_string(rs, ',') AS reason FROM r WHERE len(rs) > 0)"""
ORACLES["templated_prompts"] = f"WITH {_PROMPTS} SELECT * FROM found"
ORACLES["reason_tally"] = f"WITH {_PROMPTS}, k AS (SELECT unnest(string_split(reason, ',')) AS r FROM found) SELECT regexp_replace(r, '\\(.*$', '') AS kind, count(*) AS n FROM k GROUP BY 1"
ORACLES["verbatim_runs"] = f"""
WITH d AS (SELECT doc_id AS ord, ' ' || array_to_string({words('text')}, ' ') || ' ' AS t FROM documents), b AS (SELECT item_id AS run_id, {words('text')} AS bw FROM benchmark)
SELECT ord, run_id FROM d, b WHERE len(bw) >= 8 AND contains(t, ' ' || array_to_string(bw, ' ') || ' ')"""

ORACLES["near_fronts"] = f"""
WITH {CARDS}, f AS (SELECT collection, {collapse('front')} AS norm, min(ord) AS ord FROM cards WHERE length({collapse('front')}) >= 20 GROUP BY ALL), w AS (SELECT *, list_distinct(string_split(norm, ' ')) AS ws FROM f),
p AS (SELECT a.collection, a.ord AS ord_a, b.ord AS ord_b, len(list_intersect(a.ws, b.ws))::INT AS "both", len(list_distinct(list_concat(a.ws, b.ws)))::INT AS either FROM w a JOIN w b ON a.collection = b.collection AND a.ord < b.ord)
SELECT * FROM p WHERE "both" * 100 >= either * 85"""

ORACLES["term_clusters"] = f"""
WITH {TERMS}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY length(definition) DESC, ord, line_no) AS k FROM named)
SELECT name, count(*) AS n, count(DISTINCT collection) AS n_collections, max(ord) FILTER (k = 1) AS canonical_ord, (max(line_no) FILTER (k = 1))::INT AS canonical_line FROM r GROUP BY 1"""
ORACLES["term_within_duplicates"] = f"WITH {TERMS} SELECT collection, name, count(*) AS n FROM named GROUP BY ALL HAVING count(*) > 1"
ORACLES["term_conflicts"] = f"""
WITH {TERMS}, r AS (SELECT *, row_number() OVER (PARTITION BY name, collection ORDER BY ord, line_no) AS k FROM named), f AS (SELECT name, collection, list_distinct(string_split({collapse('definition')}, ' ')) AS ws FROM r WHERE k = 1),
p AS (SELECT a.name, a.collection AS collection_a, b.collection AS collection_b, len(list_intersect(a.ws, b.ws))::INT AS "both", len(list_distinct(list_concat(a.ws, b.ws)))::INT AS either FROM f a JOIN f b ON a.name = b.name AND a.collection < b.collection)
SELECT * FROM p WHERE "both" * 100 < either * 50"""

ORACLES["elements_los"] = f"""
WITH {ELEMENTS} SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY n, k::VARCHAR || '}}') - 1)::INT AS ord, 'L-' || n::VARCHAR AS los_id, 'Explain' AS level, 'the \\textbf{{part}} ' || k::VARCHAR AS statement FROM li WHERE n % 4 = 1"""
ORACLES["elements_terms"] = f"WITH {ELEMENTS} SELECT doc, 'L-' || n::VARCHAR AS los_id, 'Part ' || k::VARCHAR AS name, 'A part with flag {{' || f || '}}' AS definition, 'Define: Part ' || k::VARCHAR AS front FROM li WHERE n % 4 = 2"
ORACLES["elements_problems"] = f"WITH {ELEMENTS} SELECT doc, 'P' || k::VARCHAR AS title, 'L-' || n::VARCHAR AS los_id, 'Find ' || k::VARCHAR || '?' AS front, 'It is ' || n::VARCHAR || '.' AS back FROM li WHERE n % 4 = 0"
ORACLES["elements_margins"] = f"WITH {ELEMENTS} SELECT doc, 'Pattern' AS category, 'Key pattern from ' || k::VARCHAR AS note FROM li WHERE n % 4 = 3"
ORACLES["term_names"] = f"WITH {ELEMENTS} SELECT doc, 'part ' || k::VARCHAR AS name, 'PART_' || k::VARCHAR AS slug FROM li WHERE n % 4 = 2"

_REFS = f"{ELEMENTS}, refs AS (SELECT doc, 'p:' || k::VARCHAR AS label FROM li WHERE n % 4 = 2), labels_ AS (SELECT doc, 'p:' || k::VARCHAR AS label FROM li WHERE n % 4 = 3)"
ORACLES["duplicate_labels"] = f"WITH {_REFS} SELECT label, count(*) AS n FROM labels_ GROUP BY 1 HAVING count(*) > 1"
ORACLES["label_orphans"] = f"WITH {_REFS} SELECT DISTINCT label FROM labels_ WHERE label NOT IN (SELECT label FROM refs)"
ORACLES["incoming_counts"] = f"WITH {_REFS} SELECT l.label, count(r.doc) AS n_refs, count(DISTINCT r.doc) AS n_docs FROM (SELECT DISTINCT label FROM labels_) l LEFT JOIN refs r USING (label) GROUP BY 1"

_LOS = "d AS (SELECT DISTINCT o_orderpriority AS collection, o_custkey::VARCHAR AS los_id FROM orders), t AS (SELECT DISTINCT o_orderpriority AS collection, o_custkey::VARCHAR AS los_id FROM orders WHERE o_orderstatus = 'F')"
ORACLES["retrieval_coverage"] = f"""
WITH {_LOS}, c AS (SELECT d.collection, count(*) AS n_defined, count(t.los_id) AS n_tested FROM d LEFT JOIN t ON d.collection = t.collection AND d.los_id = t.los_id GROUP BY 1)
SELECT *, CASE WHEN n_tested * 100 >= n_defined * 80 THEN 'GREEN' WHEN n_tested * 100 >= n_defined * 50 THEN 'YELLOW' ELSE 'RED' END AS status FROM c"""
ORACLES["untested_los"] = f"WITH {_LOS} SELECT * FROM d EXCEPT SELECT * FROM t"
ORACLES["registry_vs_disk"] = """
WITH r AS (SELECT DISTINCT n_nationkey AS slug FROM nation), k AS (SELECT DISTINCT s_nationkey + 2 AS slug FROM supplier)
SELECT coalesce(r.slug, k.slug) AS slug, r.slug IS NOT NULL AS registered, k.slug IS NOT NULL AS on_disk FROM r FULL JOIN k ON r.slug = k.slug"""
ORACLES["undefined_styles"] = "SELECT p_brand AS style FROM part INTERSECT SELECT p_brand FROM part WHERE p_size > 10 EXCEPT SELECT p_brand FROM part WHERE p_retailprice > 1950 OR p_size = 49"

_DAILY = "m AS (SELECT event_type AS metric, ts::DATE AS day, count(*) AS value FROM events GROUP BY ALL)"
ORACLES["metric_trends"] = f"WITH {_DAILY}, l AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY day) AS b FROM m) SELECT metric, day, value, CASE WHEN b IS NULL THEN 'new' WHEN value > b THEN 'up' WHEN value < b THEN 'down' ELSE 'stable' END AS trend FROM l"
ORACLES["history_last_50"] = f"WITH {_DAILY} SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY metric ORDER BY day DESC) <= 50"
ORACLES["metric_lights"] = f"WITH {_DAILY} SELECT metric, day, CASE WHEN metric = 'error' THEN CASE WHEN value <= 60 THEN 'GREEN' WHEN value <= 40 THEN 'YELLOW' ELSE 'RED' END WHEN value >= 60 THEN 'GREEN' WHEN value >= 40 THEN 'YELLOW' ELSE 'RED' END AS status FROM m"

_GATES = """
g0 AS (SELECT c_nationkey AS collection, 'G' || (c_custkey % 7 + 1)::VARCHAR AS gate, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY ALL),
g AS (SELECT collection, gate, (low > -900 AND high > 0) OR (gate <> 'G5' AND collection % 2 = 0) AS passed, CASE WHEN high > 5000 THEN 'missing' ELSE 'scaffold' END AS reason FROM g0)"""
ORACLES["gate_class"] = f"""
WITH {_GATES}, c AS (SELECT collection, bool_and(passed) AS a, bool_and(passed OR gate = 'G5') AS o, max(reason) FILTER (gate = 'G5') AS r FROM g GROUP BY 1)
SELECT collection, CASE WHEN a THEN 'PASS' WHEN o AND r = 'missing' THEN 'GOLD-ELIGIBLE' WHEN o THEN 'SCAFFOLD-ONLY' ELSE 'FAIL' END AS class FROM c"""
ORACLES["gate_pivot"] = f"WITH {_GATES} SELECT collection, " + ", ".join(f"coalesce(max(CASE WHEN passed THEN 'pass' ELSE 'fail' END) FILTER (gate = 'G{i}'), '—') AS G{i}" for i in range(1, 9)) + " FROM g GROUP BY 1"
ORACLES["first_failing_gate"] = f"WITH {_GATES} SELECT collection, min(gate) FILTER (NOT passed) AS first_failing FROM g GROUP BY 1"

_CHECKS = "k AS (SELECT o_custkey AS collection, o_orderpriority AS c, CASE WHEN avg(o_totalprice) >= 200000 THEN 'GREEN' WHEN avg(o_totalprice) >= 120000 THEN 'YELLOW' ELSE 'RED' END AS status FROM orders GROUP BY ALL), b AS (SELECT collection, count(*) FILTER (status = 'GREEN') AS n_green, count(*) FILTER (status = 'YELLOW') AS n_yellow, count(*) FILTER (status = 'RED') AS n_red FROM k GROUP BY 1)"
ORACLES["bronze_scores"] = f"WITH {_CHECKS} SELECT * FROM b"
ORACLES["worst_first"] = f"WITH {_CHECKS} SELECT * FROM b ORDER BY n_red DESC, n_yellow DESC, collection LIMIT 25"
ORACLES["readiness_exit"] = f"WITH {_CHECKS} SELECT collection, CASE WHEN bool_or(status = 'RED' AND c IN ('1-URGENT', '2-HIGH')) THEN 1 WHEN bool_or(status = 'RED') THEN 2 ELSE 0 END AS exit_code FROM k GROUP BY 1"
ORACLES["level_histogram"] = "WITH g AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT *, (sum(n) OVER (PARTITION BY o_orderpriority))::BIGINT AS total FROM g"
ORACLES["worst_five_per_collection"] = f"WITH {CARDS}, r AS (SELECT collection, ord, length(back)::INT AS n_chars, row_number() OVER (PARTITION BY collection ORDER BY length(back) DESC, ord)::INT AS rank FROM cards) SELECT * FROM r WHERE rank <= 5"
ORACLES["crossref_floor"] = "WITH d AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, lang, n, CASE WHEN n >= 10 THEN 6 ELSE greatest(2, least(4, n // 4)) END::INT AS refs, CASE WHEN n >= 10 THEN 4 ELSE greatest(2, least(3, n // 3)) END::INT AS files FROM d"
ORACLES["bib_sorted"] = """
SELECT 'k' || p_partkey::VARCHAR AS bibkey, CASE WHEN p_size % 3 = 0 THEN 'article' WHEN p_size % 2 = 0 THEN 'inproceedings' WHEN p_size % 3 = 1 THEN 'online' ELSE 'misc' END AS kind,
  CASE WHEN p_size + 1970 BETWEEN 1900 AND 2099 THEN (p_size + 1970)::VARCHAR END AS year FROM part"""

_PAGES = """
s AS (
  SELECT page_id, url, page_id % 11 = 0 AS degraded, CASE WHEN page_id % 11 <> 0 AND page_id % 3 <> 0 THEN 'March 2025' ELSE '' END AS began,
    CASE WHEN page_id % 11 = 0 THEN '' ELSE ['April', 'Juny', 'May'][page_id % 3 + 1] || ' 2026' END AS last_updated_month, CASE WHEN page_id % 11 = 0 THEN '' ELSE 'Early 2027' END AS publication,
    CASE WHEN page_id % 11 = 0 THEN '' ELSE '9781234567890' END AS isbn, CASE WHEN page_id % 11 = 0 THEN '0' ELSE (page_id % 5 * 100)::VARCHAR END AS n_pages FROM pages
), st AS (SELECT *, began <> '' AS is_early, substr(sha256(began || '|' || last_updated_month || '|' || publication || '|' || isbn || '|' || n_pages), 1, 16) AS signature FROM s)"""
ORACLES["page_state"] = f"WITH {_PAGES} SELECT page_id, began, last_updated_month, publication, isbn, n_pages, is_early, degraded, signature FROM st"
ORACLES["month_iso"] = f"WITH {_PAGES} SELECT page_id, CASE last_updated_month WHEN 'April 2026' THEN '2026-04' WHEN 'May 2026' THEN '2026-05' END AS month FROM st"
_STATUS = f"""{_PAGES}, x AS (
  SELECT *, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1) AS slug, page_id % 5 > 1 AND page_id % 7 <> 0 AS known,
    CASE last_updated_month WHEN 'April 2026' THEN '2026-04' WHEN 'May 2026' THEN '2026-05' END AS live, CASE page_id % 4 WHEN 0 THEN '2026-05' WHEN 1 THEN '2026-03' END AS build FROM st
), f AS (
  SELECT page_id, CASE WHEN degraded THEN 'ERROR' WHEN page_id % 13 = 0 AND slug <> 'other' THEN 'RENAMED' WHEN NOT is_early THEN 'PUBLISHED' WHEN live > build THEN 'STALE'
    WHEN build IS NULL AND known AND page_id % 2 = 0 THEN 'STALE' WHEN NOT known AND page_id % 2 = 0 AND page_id % 12 > page_id % 10 THEN 'STALE?' WHEN NOT known THEN 'BASELINE' WHEN page_id % 3 <> 1 THEN 'STALE' ELSE 'OK' END AS status FROM x
)"""
ORACLES["freshness_status"] = f"WITH {_STATUS} SELECT * FROM f"
ORACLES["freshness_report"] = f"WITH {_STATUS} SELECT status, count(*) AS n, list_position(['RENAMED', 'UNRESOLVED', 'ERROR', 'PUBLISHED', 'STALE', 'STALE?', 'BASELINE', 'OK'], status) AS place FROM f GROUP BY 1"
ORACLES["page_changes"] = "WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT user_id, event_id, CASE WHEN b IS NULL THEN 'BASELINE' WHEN b <> event_type THEN 'STALE' ELSE 'OK' END AS status FROM l"
ORACLES["substantive_words"] = "SELECT doc_id AS ord, len(regexp_extract_all(regexp_replace(text, '[^A-Za-z0-9 \\n-]', ' ', 'g'), '\\b[A-Za-z][A-Za-z0-9-]+\\b'))::INT AS n FROM documents"

ORACLES["environment_cards"] = f"""
SELECT p_partkey AS doc, {_list(k.type for k in KINDS)}[k + 1] AS type, p_type AS title, 'L-' || p_size::VARCHAR AS los_id, 'Body of ' || p_name || ' in ' || p_brand AS back,
  CASE WHEN list_contains({_list(SCAFFOLDING["none"].split())}, {_list(k.type for k in KINDS)}[k + 1]) THEN 'none' WHEN list_contains({_list(SCAFFOLDING["full"].split())}, {_list(k.type for k in KINDS)}[k + 1]) THEN 'full' ELSE 'partial' END AS scaffolding_level, k::INT AS ord_extractor
FROM (SELECT *, p_size % {len(KINDS)} AS k FROM part)"""
ORACLES["two_way_terms"] = "SELECT p_partkey AS doc, 0 AS way, 'Define: ' || p_brand AS front, p_name AS back FROM part UNION ALL SELECT p_partkey, 1, 'Which term: ' || substr(p_name, 1, 80), p_brand FROM part"
ORACLES["interview_gate"] = """
WITH b AS (SELECT p_partkey AS doc, p_size % 2 = 1 AS odd, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS least, (p_size % 2)::INT AS n FROM part),
r AS (SELECT doc, list_filter([CASE WHEN n < least THEN 'question_count<' || least::VARCHAR || ' (' || n::VARCHAR || ')' END, CASE WHEN NOT odd THEN 'no_role_delta' END, CASE WHEN NOT odd THEN 'no_los_refs' END], lambda x: x IS NOT NULL) AS rs FROM b)
SELECT doc, len(rs) = 0 AS passed, coalesce(array_to_string(rs, ';'), '') AS reason FROM r"""
ORACLES["open_mark_density"] = "SELECT p_partkey AS doc, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END AS todo, CASE WHEN p_size % 2 = 0 THEN 5 ELSE 0 END AS fields FROM part"
ORACLES["status_marks"] = "SELECT p_partkey AS doc, (p_size % 2)::INT AS red, (p_size % 2)::INT AS yellow, 0 AS green FROM part"
ORACLES["section_min_words"] = "SELECT p_partkey AS doc, CASE WHEN p_size % 2 = 1 THEN 2 END AS least FROM part"
ORACLES["render_faults"] = rf"""
WITH {MARKED}, b AS (SELECT ord, CASE WHEN ord % 3 = 0 THEN back || ' \( &lt; a < b \begin{{x}}' ELSE back END AS back FROM marked)
SELECT ord, 'inline delimiters' AS fault FROM b WHERE len(regexp_extract_all(back, '\\\(')) <> len(regexp_extract_all(back, '\\\)'))
UNION ALL SELECT ord, 'environments' FROM b WHERE list_sort(regexp_extract_all(back, '\\begin\{{([a-z*]+)\}}', 1)) <> list_sort(regexp_extract_all(back, '\\end\{{([a-z*]+)\}}', 1))
UNION ALL SELECT ord, 'angle bracket' FROM b WHERE regexp_matches(regexp_replace(back, '<[^<>]*>', '', 'g'), '[<>]')
UNION ALL SELECT ord, 'entity' FROM b WHERE regexp_matches(back, '&(?:amp;)?(?:lt|gt|amp|quot|nbsp);')"""
ORACLES["paragraphs"] = f"""
WITH {LINES}, l AS (SELECT ord, line_no, CASE WHEN line_no % 4 = 0 THEN '' ELSE line END AS line FROM lines), i AS (SELECT *, sum(({strip('line')} = '')::INT) OVER (PARTITION BY ord ORDER BY line_no) AS island FROM l)
SELECT ord, min(line_no)::INT AS first_line, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM i WHERE {strip('line')} <> '' GROUP BY ord, island"""
ORACLES["preserved_outcomes"] = f"""
WITH {CARDS}, k AS (SELECT id, min(los_id) AS was FROM cards WHERE ord % 2 = 0 AND los_id IS NOT NULL GROUP BY 1)
SELECT ord, cards.id, coalesce(CASE WHEN ord % 3 = 0 THEN los_id END, was) AS los_id FROM cards LEFT JOIN k ON k.id = cards.id"""
ORACLES["phrase_notes"] = f"WITH {CARDS}, h AS (SELECT c.ord, arg_min(n_name, n_nationkey) AS note FROM cards c JOIN nation ON contains(lower(c.front || ' ' || c.back), substr(lower(n_name), 1, 3)) GROUP BY 1) SELECT cards.ord, h.note FROM cards LEFT JOIN h ON h.ord = cards.ord"
ORACLES["log_sources"] = """
WITH e AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'chapters/c' || (event_id % 9)::VARCHAR || '.tex' END AS opened, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_type = 'error' THEN 'o' WHEN event_type = 'click' THEN 'u' END AS cat FROM events),
l AS (SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS src FROM e)
SELECT coalesce(src, 'none') AS source, count(*) FILTER (cat = 'u') AS undefined, count(*) FILTER (cat = 'o') AS overfull_hbox FROM l WHERE cat IS NOT NULL GROUP BY 1"""

ORACLES.update(queries_fleet.ORACLES)
ORACLES.update(queries_structure.ORACLES)
ORACLES.update(queries_exercises.ORACLES)
