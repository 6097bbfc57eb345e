"""Queries over the structure of marked-up documents, with their SQL: both read the texts of the same views.

The SQL cuts the texts at the same tokens and works on the pieces with windows of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import cutting, fixed, scanning
from inkwell import queries_fleet
from inkwell.operators import currency, fleet, integrity, rewriting, scoring, structure
from inkwell.sources import adapters as ad
from inkwell.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def named(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return named


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _pieces(view: str, pattern: str, name: str) -> str:
    """CTE name: doc, k, piece and off of the texts of a view, cut in front of the matches of pattern."""
    return f"""{name}_0 AS (SELECT doc, chapter, string_split(regexp_replace(text, {_q("(" + pattern + ")")}, chr(1) || '\\1', 'g'), chr(1)) AS s FROM {view}),
{name}_1 AS (SELECT doc, chapter, unnest(s) AS piece, generate_subscripts(s, 1) AS k FROM {name}_0),
{name} AS (SELECT doc, chapter, k, piece, COALESCE(sum(length(piece)) OVER (PARTITION BY doc ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM {name}_1)"""


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_BOXES = "boxes AS (" + views.BOXES.format(part="part") + ")"
_ITEMS = f"""{_BOXES}, {_pieces("boxes", fixed.LIST_TOKENS, "p")},
t AS (SELECT *, regexp_extract(piece, '^\\\\(?:begin|end)\\{{([^}}]*)\\}}', 1) AS env, CASE WHEN starts_with(piece, chr(92) || 'begin' || chr(123)) THEN 1 WHEN starts_with(piece, chr(92) || 'end' || chr(123)) THEN -1 ELSE 0 END AS step,
 CAST(regexp_matches(piece, {_q(fixed.CHECKPOINT_OPENING)}) AS INT) AS opens, regexp_matches(piece, '^\\\\item\\b') AS item FROM p),
b AS (SELECT * FROM (SELECT *, sum(opens) OVER (PARTITION BY doc ORDER BY k) AS box FROM t) WHERE box > 0),
o AS (SELECT *, sum(CASE WHEN env = owner THEN step ELSE 0 END) OVER (PARTITION BY doc, box ORDER BY k) AS level FROM (SELECT *, first_value(env) OVER (PARTITION BY doc, box ORDER BY k) AS owner FROM b)),
i AS (SELECT *, first_value(NULLIF({_STRIP.format("regexp_extract(piece, '^.begin.tcolorbox.[^~]*?title\\s*=\\s*\\{?([^}\\]]+)', 1)")}, '')) OVER (PARTITION BY doc, box ORDER BY k) AS title,
 CAST(sum(CAST(regexp_matches(piece, {_q(fixed.ANSWERS_MARK)}) AS INT)) OVER (PARTITION BY doc, box ORDER BY k) > 0 AS INT) AS half
 FROM (SELECT *, min(level) OVER (PARTITION BY doc, box ORDER BY k) AS least, min(level) OVER (PARTITION BY doc, box) AS last FROM o) WHERE last <= 0 AND least >= 1),
d AS (SELECT *, COALESCE(sum(CASE WHEN opens = 1 THEN 0 ELSE step END) OVER (PARTITION BY doc, box, half ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM i),
e AS (SELECT *, min(CASE WHEN item THEN depth END) OVER (PARTITION BY doc, box, half) AS base FROM d),
n AS (SELECT * FROM (SELECT *, sum(CAST(item AND depth = base AS INT)) OVER (PARTITION BY doc, box, half ORDER BY k) AS no FROM e) WHERE no > 0),
s AS (SELECT *, max(CAST(step = -1 AND depth = base AS INT)) OVER (PARTITION BY doc, box, half, no ORDER BY k) AS shut FROM n),
items AS (SELECT doc, chapter, box, half, no, any_value(title) AS title, min(off) AS off, {_STRIP.format("substr(string_agg(piece, '' ORDER BY k), 6)")} AS item FROM s WHERE shut = 0 GROUP BY doc, chapter, box, half, no)"""


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(spark, sf, views.BOXES, "part")


_GROUP = "[^{}]*(?:\\{[^{}]*(?:\\{[^{}]*\\}[^{}]*)*\\}[^{}]*)*"


@query(f"WITH {_ITEMS}, q AS (SELECT * FROM items WHERE half = 0), a AS (SELECT * FROM items WHERE half = 1), " + f"""
c AS (SELECT q.doc, q.box, q.no, q.off, COALESCE(q.title, a.title, q.chapter || ' Checkpoint') AS title, COALESCE(NULLIF(regexp_extract(q.item, '^\\[([A-Z0-9]+-[\\d.]+)\\]', 1), ''), NULLIF(regexp_extract(q.item, '\\\\hfill\\\\textit\\{{[^}}]*?([A-Z0-9]+-[\\d.]+)', 1), '')) AS los_id,
 NULLIF({_STRIP.format("regexp_extract(q.item, '(?s)" + chr(92) * 2 + "checkpointanswer" + chr(92) + "s*" + chr(92) + "{(" + _GROUP + ")" + chr(92) + "}', 1)")}, '') AS own,
 {_STRIP.format("regexp_replace(CASE WHEN regexp_matches(q.item, '" + chr(92) * 2 + "checkpointanswer" + chr(92) + "s*" + chr(92) + "{" + _GROUP + chr(92) + "}') THEN regexp_extract(q.item, '(?s)^(.*?)" + chr(92) * 2 + "checkpointanswer" + chr(92) + "s*" + chr(92) + "{', 1) ELSE q.item END, '^(?:\\[[^\\]]*\\])?\\s*', '')")} AS front,
 NULLIF({_STRIP.format("regexp_replace(a.item, '^(?:\\[[^\\]]*\\])?\\s*', '')")}, '') AS paired FROM q LEFT JOIN a ON a.doc = q.doc AND a.box = q.box AND a.no = q.no)
SELECT doc, box, no, off, title, los_id, front, COALESCE(own, paired, 'Self-check from: ' || title || chr(10) || chr(10) || '(Answer from memory, then verify against the chapter text.)') AS back,
 CASE WHEN own IS NOT NULL THEN 'inline' WHEN paired IS NOT NULL THEN 'paired' ELSE 'placeholder' END AS back_from FROM c WHERE length(front) >= 10""")
def checkpoint_items(spark, sf):
    return structure.checkpoint_cards(_boxes(spark, sf), "chapter", "doc")


@query(f"WITH {_ITEMS}, l AS (SELECT *, NULLIF(regexp_extract(item, '^\\[([A-Z0-9]+-[\\d.]+)\\]', 1), '') AS los_id FROM items) SELECT doc, box, half, no, off, los_id FROM l WHERE los_id IS NOT NULL AND NOT (half = 1 AND EXISTS (SELECT 1 FROM l m WHERE m.doc = l.doc AND m.box = l.box AND m.half = 0 AND m.los_id = l.los_id))")
def checkpoint_prompts(spark, sf):
    return structure.checkpoint_prompts(_boxes(spark, sf), "doc").drop("words")


_CASES = "cases AS (" + views.CASES.format(part="part") + ")"


def _mark(p: str, k: int) -> str:
    return f"WHEN regexp_matches(body, {_q(p)}) THEN length(regexp_extract(body, {_q('(?s)^(.*?)(?:' + p + ')')}, 1))"


@query(f"WITH {_CASES}, {_pieces('cases', fixed.VIGNETTE_TOKENS, 'p')}," + f"""
t AS (SELECT *, regexp_extract(piece, '^\\\\(?:begin|end)\\{{([a-z]*)\\}}', 1) AS env, starts_with(piece, chr(92) || 'begin' || chr(123)) AS opens, starts_with(piece, chr(92) || 'end' || chr(123)) AS ends FROM p WHERE k > 1),
v AS (SELECT * FROM (SELECT *, lag(k) OVER (PARTITION BY doc ORDER BY k) AS before FROM t WHERE env = 'vignette')),
first_ AS (SELECT v.doc, v.off, v.k, (SELECT min(w.off) FROM t w WHERE w.doc = v.doc AND w.ends AND w.env = 'vignette' AND w.k > v.k) AS closes FROM v
 WHERE v.opens AND NOT EXISTS (SELECT 1 FROM t u WHERE u.doc = v.doc AND u.env = 'vignette' AND u.opens AND u.k < v.k AND NOT EXISTS (SELECT 1 FROM t w WHERE w.doc = v.doc AND w.env = 'vignette' AND w.ends AND w.k > u.k AND w.k < v.k))),
n AS (SELECT f.doc, f.off, f.closes, f.closes + 14 AS end_off, (SELECT arg_min(u.env, u.k) FROM t u WHERE u.doc = f.doc AND u.opens AND u.off > f.closes) AS next_env, (SELECT min(u.off) FROM t u WHERE u.doc = f.doc AND u.opens AND u.off > f.closes) AS next_off FROM first_ f WHERE f.closes IS NOT NULL),
e AS (SELECT *, (SELECT min(w.off) FROM t w WHERE w.doc = n.doc AND w.ends AND w.env = 'solution' AND w.off > n.next_off) AS solved FROM n),
x AS (SELECT e.doc, e.off, substr(c.text, CAST(e.off + 1 AS BIGINT), CAST(e.closes - e.off AS BIGINT)) AS raw, CASE WHEN next_env = 'solution' AND solved + 14 <= end_off + {fixed.VIGNETTE_REACH} THEN NULLIF({_STRIP.format("substr(c.text, CAST(next_off + 17 AS BIGINT), CAST(solved - next_off - 16 AS BIGINT))")}, '') END AS solution FROM e JOIN cases c ON c.doc = e.doc),
y AS (SELECT doc, off, solution, NULLIF(regexp_extract(raw, '(?s)^.begin.vignette.(?:\\[([^\\]]*)\\])?', 1), '') AS title, NULLIF({_STRIP.format("regexp_extract(raw, '(?s)^.begin.vignette.(?:\\[([^\\]]*)\\])?(?:\\[([^\\]]*)\\])?', 2)")}, '') AS los_id, {_STRIP.format("regexp_replace(raw, '(?s)^.begin.vignette.(?:\\[[^\\]]*\\])?(?:\\[[^\\]]*\\])?', '')")} AS body FROM x),
z AS (SELECT *, CASE {' '.join(_mark(p, k) for k, p in enumerate(fixed.QUESTION_MARKS))} END AS place FROM y)
SELECT doc, off, COALESCE(title, 'Case Study') AS title, los_id, 'Case Study: ' || COALESCE(title, 'Case Study') || CASE WHEN place IS NULL THEN '' ELSE chr(10) || chr(10) || {_STRIP.format("substr(body, 1, place)")} END AS front,
 CASE WHEN place IS NULL THEN body ELSE substr(body, place + 1) END || CASE WHEN solution IS NULL THEN '' ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**Answer Rubric:**' || chr(10) || solution END AS back, solution IS NOT NULL AS has_solution FROM z""")
def vignettes(spark, sf):
    return structure.vignettes(views.view(spark, sf, views.CASES, "part"), "doc")


# the currency gate, and gates of collections as they are

NOW = "2026-08"
_APPENDICES = "appendices AS (" + views.APPENDICES.format(supplier="supplier") + ")"


def _n(text: str, *patterns: str) -> str:
    return " + ".join(f"len(regexp_extract_all({text}, {_q(p)}))" for p in patterns)


def _uncited(spans: str) -> str:
    return f"len(list_filter({spans}, lambda x: {_n('x', *fixed.CITATIONS)} < 1))"


_CURRENCY = rf"""{_APPENDICES},
a AS (SELECT *, array_to_string(list_filter(string_split(changes, chr(10)), lambda x: NOT ({' OR '.join(f"contains(x, '{s}')" for s in fixed.SCAFFOLD_SIGNATURES)})), chr(10)) AS body FROM appendices),
b AS (SELECT *, regexp_replace(body, '(?m)(^|[^\\])%.*$', '\1', 'g') AS live, greatest({_n("body", fixed.LIST_ITEM)}, {_n("body", fixed.SUBSECTION)}) AS n, regexp_replace(debates, '(?m)(^|[^\\])%.*$', '\1', 'g') AS open,
 CASE WHEN TRY_CAST(regexp_extract(changes, {_q(fixed.AS_OF_NUMBER)}, 2) AS INT) BETWEEN 1 AND 12 THEN CAST(regexp_extract(changes, {_q(fixed.AS_OF_NUMBER)}, 1) AS INT) * 12 + CAST(regexp_extract(changes, {_q(fixed.AS_OF_NUMBER)}, 2) AS INT)
 WHEN regexp_matches(changes, {_q(fixed.AS_OF_WORD)}) THEN CAST(regexp_extract(changes, {_q(fixed.AS_OF_WORD)}, 2) AS INT) * 12 + NULLIF(CAST(ceil(instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(substr(regexp_extract(changes, {_q(fixed.AS_OF_WORD)}, 1), 1, 3))) / 3.0) AS INT), 0) END AS stamp FROM a),
c AS (SELECT *, (string_split(regexp_replace(regexp_replace(live, '(?is)^\s*.section.?\{{[^}}]*still hold.*$|\n\s*.section.?\{{[^}}]*still hold.*$', ''), '(?m)({fixed.SUBSECTION.removeprefix("(?m)")})', chr(1) || '\1', 'g'), chr(1)))[2:] AS subs,
 (string_split(regexp_replace(regexp_replace(live, '(?is)\n\s*.section.?\{{[^}}]*still hold.*$', ''), '({fixed.LIST_ITEM})', chr(1) || '\1', 'g'), chr(1)))[2:] AS points,
 list_filter(string_split(regexp_replace(open, '(?i)(.textbf\{{\s*Position\s+[A-Z]\b|.textbf\{{[^}}]*?where\s+(?:this|the)\s+book\s+sits)', chr(1) || '\1', 'g'), chr(1)), lambda x: regexp_matches(x, '(?i)^.textbf\{{\s*Position\s+[A-Z]\b')) AS positions,
 {2026 * 12 + 8} - stamp AS age, CASE velocity WHEN 'fast' THEN 6 WHEN 'medium' THEN 12 ELSE 18 END AS most, {_n("debates", fixed.BOOK_ANCHOR)} AS nd, {_n("open", *fixed.CITATIONS)} AS cites, lower(trim(COALESCE(debates_waiver, ''))) = 'true' AND trim(debates_justification) <> '' AS waived FROM b),
d AS (SELECT *, CASE WHEN len(subs) > 0 THEN subs ELSE points END AS items FROM c),
e AS (SELECT collection, waived, CASE WHEN changes IS NULL THEN '{fixed.CURRENCY_FILE} missing' ELSE concat_ws('; ', CASE WHEN regexp_matches(body, {_q(fixed.NO_CHANGES_YET)}) AND n < 3 THEN 'E is a stub (no-changes-yet placeholder)' END,
 CASE WHEN age IS NULL THEN 'E has no ''current as of YYYY-MM'' date' WHEN age > most THEN 'E age ' || age || 'mo > ' || velocity || ' SLA ' || most || 'mo' WHEN age < 0 THEN 'E date is in the future' END, CASE WHEN n < 3 THEN '<3 currency items' END,
 CASE WHEN NOT regexp_matches(body, {_q(fixed.STILL_HOLDS)}) THEN 'no ''what still holds'' section' END, CASE WHEN {_uncited("items")} > 0 THEN {_uncited("items")} || '/' || len(items) || ' items uncited' END,
 CASE WHEN starts_with(version, 'v') AND NOT regexp_matches(body, '\b' || split_part(version, ' ', 1) || '\b') THEN 'E does not name MEAP version (' || split_part(version, ' ', 1) || ')' END) END AS e,
 CASE WHEN waived THEN '' WHEN debates IS NULL THEN '{fixed.DEBATE_FILE} missing' ELSE concat_ws('; ', CASE WHEN nd < 3 THEN '<3 debates (' || nd || ')' END, CASE WHEN {_n("debates", fixed.VERDICT)} < 3 THEN 'missing verdict flags (well-supported/contested/dated)' END,
 CASE WHEN cites < greatest(6, 2 * nd) THEN '<' || greatest(6, 2 * nd) || ' resolvable citations (' || cites || ')' END, CASE WHEN {_uncited("positions")} > 0 THEN {_uncited("positions")} || '/' || len(positions) || ' Positions uncited' END) END AS f FROM d),
g7 AS (SELECT collection, e = '' AND f = '' AS passed, CASE WHEN e = '' AND f = '' THEN 'E ok; F ' || CASE WHEN waived THEN 'waived' ELSE 'ok' END ELSE 'E: ' || CASE WHEN e = '' THEN 'ok' ELSE e END || ' | F: ' || CASE WHEN f <> '' THEN f WHEN waived THEN 'waived' ELSE 'ok' END END AS detail FROM e)"""


@query(f"WITH {_CURRENCY} SELECT * FROM g7")
def currency_gate(spark, sf):
    return currency.currency_gate(views.view(spark, sf, views.APPENDICES, "supplier"), NOW)


def _as_cte(name: str) -> str:
    """A gate's own SQL; a nested WITH keeps its names to itself."""
    return f"{name} AS ({queries_fleet.ORACLES[name]})"


_REAL = f"""{_as_cte("deck_gate")}, {_as_cte("dashboard_gate")}, {_as_cte("fidelity_gate")}, {_CURRENCY}, every AS (SELECT s_suppkey AS collection FROM supplier),
rows_ AS (SELECT collection, 'G3' AS gate, passed, reason FROM deck_gate UNION ALL SELECT collection, 'G5', passed, reason FROM fidelity_gate UNION ALL SELECT collection, 'G6', passed, reason FROM dashboard_gate UNION ALL SELECT collection, 'G7', passed, detail FROM g7),
real AS (SELECT collection, names.gate, COALESCE(passed, false) AS passed, COALESCE(reason, 'missing') AS reason FROM every CROSS JOIN (VALUES ('G3'), ('G5'), ('G6'), ('G7')) names(gate) LEFT JOIN rows_ USING (collection, gate))"""


def _real_gates(spark, sf):
    files, settings = queries_fleet._files(spark, sf), queries_fleet._settings(spark, sf)
    decks = fleet.deck_gate(files, settings, queries_fleet._mapped(spark, sf))
    return currency.collection_gates(decks, fleet.dashboard_gate(files, settings), fleet.fidelity_gate(files), currency_gate(spark, sf), settings.select("collection"))


@query(f"WITH {_REAL} SELECT * FROM real")
def collection_gates(spark, sf):
    return _real_gates(spark, sf)


@query(f"""WITH {_REAL}, classed AS (SELECT collection, bool_and(passed) AS a, bool_and(passed OR gate = 'G5') AS o, max(reason) FILTER (gate = 'G5') AS r, min(gate) FILTER (NOT passed) AS first_failing FROM real GROUP BY 1)
SELECT collection, CASE WHEN a THEN 'PASS' WHEN o AND r = 'missing' THEN 'GOLD-ELIGIBLE' WHEN o THEN 'SCAFFOLD-ONLY' ELSE 'FAIL' END AS class, first_failing FROM classed""")
def collection_gate_classes(spark, sf):
    gates = _real_gates(spark, sf)
    return scoring.gate_class(gates).join(scoring.first_failing(gates), "collection")


# scans that keep places

_PROTECTED = "texts AS (" + views.PROTECTED.format(part="part") + ")"


def _blank(c: str, pattern: str) -> str:
    """SQL of blanked(), with escaped dollars taken out before and no lookbehind."""
    p = _q(pattern.replace(r"(?<!\\)", ""))
    return f"array_to_string(list_transform(list_zip(string_split_regex({c}, {p}), regexp_extract_all({c}, {p})), lambda z: z[1] || COALESCE(repeat(' ', length(z[2])), '')), '')"


_STEPS = "w0 AS (SELECT doc, replace(text, chr(92) || '$', chr(2) || chr(3)) AS c FROM texts)"
for _k, _p in enumerate((*fixed.PROTECTED, "</?[A-Za-z][^<>]*>|<!--.*?-->")):
    _STEPS += f", w{_k + 1} AS (SELECT doc, {_blank('c', _p)} AS c FROM w{_k})"


@query(f"WITH {_PROTECTED}, {_STEPS}, m AS (SELECT doc, unnest(string_split(c, '')) AS mark, generate_subscripts(string_split(c, ''), 1) AS place FROM w{len(fixed.PROTECTED) + 1}) SELECT doc, CAST(place AS BIGINT) AS place, mark FROM m WHERE mark IN ('<', '>')")
def stray_angle_marks(spark, sf):
    return scanning.stray_angles(views.view(spark, sf, views.PROTECTED, "part"), "text", "doc")


def _nested(plain: str, levels: int) -> str:
    inner = f"(?:{plain})*"
    for _ in range(levels):
        inner = rf"(?:{plain}|\{{{inner}\}})*"
    return inner


@query(f"WITH {_PROTECTED} SELECT doc, regexp_replace(regexp_replace(margins, {_q(fixed.MARGIN_OPENING + _nested(chr(92) * 2 + '.|[^{}' + chr(92) * 2 + ']', 3) + chr(92) + '}')}, '', 'g'), {_q(fixed.MARGIN_OPENING)}, '', 'g') AS rest FROM texts")
def margins_removed(spark, sf):
    return views.view(spark, sf, views.PROTECTED, "part").select("doc", scanning.without_margins("margins").alias("rest"))


@query(rf"""WITH ledgers AS ({views.LEDGERS.format(part="part")}), {_pieces("ledgers", fixed.ENTRY_OPENING, "p")},
h AS (SELECT p.*, regexp_matches(regexp_extract(substr(l.text, 1, CAST(off AS BIGINT)), '[^\n]*$'), '(^|[^\\])%') AS hidden FROM p JOIN ledgers l USING (doc)),
e AS (SELECT doc, k, lower(regexp_extract(piece, '^@(\w+)', 1)) AS kind, trim(regexp_extract(piece, '^@\w+\{{([^,\n]+),', 1)) AS key, regexp_extract(piece, {_q(r"^@\w+\{" + _nested("[^{}]", 4) + r"\}")}) AS whole, piece FROM h WHERE NOT hidden AND k > 1)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY k) AS no, kind, key, regexp_replace(CASE WHEN whole <> '' THEN whole ELSE piece END, '\s+$', '') AS entry, whole <> '' AS closed FROM e""")
def reference_entries(spark, sf):
    return scanning.reference_entries(views.view(spark, sf, views.LEDGERS, "part"), "doc")


@query(None)
def command_refusals(spark, sf):
    return views.view(spark, sf, views.COMMANDS, "orders").select("doc", "command", scanning.command_refusal("command").alias("refusal"))


_MACROS = " OR ".join(f"contains(line, chr(92) || '{m}')" for m in fixed.CARD_MACROS)


@query(f"""WITH sources AS ({views.SOURCES.format(part="part")}), f AS ({views.FINDINGS.format(part="part")}),
n AS (SELECT *, {_STRIP.format("substr(COALESCE(front, ''), 1, 30)")} AS head, CASE WHEN contains(card_id, '-') THEN lower(replace(regexp_extract(card_id, '[^-]*$'), '_', ' ')) ELSE '' END AS tail FROM f),
h AS (SELECT id, n.source, COALESCE((SELECT min(line_no) FROM sources s WHERE s.source = n.source AND head <> '' AND contains(line, head) AND ({_MACROS})), (SELECT min(line_no) FROM sources s WHERE s.source = n.source AND tail <> '' AND contains(lower(line), tail))) AS line_no FROM n)
SELECT id, CAST(COALESCE(h.line_no, 0) AS BIGINT) AS line_no, COALESCE(substr({_STRIP.format("line")}, 1, 120), '') AS excerpt FROM h LEFT JOIN sources s ON s.source = h.source AND s.line_no = h.line_no""")
def finding_source_lines(spark, sf):
    return integrity.source_lines(views.view(spark, sf, views.FINDINGS, "part"), views.view(spark, sf, views.SOURCES, "part"))


_LANGUAGE = queries_fleet.ORACLES["code_languages"]
_LANGUAGE = _LANGUAGE[_LANGUAGE.index("CASE WHEN trim(listing)") : _LANGUAGE.index(" AS language FROM t")]


@query(rf"""WITH listed AS ({views.LISTED.format(part="part")}), m AS (SELECT doc, regexp_extract_all(text, '(?s).begin.verbatim.(.*?).end.verbatim.', 1) AS bodies, string_split_regex(text, '(?s).begin.verbatim..*?.end.verbatim.') AS rest FROM listed),
b AS (SELECT doc, unnest(bodies) AS listing, generate_subscripts(bodies, 1) AS k FROM m), l AS (SELECT doc, k, listing AS body, ({_LANGUAGE}) AS language FROM b),
j AS (SELECT doc, list(CASE WHEN language IS NULL THEN chr(92) || 'begin{{verbatim}}' || body || chr(92) || 'end{{verbatim}}' ELSE chr(92) || 'begin{{minted}}{{' || language || '}}' || body || chr(92) || 'end{{minted}}' END ORDER BY k) AS new, count(language) AS converted, count(*) - count(language) AS untyped FROM l GROUP BY doc)
SELECT m.doc, array_to_string(list_transform(list_zip(rest, COALESCE(new, [])), lambda z: z[1] || COALESCE(z[2], '')), '') AS text, COALESCE(converted, 0) AS converted, COALESCE(untyped, 0) AS untyped FROM m LEFT JOIN j USING (doc)""")
def listings_typed(spark, sf):
    return rewriting.typed_listings(views.view(spark, sf, views.LISTED, "part"), "doc")


_SETTINGS_WANTED = (
    rewriting.Setting("metrics", "check_cmd", 'pages "guide/main.pdf" \\d+', entry="page_count"),
    rewriting.Setting("metrics", "check_cmd", "warnings {log} --json", entry="latex_overflow_visible"),
    rewriting.Setting("readiness_checks", "cmd", "refs chapters/*.tex", word="check_refs"),
    rewriting.Setting("readiness_checks", "cmd", "warnings {log} --red 5", word="check_latex_warnings"),
)
_LOG = "'guide/' || COALESCE(NULLIF(regexp_extract(line, 'main(?:_digital)?\\.log'), ''), 'main.log')"


def _setting(s: rewriting.Setting) -> str:
    quoted = s.value.replace("\\", "\\\\").replace('"', '\\"')
    more = f" AND entry = '{s.entry}'" if s.entry else f" AND contains(line, '{s.word}')"
    return f"WHEN section = '{s.section}' AND starts_with(line, '    {s.key}:'){more} THEN '    {s.key}: \"' || replace('{quoted}', '{{log}}', {_LOG}) || '\"'"


@query(rf"""WITH f AS ({views.SETTING_FILES.format(supplier="supplier")}), l AS (SELECT doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM f WHERE text IS NOT NULL),
t AS (SELECT *, NULLIF(regexp_extract(line, '^([A-Za-z][\w-]*):', 1), '') AS top, NULLIF(regexp_extract(line, '^  ([A-Za-z_]+):\s*$', 1), '') AS sub FROM l),
s AS (SELECT *, (SELECT arg_max(u.top, u.k) FROM t u WHERE u.doc = t.doc AND u.k <= t.k AND u.top IS NOT NULL) AS section, (SELECT max(u.k) FROM t u WHERE u.doc = t.doc AND u.k <= t.k AND u.top IS NOT NULL) AS since FROM t),
e AS (SELECT *, (SELECT arg_max(u.sub, u.k) FROM t u WHERE u.doc = s.doc AND u.k <= s.k AND u.k >= s.since AND u.sub IS NOT NULL) AS entry FROM s),
n AS (SELECT doc, k, line, CASE {' '.join(_setting(s) for s in _SETTINGS_WANTED)} ELSE line END AS new FROM e)
SELECT f.doc, any_value(f.text) IS NOT NULL AND COALESCE(bool_or(new <> line), false) AS changed, string_agg(new, chr(10) ORDER BY k) AS text FROM f LEFT JOIN n USING (doc) GROUP BY f.doc""")
def settings_rewritten(spark, sf):
    return rewriting.rewritten_settings(views.view(spark, sf, views.SETTING_FILES, "supplier"), _SETTINGS_WANTED, "doc")


@query(None)
def cut_texts(spark, sf):
    marked = F.regexp_replace(F.regexp_replace("text", r"\b(\w{5,8})\b", r"\$$1\$"), r"\b(\w{9,})\b", r"\\($1\\)")
    return ad.table(spark, sf, "documents").select("doc_id", cutting.cut(marked, 400).alias("cut"))
