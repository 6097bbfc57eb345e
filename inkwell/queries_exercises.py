"""Queries over exercises in marked-up documents, with their SQL: both read the texts of one view, each with patterns of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import fixed
from inkwell.operators import exercises
from inkwell.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    def named(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return named


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(spark, sf, views.EXERCISES, "part")


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _strip(sql: str) -> str:
    return rf"regexp_replace({sql}, '^\s+|\s+$', '', 'g')"


def _given(sql: str) -> str:
    return f"NULLIF({_strip(sql)}, '')"


def _blocks(name: str, cte: str, lead: str, *groups: str) -> str:
    """CTE: doc, block, the groups of lead and the stripped rest as body."""
    whole = rf"(?s)\\begin\{{{name}\}}.*?\\end\{{{name}\}}"
    start, both = len(f"\\begin{{{name}}}"), len(f"\\begin{{{name}}}\\end{{{name}}}")
    pattern = _q(rf"(?s)^{lead}(.*)$")
    names = ", ".join(f"regexp_extract(inner_, {pattern}, {i + 1}) AS {g}" for i, g in enumerate(groups))
    return f"""{cte}_l AS (SELECT doc, regexp_extract_all(text, {_q(whole)}) AS l FROM exercises),
{cte}_m AS (SELECT doc, unnest(l) AS m, generate_subscripts(l, 1) AS block FROM {cte}_l), {cte}_i AS (SELECT doc, block, substr(m, {start + 1}, length(m) - {both}) AS inner_ FROM {cte}_m),
{cte} AS (SELECT doc, block, {names}, {_strip(f"regexp_extract(inner_, {pattern}, {len(groups) + 1})")} AS body FROM {cte}_i WHERE regexp_matches(inner_, {pattern}))"""


_VIEW = "WITH exercises AS (" + views.EXERCISES.format(part="part") + "), "
_BRACED, _BRACKET = r"\{([^}]+)\}", r"(?:\[([^\]]*)\])?"
_ONE = r"(?:[^{}]|\{[^{}]*\})*"
_TWO = r"(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*"


def _first(patterns: tuple[str, ...], sql: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({sql}, {_q(p)}) THEN {_strip(f'regexp_extract({sql}, {_q(p)}, 1)')}" for p in patterns) + " END"


def _list(sql: str) -> str:
    return f"list_filter(list_transform(string_split({sql}, ','), lambda x: {_strip('x')}), lambda x: x <> '')"


_TAGS = r"'\\companytags\{([^}]*)\}'"


@query(_VIEW + _blocks("interviewcontext", "b", _BRACKET * 2, "t", "los") + rf""",
c AS (SELECT doc, block, t, {_list("los")} AS ids, flatten(list_transform(regexp_extract_all(body, {_TAGS}, 1), lambda y: {_list("y")})) AS roles, {_strip(rf"regexp_replace(body, {_TAGS}, '', 'g')")} AS body FROM b),
s AS (SELECT *, substr(split_part(body, '.', 1), 1, 80) AS sentence, {_first(fixed.INTERVIEW_QUESTIONS, "body")} AS asked, substr({_first(fixed.INTERVIEW_TOPICS, "body")}, 1, 60) AS topic, {_strip("split_part(body, chr(10), 1)")} AS line FROM c),
n AS (SELECT *, CASE WHEN t <> '' THEN {_strip("replace(replace(replace(t, chr(96) || chr(96), ''), chr(39) || chr(39), ''), chr(34), '')")} WHEN topic IS NOT NULL THEN topic WHEN length(sentence) > 20 THEN regexp_replace(sentence, '(?s) [^ ]*$', '') || '...' ELSE 'Strategy ' || block END AS title FROM s)
SELECT doc, block, title, ids[1] AS los_id, array_to_string(ids, '|') AS los_ids, array_to_string(roles, '|') AS companies, body AS back, CASE WHEN asked IS NOT NULL THEN 'Interview Q: ' || CASE WHEN length(asked) > 100 THEN regexp_replace(substr(asked, 1, 100), '(?s) [^ ]*$', '') || '...' ELSE asked END
 ELSE 'Interview: ' || CASE WHEN contains(lower(title), 'why') AND contains(lower(title), 'matter') THEN 'Why does this matter? What business context should you lead with?'
 WHEN contains(lower(title), 'example') THEN 'Tell a STAR story about ' || {_strip("replace(replace(title, 'Example', ''), 'example', '')")} || '. What was the situation and outcome?'
 WHEN contains(lower(title), 'practice') AND contains(lower(title), 'question') THEN CASE WHEN length(line) > 10 THEN substr(line, 1, 150) ELSE 'Practice answering this question out loud.' END
 WHEN contains(lower(title), 'template') OR contains(lower(title), 'structure') THEN 'What is the ' || title || '? Walk through each step.'
 WHEN contains(lower(title), 'recovery') OR contains(lower(title), 'phrase') THEN 'What are key recovery phrases when stuck? When do you use each?' WHEN contains(lower(title), 'best practice') THEN 'What are the ' || title || '?' ELSE title END END AS front FROM n""")
def interview_questions(spark, sf):
    d = exercises.interview_questions(_docs(spark, sf), "doc")
    return d.drop("off").withColumn("los_ids", F.array_join("los_ids", "|")).withColumn("companies", F.array_join("companies", "|"))


def _macro(name: str, inner: str) -> str:
    pattern = _q(rf"\\{name}\{{({inner})\}}")
    return f"CASE WHEN regexp_matches(body, {pattern}) THEN {_strip(f'regexp_extract(body, {pattern}, 1)')} END"


@query(_VIEW + _blocks("drill", "b", _BRACKET, "los") + f""",
c AS (SELECT doc, block, {_given("los")} AS los_id, {_macro("drillprompt", _ONE)} AS front, NULLIF({_macro("drillanswer", _TWO)}, '') AS answer, NULLIF({_macro("technique", _TWO)}, '') AS technique FROM b)
SELECT doc, block, los_id, front, concat_ws(chr(10) || chr(10), '**Answer:**' || chr(10) || answer, '---' || chr(10) || chr(10) || '**Technique:**' || chr(10) || technique) AS back FROM c WHERE front IS NOT NULL""")
def drill_cards(spark, sf):
    return exercises.drills(_docs(spark, sf), "doc").drop("off")


def _table(macro: str, heads: tuple[str, ...], order: tuple[int, ...], dashes: str) -> str:
    row = _q(rf"\\{macro}" + r"\{([^}]*)\}" * (len(heads) + 1))
    cell = lambda g: _strip(f"(regexp_extract_all(body, {row}, {g + 1}))[i]")
    line = " || ' | ' || ".join(cell(g) for g in (0, *order))
    head = "'| Dimension | ' || " + " || ' | ' || ".join(heads) + " || ' |'"
    return f"CASE WHEN regexp_matches(body, {row}) THEN {head} || chr(10) || '|-----------|{dashes * len(heads)}' || chr(10) || array_to_string(list_transform(range(1, len(regexp_extract_all(body, {row})) + 1), lambda i: '| ' || {line} || ' |'), chr(10)) END"


@query(_VIEW + _blocks("levelcard", "b", _BRACED + _BRACKET, "t", "los") + f"""
SELECT doc, block, {_strip("t")} AS title, {_given("los")} AS los_id, 'IC4 vs IC5: ' || {_strip("t")} AS front, COALESCE({_table("levelrow", ("'IC4'", "'IC5'"), (1, 2), "-----|")}, body) AS back FROM b""")
def level_cards(spark, sf):
    return exercises.level_cards(_docs(spark, sf), "doc").drop("off")


_TX, _TY, _TZ, _TT = (_strip(c) for c in "xyzt")


@query(_VIEW + _blocks("comparisoncard", "b", _BRACED * 3 + _BRACKET, "t", "x", "y", "los") + ", " + _blocks("comparisoncard3", "w", _BRACED * 4 + _BRACKET, "t", "x", "y", "z", "los") + f""",
r AS (SELECT *, {_table("comprow", (_TX, _TY), (1, 2), "--------|")} AS fore, {_table("comprow", (_TY, _TX), (2, 1), "--------|")} AS aft FROM b)
SELECT doc, 'comparison' AS type, block, false AS reverse, {_TT} AS title, {_given("los")} AS los_id, 'Compare: ' || {_TT} AS front, COALESCE(fore, body) AS back FROM r
UNION ALL SELECT doc, 'comparison', block, true, {_TT}, {_given("los")}, 'Compare: ' || {_TY} || ' vs ' || {_TX} || ' (' || {_TT} || ')', aft FROM r WHERE aft IS NOT NULL
UNION ALL SELECT doc, 'comparison3', block, false, {_TT}, {_given("los")}, 'Compare: ' || {_TT}, COALESCE({_table("comprowiii", (_TX, _TY, _TZ), (1, 2, 3), "--------|")}, body) FROM w""")
def comparison_cards(spark, sf):
    return exercises.comparisons(_docs(spark, sf), "doc").drop("off")


_FOUR = r"(?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*\})*"
_OPENING = r"\\generateanswer\s*\{"
_AFTER = f"regexp_extract(body, {_q('(?s)^.*?' + _OPENING + '(.*)$')}, 1)"
_CLOSED = _q("(?s)^(" + _FOUR + r")\}")


@query(_VIEW + _blocks("generatefirst", "b", _BRACKET, "t") + f""",
c AS (SELECT *, regexp_matches(body, {_q(_OPENING)}) AND regexp_matches({_AFTER}, {_CLOSED}) AS closed FROM b),
d AS (SELECT doc, block, CASE WHEN t <> '' THEN {_strip("t")} ELSE 'Predict Before Reading' END AS title, CASE WHEN closed THEN {_strip(f"regexp_extract(body, {_q('(?s)^(.*?)' + _OPENING)}, 1)")} ELSE body END AS prompt,
 CASE WHEN closed THEN {_strip(f"regexp_extract({_AFTER}, {_CLOSED}, 1)")} ELSE '{fixed.GENERATE_PLACEHOLDER}' END AS back FROM c)
SELECT doc, block, title, 'Before reading: ' || prompt AS front, back FROM d WHERE length(prompt) >= 15""")
def prediction_cards(spark, sf):
    return exercises.predictions(_docs(spark, sf), "doc").drop("off")


_SOLVED = _q(r"(?s)^(.*?)\\begin\{solution\}(.*?)\\end\{solution\}")


def _arranged(cte: str, kind: str, macro: str, n: int, ask: str) -> str:
    row = _q(rf"\\{macro}" + _BRACED * n)
    lines = f"array_to_string(list_transform(regexp_extract_all(body, {row}, 1), lambda x: '- ' || {_strip('x')} || '{'' if n == 1 else ' -> ???'}'), chr(10))"
    tail = "" if n == 1 else f" || chr(10) || chr(10) || '**Categories:** ' || array_to_string(list_transform(regexp_extract_all(body, {row}, 2), lambda x: {_strip('x')}), ' | ')"
    prompt = _given(f"regexp_extract(body, {_q('(?s)^(.*?)' + chr(92) * 2 + macro + chr(92) + '{')}, 1)")
    return f"""SELECT doc, '{kind}' AS type, block, {_given("los")} AS los_id, COALESCE({prompt}, '{ask}') || chr(10) || chr(10) || {lines}{tail} AS front, answer AS back
 FROM (SELECT doc, block, los, {_strip(f"regexp_extract(body, {_SOLVED}, 2)")} AS answer, {_strip(f"regexp_extract(body, {_SOLVED}, 1)")} AS body FROM {cte} WHERE regexp_matches(body, {_SOLVED})) WHERE regexp_matches(body, {row})"""


@query(_VIEW + _blocks("ordering", "o", _BRACKET, "los") + ", " + _blocks("matching", "m", _BRACKET, "los") + "\n" + _arranged("o", "ordering", "orderstep", 1, fixed.ORDERING_PROMPT) + "\nUNION ALL " + _arranged("m", "matching", "matchpair", 2, fixed.MATCHING_PROMPT))
def arrangement_cards(spark, sf):
    return exercises.arrangements(_docs(spark, sf), "doc").drop("off")
