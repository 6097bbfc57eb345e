"""Collections of files and notes as views over the plain tables, in SQL that Spark and other engines read alike.

Backslashes, braces and line ends are chr() calls, so that no engine's escapes matter. The texts vary:
missing files and texts, nested and unclosed markup, several elements on one line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.sources import adapters as ad


def macro(name: str, *arguments: str) -> str:
    r"""SQL text of \name{argument}..., the arguments being SQL."""
    return " || ".join([f"chr(92) || '{name}'", *(f"chr(123) || {a} || chr(125)" for a in arguments)])


def begin(name: str) -> str:
    return macro("begin", f"'{name}'")


_K = "s_suppkey"
_NUMBERS = "(SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) AS numbers"
_S = f"CAST({_K} AS STRING)"
_I = "CAST(i AS STRING)"

FILES = f"""
SELECT collection, rel_path, text, CAST(COALESCE(length(text), 0) AS BIGINT) AS size FROM (
SELECT {_K} AS collection, 'guide_qa.yaml' AS rel_path, 'guide:' || chr(10) || 'los:' || chr(10) || CASE WHEN {_K} % 6 <> 0 THEN 'metrics:' || chr(10) ELSE '' END || 'readiness_checks:' || chr(10)
 || CASE WHEN {_K} % 13 = 0 THEN 'cmd: scripts/validation/check_refs.py ' ELSE '' END || CASE WHEN {_K} % 7 = 0 THEN 'mdls x ' ELSE '' END || CASE WHEN {_K} % 14 = 0 THEN 'pdfinfo y' ELSE '' END AS text
 FROM {{supplier}} WHERE {_K} % 11 <> 0
UNION ALL SELECT {_K}, 'Makefile', 'all: x' || chr(10) || CASE WHEN {_K} % 5 = 0 THEN 'include $(TOOLING)/Makefile' WHEN {_K} % 5 = 1 THEN 'qa-health: a' || chr(10) || 'qa-refs: b'
 WHEN {_K} % 5 = 2 THEN 'qa-health: qa-refs: qa-los: qa-cards: qa-presentation:' ELSE 'none' END || CASE WHEN {_K} % 17 = 0 THEN ' ~/Claude/x' ELSE '' END FROM {{supplier}} WHERE {_K} % 9 <> 0
UNION ALL SELECT {_K}, 'notebook-extensions.sty', {macro("interviewmargin")} || ' ' || CASE WHEN {_K} % 4 <> 0 THEN {macro("formulamargin")} ELSE '' END FROM {{supplier}} WHERE {_K} % 8 <> 0
UNION ALL SELECT {_K}, 'cards/all_cards.yml', repeat('x', CAST({_K} % 200 AS INT)) FROM {{supplier}} WHERE {_K} % 10 <> 0
UNION ALL SELECT {_K}, 'decks/c' || {_I} || '.apkg', NULL FROM {{supplier}}, {_NUMBERS} WHERE ({_K} + i) % 3 <> 0 AND {_K} % 12 <> 0
UNION ALL SELECT {_K}, 'decks/All_Complete.apkg', NULL FROM {{supplier}} WHERE {_K} % 4 <> 0
UNION ALL SELECT {_K}, 'review/dashboard.md', 'State [G] ' || CASE WHEN {_K} % 3 = 0 THEN '[R] and [ R ]' ELSE '[Y]' END FROM {{supplier}} WHERE {_K} % 15 <> 0
UNION ALL SELECT {_K}, 'chapters/' || CASE i WHEN 0 THEN '00_intro' WHEN 4 THEN 'A_notes' ELSE '0' || {_I} || '_m' || {_I} || '_part' END || '.tex', CASE WHEN {_K} % 29 = 0 AND i = 2 THEN NULL ELSE
 repeat({begin("problem")} || 'x ', CAST({_K} % 7 AS INT)) || repeat({begin("keyconcept")} || chr(10), CAST(({_K} + i) % 5 AS INT)) || repeat({macro("patternmargin", "'a ' || " + macro("textbf", "'b'"))} || ' ', CAST(({_K} * i) % 12 AS INT))
 || CASE WHEN i = 1 THEN {begin("vignette")} ELSE '' END || {macro("term", "'t'", "'d'")} || chr(92) || 'term[x' || chr(10) || chr(92) || 'item[L-1.' || {_I} || '] ' || repeat('plain words ', CAST(({_K} + i) % 9 AS INT)) || {macro("end", "'itemize'")} END FROM {{supplier}}, {_NUMBERS}
UNION ALL SELECT {_K}, 'review/gold_audit_2026-0' || {_I} || '.md', '**Guide**: `x` (y, ' || CASE WHEN {_K} % 5 = 0 THEN 'TBV' ELSE 'A. Person' END || ')' || chr(10) || CASE WHEN {_K} % 7 = 0 THEN 'Subsequent revisions may deepen' || chr(10) ELSE '' END
 || repeat('evidence word ', CAST(({_K} % 4) * 100 + i AS INT)) || repeat('Ch. 3 and p. 12 ', CAST({_K} % 3 AS INT)) || CASE WHEN {_K} % 2 = 0 THEN 'E/F source verification' ELSE '' END FROM {{supplier}}, {_NUMBERS} WHERE i > 2 AND {_K} % 6 <> 1
) AS files
"""

SETTINGS = f"""
SELECT {_K} AS collection, CASE WHEN {_K} % 4 = 1 THEN 'True' WHEN {_K} % 4 = 2 THEN 'no' END AS decks_complete_only, CASE WHEN {_K} % 8 = 1 THEN ' ' ELSE 'short course' END AS justification,
 CASE WHEN {_K} % 6 = 0 THEN 'true' END AS red_waiver, CASE WHEN {_K} % 12 = 0 THEN 'known' ELSE '' END AS red_justification, CASE WHEN {_K} % 5 = 0 THEN 'aws_cert' WHEN {_K} % 5 = 1 THEN 'unknown' ELSE 'default' END AS profile
FROM {{supplier}}
"""

MAPPED = f"""SELECT {_K} AS collection, 'm' || {_I} AS module FROM {{supplier}}, {_NUMBERS} WHERE i > 0 AND ({_K} + i) % 6 <> 0 AND {_K} % 10 <> 3"""

NOTES = f"""
SELECT p_size AS collection, p_partkey AS note_id, CASE WHEN p_partkey % 7 = 0 THEN 'see ' || {macro("ref", "'p:' || CAST(p_partkey AS STRING)")} || ' and ' || {macro("ref", "'p:' || CAST(p_partkey % 40 AS STRING)")}
 WHEN p_partkey % 7 = 1 THEN 'as in ' || CAST(p_partkey % 60 AS STRING) || ' or ' || CAST(p_size AS STRING) WHEN p_partkey % 7 = 2 THEN 'from vol' || CAST(p_size AS STRING) || ' on' WHEN p_partkey % 7 = 3 THEN 'see Module 3'
 WHEN p_partkey % 7 = 4 THEN p_name WHEN p_partkey % 7 = 5 THEN '' END AS note FROM {{part}}
"""

LABELS = """SELECT p_size AS collection, 'p:' || CAST(p_partkey AS STRING) AS label FROM {part} WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_size, 'p:' || CAST(p_partkey % 40 AS STRING) FROM {part}"""


_P = "CAST(p_partkey AS STRING)"
_NL = "chr(10)"


def either(*cases: tuple[str, str], other: str = "''") -> str:
    """SQL text that is of the first condition that holds."""
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in cases) + f" ELSE {other} END"


def joined(*parts: str) -> str:
    return " || ".join(parts)


def item(*parts: str) -> str:
    return joined("chr(92) || 'item'", *parts)


_DEEP = joined(begin("itemize"), item("' inner one '"), begin("enumerate"), item("' deep '"), begin("itemize"), item("' deepest ' || p_type"), macro("end", "'itemize'"), item("' deep again'"), macro("end", "'enumerate'"), item("' inner two '"), macro("end", "'itemize'"))
_BOX_BODY = joined(
    begin("enumerate"), "'[label=a]'", _NL,
    item("'[ABC-1.' || CAST(p_size AS STRING) || '] explain ' || p_name || ' '", either(("p_partkey % 3 = 0", macro("checkpointanswer", joined("'as '", macro("textbf", "p_brand"), "' says'"))), ("p_partkey % 3 = 1", "'" + "'")), _NL),
    either(("p_partkey % 4 <> 1", joined(item("' list the parts of ' || p_type || ' '"), _DEEP, "' and say why'", _NL))),
    either(("p_partkey % 4 = 0", item("' short'"))),
    item("' when does ' || p_brand || ' hold? '", either(("p_partkey % 5 = 2", joined("chr(92) || 'hfill'", macro("textit", "'(XY-2.' || CAST(p_partkey % 7 AS STRING) || ')'"))))),
    macro("end", "'enumerate'"), "chr(92) || 'medskip and more '",
    either(("p_partkey % 6 = 1", joined(begin("enumerate"), item("' a sibling list asks for ' || p_name"), macro("end", "'enumerate'")))),
    either(("p_partkey % 2 = 0", joined(macro("textbf", "'Answers:'"), begin("enumerate"), item("' first answer ' || p_brand"), item("'[ABC-1.' || CAST(p_size AS STRING) || '] second '", _DEEP), item("'[NEW-3.1] third'"), macro("end", "'enumerate'")))),
)
BOXES = f"""
SELECT p_partkey AS doc, 'Ch' || CAST(p_size AS STRING) AS chapter, {joined(
    "'Text before. '", item("' outside any box'"), either(("p_partkey % 3 = 1", joined(begin("tcolorbox"), "'[checkpointbox, title=' || chr(123) || 'Check ' || p_brand || chr(125) || ']' || chr(10)", either(("p_partkey % 11 = 3", joined(begin("tcolorbox"), "'an aside'", macro("end", "'tcolorbox'")))))), other=begin("checkpointbox")),
    _BOX_BODY,
    either(("p_partkey % 13 = 6", "'never closed '"), ("p_partkey % 3 = 1", macro("end", "'tcolorbox'")), other=macro("end", "'checkpointbox'")),
    "' between '", item("' not in a box'"),
    either(("p_partkey % 6 = 5", joined(begin("checkpointbox"), item("' a box without a list environment ' || p_name"), macro("end", "'checkpointbox'")))),
)} AS text FROM {{part}} WHERE p_partkey % 17 <> 0
UNION ALL SELECT p_partkey, 'Ch0', CASE WHEN p_partkey % 34 = 0 THEN NULL ELSE '' END FROM {{part}} WHERE p_partkey % 17 = 0
"""

_SOLUTION = joined(begin("solution"), "' solved by ' || p_brand || ' '", macro("end", "'solution'"))
_CASE = joined(
    begin("vignette"), either(("p_partkey % 3 <> 0", "'[Case ' || p_name || ']'")), either(("p_partkey % 3 = 1", "'[ABC-1.' || CAST(p_size AS STRING) || ', ABC-2.1]'")), "' A plant makes ' || p_type || '. '",
    either(("p_partkey % 5 = 0", joined(macro("textbf", "'Discussion Questions:'"), "' What now? '")), ("p_partkey % 5 = 1", joined(macro("textit", "'Questions:'"), "' One. '", macro("textbf", "'Question 1:'"), "' Two. '")), ("p_partkey % 5 = 2", joined(macro("textbf", "'Question'"), "' Why?'"))),
    either(("p_partkey % 7 = 3", begin("vignette") + " || ' opened within '")),
)
CASES = f"""
SELECT p_partkey AS doc, 'Ch' || CAST(p_size AS STRING) AS chapter, {joined(
    "'Start. '", either(("p_partkey % 4 = 0", _SOLUTION)), _CASE, either(("p_partkey % 19 = 5", "' not closed '"), other=macro("end", "'vignette'")),
    either(("p_partkey % 8 = 1", begin("problem") + " || ' another task '"), ("p_partkey % 8 = 2", "repeat('far away ', 2700)"), ("p_partkey % 8 = 3", "repeat('near by ', 3100)"), ("p_partkey % 8 = 4", begin("problembox")), other="' then '"),
    either(("p_partkey % 9 = 4", begin("solution") + " || ' never closed'"), other=_SOLUTION), "' between '",
    either(("p_partkey % 2 = 0", joined(_CASE, macro("end", "'vignette'"), either(("p_partkey % 6 = 0", _SOLUTION))))),
)} AS text FROM {{part}} WHERE p_partkey % 17 <> 0
"""


_CITE = either(("i <> 1 OR s_suppkey % 4 <> 2", macro("parencite", "'k' || CAST(i AS STRING)")), ("s_suppkey % 8 = 2", "chr(37) || ' ' || " + macro("cite", "'only in a comment'")))


def _repeated(template: str, places: str = "01234") -> str:
    return joined(*("(" + template.replace(_I, f"'{i}'").replace(" i ", f" {i} ").replace("(i ", f"({i} ").replace("WHEN i ", f"WHEN {i} ") + ")" for i in places))


_ITEM = joined(macro("subsection*", "'[Official] part ' || " + _I), "chr(10) || 'Prose. '", _CITE, _NL)
_DEBATE = joined(
    macro("section", "'Debate ' || " + _I), "chr(10)", "chr(92) || 'textbf' || chr(123) || 'Position A (' || " + _I + " || '): one side.' || chr(125) || ' Argument '", macro("parencite", "'a' || " + _I),
    "' ' || chr(92) || 'textbf' || chr(123) || ' position B: other side.' || chr(125) || ' Argument '", either(("i <> 2 OR s_suppkey % 3 <> 1", "'https://x.org/' || " + _I)),
    "chr(10) || chr(92) || 'textbf' || chr(123) || 'Where the book sits.' || chr(125) || ' Somewhere '", either(("s_suppkey % 5 = 1", macro("cite", "'w'"))), "' Verdict: ' || CASE WHEN i = 1 THEN 'well-supported' ELSE 'contested' END || chr(10)",
)
APPENDICES = f"""
SELECT s_suppkey AS collection, CASE WHEN s_suppkey % 12 <> 7 THEN {joined(
    macro("chapter", "'Post-Course Updates'"), "chr(10)", either(("s_suppkey % 9 = 0", "'undated'"), ("s_suppkey % 9 = 1", "'As of Sept. 2025.'"), ("s_suppkey % 9 = 2", "'current as of 2026-13, as of June 2026'"), ("s_suppkey % 9 = 3", "'as of 2027-01'"), other="'Current as of 2026-0' || CAST(s_suppkey % 7 + 1 AS STRING)"), "'. names where the book sits' || chr(10)",
    either(("s_suppkey % 11 = 4", "'No significant changes identified yet' || chr(10)"), ("s_suppkey % 11 = 5", joined(begin("itemize"), "chr(10)", _repeated(joined("' ' || chr(92) || 'item one ' || " + _I, "chr(10)"), "012"), macro("end", "'itemize'"), "chr(10)")), other=_repeated(_ITEM, "012")),
    either(("s_suppkey % 10 <> 8", joined(macro("section", "'What Still Holds'"), "chr(10)", macro("subsection*", "'Core ideas'"), "chr(10) || 'Stable material v' || CAST(s_suppkey % 5 AS STRING)"))), either(("s_suppkey % 7 = 3", "chr(10) || 'Subsequent revisions may deepen ' || " + macro("cite", "'template'"))),
)} END AS changes,
 CASE WHEN s_suppkey % 14 <> 9 THEN {joined("'Each debate names where the book sits. '", _repeated(_DEBATE, "01"), either(("s_suppkey % 6 <> 4", _repeated(_DEBATE, "2"))))} END AS debates,
 CASE s_suppkey % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'medium' ELSE 'slow' END AS velocity, CASE WHEN s_suppkey % 4 = 1 THEN 'v' || CAST(s_suppkey % 10 AS STRING) || ' (seen)' WHEN s_suppkey % 4 = 2 THEN 'TBV' END AS version,
 CASE WHEN s_suppkey % 6 = 4 AND s_suppkey % 4 = 0 THEN 'true' END AS debates_waiver, CASE WHEN s_suppkey % 24 = 4 THEN 'a reason' ELSE ' ' END AS debates_justification
FROM {{supplier}}
"""


_TICK, _BS = "chr(96)", "chr(92)"
_LB, _RB = "chr(123)", "chr(125)"
PROTECTED = f"""
SELECT p_partkey AS doc, {joined(
    "'If a < b then ' || p_name", either(("p_partkey % 3 = 0", "' <b>bold</b> and 3 > 2'")), either(("p_partkey % 4 = 1", joined("' code '", _TICK, "'x < y && y > z'", _TICK, "' < after'"))),
    either(("p_partkey % 5 = 2", joined("' maths $p < q$ and ' || chr(92) || '$5 < 6 ' || chr(92) || '(r > s' || chr(92) || ') end >'"))), either(("p_partkey % 6 = 3", joined(_NL, _TICK, _TICK, _TICK, "'sql' || chr(10) || 'a < b > c' || chr(10)", _TICK, _TICK, _TICK, "chr(10) || '<<'"))),
    either(("p_partkey % 7 = 1", "' $$t <' || chr(10) || ' u$$ ' || chr(92) || '[v < w' || chr(92) || '] > ' || p_brand")), either(("p_partkey % 8 = 5", "' open $n < m'")), either(("p_partkey % 9 = 4", "'<!-- a > b -->'")),
)} AS text,
 {joined(
    "p_name || ' '", macro("patternmargin", joined("'one '", macro("textbf", macro("emph", "p_brand")), "' ' || chr(92) || chr(125) || ' more'")), "' kept '",
    either(("p_partkey % 3 = 1", joined(_BS, "'warningmargin '", _LB, "' never closed '", macro("formulamargin", "'inner'"), "' 1) a 2) b'"))), either(("p_partkey % 4 = 2", joined(macro("crossrefmargin", "p_type"), macro("interviewmargin", "'x'")))), "' ' || p_type", either(("p_partkey % 5 = 3", macro("margin", "'stays'"))),
)} AS margins FROM {{part}}
"""
LEDGERS = f"""
SELECT p_partkey AS doc, 'x' AS chapter, {joined(
    "'Reference list' || chr(10)", "'@book' || chr(123) || ' key' || CAST(p_partkey AS STRING) || ',' || chr(10) || ' title = '", _LB, "p_name", _LB, "' nested '", _LB, "'deep'", _RB, _RB, "' x'", _RB, "',' || chr(10) || ' note = '", _LB, "'a' || chr(10)", _RB, "chr(10)", either(("p_partkey % 3 <> 1", _RB)), "chr(10)",
    either(("p_partkey % 4 = 1", joined("chr(37) || ' old @misc'", _LB, "'gone, x'", _RB, "' @misc'", _LB, "'gone too,'", _RB, "chr(10)"))), either(("p_partkey % 4 = 2", joined("'5 ' || chr(92) || chr(37) || ' @Article'", _LB, "'kept,t=1'", _RB))),
    "chr(10) || '@online'", _LB, "'on' || CAST(p_size AS STRING) || ', url='", _LB, "'http://x'", _RB, either(("p_partkey % 5 = 4", "' no end'"), other=_RB), "'  ' || chr(10)", either(("p_partkey % 6 = 5", joined("'@misc'", _LB, "'in one line,'", _RB, "'@misc'", _LB, "'second, a='", _LB, "'@inner'", _LB, "'cut,'", _RB, _RB, _RB))),
)} AS text FROM {{part}}
"""
COMMANDS = """
SELECT o_orderkey AS doc, CASE o_orderkey % 12 WHEN 0 THEN 'grep -c x f' WHEN 1 THEN 'grep x f | wc -l' WHEN 2 THEN 'PYTHONPATH=../t python3 -m a.b 2>/dev/null | awk "/x/"' WHEN 3 THEN 'perl -e 1' WHEN 4 THEN 'echo "$HOME"' WHEN 5 THEN 'make -C g pilot; test -f main.pdf'
 WHEN 6 THEN 'PATH=. grep x' WHEN 7 THEN 'echo a > b' WHEN 8 THEN 'grep x f || echo 0' WHEN 9 THEN 'grep "open' WHEN 10 THEN '' ELSE 'echo a & b' END || CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' ; echo ' || o_orderpriority ELSE ' | ' || lower(o_orderstatus) END AS command FROM {orders}
"""


SOURCES = f"""
SELECT p_size AS source, p_partkey AS line_no, {joined("'  '", either(("p_partkey % 4 = 0", macro("term", "'L'", "p_name || ' of ' || p_brand || ' and ' || p_type")), ("p_partkey % 4 = 1", "p_name || ' of ' || p_brand || ' and ' || p_type"), ("p_partkey % 4 = 2", "'prose on ' || upper(p_type) || ' ' || p_name"), other=macro("redflag", "p_brand")), "' '")} AS line FROM {{part}}
"""
FINDINGS = """
SELECT p_partkey AS id, p_size AS source, CASE p_partkey % 5 WHEN 0 THEN 'noid' WHEN 1 THEN 'x-TERM-' || lower(p_type) ELSE 'x-TERM-' || replace(p_name, ' ', '_') END AS card_id,
 CASE p_partkey % 6 WHEN 0 THEN p_name || ' of ' || p_brand || ' and ' || p_type || ' and much more behind it' WHEN 1 THEN p_brand WHEN 2 THEN 'zz' WHEN 3 THEN '' WHEN 4 THEN ' ' || substr(p_brand, 1, 2) || ' ' END AS front FROM {part}
"""


_VERBATIM = (begin("verbatim"), macro("end", "'verbatim'"))
LISTED = f"""
SELECT p_partkey AS doc, 'x' AS chapter, {joined(
    "'Text '", _VERBATIM[0], either(("p_partkey % 5 = 0", "chr(10) || 'def f():' || chr(10) || ' return 1' || chr(10)"), ("p_partkey % 5 = 1", "'select a from ' || p_name || ' where x'"), ("p_partkey % 5 = 2", "' plain words '"), ("p_partkey % 5 = 3", "chr(10) || '$ ls -l' || chr(10)"), other="''"), either(("p_partkey % 7 <> 4", _VERBATIM[1])), "' between '",
    either(("p_partkey % 3 = 0", joined(_VERBATIM[0], either(("p_partkey % 9 = 0", _VERBATIM[0])), "'import ' || p_brand", _VERBATIM[1], _VERBATIM[1]))), "' end '", either(("p_partkey % 4 = 2", joined(_VERBATIM[0], "'lambda open'"))),
)} AS text FROM {{part}}
"""


def line(*parts: str) -> str:
    return joined(*parts, "chr(10)")


SETTING_FILES = f"""
SELECT s_suppkey AS doc, CASE WHEN s_suppkey % 13 <> 0 THEN {joined(
    line("'guide: ' || s_name"), line("'    check_cmd: outside'"), line("'metrics:'"), line("'  page_count:'"), line("'    check_cmd: mdls ' || s_name"), line("'    target: 5'"),
    either(("s_suppkey % 3 <> 0", joined(line("'  latex_overflow_visible: '"), line("'    check_cmd: ' || chr(34) || 'old main_digital.log' || chr(34)")))), line("'  other:'"), line("'    check_cmd: x'"),
    either(("s_suppkey % 2 = 0", joined(line("'readiness_checks:'"), line("'  - name: a'"), line("'    cmd: scripts/check_refs.py'"), line("'    cmd: check_latex_warnings ' || CASE WHEN s_suppkey % 4 = 0 THEN 'guide/main.log' ELSE '' END"), line("'   cmd: check_refs'")))), "'tail: check_cmd'",
)} END AS text FROM {{supplier}}
"""


#: Rows of a table whose texts one task makes. The tables are small files, and their texts are hundreds of times as large.
TASK_ROWS = 4000
_KEYS = {"part": "p_partkey", "supplier": "s_suppkey", "orders": "o_orderkey"}


def view(spark: SparkSession, sf: str, sql: str, name: str) -> DataFrame:
    """The rows of one of these views; name: the table that it is over.

    The table's rows are dealt out by key before the texts are made, to as many tasks as there are rows: files are
    cut, and partitions put together, by sizes that tell nothing about the texts. Rows of one document stay together.
    """
    rows = ad.table(spark, sf, name)
    return spark.sql(sql, **{name: rows.repartition(rows.count() // TASK_ROWS + 1, _KEYS[name])})


def options(*parts: str) -> str:
    """SQL text of an option in brackets."""
    return joined("'['", *parts, "']'")


def within(name: str, *parts: str) -> str:
    """SQL text of an environment."""
    return joined(begin(name), *parts, macro("end", f"'{name}'"))


_LOS = either(("p_partkey % 4 = 1", options("'ABC-1.' || CAST(p_size AS STRING)")), ("p_partkey % 4 = 2", options("' ABC-1.2, ,DEF-2.' || CAST(p_size AS STRING) || ' '")), ("p_partkey % 4 = 3", "'[ ]'"))
_TALK = joined(
    begin("interviewcontext"),
    either(("p_partkey % 9 = 0", options("'Why ' || p_brand || ' matters'")), ("p_partkey % 9 = 1", options("'Example of ' || p_name || ' example'")), ("p_partkey % 9 = 2", options("'Practice question'")), ("p_partkey % 9 = 3", options(joined(_TICK, _TICK, "'Answer' || chr(39) || chr(39) || ' structure ' || p_brand"))),
     ("p_partkey % 9 = 4", options("'Recovery'")), ("p_partkey % 9 = 5", options("'best practices for ' || p_type")), ("p_partkey % 9 = 6", options("p_name")), ("p_partkey % 9 = 7", "'[]'")), either(("p_partkey % 9 < 8", _LOS)), _NL,
    either(("p_partkey % 5 = 1", macro("companytags", "'Big Co, ' || p_brand || ' ,'"))),
    either(("p_partkey % 7 = 0", "'When asked about ' || p_name || ', begin with the end.'"), ("p_partkey % 7 = 1", "'They say: how would you make ' || p_type || '?' || chr(10) || 'And describe it.'"), ("p_partkey % 7 = 2", "'Explain why ' || repeat(p_type || ' and ', 6) || ' all hold.'"),
     ("p_partkey % 7 = 3", "'The topic covers ' || p_name || ' in some length, for ' || p_brand || ' alike. More.'"), ("p_partkey % 7 = 4", "'Short.'"), ("p_partkey % 7 = 5", "'Lead with ' || p_name || ' first' || chr(10) || 'second line'"), other="'  Key ideas: ' || p_brand || '. Walk me through ' || p_type"),
    either(("p_partkey % 5 = 1", joined("' '", macro("companytags", "'other'")))), either(("p_partkey % 16 <> 5", macro("end", "'interviewcontext'"))), "' between '",
)
_DRILL = joined(
    begin("drill"), _LOS, _NL, either(("p_partkey % 6 <> 4", macro("drillprompt", joined("' what is '", macro("textbf", "p_name"), "'?'"))), ("p_partkey % 12 = 4", joined(_BS, "'drillprompt'", _LB, "'never closed '"))), _NL,
    either(("p_partkey % 3 <> 2", macro("drillanswer", joined("p_brand || ' '", macro("frac", macro("sqrt", "'a'"), "'b'"))))), either(("p_partkey % 5 < 2", macro("technique", "' think of ' || p_type || ' '"))), either(("p_partkey % 18 <> 7", macro("end", "'drill'"))), "' then '",
)
_ROWS = "CAST(p_partkey % 4 AS INT)"
_LEVEL = within("levelcard", joined(_LB, "' Scope of ' || p_name || ' '", _RB), _LOS, either(("p_partkey % 4 = 0", "' plain words on ' || p_brand"), other=f"repeat({macro('levelrow', chr(39) + ' size ' + chr(39) + ' || p_brand', 'p_type', chr(39) + 'all' + chr(39))} || chr(10), {_ROWS})"))
_COMPARE = joined(
    within("comparisoncard", joined(_LB, "p_name", _RB, _LB, "' Left ' || p_brand", _RB, _LB, "'Right'", _RB), _LOS, either(("p_partkey % 4 = 0", "' no rows for ' || p_type"), other=f"repeat({macro('comprow', chr(39) + 'cost' + chr(39), 'p_type', chr(39) + ' b ' + chr(39))} || ' ', {_ROWS})")), "' and '",
    either(("p_partkey % 3 = 1", within("comparisoncard3", joined(_LB, "p_type", _RB, _LB, "'A'", _RB, _LB, "'B'", _RB, _LB, "p_brand", _RB), either(("p_partkey % 2 = 0", joined(macro("comprowiii", "'d1'", "'1'", "'2'", "p_name"), macro("comprowiii", "'d2'", "''", "'2'", "'3'"))), other="'words'")))),
    either(("p_partkey % 10 = 3", within("comparisoncard", "'title and columns missing'"))),
)
_PREDICT = within(
    "generatefirst", either(("p_partkey % 3 = 1", options("' Guess ' || p_brand || ' '")), ("p_partkey % 3 = 2", "'[]'")), either(("p_partkey % 8 = 3", "' short '"), other="' What will happen to ' || p_name || '? '"),
    either(("p_partkey % 5 = 0", joined(_BS, "'generateanswer '", _LB, "'It ' || chr(10)", macro("frac", macro("sqrt", macro("b", "p_type")), "'2'"), "' grows. '", _RB)), ("p_partkey % 5 = 1", joined(_BS, "'generateanswer'", _LB, "' open ' || p_type"))), "' '",
)
_ORDER = within(
    "ordering", _LOS, either(("p_partkey % 3 <> 0", "' Sort the steps of ' || p_name || ' '")), either(("p_partkey % 7 <> 2", joined(macro("orderstep", "' first ' || p_brand"), macro("orderstep", "'second'")))),
    either(("p_partkey % 6 <> 1", within("solution", "' second, then ' || p_brand || ' '"))), either(("p_partkey % 4 = 2", macro("orderstep", "'behind the solution'"))),
)
_MATCH = within("matching", _LOS, either(("p_partkey % 3 <> 1", "'Match ' || p_type")), macro("matchpair", "'pea '", "'plant'"), _NL, either(("p_partkey % 2 = 0", macro("matchpair", "p_brand", "' maker'"))), either(("p_partkey % 7 <> 6", within("solution", "'pea: plant'"))))
EXERCISES = f"""
SELECT p_partkey AS doc, CASE WHEN p_partkey % 23 <> 0 THEN {joined("'Text. '", _TALK, either(("p_partkey % 16 = 5", _TALK)), _DRILL, either(("p_partkey % 9 = 7", _DRILL)), _LEVEL, _COMPARE, _PREDICT, _ORDER, _MATCH, either(("p_partkey % 4 = 0", _ORDER)))} END AS text FROM {{part}}
"""


_APPROACH = joined(macro("textbf", "'Approach:'"), "' '", either(
    ("p_partkey % 4 = 0", joined(macro("textbf", "'(a) First:'"), "' the ' || p_type || '. More of it. '", macro("textbf", "'(b) Second.'"), "' then ' || p_brand || ' '", within("itemize", item("' inner'")))),
    ("p_partkey % 4 = 1", within("enumerate", "'[label=x]'", item("' '", macro("textbf", "'Head'"), "': take ' || p_type || ' '"), item("' then ' || p_brand || '. '", within("itemize", item("' inner'"))))),
    other="'Work with ' || p_name || ' and 1.5 times ' || p_type || '. Then Stop. And more.'",
))
_MARKED = joined("chr(37) || ' NEW: auto-generated 2026-04-30 - please review and refine' || chr(10)", macro("textbf", "'Answer:'"), either(("p_partkey % 2 = 0", joined("' '", _BS, "'textbf'", _LB, "'1.'")), other="' whole'"), _NL)
_STUBBED = joined(
    begin("problem"), either(("p_partkey % 3 = 0", within("enumerate", item("' one'"), item("' two'"))), ("p_partkey % 3 = 1", "'(a) Find ' || p_name || ' (b) Give it.'"), other="' What is it? '"), macro("end", "'problem'"), begin("solution"),
    either(("p_partkey % 5 <> 4", _APPROACH), ("p_partkey % 10 = 4", joined(macro("textbf", "'Key Insight:'"), "' it is ' || p_type || ' '"))), _NL,
    either(("p_partkey % 7 < 4", joined(macro("textbf", "'Answer:'"), "' see solution above. '")), ("p_partkey % 7 = 4", _MARKED), other=joined(macro("textbf", "'Answer:'"), "' given'")),
    either(("p_partkey % 11 <> 5", macro("end", "'solution'"))), "' between '",
)
RECAPS = f"""SELECT p_partkey AS doc, CASE WHEN p_partkey % 23 <> 0 THEN {joined("'Text '", either(("p_partkey % 6 = 1", joined(macro("textbf", "'Answer:'"), "' See solution above'"))), _STUBBED, either(("p_partkey % 4 = 3", _STUBBED)))} END AS text FROM {{part}}"""
