"""Structure of documents, the currency gate and scans that keep places, on small hand-written tables."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell import queries_structure
from inkwell.functions import fixed, scanning, snippets
from inkwell.operators import currency, integrity, rewriting, rules, structure
from inkwell.sources import views

BOX = r"""\item out \begin{checkpointbox}
\begin{enumerate}
\item[AB-1.1] Explain the first thing \checkpointanswer{because {x}}
\item Compare these parts: \begin{itemize}\item one \begin{enumerate}\item deep \begin{itemize}\item deepest\end{itemize}\end{enumerate}\end{itemize} and more
\item short
\item What holds afterwards? \hfill\textit{(AB-1.4)}
\end{enumerate}
\medskip junk
\begin{enumerate}\item A sibling list asks as well\end{enumerate}
\textbf{Answers:}
\begin{enumerate}\item no \item[AB-1.1] paired \begin{itemize}\item in it\end{itemize} tail \item third \item fourth \item[NEW-1.1] fifth\end{enumerate}
\end{checkpointbox} \item outside"""


def texts(spark, *values):
    return spark.createDataFrame([(i, "Ch1", v) for i, v in enumerate(values)], "doc long, chapter string, text string")


def test_items_of_boxes(spark):
    d = texts(spark, BOX, r"\begin{checkpointbox}\item never closed at all", None, "", r"\begin{tcolorbox}[checkpointbox, title={Check}] \begin{tcolorbox}aside \item in the aside\end{tcolorbox} \item Which of them is it?\end{tcolorbox} \item no")
    rows = {(r.doc, r.no): r for r in structure.checkpoint_cards(d, "chapter", "doc").collect()}
    assert {k: (r.front, r.back, r.back_from, r.los_id) for k, r in rows.items() if k[0] == 0} == {
        (0, 1): ("Explain the first thing", "because {x}", "inline", "AB-1.1"),
        (0, 2): (r"Compare these parts: \begin{itemize}\item one \begin{enumerate}\item deep \begin{itemize}\item deepest\end{itemize}\end{enumerate}\end{itemize} and more", r"paired \begin{itemize}\item in it\end{itemize} tail", "paired", None),
        (0, 4): (r"What holds afterwards? \hfill\textit{(AB-1.4)}", "fourth", "paired", "AB-1.4"),
        (0, 5): ("A sibling list asks as well", "fifth", "paired", None),
    }
    assert set(rows) - {k for k in rows if k[0] == 0} == {(4, 1)}  # at the least depth stands the item outside the aside
    assert rows[4, 1].title == "Check" and rows[4, 1].back.startswith("Self-check from: Check\n\n(")
    assert BOX[rows[0, 1].off :].startswith(r"\item[AB-1.1]")


def test_prompts_without_answer_keys(spark):
    found = structure.checkpoint_prompts(texts(spark, BOX), "doc").collect()
    assert sorted((r.half, r.los_id) for r in found) == [(0, "AB-1.1"), (1, "NEW-1.1")]


@pytest.mark.parametrize("name", ["checkpoint_items", "checkpoint_prompts"])
def test_boxes_are_dealt_out_once_before_their_texts_are_made(spark, name):
    """So a task holds the pieces of about views.TASK_ROWS texts, whatever the size of the table."""
    d = queries_structure.QUERIES[name](spark, "/root/testdata/sf0.01")
    plan = d._jdf.queryExecution().executedPlan().toString()
    deals = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(deals) == 2 and all("REPARTITION_BY_NUM" in line for line in deals)  # one for each branch of the union


CASE = r"\begin{vignette}[T][AB-1.1, AB-2]Body.\textbf{Question 2:} why?\end{vignette}"
CASES = [
    (CASE + r" gap \begin{solution} S \end{solution}", True),
    (CASE + r" \begin{problem}p\end{problem}\begin{solution} S \end{solution}", False),
    (CASE + r" \begin{vignette}open \begin{solution} S \end{solution}", False),
    (CASE + "x" * 24_960 + r"\begin{solution} S \end{solution}", True),
    (CASE + "x" * 24_990 + r"\begin{solution} S \end{solution}", False),
    (CASE + r" \begin{solution} never closed", False),
    (r"\begin{solution} S \end{solution}" + CASE, False),
]


@pytest.mark.parametrize(("text", "solved"), CASES)
def test_solutions_of_vignettes(spark, text, solved):
    r = structure.vignettes(texts(spark, text), "doc").first()
    assert (r.title, r.los_id, r.front, r.has_solution) == ("T", "AB-1.1, AB-2", "Case Study: T\n\nBody.", solved)
    assert r.back == r"\textbf{Question 2:} why?" + ("\n\n---\n\n**Answer Rubric:**\nS" if solved else "")


def test_marks_of_questions_by_kind(spark):
    d = texts(spark, r"\begin{vignette} a \textit{Questions:} b \textbf{Question:} c\end{vignette}", r"\begin{vignette}none\end{vignette}")
    assert [(r.front, r.back) for r in structure.vignettes(d, "doc").orderBy("doc").collect()] == [("Case Study: Case Study\n\na \\textit{Questions:} b", r"\textbf{Question:} c"), ("Case Study: Case Study", "none")]


def notes(n=3, uncited=(), head="Current as of 2026-07.", tail="\\section{What Still Holds}\n\\subsection*{Core}\nStable.\n"):
    return f"\\chapter{{U}}\n{head}\n\\section{{Changes}}\n" + "".join(f"\\subsection*{{Part {i}}}\nProse.{'' if i in uncited else ' https://x.org'}\n" for i in range(n)) + tail


def debates(n=3, uncited=(), verdict_cites=False):
    one = "\\section{{D}}\n\\textbf{{Position A: x.}} \\parencite{{a}}\n\n\\textbf{{Position B: y.}} {b}\n\n\\textbf{{Where the book sits.}} {w} Verdict: contested.\n"
    return "Prose that names where the book sits.\n" + "".join(one.format(b="" if i in uncited else "10.1000/x.y", w="\\cite{w}" if verdict_cites else "") for i in range(n))


GATES = [
    (notes(), debates(), {}, "E ok; F ok"),
    (notes(uncited={1}), debates(uncited={0, 2}, verdict_cites=True), {}, "E: 1/3 items uncited | F: 2/6 Positions uncited"),
    (notes(head="as of Sept. 2025"), debates(), {}, "E: E age 11mo > fast SLA 6mo | F: ok"),
    (notes(head="as of 2026-00, as of June 2026"), None, {}, "E ok | F".replace("E ok | F", "E: ok | F: F_contrasting_opinions_open_debates.tex missing")),
    (notes(head="as of 2026-12"), debates(2), {"waiver": "true", "why": "short"}, "E: E date is in the future | F: waived"),
    (None, debates(2), {"waiver": "true", "why": " "}, "E: E_post_course_updates.tex missing | F: <3 debates (2); missing verdict flags (well-supported/contested/dated); <6 resolvable citations (4)"),
    (notes(0, head="as of 2026-08. No significant changes yet"), debates(), {}, "E: E is a stub (no-changes-yet placeholder); <3 currency items | F: ok"),
    (notes(tail=""), debates(), {"version": "v4 (seen)"}, "E: no 'what still holds' section; E does not name MEAP version (v4) | F: ok"),
    (notes(uncited={0}).replace("Prose.\n", "Prose. % \\cite{x}\n"), debates(), {"version": "TBV"}, "E: 1/3 items uncited | F: ok"),
]


@pytest.mark.parametrize(("e", "f", "more", "detail"), GATES)
def test_currency_gate(spark, e, f, more, detail):
    row = (1, e, f, "fast", more.get("version"), more.get("waiver"), more.get("why"))
    d = spark.createDataFrame([row], "collection long, changes string, debates string, velocity string, version string, debates_waiver string, debates_justification string")
    r = currency.currency_gate(d, "2026-08").first()
    assert (r.detail, r.passed) == (detail, detail.startswith("E ok; "))


def test_currency_remarks(spark):
    d = spark.createDataFrame([(1, notes(uncited={1}), debates(), "fast", None, None, None)], "collection long, changes string, debates string, velocity string, version string, debates_waiver string, debates_justification string")
    r = currency.currency_gate(d, "2026-08", strict=False).first()
    assert (r.passed, r.detail) == (True, "E: ok (1/3 items uncited, advisory) | F: ok")


ACCEPTED = [
    "grep -c '^@' refs.bib", r"grep -rc '\\los{' chapters/ | awk -F: '{s+=$2}END{print s}'", r"grep -c '\\term\[' glossary.tex", "PYTHONPATH=../t python3 -m a.b main.log --json 2>/dev/null | python3 -c \"import sys; print(1)\"",
    "make -C guide pilot; test -f main.pdf", "grep -c x f 2>/dev/null || grep -c y g 2>/dev/null || echo 0", "echo 0 >/dev/null", "wc -l a*.tex", r"echo a\;b", "'grep' x f", "pdfinfo x.pdf", "grep x f |wc -l", "echo \"it's; fine | so\"",
]
REFUSED = [
    ("grep -c x f; touch /tmp/p", "allowlist"), ("grep -c x f && touch /tmp/p", "forbidden shell character"), ("grep x $(date)", "outside single quotes"), ("grep x `date`", "backtick"), ('python3 -c "x" > /tmp/p', "redirect"),
    ("grep x f 2>/tmp/p", "redirect"), ("grep x 2>/dev/nullX", "redirect"), ("perl -e 1", "allowlist"), ("grep x f & ", "forbidden shell character"), ('python3 -c "$(date)"', "outside single quotes"), (r'echo "a \$b"', "outside single quotes"),
    ("PYTHONPATH=$HOME python3", "outside single quotes"), ("'perl' -e 1", "allowlist"), ("grep x f | perl -ne 1", "allowlist"), ("", "empty"), ("   ", "empty"), (None, "empty"), ("grep 'open", "unterminated quote"), ('grep "open', "unterminated quote"),
    ("grep x f <in", "forbidden shell character"), ("PYTHONPATH=x", "no executable"), ("PATH=./bin grep x", "env assignment"), ("LD_PRELOAD=./x.so grep x", "env assignment"), ("grep x \\", "trailing backslash"), ("|;", "no command"), (r"\cmake x", "allowlist"), ("grep x\nperl", "forbidden shell character"), ("echo #x", "forbidden shell character"),
]


def test_commands(spark):
    d = spark.createDataFrame([(c, None) for c in ACCEPTED] + REFUSED, "command string, why string")
    for r in d.select("command", "why", scanning.command_refusal("command").alias("r")).collect():
        assert (r.r is None) == (r.why is None) and (r.why or "") in (r.r or ""), (r.command, r.r)


@settings(max_examples=300, deadline=None)
@given(st.text("gre p|;'\"\\$>2&/devnul", max_size=40))
def test_quoted_text_is_never_cut(command):
    assert scanning.refusal("'" + command.replace("'", "") + "'" if command else "''") != "no command found"
    scanning.refusal(command)


def test_masks_keep_places(spark):
    values = ["a <b `x < y` $p < q$ c", "```sql\na < b\n``` <", r"\(r > s\) > \[t", "$$a\n<$$ <b>c</b> <!-- > --> <", r"\$5 < \$6 $x$", "", "`open < ", "$a\n<$"]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc long, text string")
    for r in d.select("text", scanning.masked("text").alias("m")).collect():
        assert len(r.m) == len(r.text) and all(a in (b, " ") for a, b in zip(r.m, r.text, strict=True))
    found = [(r.doc, r.place, r.mark) for r in scanning.stray_angles(d, "text", "doc").orderBy("doc", "place").collect()]
    assert all(values[doc][place - 1] == mark for doc, place, mark in found)
    assert [(doc, place) for doc, place, _ in found] == [(0, 3), (1, 18), (2, 11), (3, len(values[3])), (4, 5), (6, 7), (7, 4)]


def test_masking_works_a_text_out_once(spark):
    """It was worked out twice for each kind of region, and so were all maskings before it."""
    d = spark.range(1).select(scanning.masked(F.upper(F.concat(F.lit("a $b < c$ "), F.col("id").cast("string")))).alias("m"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1 and d.first().m == "A         0"


def test_margins_go(spark):
    d = texts(spark, r"a \patternmargin{x {y \} z} {}} b", r"a \warningmargin {open \formulamargin{in} b", r"\margin{stays} \%", None)
    assert [r.x for r in d.orderBy("doc").select(scanning.without_margins("text").alias("x")).collect()] == ["a  b", "a open  b", r"\margin{stays} \%", None]


def plain_entries(text):
    out, at = [], 0
    while m := re.compile(fixed.ENTRY_OPENING).search(text, at):
        at = m.end()
        if re.search(r"(?<!\\)%", text[text.rfind("\n", 0, m.start()) + 1 : m.start()]):
            continue
        nxt = re.compile(fixed.ENTRY_OPENING).search(text, m.end())
        stop, depth = nxt.start() if nxt else len(text), 0
        for j in range(m.start(), stop):
            depth += (text[j] == "{") - (text[j] == "}")
            if not depth and text[j] == "}":
                stop = j + 1
                break
        out.append((text[m.start() : stop].rstrip(), stop))
        at = max(at, stop)
    return [e for e, _ in out]


def test_reference_entries(spark):
    pieces = ["@book{a,\n t={x {y} z}}\n", "@misc{b, open {\n", "% @misc{c, x}\n", "5 \\% @misc{d,}\n", "@a{e,}@a{f, {@in{g,}}}", "text } {\n", "% x @misc{h,} @misc{i,}\n", "@nokey{}\n"]
    values = ["".join(pieces[(i * 7 + j * (i + 1)) % len(pieces)] for j in range(2 + i % 4)) for i in range(40)]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc long, text string")
    found = {}
    for r in scanning.reference_entries(d, "doc").orderBy("doc", "no").collect():
        found.setdefault(r.doc, []).append(r.entry)
    assert found == {i: e for i, v in enumerate(values) if (e := plain_entries(v))}


def test_patterns_take_linear_time(spark):
    values = ["Ch" + " " * 200_000, "MATCH (a" * 25_000, "MATCH (a" * 25_000 + "\n)-[:R]->", "SELECT " * 28_000, "UPDATE\n" * 28_000, "a " * 100_000]
    d = spark.createDataFrame([(v,) for v in values], "text string")
    began = time.time()
    rows = d.select(F.col("text").rlike(fixed.CHAPTER_REFERENCE).alias("a"), snippets.code_language("text").alias("b"), rules.presentation_excluded("text").alias("c")).collect()
    assert time.time() - began < 60 and [r.c for r in rows] == [False] * 6 and rows[0].a is False
    small = spark.createDataFrame([("MATCH (a)-[:R]->(b)",), ("MATCH\n (a)\n-[:R]->",), ("x)-[:R]-> MATCH q",), ("select a\nfrom b",), ("select from",), ("see Ch. ~\\ref{x}",)], "text string")
    rows = small.select(snippets.code_language("text").alias("b"), rules.presentation_excluded("text").alias("c"), F.col("text").rlike(fixed.CHAPTER_REFERENCE).alias("a")).collect()
    assert [r.b == "cypher" for r in rows] == [True, True, False, False, False, False] and [r.c for r in rows] == [False, False, False, True, False, False] and rows[5].a


def test_source_lines(spark):
    lines = spark.createDataFrame([("s", 1, "prose on Alpha Beta"), ("s", 2, r"  \term{L}{Alpha Beta and a name that goes on and on}"), ("s", 3, r"\redflag{ab}"), ("t", 1, r"\term{Alpha Beta}"), ("s", 4, "has gamma ray"), ("s", 5, None), ("s", 6, "")], "source string, line_no long, line string")
    rows = [(1, "s", "x-TERM-NONE", "Alpha Beta and a name that goes elsewhere"), (2, "s", "x-TERM-GAMMA_RAY", "nowhere"), (3, "s", "noid", "nowhere"), (4, "s", None, "ab"), (5, "t", "a-b", "Alpha Beta"), (6, "u", "x-a", "Alpha"), (7, "s", "x-", None), (8, "s", "q-Z", " b ")]
    d = spark.createDataFrame(rows, "id long, source string, card_id string, front string")
    found = {r.id: (r.line_no, r.excerpt) for r in integrity.source_lines(d, lines).collect()}
    assert found == {1: (2, r"\term{L}{Alpha Beta and a name that goes on and on}"), 2: (4, "has gamma ray"), 3: (0, ""), 4: (3, r"\redflag{ab}"), 5: (1, r"\term{Alpha Beta}"), 6: (0, ""), 7: (0, ""), 8: (3, r"\redflag{ab}")}


def test_typed_listings_once(spark):
    code, prose = "\\begin{verbatim}\nimport x\n\\end{verbatim}", "\\begin{verbatim}plain words\\end{verbatim}"
    d = texts(spark, f"a {code} b {prose} c {code}", prose + "\\begin{verbatim}import open", None, "", "\\end{verbatim} " + code)
    once = rewriting.typed_listings(d, "doc", "chapter")
    typed = code.replace("begin{verbatim}", "begin{minted}{python}").replace("end{verbatim}", "end{minted}")
    assert [tuple(r)[2:] for r in once.orderBy("doc").collect()] == [(f"a {typed} b {prose} c {typed}", 2, 1), (prose + "\\begin{verbatim}import open", 0, 1), (None, 0, 0), ("", 0, 0), ("\\end{verbatim} " + typed, 1, 0)]
    again = rewriting.typed_listings(once.select("doc", "chapter", "text"), "doc", "chapter")
    assert {(r.doc, r.text) for r in again.collect()} == {(r.doc, r.text) for r in once.collect()} and again.agg(F.sum("converted")).first()[0] == 0


def test_settings_by_section(spark):
    wanted = (rewriting.Setting("metrics", "check_cmd", 'count "a" \\s {log}', entry="pages"), rewriting.Setting("ready", "cmd", "refs", word="check_refs"))
    source = "check: x\n    check_cmd: kept\nmetrics:\n  pages:\n    check_cmd: old main_digital.log\n  other:\n    check_cmd: kept\nready:\n    cmd: check_refs now\n    cmd: kept\n    check_cmd: kept\n  pages:\n    check_cmd: kept"
    d = texts(spark, source, None, "", "metrics:\n    check_cmd: no entry")
    once = {r.doc: (r.text, r.changed) for r in rewriting.rewritten_settings(d, wanted, "doc").collect()}
    new = source.replace("check_cmd: old main_digital.log", r'check_cmd: "count \"a\" \\s guide/main_digital.log"').replace("cmd: check_refs now", 'cmd: "refs"')
    assert once == {0: (new, True), 1: (None, False), 2: ("", False), 3: ("metrics:\n    check_cmd: no entry", False)}
    made = rewriting.rewritten_settings(d, wanted, "doc").drop("changed")
    assert {r.doc: r.text for r in rewriting.rewritten_settings(made, wanted, "doc").where("not changed").collect()} == {k: v for k, (v, _) in once.items()}
    values = [(r.section, r.entry, r.key, r.value) for r in rewriting.setting_values(made, "doc").orderBy("k").collect()]
    assert values == [("metrics", "pages", "check_cmd", 'count "a" \\s guide/main_digital.log'), ("ready", None, "cmd", "refs")]


def test_texts_of_views_are_dealt_out_and_not_broadcast(spark):
    cases = views.view(spark, "/root/testdata/sf0.1", views.CASES, "part")
    assert cases.rdd.getNumPartitions() == 20_000 // views.TASK_ROWS + 1
    plan = structure.vignettes(cases, "doc")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(p_partkey") == 2  # texts aren't shuffled


def test_source_lines_of_equal_lines_and_needles(spark):
    lines = spark.createDataFrame([(1, n, r"\term{a long line of words that many findings share}") for n in range(9, 0, -1)] + [(2, 3, r"\term{a long line of words that}")], "source long, line_no long, line string")
    findings = spark.createDataFrame([(i, 1 + i % 2, "x", "a long line of words that many") for i in range(6)], "id long, source long, card_id string, front string")
    found = integrity.source_lines(findings, lines)
    assert sorted((r.id, r.line_no) for r in found.collect()) == [(i, i % 2 ^ 1) for i in range(6)]
    big = views.view(spark, "/root/testdata/sf0.1", views.SOURCES, "part")
    plan = integrity.source_lines(views.view(spark, "/root/testdata/sf0.1", views.FINDINGS, "part"), big)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
