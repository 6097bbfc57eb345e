"""Answers written anew from their solutions, from texts written by hand."""

import pytest

from inkwell.operators import recaps

MARK = "% NEW: auto-generated 2026-04-30 - please review and refine\n"
STUB = r"\textbf{Answer:} See solution above."
MANY = r"\begin{problem}\begin{enumerate}\item x\end{enumerate}\end{problem}"
ONE = r"\begin{problem}What?\end{problem}"


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc int, text string")


def listed(*lines):
    return "\\textbf{Answer:}\n\\begin{enumerate}[label=(\\alph*)]\n" + "\n".join(f"  \\item {x}" for x in lines) + "\n\\end{enumerate}"


LONG = "A sentence of more than thirty characters"
LIST = r"\begin{enumerate}[label=a]\item \textbf{Head}: take it. \item Then \begin{itemize}\item in \begin{enumerate}\item deep\end{enumerate} ner\end{itemize} go \end{enumerate}"
CASES = [
    (ONE, rf"\textbf{{Approach:}} {LONG}. Next one. ", rf"\textbf{{Answer:}} {LONG}."),
    (ONE, rf"\textbf{{Approach:}} {LONG} of 1. Next one? No. ", rf"\textbf{{Answer:}} {LONG} of 1. Next one?"),
    (ONE, r"\textbf{Approach:} Short. Next one. ", r"\textbf{Answer:} Short. Next one."),
    (ONE, r"\textbf{Approach:} " + "word " * 20 + "end. " + "word " * 60, r"\textbf{Answer:} " + "word " * 20 + "end."),
    (ONE, r"\textbf{Approach:} " + "word " * 80, r"\textbf{Answer:} " + ("word " * 56).strip()),
    (ONE, r"\textbf{Approach:} Do it \textbf{Step 1} more ", r"\textbf{Answer:} Do it"),
    (ONE, r"\textbf{Approach:}  \textbf{Key Insight:} All is one. \textbf{Note} ", r"\textbf{Answer:} All is one."),
    (ONE, "Nothing. ", r"\textbf{Answer:} See Approach above for derivation."),
    (MANY, rf"\textbf{{Approach:}} {LIST} ", listed("take it.", "Then go")),
    (ONE, rf"\textbf{{Approach:}} {LIST} ", rf"\textbf{{Answer:}} {LIST}"),
    (MANY, r"\textbf{Approach:} \begin{enumerate}\item a \item b ", r"\textbf{Answer:} \begin{enumerate}\item a \item b"),
    (MANY, r"\textbf{Approach:} \begin{enumerate} lead \item a\end{enumerate} ", listed("lead", "a")),
    (MANY, r"\textbf{Approach:} \textbf{(a) First:} do x. \textbf{(b) Second.} \begin{itemize}\item i\end{itemize} \textbf{(c) } ", listed(r"\textbf{First:} do x.", r"\textbf{Second}.", "(see solution body)")),
    (r"\begin{problem}(a)~x (b)~y\end{problem}", r"\textbf{Approach:} \textbf{1. One} x \textbf{2. Two:} y ", listed(r"\textbf{One:} x", r"\textbf{Two:} y")),
    (MANY, r"\textbf{Approach:} \textbf{(a) Alone:} x ", r"\textbf{Answer:} \textbf{(a) Alone:} x"),
]


@pytest.fixture(scope="module")
def made(spark):
    d = texts(spark, *(f"{p} s \\begin{{solution}}{s}{STUB} rest\\end{{solution}} end" for p, s, _ in CASES))
    return {r.doc: r for r in recaps.recapped(d, "doc").collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_recaps(made, n):
    problem, solution, answer = CASES[n]
    assert made[n].text == f"{problem} s \\begin{{solution}}{solution}{MARK}{answer} rest\\end{{solution}} end"
    assert made[n].replaced == 1


def test_places(spark):
    inner = rf"\begin{{solution}}\textbf{{Approach:}} Go. {STUB.replace("See", "see").replace("above", "ABOVE")}\end{{solution}}"
    rows = [f"{STUB} {inner} {STUB}", f"{MANY}{inner}{ONE}{inner}", rf"\begin{{solution}}{STUB}", None, "", "plain"]
    d = texts(spark, *rows)
    found = [(r.text, r.replaced) for r in recaps.recapped(d, "doc").orderBy("doc").collect()]
    new = inner.replace(inner[inner.index("Go. ") + 4 : -len(r"\end{solution}")], MARK + r"\textbf{Answer:} Go.")
    assert found == [(f"{STUB} {new} {STUB}", 1), (f"{MANY}{new}{ONE}{new}", 2), (rows[2], 0), (None, 0), ("", 0), ("plain", 0)]
    again = recaps.recapped(texts(spark, *(t for t, _ in found)), "doc")
    assert [(r.text, r.replaced) for r in again.orderBy("doc").collect()] == [(t, 0) for t, _ in found]


def marked(problem, answer, solution=r"\textbf{Approach:} \textbf{(a) A:} x \textbf{(b) B:} y "):
    return f"{problem}\\begin{{solution}}{solution}{MARK}{answer}\\end{{solution}} end"


def test_renewed(spark):
    parts = listed(r"\textbf{A:} x", r"\textbf{B:} y")
    rows = [
        marked(ONE, r"\textbf{Answer:} 1.5 is whole" + "\n"), marked(ONE, r"\textbf{Answer:} \textbf{1." + "\n"), marked(ONE, "\\textbf{Answer:}\n"), marked(MANY, "\\textbf{Answer:} (a) only\n"),
        marked(MANY, parts + "\n"), marked(MANY, r"\textbf{Answer:} \textbf{a} \textbf{b} \textbf{c}"), marked(ONE, r"\textbf{Answer:} See Approach above for derivation.", ""), marked(ONE, r"\textbf{Answer:} \begin{solution}"), None,
    ]
    one = r"\textbf{Answer:} \textbf{(a) A:} x \textbf{(b) B:} y" + "\n"
    want = [(rows[0], 0), (marked(ONE, one), 1), (marked(ONE, one), 1), (marked(MANY, parts + "\n"), 1), *((t, 0) for t in rows[4:])]
    assert [(r.text, r.replaced) for r in recaps.renewed(texts(spark, *rows), "doc").orderBy("doc").collect()] == want
    forced = recaps.renewed(texts(spark, rows[0], rows[4]), "doc", force=True)
    assert [(r.text, r.replaced) for r in forced.orderBy("doc").collect()] == [(marked(ONE, one), 1), (rows[4], 0)]


def test_made_up_texts_change_once(spark):
    from inkwell.sources import views

    d = views.view(spark, "/root/testdata/sf0.001", views.RECAPS, "part")
    fixed = lambda f, d: spark.createDataFrame(f(d, "doc").collect(), "doc long, text string, replaced long")
    once = fixed(recaps.recapped, d)
    twice = fixed(recaps.renewed, once.drop("replaced"))
    assert once.agg({"replaced": "sum"}).first()[0] > 0 and twice.agg({"replaced": "sum"}).first()[0] > 0
    assert recaps.recapped(twice.drop("replaced"), "doc").where("replaced > 0").count() == 0
    assert recaps.renewed(twice.drop("replaced"), "doc").where("replaced > 0").count() == 0


def test_texts_are_not_broadcast(spark):
    from inkwell.sources import views

    d = views.view(spark, "/root/testdata/sf0.01", views.RECAPS, "part")
    for found in (recaps.recapped(d, "doc"), recaps.renewed(d, "doc")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
