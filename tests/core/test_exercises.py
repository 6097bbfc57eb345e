"""Cards of exercises, from texts written by hand."""

import time

import pytest

from inkwell.operators import exercises


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc int, text string")


TALKS = [
    (r"[T]When asked about ``x'', say", "T", "Interview Q: ``x''"),
    (r"[T]Explain how it works. How would you do it?", "T", "Interview Q: do it?"),
    (r"[T]Explain how it works. Fine.", "T", "Interview Q: it works"),
    (r"[Why it Matters]Say so.", "Why it Matters", "Interview: Why does this matter? What business context should you lead with?"),
    (r"[``Fit'' Example]Say so.", "Fit Example", "Interview: Tell a STAR story about Fit. What was the situation and outcome?"),
    (r"[Practice Question]Say this out loud." + "\nMore", "Practice Question", "Interview: Say this out loud."),
    (r"[Practice Question]Short", "Practice Question", "Interview: Practice answering this question out loud."),
    (r"[Answer template]Say.", "Answer template", "Interview: What is the Answer template? Walk through each step."),
    (r"[Phrases]Say.", "Phrases", "Interview: What are key recovery phrases when stuck? When do you use each?"),
    (r"[Best Practices]Say.", "Best Practices", "Interview: What are the Best Practices?"),
    (r"The topic is about pay rises. Say.", "pay rises", "Interview: pay rises"),
    (r"Begin with the numbers that matter. Say.", "Begin with the numbers that...", "Interview: Begin with the numbers that..."),
    (r"Say.", "Strategy 1", "Interview: Strategy 1"),
    (r"[T]Describe " + "word " * 30, "T", "Interview Q: " + ("word " * 20).strip() + "..."),
]


@pytest.mark.parametrize(("body", "title", "front"), TALKS)
def test_interview_fronts(spark, body, title, front):
    r = exercises.interview_questions(texts(spark, rf"\begin{{interviewcontext}}{body}\end{{interviewcontext}}"), "doc").first()
    assert (r.title, r.front) == (title, front)


def test_interview_roles_stay_in_their_block(spark):
    one = r"\begin{interviewcontext}[T][A-1, B-2,]\companytags{X, Y} Say.\end{interviewcontext}"
    between = r" \companytags{Z} "
    rows = exercises.interview_questions(texts(spark, one + between + one.replace("X, Y", "").replace("[A-1, B-2,]", "")), "doc").orderBy("block").collect()
    assert [(r.block, r.off, r.los_id, r.los_ids, r.companies, r.back) for r in rows] == [(1, 0, "A-1", ["A-1", "B-2"], ["X", "Y"], "Say."), (2, len(one + between), None, [], [], "Say.")]


def test_drills(spark):
    good = r"\begin{drill}[A-1]\drillprompt{p \b{q}}\technique{t {u {v}}}\drillanswer{a}\end{drill}"
    rows = exercises.drills(texts(spark, good, good.replace("drillprompt", "prompt"), good.replace("{a}", "{a {b {c {d}}}}"), None, "", r"\begin{drill}\drillprompt{x}"), "doc").orderBy("doc").collect()
    assert [(r.doc, r.los_id, r.front, r.back) for r in rows] == [(0, "A-1", r"p \b{q}", "**Answer:**\na\n\n---\n\n**Technique:**\nt {u {v}}"), (2, "A-1", r"p \b{q}", "---\n\n**Technique:**\nt {u {v}}")]


def test_a_block_runs_from_its_first_opening(spark):
    d = texts(spark, r"\begin{drill}\begin{drill}\drillprompt{x}\end{drill}\end{drill}\begin{drill}\drillprompt{y}")
    rows = exercises.blocks(d, "drill", "doc").collect()
    assert [(r.block, r.off, r.body) for r in rows] == [(1, 0, r"\begin{drill}\drillprompt{x}")]


def test_tables(spark):
    row, row3 = r"\comprow{d}{ 1 }{2}", r"\comprowiii{d}{1}{2}{3}"
    d = texts(spark, rf"\begin{{comparisoncard}}{{T}}{{L}}{{R}}[A-1]{row}{row}\end{{comparisoncard}}\begin{{comparisoncard3}}{{U}}{{L}}{{M}}{{R}}{row3}\end{{comparisoncard3}}\begin{{comparisoncard}}{{T}}{{L}}\end{{comparisoncard}}", r"\begin{comparisoncard}{T}{L}{R} no rows\end{comparisoncard}")
    rule = "|-----------|--------|--------|"
    found = {(r.doc, r.type, r.reverse, r.los_id, r.front, r.back) for r in exercises.comparisons(d, "doc").collect()}
    assert found == {
        (0, "comparison", False, "A-1", "Compare: T", f"| Dimension | L | R |\n{rule}\n| d | 1 | 2 |\n| d | 1 | 2 |"),
        (0, "comparison", True, "A-1", "Compare: R vs L (T)", f"| Dimension | R | L |\n{rule}\n| d | 2 | 1 |\n| d | 2 | 1 |"),
        (0, "comparison3", False, None, "Compare: U", f"| Dimension | L | M | R |\n{rule}--------|\n| d | 1 | 2 | 3 |"),
        (1, "comparison", False, None, "Compare: T", "no rows"),
    }
    level = exercises.level_cards(texts(spark, r"\begin{levelcard}{T}[A-1]\levelrow{s}{a}{b}\end{levelcard}"), "doc").first()
    assert (level.front, level.back, level.los_id) == ("IC4 vs IC5: T", "| Dimension | IC4 | IC5 |\n|-----------|-----|-----|\n| s | a | b |", "A-1")


def test_predictions(spark):
    head = r"\begin{generatefirst}[G] What comes out of it? "
    tail = r"\end{generatefirst}"
    rows = exercises.predictions(texts(spark, head + r"\generateanswer {a {b {c}} }" + tail, head + r"\generateanswer{open \generateanswer{x}" + tail, r"\begin{generatefirst}too short" + tail), "doc").orderBy("doc").collect()
    assert [(r.doc, r.title, r.front, r.back) for r in rows] == [(0, "G", "Before reading: What comes out of it?", "a {b {c}}"), (1, "G", r"Before reading: What comes out of it? \generateanswer{open \generateanswer{x}", "(Answer from memory, then read the section to check.)")]


def test_arrangements(spark):
    solved = r"\begin{solution} b a \end{solution}"
    d = texts(
        spark, rf"\begin{{ordering}}[A-1]Sort.\orderstep{{ a }}\orderstep{{b}}{solved}\orderstep{{c}}\end{{ordering}}", rf"\begin{{matching}}\matchpair{{x}}{{y}}\matchpair{{z}}{{w}}{solved}\end{{matching}}",
        r"\begin{ordering}\orderstep{a}\end{ordering}", rf"\begin{{matching}}{solved}\end{{matching}}",
    )
    rows = exercises.arrangements(d, "doc").orderBy("doc").collect()
    assert [(r.doc, r.type, r.los_id, r.front, r.back) for r in rows] == [(0, "ordering", "A-1", "Sort.\n\n- a\n- b", "b a"), (1, "matching", None, "Match each item to its category:\n\n- x -> ???\n- z -> ???\n\n**Categories:** y | w", "b a")]


def test_long_and_open_blocks_take_linear_time(spark):
    """One block of 200,000 characters, and as much of openings that are never closed."""
    d = texts(spark, r"\begin{drill}\drillprompt{" + "x {y} " * 33_000 + r"}\end{drill}", r"\begin{drill}\drillprompt{" * 8_000, r"\begin{ordering}" + r"\orderstep{" * 18_000 + r"\begin{solution}x\end{solution}\end{ordering}")
    began = time.time()
    assert exercises.drills(d, "doc").count() == 1 and exercises.arrangements(d, "doc").count() == 0
    assert time.time() - began < 60


def test_blocks_are_found_without_grouping(spark):
    """A document's pieces were grouped and sorted again for its blocks; now they are sorted once, for places and numbers."""
    both = r"a\x01\end{drill}\begin{drill}open\begin{drill}b\end{drill}c\end{drill}\begin{drill}\end{drill}\begin{drill}d".replace("\\x01", "\x01")
    d = exercises.blocks(texts(spark, both, None, "", r"\end{drill}"), "drill", "doc")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort [") == 1
    first = both.index(r"\begin")
    assert sorted(map(tuple, d.collect())) == [(0, 1, first, r"open\begin{drill}b"), (0, 2, both.index(r"\begin{drill}\end"), "")]
