"""Operators on small inline tables."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.functions.markup import balanced, macros, open_depths
from inkwell.operators import elements, identity, integrity, rewriting, rules, scoring
from inkwell.plans import reports
from inkwell.sources import adapters, files
from inkwell.streaming import freshness


def one(spark, expr, *values):
    d = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return d.select(expr.alias("x")).first()["x"]


COMMENTS = [
    ("a % b", "a "), (r"50\% of c % d", r"50\% of c "), (r"x \\% y", r"x \\"), (r"\url{a%20b} c", r"\url{a%20b} c"), (r"\href{a%b}{t % c}", r"\href{a%b}{t "),
    ("% all\nkept", "\nkept"), ("", ""), ("no comment", "no comment"),
]


@pytest.mark.parametrize(("source", "expected"), COMMENTS)
def test_comments(spark, source, expected):
    assert one(spark, tx.strip_comments("c0"), source) == expected


def test_long_texts_do_not_overflow(spark):
    long = "x" * 50_000
    assert len(one(spark, tx.strip_comments("c0"), long + " % y")) == 50_001
    assert len(one(spark, tx.bigrams("c0"), long)) == 1
    assert one(spark, F.size(F.regexp_extract_all(F.col("c0"), F.lit(elements.ARG), F.lit(1))), "{" + long + "{a}" + long + "}") == 1
    d = spark.createDataFrame([("keyconcept", "f", long), ("drill", "f", long + " see Chapter 3.")], "type string, front string, back string")
    assert {r["rule"] for r in rules.back_findings(d, "type").collect()} == {"H2", "I1", "H4"}
    assert rules.presentation_findings(d.select("type", "front", "back"), "type").count() == 4


def bigram(a, b):
    if a == b:
        return 1.0
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


@pytest.mark.parametrize(("a", "b"), [("abcd", "abcd"), ("", "a"), ("abcdef", "abcxef"), ("a", "b"), ("ééab", "éab")])
def test_bigram_similarity(spark, a, b):
    assert one(spark, tx.bigram_similarity("c0", "c1"), a, b) == pytest.approx(bigram(a, b))


def test_words_and_runs(spark):
    assert one(spark, tx.words("c0"), r"Explain \textbf{the trade-off} of a X \hfill\textit{(DLJ-6.6)}.") == ["explain", "the", "trade", "off", "of"]
    assert one(spark, tx.suffix(tx.words("c0"), 3), "one two three four") == "two three four"
    assert one(spark, tx.suffix(tx.words("c0"), 3), "one two") is None
    assert one(spark, tx.contains_run(tx.words("c0"), tx.words("c1")), "we explain the idea now", "explain the idea") is True
    assert one(spark, tx.contains_run(tx.words("c0"), tx.words("c1")), "we explain their idea", "explain the") is False


def test_scalars(spark):
    assert one(spark, tx.month_iso("c0"), "April 2026") == "2026-04" and one(spark, tx.month_iso("c0"), "Early 2027") is None
    assert one(spark, tx.multi_id("c0"), "A-1, B-2; ;C") == ["A-1", "B-2", "C"]
    assert one(spark, tx.slug("c0"), r"\textbf{Big} Idea, two!") == "BIG_IDEA_TWO"
    assert one(spark, tx.term_name("c0"), r"The \emph{Big} $x$ Idea") == "big idea"
    assert one(spark, tx.first_sentence("c0"), "This is version 3.5 of a long sentence here. And more.") == "This is version 3.5 of a long sentence here."
    assert one(spark, identity.guid(F.col("c0")), "x_y") == int(__import__("hashlib").sha256(b"x_y").hexdigest()[:10], 16)


def test_scanner():
    assert list(macros(r"\patternmargin{a \textbf{b} c}", ("patternmargin",))) == [("patternmargin", [], [r"a \textbf{b} c"], 0, 30)]
    assert [m[1:3] for m in macros(r"x \term[L]{a \} b}{c {d}} \term{open", ("term",))] == [(["L"], [r"a \} b", "c {d}"])]
    assert balanced("{a{b}c}", 0) == 7 and balanced("{a", 0) is None
    assert [m[0] for m in macros(r"\terms{a}\term{b}\term{c}", ("term",))] == ["term", "term"]
    deep = "{" * 5000 + "}" * 5000
    assert next(macros(r"\term" + deep, ("term",)))[4] == 10_005
    nested = r"\begin{enumerate}\item a \begin{itemize}\item x\end{itemize}\item b\end{enumerate}"
    assert len(open_depths(nested, ("enumerate", "itemize"))) == 2


def macros_by_character(text, names):
    """What macros() gives, read one character at a time."""

    def close(at):
        opening, closing, depth, i = text[at], "}" if text[at] == "{" else "]", 0, at
        while i < len(text):
            if text[i] == "\\":
                i += 1
            elif text[i] in (opening, closing):
                depth += 1 if text[i] == opening else -1
                if not depth:
                    return i + 1
            i += 1
        return None

    at, found = text.find("\\"), []
    while at >= 0:
        end = at + 1
        while end < len(text) and text[end].isalpha():
            end += 1
        i, options, args = end, [], []
        while text[at + 1 : end] in names and text[i : i + 1] in ("[", "{") and (to := close(i)):
            (options if text[i] == "[" else args).append(text[i + 1 : to - 1])
            i = to
        if args:
            found.append((text[at + 1 : end], options, args, at, i))
        at = text.find("\\", end if end > at + 1 else at + 2)
    return found


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["\\", "\\\\", "{", "}", "[", "]", r"\term", r"\termx", r"\te", r"\term{", "a", "\n", "²", "é", "_", "1", r"\{", r"\}", "]{", "}{"]), max_size=18).map("".join))
def test_scanner_equals_reading_by_character(text):
    assert list(macros(text, ("term", "te"))) == macros_by_character(text, ("term", "te"))


def test_macros_are_scanned_in_batches_and_texts_made_behind_the_shuffle(spark):
    d = spark.createDataFrame([(1, r"\term[L]{a}{b {c}} \\term{no}{x}"), (2, None), (3, ""), (4, r"\term{x}{y}\term{z}{\term{i}{j}}")], "doc long, text string")
    found = elements.macro_rows(d, ("term",), "doc").collect()
    assert sorted((r.doc, r.ord, r.options, r.args, r.off) for r in found if r.doc != 4) == [(1, 0, ["L"], ["a", "b {c}"], 0)]
    assert sorted((r.ord, r.args[0]) for r in found if r.doc == 4) == [(0, "x"), (1, "z"), (2, "i")]
    plan = elements.terms(adapters.markup(spark, "/root/testdata/sf0.001"), "doc")._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDTF" not in plan and "MapInArrow" in plan
    assert "CASE WHEN" not in plan[plan.index("Exchange") :]  # from the top of the plan down: no text is shuffled


BACKS = [
    ("term", "What?", "", {"C1"}), ("cloze", "What?", "", set()), ("cloze", "x", None, set()), ("term", "f", None, {"C1"}),
    ("term", "f", "...   ;;;", {"C2", "H1"}), ("checkpoint", "f", "```python\n# TODO\nx\n```", {"C3", "M1", "H1"}),
    ("drill", "What is X?", "X?", {"H1", "M2", "H4"}), ("term", "f", "Cosine sim is angle...", {"C5", "H1"}),
    ("term", "f", "Cosine similarity is the angle between two vectors and more...", set()),
    ("keyconcept", "f", "p" * 150, {"H2"}), ("keyconcept", "f", "**Core Insight:** " + "a" * 90 + "\n**Why It Matters:** b", set()),
    ("problem", "f", "**Approach:** " + "a" * 100 + "\n**Answer:** See solution above.", {"H6"}), ("drill", "f", "A. one two three four five six\n**B. two three four five six**", set()),
    ("drill", "f", "A. one two three four five\n**A. x** is here for us and you", set()), ("comparison", "f", "x" * 120, {"H5"}), ("comparison", "f", "| a | b |\n|---|---|\n" + "x" * 120, set()),
    ("other", "f", "see Chapter 3.", {"H1", "M3"}), ("other", "f", "d" * 90 + " See Chapter 7.", set()),
    ("checkpoint", "f", "Self-check from: Module 1 Checkpoint\n\n(Answer from memory, then verify against the chapter text.)", {"M5"}),
    ("other", "f", "w" * 40 + r" \textcolor{red}{x}", {"M4"}), ("keyconcept", "f", "**Core Insight:** " + "a" * 800 + "\nWhy It Matters: b", {"I1"}),
    ("problem", "A front that is copied whole", "a front  that is copied WHOLE", {"C4", "H1"}), ("formula", "f", "$x$ is the thing that matters. " + "y" * 40, {"H3"}),
    ("formula", "f", "$x$ is the thing.\n**Variables:** " + "y" * 40, set()),
]


def test_back_rules(spark):
    d = spark.createDataFrame([(i, *b[:3]) for i, b in enumerate(BACKS)], "i int, type string, front string, back string").withColumn("rule", F.lit("clash"))
    found = {}
    for r in rules.back_findings(d, "i").collect():
        found.setdefault(r["i"], set()).add(r["rule"])
    assert {i: found.get(i, set()) for i in range(len(BACKS))} == {i: b[3] for i, b in enumerate(BACKS)}
    assert rules.back_findings(d.limit(0), "i").count() == 0


def test_presentation(spark):
    texts = [
        ("Steps 1. First thing 2. Second", {"run_on_numbered"}), ("text (a) one (b) two", {"run_on_lettered"}), ("text - Item - Other", {"run_on_bullets"}), ("x = 3 - Y - Z", set()),
        ("Approach: do it. Summary: done", set()), ("**Approach:** x **Summary:** y", {"inline_sections"}), ("w" * 201, {"very_long_line"}), ("\n".join(["w " * 90] * 3), {"wall_of_text"}),
        ("a, b, c, d, e, f", {"comma_list"}), ("a; b; c", {"semicolon_list"}), ("```\n1. A 2. B\n```", set()), ("plain", set()),
    ]
    d = spark.createDataFrame([(i, "", t) for i, (t, _) in enumerate(texts)], "i int, front string, back string")
    found = {}
    for r in rules.presentation_findings(d, "i").collect():
        found.setdefault(r["i"], set()).add(r["rule"])
    assert {i: found.get(i, set()) for i in range(len(texts))} == {i: t[1] for i, t in enumerate(texts)}


def test_margins_and_repeats(spark):
    notes = [("Pattern", "Common mistake in pandas indexing.", {"template"}), ("Pattern", "Common mistake in pandas is chained assignment.", set()), ("Odd", "be careful", {"non_standard", "generic_2"}), ("Formula", "$x$", {"bare_formula"}), ("Pattern", "why? " + "w " * 31, {"over_length", "answer_in_margin"})]
    d = spark.createDataFrame([(i, c, n) for i, (c, n, _) in enumerate(notes)], "i int, category string, note string")
    found = {}
    for r in rules.margin_findings(d, "i").collect():
        found.setdefault(r["i"], set()).add(r["rule"])
    assert {i: found.get(i, set()) for i in range(len(notes))} == {i: n[2] for i, n in enumerate(notes)}
    t = spark.createDataFrame([(1, "explain Explain the"), (2, "Use use-case now"), (3, "one two")], "i int, text string")
    assert [r["i"] for r in rules.leading_repeats(t, "i").collect()] == [1]


def test_elements(spark):
    text = "\\los{A-1}{Explain}{the {big} idea} % x\n%\\los{A-2}{Explain}{dead}\n\\term[A-1]{Big {X}}{a {nested {deep}} def}\n\\begin{problem}[T][A-1]\nFind.\n\\end{problem}\ngap\n\\begin{solution}\nIt is.\n\\end{solution}\n\\begin{problem}[U]\nNo.\n\\end{problem}\n\\label{a}\\ref{b}\\cref{a}\n% \\label{b}"
    docs = spark.createDataFrame([("d", text), ("e", None), ("f", "")], "doc string, text string")
    assert [tuple(r) for r in elements.outcomes(docs, "doc").select("los_id", "statement").collect()] == [("A-1", "the {big} idea")]
    assert [r["los_id"] for r in elements.outcomes(docs, "doc", raw=True).collect()] == ["A-1", "A-2"]
    assert [tuple(r) for r in elements.terms(docs, "doc").select("los_id", "name", "definition").collect()] == [("A-1", "Big {X}", "a {nested {deep}} def")]
    assert [tuple(r) for r in elements.problems(docs, "doc").select("title", "los_id", "front", "back").collect()] == [("T", "A-1", "Find.", "It is.")]
    refs, labels = elements.references(docs, "doc"), elements.labels(docs, "doc")
    assert [r["label"] for r in integrity.undefined(refs, labels).collect()] == ["b"]
    assert elements.problems(docs.withColumn("text", F.regexp_replace("text", "gap", "g" * 16_000)), "doc").count() == 0


def test_identity(spark):
    d = spark.createDataFrame([(1, "P", "Big Idea", "body one here", None), (2, "P", "Big Idea", "body two here", None), (3, "P", "Big Idea", "body two here", None), (4, "P", "x", "b", "LOS-77")], "ord int, prefix string, title string, body string, los_id string")
    ids = [r["card_id"] for r in identity.card_ids(d, ["ord"]).orderBy("ord").collect()]
    assert ids[0] == "P_BIG_IDEA" and ids[1] == ids[2] and ids[1].startswith("P_BIG_IDEA_H") and ids[3] == "P_LOS77"
    assert identity.keep_first(identity.card_ids(d, ["ord"]), "card_id", ["ord"]).count() == 3


def test_templated(spark):
    tail = "that it worked and one thing that can go wrong"
    items = [("c", 1, "L1", "do it " + tail), ("c", 2, "L2", "alpha beta gamma delta epsilon zeta eta theta iota kappa"), ("c", 3, "L2", "x alpha beta gamma delta epsilon zeta eta theta iota kappa"), ("c", 4, "L2", "yy alpha beta gamma delta epsilon zeta eta theta iota kappa"), ("c", 5, "L3", "Explain why caching helps now"), ("c", 6, "L9", "short")]
    d = spark.createDataFrame(items, "collection string, ord int, los_id string, text string")
    outcomes = spark.createDataFrame([("L3", "why caching helps", 1), ("L3", "other words here", 2), ("L9", "short", 1)], "los_id string, statement string, ord int")
    found = {r["ord"]: r["reason"] for r in identity.templated(d, outcomes, (tail,), "ord").collect()}
    assert found == {1: "known-tail", 2: "shared-suffix(x3)", 3: "shared-suffix(x3)", 4: "shared-suffix(x3)", 5: "verbatim-los"}
    tally = {r["kind"]: r["n"] for r in identity.reason_tally(identity.templated(d, outcomes, (tail,), "ord")).collect()}
    assert tally == {"known-tail": 1, "shared-suffix": 3, "verbatim-los": 1}


def test_near_fronts_brute(spark):
    fronts = ["the quick brown fox jumps over the lazy dog again", "the quick brown fox jumps over the lazy cat again", "the quick brown fox jumps over one lazy dog today", "completely different words stand in this front here"]
    d = spark.createDataFrame([("c", i, f) for i, f in enumerate(fronts)], "collection string, ord int, front string")
    words = [set(f.split()) for f in fronts]
    for least in (50, 70, 85):
        expected = {(i, j) for i in range(4) for j in range(i + 1, 4) if 100 * len(words[i] & words[j]) >= least * len(words[i] | words[j])}
        assert {(r["ord_a"], r["ord_b"]) for r in identity.near_fronts(d, least).collect()} == expected


def test_lights_and_gates(spark):
    cases = [(10, 8, 5, False, "GREEN"), (6, 8, 5, False, "YELLOW"), (1, 8, 5, False, "RED"), (None, 8, 5, False, "RED"), (3, 3, 6, True, "GREEN"), (5, 3, 6, True, "YELLOW"), (7, 3, 6, True, "RED")]
    d = spark.createDataFrame([c[:4] for c in cases], "v int, t int, y int, i boolean")
    assert [r[0] for r in d.select(scoring.light(*(F.col(c) for c in "vtyi"))).collect()] == [c[4] for c in cases]
    gates = spark.createDataFrame([("a", "G1", True, ""), ("a", "G5", True, ""), ("b", "G1", True, ""), ("b", "G5", False, "missing"), ("c", "G1", True, ""), ("c", "G5", False, "short"), ("d", "G1", False, "")], "collection string, gate string, passed boolean, reason string")
    assert {r[0]: r[1] for r in scoring.gate_class(gates).collect()} == {"a": "PASS", "b": "GOLD-ELIGIBLE", "c": "SCAFFOLD-ONLY", "d": "FAIL"}
    assert {r["collection"]: (r["G1"], r["G5"], r["G9"]) for r in scoring.gate_pivot(gates, ["G1", "G5", "G9"]).collect()}["d"] == ("fail", "—", "—")
    checks = spark.createDataFrame([("a", True, False), ("b", False, None), ("c", True, True)], "collection string, blocking boolean, passed boolean")
    assert {r[0]: r[1] for r in scoring.exit_codes(checks).collect()} == {"a": 1, "b": 2, "c": 0}


FRESH = [
    ("renamed", dict(live_slug="y"), "RENAMED"), ("published", dict(is_early=False), "PUBLISHED"), ("sticky", dict(build_date="2026-03-01"), "STALE"),
    ("cleared", dict(build_date="2026-04-20", prior_signature="s"), "OK"), ("kept debt", dict(prior_status="STALE", prior_signature="s"), "STALE"),
    ("old schema", dict(prior_schema="page_state/1", prior_signature="z"), "BASELINE"), ("behind", dict(prior_schema=None, captured=3, latest_chapter=5), "STALE?"),
    ("changed", dict(prior_signature="z"), "STALE"), ("same", dict(prior_signature="s"), "OK"), ("degraded", dict(degraded=True), "ERROR"),
]


def test_freshness(spark):
    base = dict(recorded_slug="x", live_slug="x", is_early=True, degraded=False, signature="s", last_updated_month="April 2026", latest_chapter=1, captured=None, build_date=None, prior_schema=freshness.SCHEMA, prior_signature=None, prior_status="OK", prior_month="April 2026")
    schema = "name string, recorded_slug string, live_slug string, is_early boolean, degraded boolean, signature string, last_updated_month string, latest_chapter int, captured int, build_date string, prior_schema string, prior_signature string, prior_status string, prior_month string"
    names = [f.split(" ")[0] for f in schema.split(", ")]
    rows = [tuple({"name": n, **base, **change}[c] for c in names) for n, change, _ in FRESH]
    found = {r["name"]: r["status"] for r in freshness.classify(spark.createDataFrame(rows, schema)).collect()}
    assert found == {n: s for n, _, s in FRESH}
    rows = [("OK", 12, 11, None, None, "STALE"), ("RENAMED", 12, 11, None, None, "RENAMED"), ("OK", None, None, "2026-05-01", "2026-04-01", "STALE"), ("OK", None, None, None, None, "OK")]
    d = spark.createDataFrame([r[:5] for r in rows], "status string, live_version int, recorded_version int, live_date string, build_date string")
    assert [r["status"] for r in freshness.overlay(d).collect()] == [r[5] for r in rows]


def test_page_parse(spark):
    d = spark.createDataFrame([(1, "<p>Reading began September 2025</p> Last updated <b>April 2026</b> Publication in Early 2027 ISBN 9781234567890 375 pages"), (2, None), (3, "x")], "page_id int, html string")
    rows = {r["page_id"]: r for r in freshness.parse(d, "page_id").collect()}
    assert rows[1]["is_early"] and rows[1]["last_updated_month"] == "April 2026" and rows[1]["publication"] == "Early 2027" and rows[1]["n_pages"] == "375"
    assert rows[2]["degraded"] and rows[3]["degraded"] and not rows[1]["degraded"]


def test_stream_equals_batch(spark, tmp_path):
    page = "Last updated {} 2026 ISBN 9781234567890"
    batches = [[("a", 1, page.format("April")), ("b", 1, page.format("May"))], [("a", 2, page.format("April")), ("b", 2, page.format("June"))], [("a", 3, page.format("July"))]]
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    for b in batches:
        spark.createDataFrame(b, "key string, ts int, html string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, ts int, html string").parquet(source)
        freshness.stream_changes(stream, state, out, str(tmp_path / "checkpoint")).awaitTermination()
    streamed = {(r["key"], r["ts"]): r["status"] for r in spark.read.parquet(out).collect()}
    every = freshness.parse(spark.createDataFrame([r for b in batches for r in b], "key string, ts int, html string"), "key", "ts")
    assert streamed == {(r["key"], r["ts"]): r["status"] for r in freshness.changes(every, "key", "ts").collect()}
    assert streamed[("b", 2)] == "STALE" and streamed[("a", 2)] == "OK"


def test_files(spark, tmp_path):
    for p, text in {"topic-a/g1/guide_qa.yaml": "x", "reports/_scratch/g1/guide_qa.yaml": "x", "flat/guide_qa.yaml": "x", ".hid/g9/guide_qa.yaml": "x", "topic-x/other/guide_qa.yaml": "x", "flat/guide/chapters/c1.tex": r"A \input{c2}", "flat/guide/cards/c1_cards.json": '{"cards":[{"id":"1","type":"term"}]}', "flat/guide/cards/bad.json": "{oops", "flat/guide/cards/empty.json": ""}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    (tmp_path / "flat/guide/chapters/c2.tex").write_bytes(b"\xff\xfe bad")
    listed = files.listed(spark, str(tmp_path))
    topics = spark.createDataFrame([("g1", "topic-a")], "slug string, topic string")
    assert sorted(r["slug"] for r in files.discovered(listed, topics).collect()) == ["flat", "g1"]
    assert sorted(r["slug"] for r in files.discovered(listed).collect()) == ["flat", "g1", "other"]
    texts = files.texts(listed)
    assert [r["rel_path"] for r in files.unreadable_findings(texts).collect()] == ["flat/guide/chapters/c2.tex"]
    cards = {(r["rel_path"].split("/")[-1], r["id"], r["error"]) for r in files.card_rows(texts).collect()}
    assert cards == {("c1_cards.json", "1", None), ("bad.json", None, "no list of cards")}


def test_includes_and_resolution(spark):
    d = spark.createDataFrame([("a", r"one \input{b}"), ("b.tex", "two \\input{c}"), ("c.tex", "three")], "rel_path string, text string")
    assert {r["rel_path"]: r["text"] for r in files.expanded(d).collect()}["a"].split("\n") == [r"one \input{b}", r"two \input{c}", "three"]
    registry = spark.createDataFrame([(1, "deep-learning", "Deep Learning"), (2, "learning", "Old Deep"), (3, "ml", "Machine Learning")], "ord int, slug string, title string")
    asked = spark.createDataFrame([("learning",), ("deep",), ("machine",)], "query string")
    assert {r["query"]: r["slug"] for r in files.resolve(registry, asked).collect()} == {"learning": "learning", "deep": "deep-learning", "machine": "ml"}
    includes = spark.createDataFrame([("d", "x"), ("d", "y"), ("e", None), ("f", "x")], "doc string, target string")
    there = spark.createDataFrame([("x", None)], "target string, kind string")
    found = {r["doc"]: (r["status"], r["detail"]) for r in integrity.include_status(includes, there).collect()}
    assert found == {"d": ("RED", "missing y"), "e": ("YELLOW", ""), "f": ("GREEN", "")}


def test_rewriting(spark):
    long = "First sentence of some length here. " * 12
    once = rewriting.wrapped(long)
    assert max(map(len, once.split("\n"))) <= rewriting.LINE and rewriting.wrapped(once) == once and once.split() == long.split()
    assert rewriting.wrapped("| " + "x " * 200) == "| " + "x " * 200 and rewriting.wrapped(None) is None
    fixed = one(spark, rewriting.break_run_ons("c0"), "Do 1. This 2. That and x - Y")
    assert fixed == "Do\n1. This\n2. That and x\n- Y" and one(spark, rewriting.break_run_ons("c0"), fixed) == fixed
    assert rewriting.truncated("Short.", 10) == "Short." and rewriting.truncated("A first sentence. Then a second one follows", 25) == "A first sentence."


def test_reports(spark):
    d = spark.createDataFrame([("a", "t", 1), ("a", "u", 2), ("b", "t", 3)], "collection string, type string, ord int")
    assert {r[0]: (r[1], r[2]) for r in reports.by_type_text(d).collect()} == {"a": (2, "t=1,u=1"), "b": (1, "t=1")}
    assert [r["line"] for r in reports.markdown_table(d, ["collection", "ord"], ["ord"], "collection").orderBy("collection", "line_no").collect()] == ["| a | 1 |", "| a | 2 |", "| b | 3 |"]
    capped = reports.capped(d, ["ord"], 1, "collection").collect()
    assert {(r["collection"], r["ord"], r["more"]) for r in capped} == {("a", 1, 1), ("b", 3, 0)}
    bib = spark.createDataFrame([("k", "A & B 5%", "https://arxiv.org/abs/1", None, "2020-01"), ("m", r"C \& D", None, "Proceedings of X 2019", None)], "bibkey string, title string, url string, venue string, date string")
    rows = {r["bibkey"]: r for r in reports.bibliography(bib).collect()}
    assert rows["k"]["kind"] == "article" and r"A \& B 5\%" in rows["k"]["entry"] and r"C \& D" in rows["m"]["entry"] and rows["m"]["year"] == "2019"


def test_no_reference_to_the_training_data_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "inkwell"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"inkwell\.llm|from \.?llm", p.read_text())]


def test_environment_cards(spark):
    from inkwell.operators import cards

    text = "\\begin{redflag}[][A-1]\nBad   sign.\n\\end{redflag}\n\\begin{keyconcept}[Bias vs Variance]\n" + "A sentence here. " * 200 + "\n\\end{keyconcept}\n\\begin{pitfall}\n\n\\end{pitfall}\\termbi{Big}{A big thing}\\clozeterm[L]{The {{c1::x}}}{y}"
    docs = spark.createDataFrame([("d", text)], "doc string, text string")
    rows = {r["type"]: r for r in cards.environment_cards(docs, "doc").collect()}
    assert set(rows) == {"redflag", "keyconcept"}
    assert rows["redflag"]["front"] == "Red flag: Red Flag" and rows["redflag"]["los_id"] == "A-1" and rows["redflag"]["back"] == "Bad sign."
    assert rows["keyconcept"]["front"] == "Compare: Bias vs Variance" and len(rows["keyconcept"]["back"]) <= 1500 and rows["keyconcept"]["back"].endswith("here.")
    assert [(r["front"], r["back"]) for r in cards.two_way_terms(docs, "doc").orderBy("way").collect()] == [("Define: Big", "A big thing"), ("Which term: A big thing", "Big")]
    assert [(r["front"], r["back"], r["los_id"]) for r in cards.cloze_cards(docs, "doc").collect()] == [("The {{c1::x}}", "y", "L")]


def test_checkpoints(spark):
    from inkwell.operators import cards

    text = "\\begin{checkpointbox}[Module 1]\\begin{enumerate}\\item[A-1] Why is it so important? \\checkpointanswer{Because {x}}\\item Too short\\item[A-2] What does the second one mean?\\item And a fourth, without any answer?\\end{enumerate}\\textbf{Answers:}\\begin{enumerate}\\item a\\item b\\item[A-2] third answer\\end{enumerate}\\end{checkpointbox}"
    docs = spark.createDataFrame([("d", text)], "doc string, text string")
    rows = [(r["k"], r["los_id"], r["back"].split("\n")[0]) for r in cards.checkpoints(docs, "doc").orderBy("k").collect()]
    assert rows == [(0, "A-1", "Because {x}"), (2, "A-2", "third answer"), (3, None, "Self-check from: Module 1")]


def test_gates(spark):
    from inkwell.operators import gates

    texts = {"good": "\\item \\textbf{Why} \\subsection{Q1} Senior and Junior \\cref{ch:x}", "bad": "Senior only"}
    d = spark.createDataFrame(list(texts.items()), "doc string, text string")
    found = {r["doc"]: (r["passed"], r["reason"]) for r in gates.interview_gate(d, F.lit(1), "doc").collect()}
    assert found == {"good": (True, ""), "bad": (False, "question_count<1 (0);no_role_delta;no_los_refs")}
    head, item = "Current as of 2026-07.\n", "\\subsection{X} text \\cite{a}\n"
    cases = {"ok": head + item * 3, "uncited": head + item * 2 + "\\subsection{Y} none\n", "few": head + item, "old": "Current as of 2025-01." + item * 3, "future": "Current as of October 2026." + item * 3, "undated": item * 3, "month": "Current as of 2026-13" + item * 3}
    d = spark.createDataFrame([(k, v, "fast") for k, v in cases.items()], "doc string, text string, velocity string")
    found = {r["doc"]: r["reason"] for r in gates.currency(d, "2026-08", "doc").collect()}
    assert found == {"ok": "", "uncited": "1/3 items uncited", "few": "few items", "old": "old", "future": "future", "undated": "undated", "month": "undated"}
    assert [one(spark, gates.include_body("c0"), t) for t in ("TODO write", "\\section{A}\n\\label{x}", "% only", "Some prose here.")] == ["stub", "empty", "empty", None]
    assert [one(spark, c, "[R] [ Y ] [R]") for c in gates.status_marks("c0")] == [2, 1, 0]
    todo, fields = gates.todo_density("c0")
    assert (one(spark, todo, "- **A**: TODO\n| a | b |\n|---|---|\n| TODO | x |"), one(spark, fields, "- **A**: TODO\n| a | b |\n|---|---|\n| TODO | x |")) == (2, 5)
    assert one(spark, gates.section_words("c0", ["Setup", "Use"]), "## Setup\n- two words\n## Other\nx\n## Use\none two three") == 2
    faults = spark.createDataFrame([(1, r"\(x \begin{a}\end{b} < &lt;"), (2, r"\(x\) <b>y</b>")], "i int, back string")
    assert {(r["i"], r["fault"]) for r in gates.render_faults(faults, "i").collect()} == {(1, f) for f in ("inline delimiters", "environments", "angle bracket", "entity")}


def test_cleaning(spark):
    from inkwell.functions import clean

    assert clean.plain(r"A \textbf{bold \emph{x}} 50\% of $a_{1}$ --- see \cref{ch:one}~\cite{k}") == "A **bold *x*** 50% of $a_{1}$ — see one [k]"
    assert clean.plain("```\n\\textbf{x}\n```") == "```\n\\textbf{x}\n```" and clean.plain(None) is None
    assert clean.to_html("**b** $x<y$ a<b\n- one\n- two") == r"<b>b</b> \(x<y\) a&lt;b<br><ul><li>one</li><li>two</li></ul>"
    assert clean.inline_dollars("costs $5 and then $10 more") == [] and clean.inline_dollars("$x$ and \\$5") == [(0, 3)]
    d = spark.createDataFrame([("abcd", "abce"), (None, "x")], "a string, b string")
    assert [r[0] for r in d.select(clean.ratio("a", "b")).collect()] == [0.75, 0.0]
    assert [r[0] for r in d.select(clean.clean_markup("a")).collect()] == ["abcd", None]


def test_presentation_patterns_are_linear(spark):
    """Lines of 200,000 characters without a match, and the same texts accepted as by the plain patterns."""
    import re
    import time

    from inkwell.operators import rules

    long = ("a 1 b (x c; " * 17_000).replace(";", ",")
    texts = ["x 1. Abc", " 1. Abc", "x\n 1. Abc", "x (a) y", "(a) y", "a;b;", ";b;", "a;;", "a; b; c", "x \n y 2.\nZ", "\t x 3.  Q", "q 0. A"]
    rows = spark.createDataFrame([(k, "f", t) for k, t in enumerate([*texts, long, long + "1. Abc"])], "ord int, front string, back string")
    began = time.time()
    found = {(r["ord"], r["rule"]) for r in rules.presentation_findings(rows, "ord").where("side = 'back'").collect()}
    assert time.time() - began < 60
    plain = {"run_on_numbered": r"\S[^\n]*[ \t][1-9]\.\s+[A-Z]", "run_on_lettered": r"\S[^\n]*[ \t]\([a-z]\)[ \t]+", "semicolon_list": r"[^;]+;[^;]+;"}
    for rule, pattern in plain.items():
        assert {k for k, r in found if r == rule and k < len(texts)} == {k for k, t in enumerate(texts) if re.search(pattern, t)}
    assert (len(texts), "run_on_numbered") not in found and (len(texts) + 1, "run_on_numbered") in found


def test_run_places(spark):
    """A run is found at any place, once; a head that isn't followed by the rest isn't a hit."""
    from inkwell.operators import identity

    items = spark.createDataFrame([(1, "xxx aaa bbb ccc ddd eee fff ggg hhh iii jjj"), (2, "aaa bbb ccc ddd eee fff ggg hhh zzz"), (3, "aaa bbb ccc ddd eee fff ggg hhh iii aaa bbb ccc ddd eee fff ggg hhh iii"), (4, None), (5, "a b")], "ord int, text string")
    runs = spark.createDataFrame([(7, "Aaa bbb ccc, ddd eee fff ggg hhh iii"), (8, "aaa bbb"), (9, None)], "run_id int, text string")
    assert {tuple(r) for r in identity.run_hits(items, runs).collect()} == {(1, 7), (3, 7)}


def test_collection_gates(spark):
    from inkwell.operators import fleet

    rows = [
        (1, "guide_qa.yaml", "guide:\nlos:\nmetrics:\nreadiness_checks:"), (1, "Makefile", "include $(TOOLING)/x"), (1, "a-extensions.sty", "\\interviewmargin \\formulamargin"), (1, "cards/all_cards.yml", "x" * 100),
        (1, "decks/x_complete.apkg", None), (1, "decks/c1.apkg", None), (1, "decks/c2.apkg", None), (1, "review/dashboard.md", "[G]"), (1, "chapters/01_m1_a.tex", None), (1, "chapters/00_x.tex", "x"), (1, "chapters/B_y.tex", "x"),
        (2, "review/dashboard.md", None), (3, "review/gold_audit_1.md", None),
    ]
    files = spark.createDataFrame([(*r, len(r[2] or "")) for r in rows], "collection int, rel_path string, text string, size int")
    status = {(r["collection"], r["check"]): r["status"] for r in fleet.file_checks(files).collect()}
    assert {v for (c, _), v in status.items() if c == 1} == {"GREEN"}
    assert status[2, "dashboard"] == "GREEN" and status[2, "configuration"] == status[3, "decks"] == "RED" and status[2, "portable_paths"] == "GREEN"
    assert {r["collection"]: r["n_chapters"] for r in fleet.chapter_counts(files).collect()} == {1: 1}
    settings = spark.createDataFrame([(1, None, None, None, None), (2, "true", "x", "true", ""), (4, "true", " ", None, None)], "collection int, decks_complete_only string, justification string, red_waiver string, red_justification string")
    mapped = spark.createDataFrame([(1, "m1")], "collection int, module string")
    decks = {r["collection"]: (r["passed"], r["reason"]) for r in fleet.deck_gate(files, settings, mapped).collect()}
    assert decks == {1: (True, ""), 2: (False, "no complete deck; empty map"), 4: (False, "no complete deck; empty map; 0/2 decks")}
    assert [(r["red"], r["passed"], r["reason"]) for r in fleet.dashboard_gate(files, settings).orderBy("collection").collect()] == [(0, True, ""), (0, True, ""), (None, False, "missing")]
    assert [(r["passed"], r["reason"]) for r in fleet.fidelity_gate(files).collect()] == [(False, "unreadable")]
    assert [tuple(r) for r in fleet.stub_items(files).collect()] == [(1, 0, 0, 1)]
    assert fleet.file_checks(files.limit(0)).count() == 0 and fleet.fleet_exit(spark.createDataFrame([], "class string")).first()[0] == 0


def test_fields_of_texts(spark):
    from pyspark.sql import functions as F

    from inkwell.functions import snippets

    def one(c):
        return spark.range(1).select(c).first()[0]

    assert one(snippets.citation(F.lit("smith_deep2019"))) == "Smith (2019)" and one(snippets.citation(F.lit("rfc"))) == "rfc"
    assert one(snippets.company_tags(F.lit(r"\companytags{a, b} x \companytags{ c,}"))) == ["a", "b", "c"]
    assert one(snippets.image_names(F.lit("<img alt='q' src='a.png'><img src=\"b.png\"/> <img src='a.png'>"))) == ["a.png", "b.png"]
    assert one(snippets.clean_tags(F.array(F.lit(" a b "), F.lit("c::d!"), F.lit("  "), F.lit("a_b")))) == ["a_b", "c::d"]
    assert [one(c) for c in snippets.volume_chapter(F.lit("vol3_x/chapters/07_intro.tex"))] == ["vol3", "ch07"]
    assert [one(c) for c in snippets.volume_chapter(F.lit("x.tex"))] == ["vol0", "ch00"]
    assert one(snippets.velocity(F.lit(" FAST "), F.lit("x"))) == "fast" and one(snippets.velocity(F.lit(None).cast("string"), F.lit("rag-and-search"))) == "fast" and one(snippets.velocity(F.lit("odd"), F.lit("x"))) == "medium"
    assert one(snippets.outcome_fault(F.lit("PY-1.1"), F.lit("Explain"))) is None and one(snippets.outcome_fault(F.lit(None).cast("string"), F.lit("x"))) == "format"
    block, body, error = snippets.front_matter(F.lit("---\na: 'x y'\n---\n## H\n"))
    assert one(snippets.field_of(block, "a")) == "x y" and one(body) == "## H\n" and one(error) is None and one(snippets.code_language(F.lit("plain words"))) is None


def test_near_fronts_and_their_ratio_against_all_pairs(spark):
    """Candidates are met without their words and only where enough words are left; ratios are bounded before they are worked out."""
    import random
    from difflib import SequenceMatcher

    from pyspark.sql import functions as F

    from inkwell.functions import clean
    from inkwell.operators import identity

    rnd = random.Random(5)
    fronts = [" ".join(rnd.choices(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "theta"], k=rnd.randint(4, 9))) for _ in range(60)]
    d = spark.createDataFrame([(f"c{i % 2}", i, f) for i, f in enumerate(fronts)], "collection string, ord long, front string")
    found = identity.near_fronts(d, 60)
    first = {}
    for i, f in enumerate(fronts):
        if len(f) >= 20:
            first.setdefault((i % 2, f), i)
    sets = {i: (c, set(f.split(" "))) for (c, f), i in first.items()}
    wanted = {(a, b) for a, (c, x) in sets.items() for b, (e, y) in sets.items() if a < b and c == e and len(x & y) * 100 >= len(x | y) * 60}
    assert wanted and {(r.ord_a, r.ord_b) for r in found.collect()} == wanted
    assert "Aggregate [ord_a" in found._jdf.queryExecution().optimizedPlan().toString()  # pairs are made one before their words are fetched
    pairs = [(x, y) for x in fronts[:12] for y in fronts[:12]] + [("a", None), (None, None)]
    near = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(clean.ratio_above(F.col("a"), F.col("b"), 0.9)).collect()]
    assert near == [SequenceMatcher(None, x or "", y or "").ratio() > 0.9 for x, y in pairs]
