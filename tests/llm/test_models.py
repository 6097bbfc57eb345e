"""Extraction, classifiers and the pipeline."""

import hashlib
import html as entities
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import common, decontaminate, html_extract, language_id, quality, queries, secrets, sentencepiece_codec
from tests.llm.test_pairs import jaccard_brute

SF = "/root/testdata/sf0.001"
HERE = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

PAGES = [
    ("<html><body><nav>Menu</nav><article><h1>A &amp; B</h1><p>One <b>bo</b>ld<br>two</p><p>three\n\n four</article><footer>f</footer></body></html>", "A & B One bold two three four"),
    ("<div class='site-header'>Site</div><div id=content class='post-12'><h2>T</h2><p>Text that is long enough to win here.<ul><li>x<li>y</ul><div class='comments'><p>Reader says a lot of things, really a lot of things here.</p></div></div><aside>side</aside>", "T Text that is long enough to win here. x y"),
    ("<main><header><h1>Title</h1></header><p>Body.</p><form><input>q<button>go</button></form><div class=ad>Buy</div><script>var a='</p>';</script><style>p{}</style></main>", "Title Body."),
    ("<body><div class='cookie-notice'>We use</div><p>Only &lt;text&gt; &nbsp; here &copy;</p>", "Only <text> here ©"),
    ("plain text", "plain text"),
    ("", ""),
    (None, ""),
    ("<p>unclosed <i>inline <p>next", "unclosed inline next"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b c"),
    ("<article><p hidden>no</p><p role=alert>no</p><p>a < b and 1<2</p><!-- <p>c</p> --></article>", "a < b and 1<2"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_page_text(page, text):
    assert html_extract.text_by(page, None)[0] == text


SEVERAL = [
    ("<body><div class=part><p>" + "first words " * 90 + "</p></div><div class=part><p>" + "second words " * 80 + "</p></div></body>", "first words " * 90 + "second words " * 80),
    ("<article><h1>T</h1><p>intro</p><section><p>" + "long text " * 60 + "</p></section></article>", "T intro " + "long text " * 60),
    ("<article><header><h1>T</h1></header><section><p>" + "long text " * 60 + "</p></section></article>", "T " + "long text " * 60),
    ("<main><ul><li><a href=x>another page of this site</a></ul><article><p>" + "long text " * 60 + "</p></article></main>", "long text " * 60),
]


@pytest.mark.parametrize(("page", "text"), SEVERAL)
def test_articles_of_several_containers(page, text):
    found, path = html_extract.text_by(page, None)
    assert found == text.strip()
    assert html_extract.text_by(page, [path])[0] == text.strip()


def test_all_containers_of_a_winning_path():
    page = "<body>" + "".join(f"<section class=s{i}><p>part {i} of the text</p></section>" for i in range(5)) + "<div><a href=x>more</a></div></body>"
    assert html_extract.text_by(page, [">body>section.s0"]) == (" ".join(f"part {i} of the text" for i in range(5)), ">body>section.s0")


def test_host_paths_decide(spark):
    """Pages whose own best container is a long side text are extracted by the path that their host's other pages agree on."""
    normal = "<div class='main-{i}'><p>" + "article words here " * 20 + "</p></div><div class=box><p>short</p></div>"
    odd = "<div class='main-9'><p>" + "article words here " * 20 + "</p></div><div class=box><p>" + "filler text " * 36 + "</p></div>"
    rows = [(i, f"http://User@Ho.st:80/p{i}?q#f", normal.replace("{i}", str(i))) for i in range(6)] + [(7, "http://ho.st/x", odd), (8, None, "<p>alone</p>"), (9, "http://empty", None), (7, "http://ho.st/x", odd)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "'z' as paths")
    found = [(r["page_id"], r["text"], r["n_chars"], r["path"]) for r in html_extract.extract(pages).collect()]
    assert len(found) == len(rows)
    by = {f[0]: f for f in found}
    assert by[7][3] == by[1][3] == ">div.main-0" and by[7][1] == by[1][1] == ("article words here " * 20).strip() and by[8][1] == "alone" and by[9][1] == ""
    assert all(f[2] == len(f[1]) for f in found)
    assert html_extract.extract(pages.limit(0)).count() == 0


NO_ARTICLE = [
    ("<body><form id=aspnetForm action=/x><div class=menu><a href=/>Home</a></div><div id=main><h1>T</h1><p>" + "page text " * 30 + "</p></div><input type=submit></form></body>", "T " + "page text " * 30),
    ("<body><div id=main><h1>T</h1><p>" + "page text " * 30 + "</p><form class=x><p>Subscribe now</p></form></div></body>", "T " + "page text " * 30),
    ("<article><p class=feedback>The loop.</p><p class='tags-intro'>Tags are words.</p><p class=ad>Buy</p><div class=feedback><p>Rate us</p></div><form><p>Say it</p></form></article>", "The loop. Tags are words."),
    ("<body><div class='left col'><a href=/>x</a></div><div class='mid col'><p>" + "words of it " * 20 + "</p></div></body>", "words of it " * 20),
]


@pytest.mark.parametrize(("page", "text"), NO_ARTICLE)
def test_forms_and_prose(page, text):
    assert html_extract.text_by(page, None)[0] == text.strip()


def test_all_classes_tell_containers_apart():
    assert html_extract.generalised("div", {"class": "a b c d main"}) != html_extract.generalised("div", {"class": "a b c d side"})


def test_winning_paths_are_bounded(spark):
    """A host with a path for each page has no winner; equal votes go by path."""
    votes = [("many", f">div.p{chr(97 + i % 26)}{chr(97 + i // 26)}", 1.0) for i in range(300)] + [("two", ">b", 0.5), ("two", ">a", 0.5), ("none", ">a", 0.0)]
    found = {r["host"]: r["paths"] for r in html_extract.winners(spark.createDataFrame(votes, "host string, path string, vote double")).collect()}
    assert found == {"two": [">a", ">b"]}


@HERE
def test_pages_of_the_test_tables(spark):
    rows = {r["page_id"]: r["html"] for r in common.table(spark, SF, "pages").collect()}
    for r in html_extract.query(spark, SF).collect():
        inner = re.search(r"<article>(.*?)</article>", rows[r["page_id"]], re.S)[1]
        expected = entities.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", inner)))
        assert r["text"] == " ".join(expected.split())


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_statistics_follow_the_text():
    texts = ["Hello World. Again", "", "AAA!! BBB!!", "é é é", "a\nb\na"]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    s = dict(zip(quality.STATISTICS, quality.statistics(np.frombuffer(b"".join(raw), np.uint8), at).T, strict=True))
    assert np.allclose(s["log words"], np.log1p([3, 0, 2, 3, 3])) and np.allclose(s["log bytes"], np.log1p([len(r) for r in raw]))
    assert np.allclose(s["distinct words"], [1, 0, 1, 1 / 3, 2 / 3]) and np.allclose(s["distinct lines"], [1, 0, 1, 1, 2 / 3])
    assert s["upper share of letters"][2] == 1 and s["exclamation share"][2] == 4 / 11


def test_isotonic():
    x, y = quality.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.5]), np.ones(6))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all() and y[0] == 0 and np.isclose(y[-1], 2.5 / 3)


def remainder(doc_id: int, by: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % by


@HERE
def test_quality_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    found = {r["doc_id"]: r for r in quality.query(spark, sf).collect()}
    label = {r["doc_id"]: r["quality"] for r in common.table(spark, sf, "labels").collect()}
    assert all(r["held_out"] == (remainder(i, 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in found.items())
    held = [i for i in label if found[i]["held_out"]]
    assert np.mean([found[i]["predicted"] == label[i] for i in held]) > 0.95
    assert np.mean([found[i]["predicted"] == 0 for i in held if label[i] == 0]) > 0.8


def test_quality_edges(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "text", "en", "s", 4), (3, "x " * 100_000, "en", "s", 1), (3, "x " * 100_000, "en", "s", 1)]
    docs = documents(spark, rows).withColumnRenamed("source", "stats")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality.classify(docs, none).collect()
    assert len(found) == 5 and all(r["score"] == 0.5 for r in found) and [r["held_out"] for r in found if r["doc_id"] is None] == [True]
    some = spark.createDataFrame([(1, 0, 0), (2, None, 0), (3, 1, 0), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, some).count() == 5 and quality.classify(docs.limit(0), some).count() == 0


@HERE
def test_languages_of_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    lang = {r["doc_id"]: r["lang"] for r in common.table(spark, sf, "documents").select("doc_id", "lang").collect()}
    found = {r["doc_id"]: r for r in language_id.query(spark, sf).collect()}
    assert all(r["held_out"] == (remainder(i, 4) == 2) for i, r in found.items())
    assert np.mean([found[i]["lang_pred"] == lang[i] for i in lang if found[i]["held_out"]]) > 0.98


def test_language_edges(spark):
    words = {"en": "the and of with that", "de": "und der die nicht ein", "fr": "le la les des une", "xx": "qzx wqz xzq zzq qxz"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation((w * 3).split())), k, "s", 1) for j, (k, w) in enumerate(words.items()) for i in range(100 * j, 100 * j + 40)]
    rows += [(900, None, "en", "s", 1), (901, "12 34 !?", "en", "s", 1), (902, "", None, "s", 1), (None, "und der die", "de", "s", 1), (903, "ß", None, "s", 1)]
    docs = documents(spark, rows).withColumnRenamed("source", "score")
    model = language_id.fit(docs)
    assert sorted(model.families) == ["=xx", "germanic", "romance"] and model.members["germanic"] == ["de", "en"]
    found = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (900, 901, 902)) and found[903]["lang_pred"] != "und"
    assert all(found[r[0]]["lang_pred"] == r[2] for r in rows[:160]) and found[None]["lang_pred"] == "de"
    assert language_id.fit(docs.where("lang is null")) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


@HERE
def test_pipeline_against_plain_stages(spark):
    sf = SF.replace("0.001", "0.01")
    docs = {r["doc_id"]: r["text"] for r in common.table(spark, sf, "documents").collect()}
    good = {r["doc_id"] for r in quality.classify(common.table(spark, sf, "documents"), common.table(spark, sf, "labels")).collect() if r["predicted"]}
    kept = {i: t for i, t in docs.items() if i in good}
    kept = {i: kept[i] for i, (_, c) in jaccard_brute_fast(kept).items() if i == c}
    items = [decontaminate._tokens([r["text"]])[0].tolist() for r in common.table(spark, sf, "benchmark").collect()]
    kept = {i: t for i, t in kept.items() if not overlaps(decontaminate._tokens([t])[0].tolist(), items)}
    novelty = secrets.Novelty()
    coder = sentencepiece_codec.coder_of(sentencepiece_codec.read_model())
    expected = {}
    for i, t in kept.items():
        base = secrets.base_spans(t)
        expected[i] = hashlib.sha256(coder.encode(secrets.redact(t, base + secrets.novel_spans(t, base, novelty)))).hexdigest()
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).withColumn("sha", F.sha2("ids", 256)).collect()}
    assert {i: r["sha"] for i, r in found.items()} == expected and all(r["round_trip"] for r in found.values())


def jaccard_brute_fast(texts):
    """Brute force over the pairs that share a shingle; others have no similarity."""
    from collections import defaultdict

    groups = defaultdict(set)
    for i, t in texts.items():
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        for k in range(max(1, len(w) - 4)):
            groups[tuple(w[k : k + 5])].add(i)
    joined = {i: {i} for i in texts}
    for g in groups.values():
        whole = set().union(*(joined[i] for i in g))
        for i in whole:
            joined[i] = whole
    out = {}
    for part in {id(p): p for p in joined.values()}.values():
        out |= jaccard_brute([(i, texts[i]) for i in part])
    return out


def overlaps(words, items):
    for tokens in items:
        size, least = decontaminate.needed(len(tokens))
        known = set(tokens)
        hits = [w in known for w in words]
        for a in range(len(words) - size + 1):
            if sum(hits[a : a + size]) >= least and any(sum(x == y for x, y in zip(words[a : a + size], tokens[b : b + size], strict=True)) >= least for b in range(len(tokens) - size + 1)):
                return True
    return False


@HERE
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_runs(spark, name):
    """Queries that return a row for each of a table have as many; the others have some, or fit their schema if none."""
    found = queries.QUERIES[name](spark, SF)
    rows = found.collect()
    table = {"op1_html_extract": "pages", "op12_collocations": None, "op13_whitening": None, "op3_neighbours": None, "op2_decontaminate": None}.get(name, "documents")
    assert len(rows) == common.table(spark, SF, table).count() if table else all(len(r) == len(found.schema) for r in rows)


@HERE
def test_pipeline_edges(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns and empty tables go through all stages."""
    long = "A long text has many words in it, and more. " * 4000
    rows = [(1, None, None, None, None), (None, "A plain text without an id, of some words.", "en", "s", 42), (2, "", "en", None, 0), (3, long, "en", "s", len(long)), (3, long, "en", "s", len(long)), (4, "éàü 漢字 " * 9, None, "s", 90)]
    docs = documents(spark, rows).selectExpr("*", "'x' as node", "1 as score", "'y' as ids", "2 as slot")
    for some in (docs, docs.limit(0)):
        before = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = common.cut(stage(spark, before, SF), name)
            assert after.columns == docs.columns and after.count() <= before.count()
            before = after
        coded = corpus_pipeline.STAGES[-1][1](spark, before, SF)
        assert coded.columns == ["doc_id", "lang", "source", "n_pieces", "ids", "round_trip"]
        assert coded.count() == before.count() and coded.where("not round_trip").count() == 0
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()]
    assert sorted(k or 0 for k in kept) == [0, 1, 2, 3, 3, 4]


def test_quality_weights_against_plain_numpy(spark):
    """The partition-summed normal equations and the calibration are those of one plain fit over all rows."""
    rng = np.random.default_rng(5)
    width = len(quality.STATISTICS)
    x = rng.normal(size=(240, width))
    y = (x[:, 0] + 0.3 * rng.normal(size=240) > 0).astype(int)
    stats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, stats array<double>").repartition(7)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    model = quality.fit(stats, labels)
    fold = np.array([zlib.crc32(str(i).encode()) % 3 for i in range(240)])
    use = fold != 1
    assert model.mean == pytest.approx(x[use].mean(0)) and model.scale == pytest.approx(x[use].std(0))
    z = model.features(x)
    gram, moment = z[use].T @ z[use], z[use].T @ y[use]
    assert model.weights == pytest.approx(np.linalg.solve(gram + quality.RIDGE * use.sum() * np.eye(len(gram)) / quality.FEATURES, moment), abs=1e-8)
    raw = np.zeros(240)
    for k in (0, 2):
        own, other = fold == k, fold == 2 - k
        g, m = z[other].T @ z[other], z[other].T @ y[other]
        raw[own] = np.clip(z[own] @ np.linalg.solve(g + quality.RIDGE * other.sum() * np.eye(len(g)) / quality.FEATURES, m), *quality.SPAN)
    bins = np.floor((raw - quality.SPAN[0]) / (quality.SPAN[1] - quality.SPAN[0]) * quality.BINS)
    points = sorted((b, raw[use & (bins == b)].mean(), y[use & (bins == b)].mean(), (use & (bins == b)).sum()) for b in set(bins[use]))
    knots = quality.isotonic(*(np.array([p[k] for p in points], float) for k in (1, 2, 3)))
    assert model.knots[0] == pytest.approx(knots[0], abs=1e-6) and model.knots[1] == pytest.approx(knots[1], abs=1e-6)
    assert (np.diff(model.probability(x[np.argsort(z @ model.weights)])) >= -1e-12).all()


def test_repeated_rows_have_one_language(spark):
    """Repeated rows and a very long text are predicted alike."""
    german, french = "der die das und nicht ein haus im garten mit ", "le la les et pas une maison dans le jardin avec "
    rows = [(i, (german if i % 2 else french) * 3 + str(i), "de" if i % 2 else "fr", None, 1) for i in range(60)] + [(500, german * 5000, None, None, 1), (501, german, None, None, 1), (501, german, None, None, 1)]
    table = documents(spark, rows)
    found = [(r["doc_id"], r["lang_pred"]) for r in language_id.predict(table, language_id.fit(table)).collect()]
    assert len(found) == len(rows) and {p for i, p in found if i >= 500} == {"de"}


PARTS_KEPT = [
    ("<article><p>x</p><section id=discussion><p>We find it.</p></section></article>", "x We find it."),
    ("<article><p>x</p><div id=discussion><h2>4. Discussion</h2><p>We find it.</p></div><div class=discussion><p>Reader says</p></div></article>", "x 4. Discussion We find it."),
    ("<article><p>x</p><div class='social-history'><p>Long ago.</p></div><div class='social-icons'>share it</div></article>", "x Long ago."),
    ("<article><p>x</p><table class='widget-prices'><tr><td>2<td>3</table><div class='widget-x'><a href=/>links only</a></div></article>", "x 2 3"),
    ("<body><div class=content><div class=intro><p>intro</p></div><div class=rest><p>" + "the rest " * 40 + "</p></div></div><div class=box>box</div></body>", "intro " + "the rest " * 40),
    ("<body><div class=content-wrapper><div class=left><p>side</p></div><div class=rest><p>" + "the rest " * 40 + "</p></div></div></body>", "the rest " * 40),
    ("<p>a <b title=\"x > y\">b</b> <i title='>'>c</i> d", "a b c d"),
]


@pytest.mark.parametrize(("page", "text"), PARTS_KEPT)
def test_parts_of_articles_stay(page, text):
    assert html_extract.text_by(page, None)[0] == text.strip()


UNTIDY = ["<div class=part-inner>" * 45_000 + "x", "<i>x</b>" * 125_000, "<i>" * 100_000 + "<hr>" * 100_000, '<a y=">" ' * 110_000 + '="', "<table>" + "<tr><td>" * 60_000, "<li><b>" * 75_000, "<form>" * 80_000]


@pytest.mark.parametrize("page", UNTIDY)
def test_deep_and_untidy_pages_take_linear_time_and_memory(page):
    import time
    import tracemalloc

    began = time.time()
    html_extract.text_by(page, None)
    whole = time.time() - began
    tracemalloc.start()
    html_extract.text_by(page[: len(page) // 4], None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert whole < 30 and peak < 1000 * len(page) // 4
