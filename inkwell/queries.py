"""Queries by name: each applies one operator family to the plain tables through the adapter views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell import queries_exercises, queries_fleet, queries_structure
from inkwell.functions import clean, fixed
from inkwell.functions import text as tx
from inkwell.operators import cards, elements, gates, identity, integrity, recaps, rewriting, rules, scoring
from inkwell.plans import reports
from inkwell.sources import adapters as ad
from inkwell.sources import views
from inkwell.streaming import freshness

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# cards and their identity


@query
def card_quality_by_collection(spark, sf):
    return scoring.card_quality(ad.cards(spark, sf))


@query
def id_collisions(spark, sf):
    return identity.collisions(ad.cards(spark, sf))


@query
def dedup_keep_first(spark, sf):
    return identity.keep_first(ad.cards(spark, sf), "id", ["ord"]).select("ord", "id", "collection")


@query
def card_id_assignment(spark, sf):
    d = ad.cards(spark, sf).select("ord", F.col("collection").alias("prefix"), F.substring("front", 1, 12).alias("title"), F.col("front").alias("body"), "los_id")
    return identity.card_ids(d, ["ord"]).select("ord", "card_id")


@query
def counter_ids(spark, sf):
    return identity.counted_ids(ad.cards(spark, sf), "id", ["ord"]).select("ord", "unique_id")


@query
def guid_assignment(spark, sf):
    return ad.cards(spark, sf).select("ord", identity.guid(F.concat_ws("_", F.lit("deck"), "id")).alias("guid"), identity.short_guid(F.col("id")).alias("short_guid"))


@query
def deck_notes(spark, sf):
    return reports.notes(ad.cards(spark, sf), "deck").select("deck", "guid", "id", "type")


@query
def cards_by_type(spark, sf):
    return reports.by_type_text(ad.cards(spark, sf))


# rule packs


@query
def back_rules(spark, sf):
    return rules.back_findings(ad.marked_cards(spark, sf), "ord", "type").drop("rule_ord")


@query
def back_rules_by_severity(spark, sf):
    found = rules.back_findings(ad.marked_cards(spark, sf), "collection", "ord")
    return rules.severity_counts(found, "collection", "severity", "rule")


@query
def critical_top(spark, sf):
    found = rules.back_findings(ad.marked_cards(spark, sf), "collection", "ord").where(F.col("severity").isin("critical", "high"))
    return found.groupBy("collection").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "collection").limit(10)


@query
def front_back_similarity(spark, sf):
    t = elements.pair_answers(ad.turns(spark, sf))
    a, b = tx.bigrams(tx.collapse("question")), tx.bigrams(tx.collapse("answer"))
    return t.select("conv_id", "turn", F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_union(a, b)).alias("either"))


@query
def presentation_issues(spark, sf):
    found = rules.presentation_findings(ad.marked_cards(spark, sf), "ord")
    return found.where("rule <> 'inline_sections'").select("ord", "side", "rule", "severity")


@query
def presentation_inline_sections(spark, sf):
    found = rules.presentation_findings(ad.marked_cards(spark, sf), "ord")
    return found.where("rule = 'inline_sections'").select("ord", "side", "severity")


@query
def solution_class(spark, sf):
    return rules.solution_classes(ad.marked_cards(spark, sf), "ord", "type")


@query
def atomicity_class(spark, sf):
    return rules.atomicity(ad.marked_cards(spark, sf), "ord", "type")


def _stale_lines(spark, sf):
    parts = ad.table(spark, sf, "part")
    names = [r"gpt-4-turbo", r"Llama 2", r"claude-3-opus", r"langchain>=0.1.5", r"gemini 1.5", r"nothing", r"% gpt-3.5-turbo"]
    pick = F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    return parts.select(F.col("p_partkey").alias("ord"), F.concat(pick, F.lit(" is used for "), "p_name", F.when(F.col("p_size") > 40, F.lit(" % freshness-ok")).otherwise("")).alias("line"))


@query
def staleness_findings(spark, sf):
    return rules.stale_mentions(_stale_lines(spark, sf), "ord").select("ord", "rule", "severity")


def _margin_notes(spark, sf):
    d = elements.matches(ad.markup(spark, sf), r"\\patternmargin\{([^}]*)\}", {"note": 1}, "doc")
    return d.withColumn("category", F.lit("Pattern")).withColumn("note", F.concat("note", F.when(F.col("ord") == 1, F.lit(" which is avoided when possible, and be careful")).otherwise("")))


@query
def margin_quality(spark, sf):
    return rules.margin_findings(_margin_notes(spark, sf), "doc", "ord").select("doc", "ord", "rule", "severity")


@query
def density_status(spark, sf):
    n = ad.lines(spark, sf).groupBy("collection", "ord").agg(F.count("*").alias("n"))
    return scoring.density(n.withColumn("kind", F.when(F.col("ord") % 2 == 0, "theory").otherwise("code-heavy")))


@query
def leading_repeats(spark, sf):
    d = ad.lines(spark, sf).select("ord", "line_no", F.regexp_replace("line", r"[.,]", "").alias("text"))
    return rules.leading_repeats(d, "ord", "line_no")


# clones, endings, runs, terms


@query
def clone_groups(spark, sf):
    return identity.clone_groups(ad.lines(spark, sf))


@query
def clone_rate(spark, sf):
    return identity.clone_rates(ad.lines(spark, sf))


def _items(spark, sf):
    return ad.table(spark, sf, "documents").select(F.col("source").alias("collection"), F.col("doc_id").alias("ord"), "text")


@query
def shared_suffix_clusters(spark, sf):
    return identity.suffix_clusters(_items(spark, sf), 2)


@query
def suffix_frequency(spark, sf):
    d = identity.suffixes(_items(spark, sf)).where("suffix is not null").groupBy("suffix").agg(F.count("*").alias("n"), F.count_distinct("collection").alias("n_collections"))
    return d.where("n_collections >= 2")


def _prompts(spark, sf):
    items = _items(spark, sf)
    tail = F.element_at(F.array(*(F.lit(t) for t in fixed.KNOWN_TAILS)), (F.col("ord") % len(fixed.KNOWN_TAILS) + 1).cast("int"))
    text = F.when(F.col("ord") % 5 == 0, F.concat("text", F.lit(" "), tail)).otherwise(F.col("text"))
    return items.withColumn("text", text).withColumn("los_id", (F.col("ord") % 40).cast("string"))


@query
def templated_prompts(spark, sf):
    outcomes = ad.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("los_id"), F.col("text").alias("statement"), F.col("item_id").alias("ord"))
    return identity.templated(_prompts(spark, sf), outcomes, fixed.KNOWN_TAILS, "ord", least=2)


@query
def reason_tally(spark, sf):
    return identity.reason_tally(templated_prompts(spark, sf))


@query
def verbatim_runs(spark, sf):
    runs = ad.table(spark, sf, "benchmark").select(F.col("item_id").alias("run_id"), "text")
    return identity.run_hits(_items(spark, sf), runs)


@query
def near_fronts(spark, sf):
    return identity.near_fronts(ad.cards(spark, sf))


@query
def term_clusters(spark, sf):
    return identity.term_clusters(ad.terms(spark, sf))


@query
def term_within_duplicates(spark, sf):
    return identity.term_duplicates(ad.terms(spark, sf))


@query
def term_conflicts(spark, sf):
    return identity.term_conflicts(ad.terms(spark, sf))


# elements


@query
def elements_los(spark, sf):
    return elements.outcomes(ad.markup(spark, sf), "doc").select("doc", "ord", "los_id", "level", "statement")


@query
def elements_terms(spark, sf):
    return elements.terms(ad.markup(spark, sf), "doc").select("doc", "los_id", "name", "definition", "front")


@query
def elements_problems(spark, sf):
    return elements.problems(ad.markup(spark, sf), "doc").select("doc", "title", "los_id", "front", "back")


@query
def elements_margins(spark, sf):
    return elements.margins(ad.markup(spark, sf), "doc").select("doc", "category", "note")


@query
def nearest_following_answer(spark, sf):
    return elements.pair_answers(ad.turns(spark, sf)).select("conv_id", "turn", "answer_turn")


@query
def positional_pairing(spark, sf):
    return elements.pair_by_position(ad.turns(spark, sf))


@query
def term_names(spark, sf):
    return elements.terms(ad.markup(spark, sf), "doc").select("doc", tx.term_name(F.concat(F.lit("The "), "name")).alias("name"), tx.slug("name").alias("slug"))


# integrity


def _refs(spark, sf):
    return elements.references(ad.markup(spark, sf), "doc")


def _labels(spark, sf):
    return elements.labels(ad.markup(spark, sf), "doc")


@query
def undefined_refs(spark, sf):
    return integrity.undefined(_refs(spark, sf), _labels(spark, sf)).select("doc", "line_no", "label")


@query
def duplicate_labels(spark, sf):
    return integrity.duplicate_labels(_labels(spark, sf))


@query
def label_orphans(spark, sf):
    return integrity.orphans(_labels(spark, sf), _refs(spark, sf))


@query
def incoming_counts(spark, sf):
    return integrity.incoming(_refs(spark, sf), _labels(spark, sf))


def _defined(spark, sf):
    return ad.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("collection"), F.col("o_custkey").cast("string").alias("los_id"))


def _tested(spark, sf):
    o = ad.table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return o.select(F.col("o_orderpriority").alias("collection"), F.col("o_custkey").cast("string").alias("los_id"))


@query
def retrieval_coverage(spark, sf):
    return integrity.coverage(_defined(spark, sf), _tested(spark, sf))


@query
def untested_los(spark, sf):
    return integrity.untested(_defined(spark, sf), _tested(spark, sf))


@query
def registry_vs_disk(spark, sf):
    registry = ad.table(spark, sf, "nation").select(F.col("n_nationkey").alias("slug"))
    disk = ad.table(spark, sf, "supplier").select((F.col("s_nationkey") + 2).alias("slug"))
    return integrity.unregistered(registry, disk)


@query
def undefined_styles(spark, sf):
    used = ad.table(spark, sf, "part").select(F.col("p_brand").alias("style"))
    universe = ad.table(spark, sf, "part").where("p_size > 10").select(F.col("p_brand").alias("style"))
    defined = ad.table(spark, sf, "part").where("p_retailprice > 1950 or p_size = 49").select(F.col("p_brand").alias("style"))
    return integrity.undefined_used(used, universe, defined)


# metrics, gates, tiers, reports


@query
def metric_trends(spark, sf):
    return scoring.metric_trends(ad.daily_metrics(spark, sf))


@query
def history_last_50(spark, sf):
    return scoring.latest(ad.daily_metrics(spark, sf))


@query
def metric_lights(spark, sf):
    d = ad.daily_metrics(spark, sf)
    return d.select("metric", "day", scoring.light(F.col("value"), F.lit(60), F.lit(40), F.col("metric") == "error").alias("status"))


def _gates(spark, sf):
    c = ad.table(spark, sf, "customer")
    gate = F.concat(F.lit("G"), (F.col("c_custkey") % 7 + 1).cast("string"))
    d = c.select(F.col("c_nationkey").alias("collection"), gate.alias("gate"), "c_acctbal").groupBy("collection", "gate").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))
    passed = (F.col("low") > -900) & (F.col("high") > 0) | (F.col("gate") != "G5") & (F.col("collection") % 2 == 0)
    return d.select("collection", "gate", passed.alias("passed"), F.when(F.col("high") > 5000, "missing").otherwise("scaffold").alias("reason"))


@query
def gate_class(spark, sf):
    return scoring.gate_class(_gates(spark, sf))


@query
def gate_pivot(spark, sf):
    return scoring.gate_pivot(_gates(spark, sf), [f"G{i}" for i in range(1, 9)])


@query
def first_failing_gate(spark, sf):
    return scoring.first_failing(_gates(spark, sf))


def _checks(spark, sf):
    o = ad.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("collection"), F.col("o_orderpriority").alias("check")).agg(F.avg("o_totalprice").alias("v"))
    return o.select("collection", "check", scoring.light(F.col("v"), F.lit(200000.0), F.lit(120000.0), F.lit(False)).alias("status"))


@query
def bronze_scores(spark, sf):
    return scoring.bronze(_checks(spark, sf))


@query
def worst_first(spark, sf):
    return scoring.worst_first(scoring.bronze(_checks(spark, sf)), 25)


@query
def readiness_exit(spark, sf):
    d = _checks(spark, sf).select("collection", F.col("check").isin("1-URGENT", "2-HIGH").alias("blocking"), (F.col("status") != "RED").alias("passed"))
    return scoring.exit_codes(d)


@query
def level_histogram(spark, sf):
    return scoring.shares(ad.table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query
def worst_five_per_collection(spark, sf):
    d = ad.cards(spark, sf).select("collection", "ord", F.length("back").alias("n_chars"))
    return scoring.worst_per_group(d, "collection", [F.desc("n_chars"), F.col("ord")], 5)


@query
def crossref_floor(spark, sf):
    d = ad.table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    refs, files = scoring.crossref_floor(F.col("n"))
    return d.select("source", "lang", "n", refs.alias("refs"), files.alias("files"))


@query
def bib_sorted(spark, sf):
    p = ad.table(spark, sf, "part")
    entries = p.select(F.concat(F.lit("k"), "p_partkey").alias("bibkey"), F.concat("p_name", F.lit(" & cost 5%")).alias("title"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("https://arxiv.org/abs/"), F.col("p_partkey").cast("string"))).when(F.col("p_size") % 3 == 1, F.lit("https://example.org/x")).alias("url"), F.when(F.col("p_size") % 2 == 0, F.lit("Proceedings of X")).otherwise(F.lit("Notes")).alias("venue"), F.concat((F.col("p_size") + 1970).cast("string"), F.lit("-05")).alias("date"))
    return reports.bibliography(entries).select("bibkey", "kind", "year")


# freshness


def _page_states(spark, sf):
    p = ad.table(spark, sf, "pages")
    n = F.col("page_id")
    facts = F.concat(
        F.when(n % 3 != 0, F.lit("<p>Reading began March 2025</p> ")).otherwise(""),
        F.lit("<b>Last updated "), F.element_at(F.array(*(F.lit(m) for m in ("April", "Juny", "May"))), (n % 3 + 1).cast("int")), F.lit(" 2026</b> Publication in Early 2027 ISBN 9781234567890 "),
        (n % 5 * 100).cast("string"), F.lit(" pages"),
    )
    return p.select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), F.when(n % 11 == 0, F.lit("")).otherwise(facts)).alias("html"))


@query
def page_state(spark, sf):
    return freshness.parse(_page_states(spark, sf), "page_id")


@query
def freshness_status(spark, sf):
    d = freshness.parse(_page_states(spark, sf), "page_id", "url")
    n = F.col("page_id")
    d = d.select(
        "page_id", F.when(n % 13 == 0, F.lit("other")).otherwise(freshness.final_slug(F.col("url"))).alias("recorded_slug"), freshness.final_slug(F.col("url")).alias("live_slug"),
        "is_early", "degraded", "signature", "last_updated_month", (n % 12).alias("latest_chapter"), F.when(n % 2 == 0, n % 10).alias("captured"),
        F.when(n % 4 == 0, F.lit("2026-05-03")).when(n % 4 == 1, F.lit("2026-3-9")).alias("build_date"),
        F.when(n % 5 > 1, F.when(n % 7 == 0, "page_state/1").otherwise(freshness.SCHEMA)).alias("prior_schema"), F.when(n % 3 == 1, F.col("signature")).otherwise(F.lit("00")).alias("prior_signature"),
        F.when(n % 2 == 0, "STALE").otherwise("OK").alias("prior_status"), F.col("last_updated_month").alias("prior_month"),
    )
    return freshness.classify(d).select("page_id", "status")


@query
def freshness_report(spark, sf):
    d = freshness_status(spark, sf).groupBy("status").agg(F.count("*").alias("n"))
    return d.withColumn("place", reports.status_order())


@query
def page_changes(spark, sf):
    d = ad.table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("signature"))
    return freshness.changes(d.withColumn("at", F.struct("ts", "event_id")), "user_id", "at").select("user_id", "event_id", "status")


@query
def month_iso(spark, sf):
    d = freshness.parse(_page_states(spark, sf), "page_id")
    return d.select("page_id", tx.month_iso("last_updated_month").alias("month"))


@query
def substantive_words(spark, sf):
    return _items(spark, sf).select("ord", F.regexp_count(F.regexp_replace("text", r"[^A-Za-z0-9 \n-]", " "), F.lit(r"\b[A-Za-z][A-Za-z0-9-]+\b")).alias("n"))


@query
def wrapped_lines(spark, sf):
    return _items(spark, sf).select("ord", rewriting.wrap("text").alias("text"))


@query
def run_on_fixes(spark, sf):
    return ad.marked_cards(spark, sf).select("ord", rewriting.break_run_ons("back").alias("back"))


# cards from environments, document checks


def _boxed(spark, sf):
    """One marked-up text per part: a card environment by size, a two-way term and open marks."""
    p = ad.table(spark, sf, "part")
    env = F.element_at(F.array(*(F.lit(k.environment) for k in cards.KINDS)), (F.col("p_size") % len(cards.KINDS) + 1).cast("int"))
    body = F.concat(F.lit("Body of "), "p_name", F.lit(" in "), "p_brand")
    text = F.concat(
        F.lit("\\begin{"), env, F.lit("}["), "p_type", F.lit("][L-"), F.col("p_size").cast("string"), F.lit("]\n"), body, F.lit("\n\\end{"), env, F.lit("}\n\\termbi{"), "p_brand", F.lit("}{"), "p_name", F.lit("}\n"),
        F.when(F.col("p_size") % 2 == 0, F.lit("- **Source**: TODO\n| a | b |\n|---|---|\n| c | TODO |\n")).otherwise(F.lit("\\subsection{Q1} IC4 or Senior \\cref{ch:x}\n## Setup\n- one two\n[R] [Y]\n")),
    )
    return p.select(F.col("p_partkey").alias("doc"), "p_size", text.alias("text"))


@query
def environment_cards(spark, sf):
    return cards.environment_cards(_boxed(spark, sf), "doc").select("doc", "type", "title", "los_id", "back", "scaffolding_level", "ord_extractor")


@query
def two_way_terms(spark, sf):
    return cards.two_way_terms(_boxed(spark, sf), "doc").select("doc", "way", "front", "back")


@query
def interview_gate(spark, sf):
    return gates.interview_gate(_boxed(spark, sf), F.when(F.col("p_size") > 25, 2).otherwise(1), "doc")


@query
def open_mark_density(spark, sf):
    todo, fields = gates.todo_density("text")
    return _boxed(spark, sf).select("doc", todo.alias("todo"), fields.alias("fields"))


@query
def status_marks(spark, sf):
    red, yellow, green = gates.status_marks("text")
    return _boxed(spark, sf).select("doc", red.alias("red"), yellow.alias("yellow"), green.alias("green"))


@query
def section_min_words(spark, sf):
    return _boxed(spark, sf).select("doc", gates.section_words("text", ["Setup"]).alias("least"))


@query
def render_faults(spark, sf):
    d = ad.marked_cards(spark, sf).withColumn("back", F.when(F.col("ord") % 3 == 0, F.concat("back", F.lit(" \\( &lt; a < b \\begin{x}"))).otherwise(F.col("back")))
    return gates.render_faults(d, "ord")


@query
def paragraphs(spark, sf):
    d = ad.lines(spark, sf).withColumn("line", F.when(F.col("line_no") % 4 == 0, "").otherwise(F.col("line")))
    return cards.paragraphs(d, "ord")


@query
def preserved_outcomes(spark, sf):
    d = ad.cards(spark, sf).select("ord", "id", "los_id")
    before = d.where("ord % 2 = 0").select("id", "los_id")
    return cards.previous_outcomes(d.withColumn("los_id", F.when(F.col("ord") % 3 == 0, F.col("los_id"))), before)


@query
def phrase_notes(spark, sf):
    phrases = ad.table(spark, sf, "nation").select(F.substring(F.lower("n_name"), 1, 3).alias("phrase"), F.col("n_name").alias("note"), F.col("n_nationkey").alias("ord"))
    return cards.mapped(ad.cards(spark, sf), phrases).select("ord", "note")


@query
def front_ratio(spark, sf):
    pairs = identity.near_fronts(ad.cards(spark, sf), 60)
    fronts = ad.cards(spark, sf).select("ord", "front")
    d = pairs.join(fronts.select(F.col("ord").alias("ord_a"), F.col("front").alias("a")), "ord_a").join(fronts.select(F.col("ord").alias("ord_b"), F.col("front").alias("b")), "ord_b")
    # pairs take long for their size, so partitions aren't put together by size
    d = d.select("ord_a", "ord_b", "a", "b").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ord_a", "ord_b")
    return d.select("ord_a", "ord_b", clean.ratio_above("a", "b", 0.9).alias("near"))


@query
def ratio_pairs(spark, sf):
    return identity.ratio_pairs(ad.cards(spark, sf))


@query
def cleaned_markup(spark, sf):
    return _boxed(spark, sf).select("doc", clean.clean_markup("text").alias("plain"), clean.html_of("text").alias("html"))


@query
def log_sources(spark, sf):
    e = ad.table(spark, sf, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("line_no"), "event_type", "event_id")
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("(./chapters/c"), (F.col("event_id") % 9).cast("string"), F.lit(".tex"))).when(F.col("event_type") == "error", F.lit("Overfull \\hbox (3pt too wide)")).when(F.col("event_type") == "click", F.lit("LaTeX Warning: Reference `x' undefined")).otherwise(F.lit("ok"))
    d = elements.log_sources(e.withColumn("line", line), "user_id").where("category is not null")
    return d.groupBy(F.coalesce("source", F.lit("none")).alias("source")).pivot("category", ["undefined", "overfull_hbox"]).count().fillna(0)


@query
def recapped_answers(spark, sf):
    return recaps.recapped(views.view(spark, sf, views.RECAPS, "part"), "doc")


@query
def renewed_recaps(spark, sf):
    return recaps.renewed(recaps.recapped(views.view(spark, sf, views.RECAPS, "part"), "doc").drop("replaced"), "doc")


QUERIES.update(queries_fleet.QUERIES)
QUERIES.update(queries_structure.QUERIES)
QUERIES.update(queries_exercises.QUERIES)
