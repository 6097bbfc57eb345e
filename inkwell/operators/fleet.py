r"""Checks and gates of whole collections, over one table of files.

files: collection, rel_path, text (null: not readable) and size. Every check is a group aggregate over
the files of a collection with one row per collection and check; no file's text leaves its row.
Collections without the file that a check needs are RED. Null texts count as files without content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fixed

#: Order of lights, the worst last.
LIGHTS = ("GREEN", "YELLOW", "RED")


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _named(pattern: str) -> Column:
    return F.col("rel_path").rlike(pattern)


def _of(name: str, c: Column) -> Column:
    """c of the collection's file with that path; null if there is none."""
    return F.max(F.when(F.col("rel_path") == name, c))


def path_problems(files: DataFrame) -> DataFrame:
    """Per collection the paths and commands that only work on one machine, in the order of fixed.PATH_PROBLEMS."""
    found = [F.max(F.when((F.col("rel_path") == path) & _text().rlike(has) & ~(_text().rlike(unless) if unless else F.lit(False)), F.lit(label))) for label, path, has, unless in fixed.PATH_PROBLEMS]
    return files.groupBy("collection").agg(F.array_compact(F.array(*found)).alias("problems"))


def file_checks(files: DataFrame) -> DataFrame:
    """collection, check and status of the checks on files: configuration, build targets, macros, cards, decks, dashboard, portable paths."""
    sections = sum((F.contains(_text(), F.lit(s)).cast("int") for s in fixed.CONFIG_SECTIONS), F.lit(0))
    targets = sum((F.contains(_text(), F.lit(f"{t}:")).cast("int") for t in fixed.BUILD_TARGETS), F.lit(0))
    include = F.when(F.contains(_text(), F.lit(fixed.BUILD_INCLUDE)), 99).otherwise(targets)
    style = F.when(tx_all(_text(), fixed.STYLE_MACROS), 2).otherwise(1)
    first_style = F.min_by(F.when(_named(r"^[^/]*extensions\.sty$"), style), F.when(_named(r"^[^/]*extensions\.sty$"), F.col("rel_path")))
    problems = sum((((F.col("rel_path") == path) & _text().rlike(has) & ~(_text().rlike(unless) if unless else F.lit(False))).cast("int") for _, path, has, unless in fixed.PATH_PROBLEMS), F.lit(0))
    d = files.groupBy("collection").agg(
        _of(fixed.CONFIG_FILE, sections).alias("sections"), _of("Makefile", include).alias("targets"), first_style.alias("style"), _of("cards/all_cards.yml", F.col("size")).alias("cards"),
        F.count_if(_named(r"^decks/[^/]*\.apkg$")).alias("decks"), F.count_if(F.col("rel_path") == "review/dashboard.md").alias("dashboard"), F.sum(problems).alias("problems"),
    )
    g, y, r = (F.lit(x) for x in LIGHTS)
    n, t = len(fixed.CONFIG_SECTIONS), len(fixed.BUILD_TARGETS)
    status = {
        "configuration": F.when(F.col("sections").isNull(), r).when(F.col("sections") < n, y).otherwise(g),
        "build_targets": F.when(F.coalesce("targets", F.lit(0)) == 0, r).when(F.col("targets") < t, y).otherwise(g),
        "style_macros": F.when(F.col("style").isNull(), r).when(F.col("style") < 2, y).otherwise(g),
        "cards": F.when(F.col("cards").isNull(), r).when(F.col("cards") < 100, y).otherwise(g),
        "decks": F.when(F.col("decks") == 0, r).otherwise(g),
        "dashboard": F.when(F.col("dashboard") == 0, r).otherwise(g),
        "portable_paths": F.when(F.col("problems") == 0, g).otherwise(r),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), v.alias("status")) for k, v in status.items())))
    return d.select("collection", rows.alias("c")).select("collection", "c.check", "c.status")


def tx_all(c: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for needle in needles:
        out = out & F.contains(c, F.lit(needle))
    return out


def level_checks(levels: DataFrame) -> DataFrame:
    """collection, number of distinct levels and status. levels: collection, level."""
    n = F.count_distinct("level")
    return levels.groupBy("collection").agg(n.alias("n_levels"), F.when(n <= 12, "GREEN").when(n <= 20, "YELLOW").otherwise("RED").alias("status"))


def first_class(checks: DataFrame, gates: DataFrame, needed: int) -> DataFrame:
    """PASS, MISSING or FAIL of each collection of checks: all of the needed checks GREEN, then the gates by place.

    gates: collection, place, gate, passed, reason. The first failing gate gives the detail; a missing first one is MISSING.
    """
    green = checks.groupBy("collection").agg(F.count_if(F.col("status") == "GREEN").alias("green"))
    failed = gates.where(~F.col("passed")).groupBy("collection").agg(F.min_by(F.struct("place", "gate", "reason"), "place").alias("f"))
    d = green.join(failed, "collection", "left")
    status = F.when(F.col("green") < needed, "FAIL").when(F.col("f").isNull(), "PASS").when((F.col("f.place") == 1) & (F.col("f.reason") == "missing"), "MISSING").otherwise("FAIL")
    return d.select("collection", "green", status.alias("status"), F.when(F.col("green") >= needed, F.concat_ws(": ", "f.gate", "f.reason")).alias("detail"))


def ranked(classes: DataFrame) -> DataFrame:
    """Collections by green checks, passing ones first, then by name."""
    return classes.orderBy(F.desc("green"), F.col("status") != "PASS", "collection")


# chapters, decks, dashboard, fidelity


def stem() -> Column:
    return F.regexp_extract("rel_path", r"([^/]+?)(?:\.[^./]+)?$", 1)


def chapter_counts(files: DataFrame) -> DataFrame:
    """Per collection the content chapters: without appendices A_ to F_ and front matter numbered 0."""
    d = files.where(_named(r"^chapters/[^/]*\.tex$")).withColumn("stem", stem())
    number = F.regexp_extract("stem", r"^(\d+)", 1)
    content = ~F.col("stem").rlike(r"^[A-F]_") & F.when(number != "", number.cast("decimal(38,0)") != 0).otherwise(F.col("stem").rlike(r"^ch\d"))
    return d.groupBy("collection").agg(F.count_distinct(F.when(content, F.col("stem"))).alias("n_chapters"))


def missing_modules(files: DataFrame, mapped: DataFrame) -> DataFrame:
    """Per collection the mN tokens of its chapters' names that no key of mapped (collection, module) covers, by number."""
    d = files.where(_named(r"^chapters/[^/]*\.tex$")).select("collection", F.regexp_extract(stem(), r"_(m\d+)_", 1).alias("module")).where("module <> ''").distinct()
    left = d.join(mapped.select("collection", "module"), ["collection", "module"], "left_anti")
    number = F.substring("module", 2, 30).cast("long")
    return left.groupBy("collection").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number.alias("n"), "module"))), lambda s: s["module"]), ",").alias("missing"))


def is_waived(flag: Column, justification: Column) -> Column:
    """A flag that is true and a justification that isn't blank."""
    return F.coalesce((F.lower(F.trim(flag.cast("string"))) == "true") & (F.length(F.trim(justification)) > 0), F.lit(False))


def deck_gate(files: DataFrame, settings: DataFrame, mapped: DataFrame) -> DataFrame:
    """collection, passed and reasons of the gate on decks. settings: collection, decks_complete_only, justification, of every collection."""
    deck = _named(r"^decks/[^/]*\.apkg$")
    name = F.lower("rel_path")
    d = files.groupBy("collection").agg(
        F.count_if(deck & F.contains(name, F.lit("complete"))).alias("complete"),
        F.count_if(deck & ~F.contains(name, F.lit("complete")) & ~F.contains(name, F.lit("appendices"))).alias("single"),
    )
    entries = mapped.groupBy("collection").agg(F.count("*").alias("entries"))
    d = settings.join(d, "collection", "left").join(chapter_counts(files), "collection", "left").join(entries, "collection", "left").join(missing_modules(files, mapped), "collection", "left")
    required = F.greatest(F.lit(2), F.coalesce("n_chapters", F.lit(0)) - 1)
    waived = is_waived(F.col("decks_complete_only"), F.col("justification"))
    reasons = F.array_compact(F.array(
        F.when(F.coalesce("complete", F.lit(0)) == 0, "no complete deck"),
        F.when(F.coalesce("entries", F.lit(0)) == 0, "empty map").when(F.col("missing").isNotNull(), F.concat(F.lit("missing modules "), "missing")),
        F.when(~waived & (F.coalesce("single", F.lit(0)) < required), F.concat_ws("", F.coalesce("single", F.lit(0)).cast("string"), F.lit("/"), required.cast("string"), F.lit(" decks"))),
    ))
    return d.select("collection", (F.size(reasons) == 0).alias("passed"), F.array_join(reasons, "; ").alias("reason"))


def dashboard_gate(files: DataFrame, settings: DataFrame) -> DataFrame:
    """collection, red marks and whether there are none or they are waived. settings: collection, red_waiver, red_justification."""
    d = files.where(F.col("rel_path") == "review/dashboard.md").groupBy("collection").agg(F.sum(F.regexp_count(_text(), F.lit(r"\[\s*R\s*\]"))).alias("red"))
    d = settings.join(d, "collection", "left")
    waived = is_waived(F.col("red_waiver"), F.col("red_justification"))
    reason = F.when(F.col("red").isNull(), "missing").when(F.col("red") == 0, "").when(waived, "waived").when(F.lower(F.trim("red_waiver")) == "true", "no justification").otherwise("red")
    return d.select("collection", "red", (F.col("red").isNotNull() & ((F.col("red") == 0) | waived)).alias("passed"), reason.alias("reason"))


def fidelity_gate(files: DataFrame) -> DataFrame:
    """collection, passed and the first reason against the collection's latest fidelity document, of those that have one."""
    d = files.where(_named(r"^review/gold_audit_[^/]*\.md$"))
    d = d.groupBy("collection").agg(F.max_by(F.struct("text"), "rel_path")["text"].alias("text"))
    scaffold = F.lit(False)
    for s in fixed.SCAFFOLD_SIGNATURES:
        scaffold = scaffold | F.contains(F.col("text"), F.lit(s))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    author = F.trim(F.regexp_extract("text", fixed.AUTHOR, 1))
    reason = (
        F.when(F.col("text").isNull(), "unreadable").when(scaffold | (author == "TBV"), "scaffold").when(words < fixed.FIDELITY_WORDS, "short")
        .when(F.regexp_count("text", F.lit(fixed.FIDELITY_CITATION)) < fixed.FIDELITY_CITATIONS, "thin_citations").when(~F.col("text").rlike(fixed.FIDELITY_SECTION), "no_section").otherwise("pass")
    )
    return d.select("collection", (reason == "pass").alias("passed"), reason.alias("reason"))


def stub_items(files: DataFrame) -> DataFrame:
    """Per collection the checkpoint items of its chapters, those with fewer than ten words, and chapters that can't be read."""
    d = files.where(_named(r"^chapters/[^/]*\.tex$"))
    items = F.regexp_extract_all(_text(), F.lit(r"(?s)\\item\[[A-Z0-9][A-Za-z0-9.-]*\]((?:[^\\]++|\\(?!item\b|end\{))*+)"), F.lit(1))
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, r"\\[a-zA-Z]+\*?(\[[^\]]*\])?", " "), r"[{}]", " ")
    few = F.filter(items, lambda x: F.size(F.filter(F.split(plain(x), r"\s+"), lambda w: F.length(w) > 1)) < 10)
    d = d.select("collection", F.size(items).alias("items"), F.size(few).alias("stubs"), F.col("text").isNull().cast("int").alias("unreadable"))
    return d.groupBy("collection").agg(*(F.sum(c).alias(c) for c in ("items", "stubs", "unreadable")))


def retrieval_gate(coverage: DataFrame, files: DataFrame) -> DataFrame:
    """collection and whether all outcomes are tested, no item is a stub and every chapter was read. coverage: collection, tested, defined."""
    d = coverage.join(stub_items(files), "collection", "left")
    full = (F.col("defined") > 0) & (F.col("tested") >= F.col("defined"))
    return d.select("collection", (full & (F.coalesce("stubs", F.lit(0)) == 0) & (F.coalesce("unreadable", F.lit(0)) == 0)).alias("passed"), F.coalesce("stubs", F.lit(0)).alias("stubs"))


def audit_gate(verdicts: DataFrame, show: int = 3) -> DataFrame:
    """Per collection whether all audits are clean, how many aren't and the first names. verdicts: collection, audit, exit_code, output, in_scope."""
    bad = ~F.coalesce("in_scope", F.lit(True)) | (F.col("exit_code") != 0) | F.col("output").rlike(r"(?m)^FAIL")
    names = F.slice(F.array_sort(F.collect_list(F.when(F.coalesce(bad, F.lit(True)), F.col("audit")))), 1, show)
    n = F.count_if(F.coalesce(bad, F.lit(True)))
    return verdicts.groupBy("collection").agg((n == 0).alias("passed"), n.alias("failing"), F.array_join(names, "; ").alias("first"))


def fleet_exit(classes: DataFrame) -> DataFrame:
    """One row: 1 if any collection fails or is only scaffolded, else 0."""
    return classes.agg(F.coalesce(F.max(F.col("class").isin("FAIL", "SCAFFOLD-ONLY").cast("int")), F.lit(0)).alias("exit_code"))


# content metrics


def content_metrics(files: DataFrame) -> DataFrame:
    """Counts of the content elements of each chapter."""
    d = files.where(_named(r"^chapters/[^/]*\.tex$"))
    counts = {k: F.regexp_count(_text(), F.lit(p)) for k, p in fixed.CONTENT_COUNTS.items()}
    return d.select("collection", "rel_path", F.size(F.split(_text(), "\n")).alias("n_lines"), *(v.cast("long").alias(k) for k, v in counts.items()))


def content_lights(metrics: DataFrame, profiles: DataFrame) -> DataFrame:
    """Four lights and the worst of them per collection of profiles (collection, profile); an unknown profile is the default."""
    sums = metrics.groupBy("collection").agg(F.count("*").alias("chapters"), *(F.sum(k).alias(k) for k in fixed.CONTENT_COUNTS))
    d = profiles.join(sums, "collection", "left")
    value = lambda k: F.coalesce(*(F.when(F.col("profile") == p, F.lit(float(v[k]))) for p, v in fixed.CONTENT_PROFILES.items()), F.lit(float(fixed.CONTENT_PROFILES["default"][k])))

    def light(x: Column, good: Column, fair: Column) -> Column:
        return F.when(F.col("chapters").isNull(), 2).when(x >= good, 0).when(x >= fair, 1).otherwise(2)

    average = {k: F.col(k) / F.col("chapters") for k in ("margins", "keyconcepts")}
    lights = {
        "margin": light(average["margins"], value("margins"), value("margins") * 0.5),
        "keyconcept": light(average["keyconcepts"], value("keyconcepts"), F.lit(1.0)),
        "problem": light(F.col("problems"), value("problems"), value("problems") * 0.5),
        "vignette": light(F.col("vignettes"), value("vignettes"), F.lit(1.0)),
    }
    names = F.array(*(F.lit(x) for x in LIGHTS))
    out = d.select("collection", *(v.alias(k) for k, v in lights.items()))
    return out.select("collection", *(names[F.col(k)].alias(k) for k in lights), names[F.greatest(*lights)].alias("overall"))


def reference_classes(notes: DataFrame, labels: DataFrame, collections: DataFrame) -> DataFrame:
    r"""Notes (collection, note_id, note) as internal, external or unresolved, with their target and whether it is there.

    A note's \ref labels must all be defined in its collection; the first that isn't is the target.
    Without any, the first name of another collection (collections: collection) counts, then a volume,
    then a chapter or module that is spoken of.
    """
    d = notes.withColumn("refs", F.regexp_extract_all(F.coalesce("note", F.lit("")), F.lit(r"\\ref\{([^}]+)\}"), F.lit(1)))
    each = d.select("collection", "note_id", F.posexplode("refs").alias("pos", "label"))
    known = labels.select("collection", "label").distinct().withColumn("known", F.lit(True))
    bad = each.join(known, ["collection", "label"], "left").where("known is null").groupBy("collection", "note_id").agg(F.min_by("label", "pos").alias("bad"))
    word = d.select("collection", "note_id", F.posexplode(F.regexp_extract_all(F.coalesce("note", F.lit("")), F.lit(r"\b(\w+)\b"), F.lit(1))).alias("at", "name"))
    named = word.join(collections.select(F.col("collection").cast("string").alias("name")).distinct(), "name").where(F.col("name") != F.col("collection").cast("string"))
    named = named.groupBy("collection", "note_id").agg(F.min_by("name", "at").alias("other"))
    d = d.join(bad, ["collection", "note_id"], "left").join(named, ["collection", "note_id"], "left")
    volume = F.regexp_extract(F.coalesce("note", F.lit("")), fixed.VOLUME_REFERENCE, 0)
    inner = F.coalesce("note", F.lit("")).rlike(fixed.CHAPTER_REFERENCE)
    has = F.size("refs") > 0
    kind = F.when(has, "internal").when(F.col("other").isNotNull(), "external_collection").when(volume != "", "external_volume").when(inner, "internal").otherwise("unresolved")
    target = F.when(has, F.coalesce("bad", F.array_join("refs", ","))).when(F.col("other").isNotNull(), F.col("other")).when(volume != "", volume).otherwise(F.substring(F.coalesce("note", F.lit("")), 1, 60))
    return d.select("collection", "note_id", kind.alias("kind"), target.alias("target"), F.col("bad").isNull().alias("valid"))


def reference_tallies(classes: DataFrame) -> DataFrame:
    """Per collection and kind the notes and those whose target is missing."""
    return classes.groupBy("collection", "kind").agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("broken"))
