"""Referential integrity: references and labels, outcomes and items, registries and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fixed
from inkwell.functions import text as tx


def undefined(refs: DataFrame, labels: DataFrame, key: str = "label") -> DataFrame:
    """References whose label nothing defines."""
    return refs.join(labels.select(key).distinct(), key, "left_anti")


def duplicate_labels(labels: DataFrame, key: str = "label") -> DataFrame:
    """Labels defined more than once, with how often."""
    return labels.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def incoming(refs: DataFrame, labels: DataFrame, key: str = "label") -> DataFrame:
    """Every label with its references and the documents that hold them; 0 for orphans. Counted before the join."""
    n = refs.groupBy(key).agg(F.count("*").alias("n_refs"), F.count_distinct("doc").alias("n_docs"))
    return labels.select(key).distinct().join(n, key, "left").fillna(0, ["n_refs", "n_docs"])


def orphans(labels: DataFrame, refs: DataFrame, key: str = "label") -> DataFrame:
    """Labels that nothing refers to."""
    return labels.select(key).distinct().join(refs.select(key).distinct(), key, "left_anti")


def coverage(defined: DataFrame, tested: DataFrame, green: int = 80, yellow: int = 50) -> DataFrame:
    """Per collection: outcomes defined and tested, and a light by the tested share. Both tables: collection, los_id."""
    want = defined.select("collection", "los_id").distinct()
    have = tested.select("collection", "los_id").distinct().withColumn("hit", F.lit(1))
    d = want.join(have, ["collection", "los_id"], "left").groupBy("collection").agg(F.count("*").alias("n_defined"), F.count("hit").alias("n_tested"))
    share = F.col("n_tested") * 100
    return d.withColumn("status", F.when(share >= F.col("n_defined") * green, "GREEN").when(share >= F.col("n_defined") * yellow, "YELLOW").otherwise("RED"))


def untested(defined: DataFrame, tested: DataFrame) -> DataFrame:
    """Outcomes that no item tests."""
    return defined.select("collection", "los_id").distinct().join(tested.select("collection", "los_id").distinct(), ["collection", "los_id"], "left_anti")


def missing(registry: DataFrame, disk: DataFrame, key: str = "slug") -> DataFrame:
    """Registered but not on disk."""
    return registry.select(key).distinct().join(disk.select(key).distinct(), key, "left_anti")


def unregistered(registry: DataFrame, disk: DataFrame, key: str = "slug") -> DataFrame:
    """On disk and in the registry side by side; either side may be missing."""
    a = registry.select(key, F.lit(True).alias("registered")).distinct()
    b = disk.select(key, F.lit(True).alias("on_disk")).distinct()
    return a.join(b, key, "full").fillna(False, ["registered", "on_disk"])


def undefined_used(used: DataFrame, universe: DataFrame, defined: DataFrame) -> DataFrame:
    """Names used, of those that count at all, that nothing defines."""
    return used.intersect(universe).subtract(defined)


def include_status(includes: DataFrame, files: DataFrame) -> DataFrame:
    """Per document: a light for its includes. Missing or empty targets are red, none at all is yellow.

    includes: doc, target (null for a document without includes); files: target, kind (null for content,
    else stub or empty). The first three problems are listed and the rest counted.
    """
    d = includes.join(files.withColumn("there", F.lit(True)), "target", "left")
    problem = F.when(F.col("target").isNotNull() & F.col("there").isNull(), F.concat(F.lit("missing "), F.col("target"))).when(F.col("kind").isNotNull(), F.concat("kind", F.lit(" "), "target"))
    g = d.groupBy("doc").agg(F.count("target").alias("n_includes"), F.array_sort(F.collect_list(problem)).alias("problems"))
    text = F.concat_ws("; ", F.slice("problems", 1, 3), F.when(F.size("problems") > 3, F.concat(F.lit("(+"), (F.size("problems") - 3).cast("string"), F.lit(" more)"))))
    return g.select("doc", "n_includes", F.when(F.size("problems") > 0, "RED").when(F.col("n_includes") == 0, "YELLOW").otherwise("GREEN").alias("status"), text.alias("detail"))


#: Sizes of the windows that lines are indexed by; a needle is looked up by its beginning of the largest size that it has.
WINDOWS = (24, 8, 3, 1)


def first_lines_with(lines: DataFrame, needles: DataFrame) -> DataFrame:
    """id and line_no of the first line of its document that contains a needle; needles that no line contains have no row.

    lines: source, line_no, line. needles: id, source, needle (not empty). An inverted index of the lines' windows
    is joined with the needles' beginnings, then the hits are checked against the lines, so that no needle
    meets lines that don't hold its beginning. Equal lines and equal needles of a document are one each, and the joins aren't
    left to the sizes of files: an index is far larger than what it is made of, too large for the driver.
    """
    sized = F.coalesce(*(F.when(F.length("needle") >= w, F.substring("needle", 1, w)) for w in WINDOWS))
    wanted = needles.select("source", "needle").distinct().select("source", "needle", sized.alias("window"))
    lines = lines.groupBy("source", "line").agg(F.min("line_no").alias("line_no"))

    def windows(w: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length("line") - (w - 1), F.lit(1)))
        return F.when(F.length("line") >= w, F.transform(places, lambda p: F.substr(F.col("line"), p, F.lit(w)))).otherwise(F.array().cast("array<string>"))

    index = lines.select("source", "line_no", F.explode(F.array_distinct(F.concat(*(windows(w) for w in WINDOWS)))).alias("window"))
    hits = index.hint("merge").join(wanted, ["source", "window"]).select("source", "line_no", "needle")
    hits = hits.hint("merge").join(lines, ["source", "line_no"]).where(F.contains("line", "needle"))
    first = hits.groupBy("source", "needle").agg(F.min("line_no").alias("line_no"))
    return needles.hint("merge").join(first, ["source", "needle"]).groupBy("id").agg(F.min("line_no").alias("line_no"))


def source_lines(findings: DataFrame, lines: DataFrame, shown: int = 120) -> DataFrame:
    """id, line_no and excerpt of where a finding's card stands in its source; 0 and empty if nowhere.

    findings: id, source, card_id, front. The first line with the front's first 30 characters and a card's macro
    counts, else the first that has the last part of the card's id, case and underscores apart.
    """
    front = tx.strip(F.substring(F.coalesce("front", F.lit("")), 1, 30))
    macro = tx.any_of(*(F.contains("line", F.lit("\\" + m)) for m in fixed.CARD_MACROS))
    by_front = first_lines_with(lines.where(macro), findings.select("id", "source", front.alias("needle")).where("needle <> ''"))
    tail = F.when(F.contains("card_id", F.lit("-")), F.lower(F.replace(F.substring_index("card_id", "-", -1), F.lit("_"), F.lit(" ")))).otherwise("")
    rest = findings.hint("merge").join(by_front.select("id"), "id", "left_anti").select("id", "source", tail.alias("needle")).where("needle <> ''")
    by_tail = first_lines_with(lines.withColumn("line", F.lower("line")), rest)
    found = findings.select("id", "source").hint("merge").join(by_front.unionByName(by_tail), "id", "left")
    out = found.hint("merge").join(lines.select("source", "line_no", F.substring(tx.strip("line"), 1, shown).alias("excerpt")), ["source", "line_no"], "left")
    return out.select("id", F.coalesce("line_no", F.lit(0)).cast("long").alias("line_no"), F.coalesce("excerpt", F.lit("")).alias("excerpt"))
