"""Collections on disk: discovery, roles, readable texts and card files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that never hold collections.
EXCLUDED = ("archive", "archived", "reports", "templates", "node_modules", "build", "_scratch", "tooling")
MARKER = "guide_qa.yaml"


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below root: path relative to it, length and content, read lazily."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    plain = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    return files.select(F.substring(plain, F.length(F.lit(root.rstrip("/"))) + 2, 1_000_000).alias("rel_path"), "length", "content")


def discovered(files: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """Folders that hold the marker file: slug, folder and topic, one per slug.

    files: rel_path. topics: slug and topic of the registry, or None without one. Excluded and hidden
    folders are skipped at any depth; a nested folder counts only under its own registered topic, a
    flat one always. Two folders of one name are an error.
    """
    parts = F.split("rel_path", "/")
    d = files.where((F.col("rel_path") == MARKER) | F.endswith("rel_path", F.lit("/" + MARKER))).withColumn("parts", F.slice(parts, 1, F.size(parts) - 1)).where(F.size("parts") > 0)
    d = d.where(~F.exists("parts", lambda p: p.isin(*EXCLUDED) | F.startswith(p, F.lit("."))))
    d = d.select(F.element_at("parts", -1).alias("slug"), F.array_join("parts", "/").alias("folder"), F.when(F.size("parts") > 1, F.col("parts")[0]).alias("topic")).distinct()
    if topics is not None:
        known = topics.select("slug", F.col("topic").alias("registered"))
        d = d.join(F.broadcast(known), "slug", "left").where(F.col("topic").isNull() | (F.col("topic") == F.col("registered"))).drop("registered")
    counted = d.groupBy("slug").agg(F.count("*").alias("n"), F.min("folder").alias("folder"), F.min("topic").alias("topic"))
    checked = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two collections are named "), F.col("slug")))).otherwise(F.col("folder"))
    return counted.select("slug", checked.alias("folder"), "topic")


def role(path: Column) -> Column:
    """What a file of a collection is."""
    return (
        F.when(path.rlike(r"(^|/)chapters/[^/]+\.tex$"), "chapter")
        .when(path.rlike(r"(^|/)appendices/[^/]+\.tex$"), "appendix")
        .when(path.rlike(r"(^|/)cards/all_cards\.(yml|json)$"), "cards_all")
        .when(path.rlike(r"(^|/)cards/[^/]+\.(yml|json)$"), "cards")
        .when(path.rlike(r"(^|/)review/dashboard\.md$"), "dashboard")
        .when(path.rlike(r"(^|/)review/source_manifest\.md$"), "manifest")
        .when(path.rlike(r"(^|/)main\.tex$"), "main")
        .when(path.rlike(rf"(^|/){MARKER}$"), "config")
    )


def texts(files: DataFrame) -> DataFrame:
    """rel_path, role, stem, text, readable and error. A file that is no UTF-8 stays, unreadable, so that it becomes a finding."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    stem = F.regexp_extract("rel_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    d = files.select("rel_path", role(F.col("rel_path")).alias("role"), stem.alias("stem"), text.alias("text"))
    return d.withColumn("readable", F.col("text").isNotNull()).withColumn("error", F.when(F.col("text").isNull(), "not UTF-8"))


def unreadable_findings(documents: DataFrame) -> DataFrame:
    """A finding for every unreadable file."""
    return documents.where("not readable").select(F.lit("unreadable").alias("rule"), F.lit("critical").alias("severity"), "rel_path", F.col("error").alias("detail"))


CARD = "struct<type:string,id:string,front:string,back:string,los_id:string,source:string,tags:array<string>,scaffolding_level:string,difficulty:string>"


def card_rows(documents: DataFrame) -> DataFrame:
    """Cards of JSON card files: a list of cards, or an object with such a list; empty files have none.

    A malformed or otherwise shaped file gives one row with its error and no card: never no row.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    whole = F.from_json(text, f"struct<cards:array<{CARD}>>")
    bare = F.from_json(text, f"array<{CARD}>")
    found = F.when(text == "", F.array().cast(f"array<{CARD}>")).when(F.startswith(text, F.lit("[")), bare).when(F.startswith(text, F.lit("{")), whole["cards"])
    d = documents.where(F.col("role").isin("cards", "cards_all")).withColumn("found", found)
    error = F.when(F.col("found").isNull(), "no list of cards")
    return d.select("rel_path", error.alias("error"), F.posexplode_outer("found").alias("ord", "card")).select("rel_path", "ord", "card.*", "error").where("error is not null or ord is not null")


def preferred_card_files(documents: DataFrame) -> DataFrame:
    """Per folder the chapters' card files, or the combined one where there are none."""
    from pyspark.sql.window import Window

    d = documents.where(F.col("role").isin("cards", "cards_all")).withColumn("folder", F.regexp_extract("rel_path", r"^(.*?)/?[^/]+$", 1))
    single = F.max((F.col("role") == "cards").cast("int")).over(Window.partitionBy("folder"))
    return d.withColumn("single", single).where((F.col("role") == "cards") | (F.col("single") == 0)).drop("single")


def expanded(documents: DataFrame, depth: int = 5) -> DataFrame:
    r"""text with the texts of \input files appended, level by level up to depth; a file in a cycle is appended once a level."""
    out = documents.select("rel_path", "text", F.col("text").alias("added"))
    files = documents.select(F.regexp_replace("rel_path", r"\.tex$", "").alias("target"), F.col("text").alias("included"))
    for _ in range(depth):
        asked = out.select("rel_path", F.explode(F.regexp_extract_all(F.col("added"), F.lit(r"\\input\{([^}]*)\}"), F.lit(1))).alias("t"))
        asked = asked.select("rel_path", F.regexp_replace("t", r"\.tex$", "").alias("target")).distinct()
        more = asked.join(files, "target").groupBy("rel_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("target", "included"))), lambda s: s["included"]), "\n").alias("more"))
        out = out.join(more, "rel_path", "left").select("rel_path", F.concat_ws("\n", "text", "more").alias("text"), F.coalesce("more", F.lit("")).alias("added"))
    return out.select("rel_path", "text")


def resolve(registry: DataFrame, queries: DataFrame) -> DataFrame:
    """Slug for each query: equal, else contained in a slug, else in a title; the first row of the registry within each."""
    q = F.lower(F.col("query"))
    rank = F.when(F.lower("slug") == q, 0).when(F.contains(F.lower("slug"), q), 1).when(F.contains(F.lower("title"), q), 2)
    hits = queries.join(F.broadcast(registry), rank.isNotNull())
    return hits.groupBy("query").agg(F.min_by("slug", F.struct(rank, "ord")).alias("slug"))
