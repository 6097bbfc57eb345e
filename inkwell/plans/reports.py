"""Reports and generated files as tables: ordered lines, decks, bibliographies and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import text as tx
from inkwell.operators import identity
from inkwell.streaming.freshness import ORDER


def by_type_map(cards: DataFrame) -> DataFrame:
    """Per collection: total and a map from type to number, in the types' order."""
    n = cards.groupBy("collection", "type").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("type", "n")))
    return n.groupBy("collection").agg(F.sum("n").alias("total"), F.map_from_entries(entries).alias("by_type"))


def by_type_text(cards: DataFrame) -> DataFrame:
    """The same as one text, type=n parted by commas."""
    d = by_type_map(cards)
    return d.select("collection", "total", F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("by_type"))


def markdown_table(rows: DataFrame, columns: list[str], order: list[Column | str], by: str | None = None) -> DataFrame:
    """Rows as lines of a table, in order, with their number; per group if by is given, so no group is gathered."""
    w = Window.partitionBy(*([by] if by else [F.lit(1)])).orderBy(*order)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns)), F.lit(" |"))
    return rows.select(*([by] if by else []), F.row_number().over(w).alias("line_no"), line.alias("line"))


def notes(cards: DataFrame, namespace: str) -> DataFrame:
    """Deck notes: deck by the card's source, a stable guid, fields and tags without blanks."""
    deck = F.concat_ws("::", F.lit(namespace), F.coalesce(F.nullif(F.regexp_extract("collection", r"(\d+)$", 1), F.lit("")), F.lit("appendix")))
    return cards.select(deck.alias("deck"), identity.guid(F.concat_ws("_", F.lit(namespace), F.col("id"))).alias("guid"), "id", "type", "front", "back")


def status_order(c: Column | str = "status") -> Column:
    """Place of a status in the order of urgency; unknown ones last."""
    at = F.array_position(F.array(*(F.lit(s) for s in ORDER)), tx.col(c))
    return F.when(at > 0, at).otherwise(len(ORDER) + 1)


def capped(rows: DataFrame, order: list[Column | str], cap: int, by: str) -> DataFrame:
    """The first rows of each group and how many more there are."""
    w = Window.partitionBy(by)
    d = rows.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w))
    return d.where(F.col("rank") <= cap).withColumn("more", F.greatest(F.col("total") - cap, F.lit(0)))


def bibliography(entries: DataFrame) -> DataFrame:
    """Entries as text, to be ordered by key: type by url and venue, year, escaped title.

    entries: bibkey, title, url, venue, date. Prices and specials are escaped once; what is escaped stays.
    """
    title = F.regexp_replace("title", r"(?<!\\)([&%#_$])", r"\\$1")
    kind = F.when(F.col("url").rlike(r"arxiv\.org"), "article").when(F.col("venue").rlike(r"(?i)proceedings|conference|workshop"), "inproceedings").when(F.col("venue").rlike(r"(?i)journal|transactions"), "article").when(F.col("url").isNotNull(), "online").otherwise("misc")
    year = F.nullif(F.regexp_extract(F.concat_ws(" ", "date", "venue", "title"), r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    body = F.concat_ws(",\n  ", F.concat(F.lit("title = {"), title, F.lit("}")), F.concat(F.lit("year = {"), year, F.lit("}")), F.concat(F.lit("url = {"), F.col("url"), F.lit("}")))
    return entries.select("bibkey", kind.alias("kind"), year.alias("year"), F.concat(F.lit("@"), kind, F.lit("{"), F.col("bibkey"), F.lit(",\n  "), body, F.lit("\n}\n")).alias("entry"))


def append_snapshot(metrics: DataFrame, path: str) -> None:
    """Adds a snapshot to a history table; views keep the last ones of each metric."""
    metrics.write.mode("append").parquet(path)
