"""Plain tables seen as collections, cards, lines, items, terms, turns and marked-up texts.

Each view is a narrow projection, so that filters and column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Card types in turn.
TYPES = ("term", "keyconcept", "problem", "vignette", "drill", "formula", "comparison", "checkpoint", "cloze")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cards: collection, ord, id, type, front, back, los_id."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("L-"), F.col("quality").cast("string")).alias("los_id"))
    types = F.array(*(F.lit(t) for t in TYPES))
    view = docs.select(
        F.col("source").alias("collection"),
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("C-"), (F.col("doc_id") % 700).cast("string")).alias("id"),
        F.element_at(types, (F.col("doc_id") % len(TYPES) + 1).cast("int")).alias("type"),
        F.split("text", "\n", 2)[0].alias("front"),
        F.col("text").alias("back"),
    )
    return view.join(labels.withColumnRenamed("doc_id", "ord"), "ord", "left")


def marked(k: Column, text: Column, front: Column) -> Column:
    """A back by pattern k % 14: the text itself, or a defect that the rules look for."""
    made = {
        0: text, 1: F.lit(""), 2: F.lit("...   ;;;"), 3: F.lit("TODO: fill in"), 4: front, 5: F.lit("Cut off here..."),
        6: F.lit("**Approach:** think.\n**Answer:** See solution above."), 7: F.lit("see Chapter 3."), 8: F.concat(F.lit("<b>Note</b> "), text),
        9: F.concat(F.lit("**Core Insight:** "), text, F.lit("\n**Why It Matters:** "), front),
        10: F.lit("Self-check from: Module 1 Checkpoint\n\n(Answer from memory, then verify against the chapter text.)"),
        11: F.concat(text, F.lit("?")), 12: F.concat(F.lit("```python\n"), front, F.lit("\n```")),
        13: F.concat(F.lit("**Step 1:** a 1. Bee 2. Cee (a) x - Dee; e; f\n**Key Insight:** "), text, F.lit("\n**Answer:** "), front),
    }
    out = F.when(k == 0, made[0])
    for i in range(1, 14):
        out = out.when(k == i, made[i])
    return out


def marked_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards whose backs hold the defects that the rule packs look for."""
    return cards(spark, sf_dir).withColumn("back", marked((F.col("ord") % 14).cast("int"), F.col("back"), F.col("front")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: collection, ord, line_no from 1, line."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("collection"), F.col("doc_id").alias("ord"), F.posexplode(F.split("text", "\n")).alias("p", "line")).select("collection", "ord", (F.col("p") + 1).alias("line_no"), "line")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three or more words as definitions: the first word names the term."""
    some = lines(spark, sf_dir).withColumn("w", F.split("line", " ", 2)).where(F.size("w") == 2)
    return some.select("collection", "ord", "line_no", F.lower(F.regexp_replace(F.col("w")[0], "[^A-Za-z]", "")).alias("name"), F.col("w")[1].alias("definition")).where("name <> ''")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns."""
    return table(spark, sf_dir, "conversations")


def daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and day as metric snapshots: metric, day, value."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), F.to_date("ts").alias("day")).agg(F.count("*").alias("value"))


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One marked-up text per order, made of its lines: outcomes, terms, problems with solutions, references and notes.

    Lines are brought together as they are; the texts, several times as large, are made behind the shuffle.
    """
    items = table(spark, sf_dir, "lineitem")

    def element(line: Column) -> Column:
        number = line["l_linenumber"]
        n, k = number.cast("string"), line["l_partkey"].cast("string")
        return (
            F.when(number % 4 == 0, F.concat(F.lit("\\begin{problem}[P"), k, F.lit("][L-"), n, F.lit("]\nFind "), k, F.lit("?\n\\end{problem}\n\\begin{solution}\nIt is "), n, F.lit(".\n\\end{solution}\n")))
            .when(number % 4 == 1, F.concat(F.lit("\\los{L-"), n, F.lit("}{Explain}{the \\textbf{part} "), k, F.lit("} % note\n")))
            .when(number % 4 == 2, F.concat(F.lit("\\term[L-"), n, F.lit("]{Part "), k, F.lit("}{A part with flag {"), line["l_returnflag"], F.lit("}} see \\ref{p:"), k, F.lit("}\n")))
            .otherwise(F.concat(F.lit("% \\label{dead}\n\\label{p:"), k, F.lit("}\\patternmargin{Key pattern from "), k, F.lit("}\n")))
        )

    whole = items.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")).alias("lines"))
    # lines of one number stand in the order of their texts
    elements = F.sort_array(F.transform("lines", lambda line: F.struct(line["l_linenumber"].alias("n"), element(line).alias("t"))))
    return whole.select(F.col("l_orderkey").alias("doc"), F.array_join(F.transform(elements, lambda e: e["t"]), "").alias("text"))


def by_day(metrics: DataFrame) -> Window:
    return Window.partitionBy("metric").orderBy("day")
