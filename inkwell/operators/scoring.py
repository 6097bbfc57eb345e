"""Lights, trends, gates and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import fixed
from inkwell.functions import text as tx


def light(value: Column, target: Column, yellow: Column, inverted: Column) -> Column:
    """GREEN at the target, YELLOW at the second threshold, else RED; inverted: less is better. No value is RED."""
    up = F.when(value >= target, "GREEN").when(value >= yellow, "YELLOW")
    down = F.when(value <= target, "GREEN").when(value <= yellow, "YELLOW")
    return F.coalesce(F.when(inverted, down).otherwise(up), F.lit("RED"))


def trend(value: Column, before: Column) -> Column:
    return F.when(before.isNull() | value.isNull(), "new").when(value > before, "up").when(value < before, "down").otherwise("stable")


def metric_trends(metrics: DataFrame) -> DataFrame:
    """metric, day, value and its trend against the snapshot before."""
    w = Window.partitionBy("metric").orderBy("day")
    return metrics.withColumn("trend", trend(F.col("value"), F.lag("value").over(w)))


def latest(metrics: DataFrame, keep: int = 50) -> DataFrame:
    """The last snapshots of each metric."""
    w = Window.partitionBy("metric").orderBy(F.desc("day"))
    return metrics.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= keep).drop("rn_")


def card_quality(cards: DataFrame) -> DataFrame:
    """Per collection: cards by length of their backs, broken markup, outcomes, average lengths, share of terms and a verdict.

    Averages and shares are unrounded; the verdict counts points for each of five targets.
    """
    back, front = F.coalesce("back", F.lit("")), F.coalesce("front", F.lit(""))
    n = F.length(back)
    broken = tx.any_of(*(back.rlike(p) for p in fixed.BROKEN_MARKUP))
    d = cards.groupBy("collection").agg(
        F.count("*").alias("n_cards"),
        F.count_if((n < fixed.THIN) & (F.col("type") != "los")).alias("n_thin"),
        F.count_if((n >= fixed.THIN) & (n < fixed.MODERATE)).alias("n_moderate"),
        F.count_if(n >= fixed.MODERATE).alias("n_rich"),
        F.count_if(broken).alias("n_broken"),
        F.count("los_id").alias("n_with_los"),
        F.sum(F.length(front)).alias("front_chars"),
        F.sum(n).alias("back_chars"),
        F.count_if(F.col("type") == "term").alias("n_terms"),
        (F.count("*") - F.count_distinct("id")).alias("n_duplicate_ids"),
    )
    points = (
        (F.col("n_thin") * 100 <= F.col("n_cards") * 5).cast("int")
        + (F.col("n_broken") == 0).cast("int")
        + (F.col("n_with_los") * 100 >= F.col("n_cards") * 30).cast("int")
        + (F.col("n_terms") * 100 < F.col("n_cards") * 60).cast("int")
        + (F.col("n_rich") * 2 >= F.col("n_cards")).cast("int")
    )
    return d.withColumn("points", points).withColumn("verdict", F.when(F.col("points") >= 4, "PASS").when(F.col("points") >= 3, "WARN").otherwise("FAIL"))


def density(notes: DataFrame) -> DataFrame:
    """Per collection: a light for how many documents have too few notes for their kind. notes: collection, ord, kind, n."""
    least = F.when(F.col("kind") == "code-heavy", fixed.DENSITY_LEAST["code-heavy"]).otherwise(fixed.DENSITY_LEAST["theory"])
    d = notes.groupBy("collection").agg(F.count("*").alias("n_docs"), F.count_if(F.col("n") < least).alias("n_below"))
    share = F.col("n_below") * 100
    return d.withColumn("status", F.when(share <= F.col("n_docs") * 15, "GREEN").when(share <= F.col("n_docs") * 40, "YELLOW").otherwise("RED"))


def exit_codes(checks: DataFrame) -> DataFrame:
    """Per collection: 1 if a blocking check failed, 2 if another did, else 0. checks: collection, blocking, passed."""
    failed = ~F.coalesce("passed", F.lit(False))
    return checks.groupBy("collection").agg(F.when(F.bool_or(failed & F.col("blocking")), 1).when(F.bool_or(failed), 2).otherwise(0).alias("exit_code"))


def gate_class(gates: DataFrame, fidelity: str = "G5") -> DataFrame:
    """Per collection: PASS, GOLD-ELIGIBLE (only the fidelity gate is open, for want of its document), SCAFFOLD-ONLY or FAIL.

    gates: collection, gate, passed, reason.
    """
    mine = F.startswith("gate", F.lit(fidelity))
    d = gates.groupBy("collection").agg(F.bool_and("passed").alias("all_"), F.bool_and(F.col("passed") | mine).alias("others"), F.max(F.when(mine, F.col("reason"))).alias("reason"))
    c = F.when(F.col("all_"), "PASS").when(F.col("others") & (F.col("reason") == "missing"), "GOLD-ELIGIBLE").when(F.col("others"), "SCAFFOLD-ONLY").otherwise("FAIL")
    return d.select("collection", c.alias("class"))


def gate_pivot(gates: DataFrame, names: list[str]) -> DataFrame:
    """One row per collection with a column per gate: pass, fail, or a dash where it wasn't evaluated."""
    p = gates.groupBy("collection").pivot("gate", names).agg(F.first(F.when(F.col("passed"), "pass").otherwise("fail")))
    return p.select("collection", *(F.coalesce(F.col(g), F.lit("—")).alias(g) for g in names))


def first_failing(gates: DataFrame) -> DataFrame:
    """Per collection the first gate that failed; none for those that pass."""
    return gates.groupBy("collection").agg(F.min(F.when(~F.col("passed"), F.col("gate"))).alias("first_failing"))


def crossref_floor(n: Column) -> tuple[Column, Column]:
    """References and files asked of a collection of n documents."""
    refs = F.when(n >= 10, 6).otherwise(F.greatest(F.lit(2), F.least(F.lit(4), F.floor(n / 4).cast("int"))))
    files = F.when(n >= 10, 4).otherwise(F.greatest(F.lit(2), F.least(F.lit(3), F.floor(n / 3).cast("int"))))
    return refs, files


def bronze(checks: DataFrame) -> DataFrame:
    """Per collection: checks by light. checks: collection, check, status."""
    return checks.groupBy("collection").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("GREEN", "YELLOW", "RED")))


def worst_first(scores: DataFrame, top: int) -> DataFrame:
    """The collections with the most red, then yellow checks: a ranked worklist."""
    return scores.orderBy(F.desc("n_red"), F.desc("n_yellow"), "collection").limit(top)


def worst_per_group(rows: DataFrame, by: str, order: list[Column], top: int) -> DataFrame:
    """The first rows of each group in order, with their rank."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def shares(rows: DataFrame, by: str, level: str) -> DataFrame:
    """Histogram of level within by, with the group's total."""
    d = rows.groupBy(by, level).agg(F.count("*").alias("n"))
    return d.withColumn("total", F.sum("n").over(Window.partitionBy(by)))
