"""State of product pages and its changes.

parse() reads a page's fields and their signature; classify() compares it with the prior state, the
recorded slug and the capture date. One classification serves batch and stream: a stream calls it in
foreachBatch with the state table, so that a key's rows arrive in order and a repeated batch gives
the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import text as tx

SCHEMA = "page_state/2"
#: Statuses from the most to the least urgent.
ORDER = ("RENAMED", "UNRESOLVED", "ERROR", "PUBLISHED", "STALE", "STALE?", "BASELINE", "OK")


def signature(*fields: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *fields), 256), 1, 16)


def parse(pages: DataFrame, *keep: str) -> DataFrame:
    """began, last_updated_month, publication, isbn, n_pages, is_early, degraded and signature of each page (html)."""
    text = F.regexp_replace(F.regexp_replace("html", r"<[^>]+>", " "), r"\s+", " ")
    d = pages.withColumn("t_", text)
    field = {
        "began": r"began ([A-Z][a-z]+ \d{4})",
        "last_updated_month": r"Last updated ([A-Z][a-z]+ \d{4})",
        "publication": r"Publication in ([A-Za-z]+ \d{4})",
        "isbn": r"ISBN\s*(\d{13})",
        "n_pages": r"(\d+) pages",
    }
    d = d.withColumns({k: F.coalesce(F.regexp_extract("t_", p, 1), F.lit("")) for k, p in field.items()})
    d = d.withColumn("n_pages", F.when(F.col("n_pages") == "", "0").otherwise(F.col("n_pages")))
    sign = signature(*(F.col(c) for c in field))
    none = tx.all_of(*(F.col(c) == "" for c in ("began", "last_updated_month", "publication", "isbn"))) & (F.col("n_pages") == "0")
    return d.select(*keep, *field, (F.col("began") != "").alias("is_early"), none.alias("degraded"), sign.alias("signature"))


def final_slug(url: Column) -> Column:
    """Last part of the path, without query and fragment."""
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", ""), r"([^/]*)$", 1)


def classify(now: DataFrame) -> DataFrame:
    """Adds status. now: recorded_slug, live_slug, is_early, degraded, signature, last_updated_month, latest_chapter, captured,
    build_date and the prior state's prior_schema, prior_signature, prior_status, prior_month (all null without one).

    Staleness sticks: while the page's month is later than the capture's, or while there is no capture
    date to clear it, the row stays STALE. A prior state of another schema counts as none.
    """
    known = F.col("prior_schema") == SCHEMA
    prior = {c: F.when(known, F.col(f"prior_{c}")) for c in ("signature", "status", "month")}
    live = tx.month_iso("last_updated_month")
    build = F.nullif(F.concat_ws("-", F.nullif(F.regexp_extract(F.col("build_date"), r"^(\d{4})-(\d{1,2})", 1), F.lit("")), F.lpad(F.nullif(F.regexp_extract(F.col("build_date"), r"^(\d{4})-(\d{1,2})", 2), F.lit("")), 2, "0")), F.lit(""))
    status = (
        F.when(F.col("degraded"), "ERROR")
        .when(F.col("live_slug") != F.col("recorded_slug"), "RENAMED")
        .when(~F.col("is_early"), "PUBLISHED")
        .when(live > build, "STALE")
        .when(build.isNull() & (prior["status"] == "STALE") & prior["month"].eqNullSafe(F.col("last_updated_month")), "STALE")
        .when(prior["signature"].isNull() & (F.col("latest_chapter") > F.col("captured")), "STALE?")
        .when(prior["signature"].isNull(), "BASELINE")
        .when(prior["signature"] != F.col("signature"), "STALE")
        .otherwise("OK")
    )
    return now.withColumn("status", status)


def overlay(rows: DataFrame) -> DataFrame:
    """A newer live version or date makes a row STALE, but never takes the place of a status that asks for another action.

    rows: status, live_version, recorded_version, live_date, build_date.
    """
    newer = F.coalesce(F.col("live_version") > F.col("recorded_version"), F.lit(False)) | F.coalesce(F.col("live_date") > F.col("build_date"), F.lit(False))
    first = F.col("status").isin("RENAMED", "UNRESOLVED", "PUBLISHED")
    return rows.withColumn("status", F.when(newer & ~first, "STALE").otherwise(F.col("status")))


def changes(states: DataFrame, key: str, order: str) -> DataFrame:
    """Batch twin of the stream: every state against the key's one before. states: key, order, signature and month."""
    w = Window.partitionBy(key).orderBy(order)
    return states.withColumn("prior_signature", F.lag("signature").over(w)).withColumn(
        "status", F.when(F.col("prior_signature").isNull(), "BASELINE").when(F.col("prior_signature") != F.col("signature"), "STALE").otherwise("OK")
    )


def upserted(state: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The state table after a batch: the latest row of each key wins, of equally late ones the batch's."""
    both = state.withColumn("from_", F.lit(0)).unionByName(batch.withColumn("from_", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("from_"))
    return both.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_", "from_")


def stream_changes(pages: DataFrame, state_path: str, out_path: str, checkpoint: str, key: str = "key", order: str = "ts"):
    """Starts a stream over pages (key, ts, html) that appends each page's status to out_path and keeps the state in state_path.

    The state is written per batch under its number, so a batch that runs again reads the state
    before it and writes the same: results are exactly once.
    """
    spark = pages.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        from pyspark.errors import AnalysisException

        now = parse(batch, key, order)
        state = None
        for n in range(number - 1, -1, -1):
            try:
                state = spark.read.parquet(f"{state_path}/batch={n}")
                break
            except AnalysisException:
                continue
        kept = now.select(key, order, "signature", "last_updated_month")
        known = kept if state is None else state.select(*kept.columns).unionByName(kept)
        done = changes(known, key, order).join(now.select(key, order).distinct(), [key, order], "left_semi")
        done.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        (kept.limit(0) if state is None else state.select(*kept.columns)).transform(lambda s: upserted(s, kept, key, order)).write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
