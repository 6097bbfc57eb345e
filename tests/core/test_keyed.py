"""Keyed streaming state: equal to the batch, bounded, late rows left alone."""

from inkwell.streaming import freshness, keyed

PAGE = "Last updated {} 2026 ISBN 9781234567890"


def poll(spark, tmp_path, batches, **options):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for b in batches:
        spark.createDataFrame(b, "key string, ts int, html string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, ts int, html string").parquet(source)
        keyed.run_keyed(stream, out, checkpoint, **options).awaitTermination()
    return {(r["key"], r["ts"]): r["status"] for r in spark.read.parquet(out).collect()}


def test_keyed_stream_equals_batch(spark, tmp_path):
    batches = [[("a", 1, PAGE.format("April")), ("b", 1, PAGE.format("May")), ("b", 2, PAGE.format("May"))], [("a", 2, PAGE.format("April")), ("b", 4, PAGE.format("June"))], [("a", 3, PAGE.format("July"))]]
    streamed = poll(spark, tmp_path, batches)
    every = freshness.parse(spark.createDataFrame([r for b in batches for r in b], "key string, ts int, html string"), "key", "ts")
    assert streamed == {(r["key"], r["ts"]): r["status"] for r in freshness.changes(every, "key", "ts").collect()}
    assert streamed["b", 4] == "STALE" and streamed["a", 2] == "OK"


def test_late_unreadable_and_expired(spark, tmp_path):
    streamed = poll(spark, tmp_path, [[("a", 5, PAGE.format("April"))], [("a", 3, PAGE.format("May")), ("a", 6, None)], [("a", 7, PAGE.format("April"))]])
    assert streamed == {("a", 5): "BASELINE", ("a", 3): "LATE", ("a", 6): "ERROR", ("a", 7): "OK"}
    expired = poll(spark, tmp_path / "x", [[("a", 1, PAGE.format("April"))], [("a", 2, PAGE.format("May"))]], keep_ms=1)
    assert expired == {("a", 1): "BASELINE", ("a", 2): "BASELINE"}
