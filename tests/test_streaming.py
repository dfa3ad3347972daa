"""Streams of files, run to their end."""

from __future__ import annotations

from lodestrata.operators.evaluation import threshold_metrics
from lodestrata.streaming.dedup import first_occurrences, windowed_confusion


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_first_occurrences(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a"), ("2024-01-01 00:01:00", "b"), ("2024-01-01 00:02:00", "a")]
    spark.createDataFrame(rows, "ts string, text string").selectExpr("cast(ts as timestamp) ts", "text").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "s"))
    assert sorted(r.text for r in run(spark, first_occurrences(stream, "text", "ts", "1 hour"), "firsts").collect()) == ["a", "b"]


def test_windowed_confusion(spark, tmp_path):
    rows = [(f"2024-01-{1 + k % 3:02d} 10:00:00", (k * 7 % 10) / 10, k % 2) for k in range(60)]
    batch = spark.createDataFrame(rows, "ts string, score double, label int").selectExpr("cast(ts as timestamp) ts", "score", "label")
    batch.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "s"))
    got = {r.start.day: (r.tp, r.fp, r.tn) for r in run(spark, windowed_confusion(stream, "ts", "1 day", "1 hour", 0.5), "confusions", "complete").collect()}
    want = {r.day: (r.tp, r.fp, r.tn) for r in threshold_metrics(batch.selectExpr("day(ts) as day", "score", "label"), "score", "label", 0.5, ["day"]).collect()}
    assert got == want
