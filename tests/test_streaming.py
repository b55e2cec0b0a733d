from __future__ import annotations

from quillon.streaming import windows


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "lab", f"2024-01-0{1 + k % 3} 0{k % 9}:00:00", float(k)) for k in range(30)] + [(2, None, "2024-01-01 00:00:00", 1.0), (2, "hr", None, 1.0), (2, "hr", "2024-01-05 00:00:00", None)]
    df = spark.createDataFrame(rows, "stay_id long, token string, t string, value double").selectExpr("stay_id", "token", "cast(t as timestamp) as ts", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = windows.token_counts(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    out = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {tuple(r) for r in windows.token_counts(df).collect()}
    assert out <= batch and len(out) == 3 and len(batch) == 4
