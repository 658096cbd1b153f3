from pyspark.sql import functions as F

from fieldloom.operators.timeaxis import daily
from fieldloom.streaming.daily import daily_stream


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = daily_stream(stream, ["event_type"], "ts", "value", "60 days").writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    near = lambda df: sorted((r.event_type, r.date, round(r["mean"], 6), r.high, r.low, round(r.total, 6), r.n) for r in df.collect())
    want = near(daily(events, ["event_type"], "ts", "value"))
    assert near(spark.table("days")) == want
    assert near(daily_stream(events, ["event_type"], "ts", "value")) == want
