"""The hourly-to-daily resample over a stream of readings, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def daily_stream(readings: DataFrame, keys: list[str], ts: str, value: str, late: str = "2 days") -> DataFrame:
    """Mean, highest, lowest, sum and number of readings per key and day of a streaming table.

    A day is final once readings `late` newer have come; later ones for it are dropped by Spark's watermark. On a batch
    table the result is that of `timeaxis.daily`.
    """
    v = F.col(value)
    day = F.window(ts, "1 day")
    stamped = readings.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks need a time zone
    out = stamped.withWatermark(ts, late).groupBy(*keys, day.alias("day")).agg(F.avg(v).alias("mean"), F.max(v).alias("high"), F.min(v).alias("low"), F.sum(v).alias("total"), F.count("*").alias("n"))
    return out.select(*keys, F.to_date("day.start").alias("date"), "mean", "high", "low", "total", "n")
