"""Joins of attributes, series and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.functions.numeric import floor_window

def attach(rows: DataFrame, attributes: DataFrame, keys: list[str]) -> DataFrame:
    """N:1 join of attributes; Spark broadcasts them if their size in bytes allows it, at run time too."""
    return rows.join(attributes, keys, "left")


def not_unique(attributes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that an N:1 join would multiply."""
    return attributes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def series_onto(steps: DataFrame, series: DataFrame, field: str, step: str) -> DataFrame:
    """Values of per-field series at each pixel's steps."""
    return steps.join(series, [field, step], "left")


def cell_windows(fields: DataFrame, cells: DataFrame, cell: str, origin: str, start: int, width: int, n: int, aggregates: list[Column]) -> DataFrame:
    """Windows of cell series counted from each field's own origin date: an equi join on the cell, then arithmetic."""
    day = F.datediff("date", F.col(origin))
    d = fields.join(cells, cell).withColumn("k", floor_window(day, start, width)).where((F.col("k") >= 0) & (F.col("k") < n))
    return d.groupBy("field", "k").agg(F.count("*").alias("n_days"), *aggregates)


def reference_results(results: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """Published numbers beside one's own, NULL where there are none."""
    return results.join(published, keys, "left")


def checked(rows: DataFrame, means: DataFrame, keys: list[str], n_rows: str, n_means: str, value: str) -> DataFrame:
    """A group's mean only where it was made from as many members as the row says."""
    j = rows.join(means.select(*keys, F.col(n_means).alias("_n"), F.col(value).alias("_v")), keys, "left")
    return j.withColumn(value, F.when(F.col(n_rows) == F.col("_n"), F.col("_v"))).drop("_n", "_v")


def origin_tag(rows: DataFrame, others: dict[str, DataFrame], key: str, none: str) -> DataFrame:
    """Adds `origin`: the first other table that has the row's key, else `none`."""
    tag = None
    for name, df in others.items():
        rows = rows.join(df.select(F.col(key).alias(f"_{name}")).distinct(), F.col(key) == F.col(f"_{name}"), "left")
        hit = F.col(f"_{name}").isNotNull()
        tag = F.when(hit, F.lit(name)) if tag is None else tag.when(hit, F.lit(name))
    return rows.withColumn("origin", tag.otherwise(F.lit(none))).drop(*[f"_{n}" for n in others])
