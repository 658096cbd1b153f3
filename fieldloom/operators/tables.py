"""Set operations, pivots, codes and report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.session import checkpoint_dir


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds consecutive numbers from 0 by a full order of the rows.

    Rows are ranged into partitions; each numbers its own and adds how many lie before, so no task sees all rows.
    """
    checkpoint_dir(df.sparkSession)
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).checkpoint()
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_r", own).join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_r") - 1).drop("_p", "_r", "_b")


def running_sums(df: DataFrame, by: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """Adds the sum of `amount` over the rows before, in a full order of each group's rows.

    Rows are ranged by group and order into partitions; each sums its own part of a group and adds the parts before, so no
    task sees a whole group. The sums of parts are a row a partition and group.
    """
    checkpoint_dir(df.sparkSession)
    parts = df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*by, "_part").agg(F.sum(amount).alias("_part_sum")).withColumn("_part_before", F.coalesce(F.sum("_part_sum").over(before), F.lit(0)))
    keyed = sums.select(F.col("_part").alias("_part_of"), *[F.col(c).alias(f"_part_key{i}") for i, c in enumerate(by)], "_part_before")
    own = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumn("_own_before", F.coalesce(F.sum(amount).over(own), F.lit(0)))
    same = F.col("_part") == F.col("_part_of")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_part_key{i}"))
    return summed.join(keyed, same).select(*df.columns, (F.col("_part_before") + F.col("_own_before")).alias(name))


def integer_codes(df: DataFrame, key: str, code: str = "code") -> DataFrame:
    """(key, code): consecutive numbers of the distinct keys in key order."""
    return numbered(df.select(key).where(F.col(key).isNotNull()).distinct(), [key], code)


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not among the new ones, and the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, columns): rows that only one side has."""
    left, right = a.subtract(b).withColumn("side", F.lit("left")), b.subtract(a).withColumn("side", F.lit("right"))
    return left.unionByName(right)


def in_every(sets: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.intersect(y), sets)


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a full order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def best_rows(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """All rows that share the best value of their group."""
    return df.withColumn("_r", F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last()))).where(F.col("_r") == 1).drop("_r")


def wide_with_deltas(long: DataFrame, row: str, column: str, values: list[str], value: str, base: str) -> DataFrame:
    """A column for each value of `column`, differences to the base, and a last row with medians."""
    wide = long.groupBy(F.col(row).cast("string").alias(row)).pivot(column, values).agg(F.avg(value))
    full = wide.unionByName(wide.agg(F.lit("median").alias(row), *[F.median(F.col(f"`{v}`")).alias(v) for v in values]))
    return full.select(row, *values, *[(F.col(f"`{v}`") - F.col(f"`{base}`")).alias(f"d_{v}") for v in values if v != base])


def ranked_order(df: DataFrame, column: str, order: list[str]) -> Column:
    """Place of a value in a given order; others come last."""
    out = F.lit(len(order))
    for k, v in reversed(list(enumerate(order))):
        out = F.when(F.col(column) == v, F.lit(k)).otherwise(out)
    return out


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of the listed values, with a total column and a total row that count all rows, listed or not."""
    counts = [F.count_if(F.col(column) == v).alias(f"y{v}") for v in values]
    own = df.groupBy(F.col(row).cast("string").alias(row)).agg(*counts, F.count("*").alias("total"))
    return own.unionByName(own.agg(F.lit("total").alias(row), *[F.sum(c).alias(c) for c in own.columns[1:]]))


def cell_differences(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, column): cells that differ between two builds, rows of one side included."""
    x = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("_a"))
    y = b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("_b"))
    j = x.join(y, keys, "full_outer")
    lone = F.col("_a").isNull() | F.col("_b").isNull()
    cells = F.array(*[F.struct(F.lit(v).alias("column"), (lone | ~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}"))).alias("differs")) for v in values])
    return j.select(*keys, F.explode(cells).alias("c")).where("c.differs").select(*keys, "c.column")


def attributed(rows: DataFrame, reference: DataFrame, window: list[str], pixel: list[str], source: str, values: list[str]) -> DataFrame:
    """(window, source): sources that give a window of the reference: the same pixels, no more and no fewer, with the same
    values. Several sources may; a window without one has no row. Both sides are counted, and the pixels that agree."""
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"_r_{v}").eqNullSafe(F.col(v))
    own = reference.select(*window, *pixel, *[F.col(v).alias(f"_r_{v}") for v in values])
    agree = rows.join(own, [*window, *pixel]).where(same).groupBy(*window, source).agg(F.count("*").alias("_agree"))
    there = rows.groupBy(*window, source).agg(F.count("*").alias("_there"))
    wanted = reference.groupBy(*window).agg(F.count("*").alias("_wanted"))
    return agree.join(there, [*window, source]).join(wanted, window).where("_agree = _there and _agree = _wanted").select(*window, source)


def empty_windows(rows: DataFrame, reference: DataFrame, window: list[str], source: str) -> DataFrame:
    """(window, n_sources): windows that have no row in the reference although sources lie in them."""
    seen = rows.groupBy(*window).agg(F.count_distinct(source).alias("n_sources"))
    return seen.join(reference.select(*window).distinct(), window, "left_anti")


def build_report(a: DataFrame, b: DataFrame, field: str, pixel: list[str], window: str, values: list[str], first_window: int, allowed: int = 0) -> DataFrame:
    """Per field: pixels that differ between a build and its reference from the first window on, the windows in which they do,
    pixels for which the reference has values in windows before, and whether the build passes as a whole: at most `allowed`
    pixels differ and none has early values. Fields without a difference have no row; rows without any value are absent ones."""
    some = F.coalesce(*[F.col(v) for v in values]).isNotNull()
    early = b.where(some & (F.col(window) < first_window)).select(field, *pixel).distinct()
    late = lambda d: d.where(some & (F.col(window) >= first_window))
    cells = cell_differences(late(a), late(b), [field, *pixel, window], values).select(field, *pixel, window).distinct()
    both = cells.withColumn("_e", F.lit(0)).unionByName(early.select(field, *pixel, F.lit(None).cast(dict(b.dtypes)[window]).alias(window), F.lit(1).alias("_e")))
    key = F.struct(*pixel)
    per = both.groupBy(field).agg(F.count_distinct(F.when(F.col("_e") == 0, key)).alias("n_pixels"), F.array_sort(F.collect_set(window)).alias("windows"), F.count_distinct(F.when(F.col("_e") == 1, key)).alias("n_early"))
    total = per.agg(F.coalesce(F.sum("n_pixels"), F.lit(0)).alias("_n"), F.coalesce(F.sum("n_early"), F.lit(0)).alias("_x"))
    return per.crossJoin(F.broadcast(total)).select(field, "n_pixels", "windows", "n_early", ((F.col("_n") <= allowed) & (F.col("_x") == 0)).alias("passes"))  # one row
