"""Samples and augmentations whose randomness is a hash of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.functions.numeric import hash_rank, hash_unit, normal


def per_group(df: DataFrame, group: list[str], keys: list[str], k: int, seed: int) -> DataFrame:
    """At most k rows of each group."""
    w = Window.partitionBy(*group).orderBy(hash_rank(seed, *keys), *keys)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def fraction(df: DataFrame, keys: list[str], p: float, seed: int) -> DataFrame:
    """Each row with probability p."""
    return df.where(hash_unit(seed, *keys) < p)


def demeaned(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return df.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(*group)))


def shifted(steps: DataFrame, key: str, step: str, values: list[str], most: int, n_steps: int, seed: int) -> DataFrame:
    """Every sample moved by a random number of steps in [-most, most]; steps that move in are NULL and not observed."""
    by = F.floor(hash_unit(seed, key) * (2 * most + 1)).cast("bigint") - most
    moved = steps.withColumn(step, F.col(step) + by).withColumn("_o", F.lit(1))
    full = steps.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_steps - 1).cast("bigint"))).alias(step))
    out = full.join(moved, [key, step], "left")
    return out.select(key, step, *values, F.coalesce("_o", F.lit(0)).alias("observed"))


def dropped(steps: DataFrame, key: str, step: str, values: list[str], p: float, seed: int) -> DataFrame:
    """Values of a step are NULL with probability p."""
    gone = hash_unit(seed, key, step) < p
    return steps.select(*[F.when(~gone, F.col(c)).alias(c) if c in values else F.col(c) for c in steps.columns])


def noisy(steps: DataFrame, key: str, values: list[str], sd: float, seed: int) -> DataFrame:
    """One normal offset for each sample and channel, the same at all steps."""
    return steps.select(*[(F.col(c) + sd * normal(seed + 2 * values.index(c), key)).alias(c) if c in values else F.col(c) for c in steps.columns])


def jittered(scenes: DataFrame, key: str, day: str, most: int, seed: int) -> DataFrame:
    """All days of a sample moved by the same random number of days in [-most, most]."""
    return scenes.withColumn(day, F.col(day) + F.floor(hash_unit(seed, key) * (2 * most + 1)).cast("bigint") - most)


def window_crop(pixels: DataFrame, field: str, size: int, draws: int, seed: int) -> DataFrame:
    """(field, draw, turn, prow, pcol, r, c): for each field and draw the pixels of a window of size by size cells at a random
    place that holds a random pixel, so none is empty, and where they are in it after one of eight turns (quarter turns, then
    a mirror). A field that is larger than the window on a side is cut, a smaller one lies at a random place inside it."""
    w = Window.partitionBy(field)
    own = pixels.select(field, "prow", "pcol", F.min("prow").over(w).alias("_top"), F.min("pcol").over(w).alias("_left"), (F.max("prow").over(w) - F.min("prow").over(w) + 1).alias("_h"), (F.max("pcol").over(w) - F.min("pcol").over(w) + 1).alias("_w"), F.count(F.lit(1)).over(w).alias("_n"), (F.row_number().over(w.orderBy("prow", "pcol")) - 1).alias("_i"))
    pick = own.where("_i = 0").select(field, "_n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    u = lambda k: hash_unit(seed + k, field, "draw")
    pick = pick.select(field, "draw", F.floor(u(0) * F.col("_n")).cast("int").alias("_i"), F.floor(u(1) * 8).cast("int").alias("turn"), u(2).alias("_u"), u(3).alias("_v"))

    def first(at: Column, extent: Column, random: Column) -> Column:
        """The window's first line: any that keeps the pixel inside, and the window inside the field or the field inside it."""
        lo = F.when(extent > size, F.greatest(F.lit(0), at - (size - 1))).otherwise(extent - size)
        hi = F.when(extent > size, F.least(at, extent - size)).otherwise(F.lit(0))
        return (lo + F.floor(random * (hi - lo + 1))).cast("bigint")

    placed = pick.join(own, [field, "_i"]).select(field, "draw", "turn", (F.col("_top") + first(F.col("prow") - F.col("_top"), F.col("_h"), F.col("_u"))).alias("_r0"), (F.col("_left") + first(F.col("pcol") - F.col("_left"), F.col("_w"), F.col("_v"))).alias("_c0"))
    r, c, last = F.col("prow") - F.col("_r0"), F.col("pcol") - F.col("_c0"), size - 1
    got = pixels.select(field, "prow", "pcol").join(placed, field).where((r >= 0) & (r <= last) & (c >= 0) & (c <= last))
    quarter = F.col("turn") % 4
    rr = F.when(quarter == 0, r).when(quarter == 1, c).when(quarter == 2, last - r).otherwise(last - c)
    cc = F.when(quarter == 0, c).when(quarter == 1, last - r).when(quarter == 2, last - c).otherwise(r)
    return got.select(field, "draw", "turn", "prow", "pcol", rr.alias("r"), F.when(F.col("turn") >= 4, last - cc).otherwise(cc).alias("c"))
