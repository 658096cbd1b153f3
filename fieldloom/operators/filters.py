"""Row selection, suppression and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.functions.scalars import standardize


def member_filter(df: DataFrame, **wanted: list[str]) -> DataFrame:
    """Rows whose columns, compared as text, are among the wanted values."""
    for c, values in wanted.items():
        df = df.where(F.col(c).cast("string").isin([str(v) for v in values]))
    return df


def rows_of(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the keys."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def missing_keys(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keys that no row has."""
    return keys.select(key).distinct().join(rows.select(key).distinct(), key, "left_anti")


def inside_buffer(pixels: DataFrame, distance: str, buffer: float) -> DataFrame:
    """Pixels farther than the buffer from their field's edge."""
    return pixels.where(F.col(distance) > buffer)


def min_observed(steps: DataFrame, keys: list[str], observed: str, least: int) -> DataFrame:
    """Rows of keys with at least that many observed steps."""
    enough = steps.groupBy(*keys).agg(F.sum(observed).alias("_n")).where(F.col("_n") >= least).select(*keys)
    return steps.join(enough, keys, "left_semi")


def scope_subset(fields: DataFrame, countries: list[str], region: str, crop: str, least: int) -> DataFrame:
    """Fields of some countries, without crops that occur in fewer regions than `least`."""
    own = fields.where(F.col("country").isin(countries))
    wide = own.groupBy(crop).agg(F.count_distinct(region).alias("_n")).where(F.col("_n") >= least).select(crop)
    return own.join(wide, crop, "left_semi")


def in_all(rows: DataFrame, variant: str, keys: list[str]) -> DataFrame:
    """Keys that every variant has (relational division)."""
    n = rows.agg(F.count_distinct(variant).alias("_all"))
    have = rows.groupBy(*keys).agg(F.count_distinct(variant).alias("_n"))
    return have.crossJoin(F.broadcast(n)).where("_n = _all").select(*keys)


def suppressed(df: DataFrame, group: str, private: list[str], measures: list[str]) -> DataFrame:
    """Measures of private groups are NULL; counts stay."""
    return df.select(*[F.when(~F.col(group).isin(private), F.col(c)).alias(c) if c in measures else F.col(c) for c in df.columns])


def inner_or_all(pixels: DataFrame, field: str, inner: Column) -> DataFrame:
    """Inner pixels; fields that have none keep all."""
    any_inner = F.max(F.coalesce(inner, F.lit(False))).over(Window.partitionBy(field))
    return pixels.withColumn("_i", F.coalesce(inner, F.lit(False))).withColumn("_a", any_inner).where("_i or not _a").drop("_i", "_a")


def on_role(df: DataFrame, role: str, which: str, condition: Column) -> DataFrame:
    """The condition applied to the rows of one role only."""
    return df.where((F.col(role) != which) | condition)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def scaler(train: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """(feature, mean, sd, n): population moments; those to keep get 0 and 1, a deviation of zero counts as 1."""
    sums = train.agg(*[f(c).alias(f"{c}__{n}") for c in features for n, f in (("mean", F.avg), ("sd", F.stddev_pop), ("n", F.count))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), (F.lit(0.0) if c in keep else F.col(f"{c}__mean")).alias("mean"), (F.lit(1.0) if c in keep else F.when(F.col(f"{c}__sd") <= 1e-12, 1.0).otherwise(F.col(f"{c}__sd"))).alias("sd"), F.col(f"{c}__n").alias("n")) for c in features])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def scaled(df: DataFrame, stats: DataFrame, features: list[str], fill: float = 0.0) -> DataFrame:
    """Features standardised by a one-row broadcast of the stats; missing values become `fill`."""
    wide = stats.groupBy().pivot("feature", features).agg(F.max("mean").alias("mean"), F.max("sd").alias("sd"))
    out = df.crossJoin(F.broadcast(wide))
    return out.select(*[standardize(c, f"{c}_mean", f"{c}_sd", fill).alias(c) if c in features else F.col(c) for c in df.columns])
