"""Profiles of tables: coverage, shifts, histograms, correlations, schemas, reconciliations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.functions.numeric import corr, ratio
from fieldloom.operators.quantiles import average_ranks, group_quantiles
from fieldloom.operators.tables import numbered


def long(df: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    """(keep, feature, value): one row for each feature."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")).select(*keep, "x.*")


def field_table(pixels: DataFrame, field: str, carried: list[str], value: str) -> DataFrame:
    """Per field: carried attributes, pixels, mean value, and how many carried attributes are not constant."""
    vary = sum((F.when(F.count_distinct(c) > 1, 1).otherwise(0) for c in carried[1:]), F.when(F.count_distinct(carried[0]) > 1, 1).otherwise(0))
    return pixels.groupBy(field).agg(*[F.min(c).alias(c) for c in carried], F.count("*").alias("n_pixels"), F.avg(value).alias("yield_mean"), vary.alias("not_constant"))


def field_steps(steps: DataFrame, field: str, step: str, values: list[str]) -> DataFrame:
    """Per field and step: mean and number of valid values of each band."""
    return steps.groupBy(field, step).agg(*[f for v in values for f in (F.avg(v).alias(f"{v}_mean"), F.count(v).alias(f"{v}_n"))])


def field_aggregates(pixels: DataFrame, field: str, carried: list[str], target: str, bands: list[str]) -> DataFrame:
    """Per field in one pass: carried attributes, pixels, mean and population deviation of the target, mean of each static
    band."""
    return pixels.groupBy(field).agg(*[F.min(c).alias(c) for c in carried], F.count("*").alias("n_pixels"), F.avg(target).alias("yield_mean"), F.stddev_pop(target).alias("yield_sd"), *[F.avg(b).alias(f"{b}_mean") for b in bands])


def field_years(pixels: DataFrame, seasons: DataFrame, field: str, target: str, at: list[float]) -> DataFrame:
    """Per field-year: labelled pixels, bounding box, distribution of the target, sowing and harvest dates, and the days
    between them (NULL if a date is missing)."""
    box = [f(c).alias(f"{n}_{c}") for c in ("prow", "pcol") for n, f in (("min", F.min), ("max", F.max))]
    q = pixels.groupBy(field).agg(F.count("*").alias("n_pixels"), F.count(target).alias("n_labelled"), *box, F.avg(target).alias("mean"), F.stddev_samp(target).alias("sd"), F.min(target).alias("lo"), F.max(target).alias("hi"), F.percentile(target, F.array(*[F.lit(a) for a in at])).alias("_q"))
    q = q.select("*", *[F.col("_q")[k].alias(f"q{round(a * 100):02d}") for k, a in enumerate(at)]).drop("_q")
    return q.join(seasons.select(field, "seeding_date", "harvesting_date", F.datediff("harvesting_date", "seeding_date").alias("season_days")), field, "left")


def raster_info(cells: DataFrame, keys: list[str], value: str, size: float = 10.0, missing: float = -1.0) -> DataFrame:
    """Per raster: height, width, labelled cells (values from 0 on) and all, area in ha, their least, mean and largest
    value, and negative values that are not the `missing` mark."""
    v = F.col(value)
    ok = F.when(v >= 0, v)
    span = lambda c: (F.max(c) - F.min(c) + 1)
    return cells.groupBy(*keys).agg(span("prow").alias("height"), span("pcol").alias("width"), F.count(ok).alias("labelled"), F.count("*").alias("n"), (F.count(ok) * (size * size / 10_000)).alias("area_ha"), F.min(ok).alias("lo"), F.avg(ok).alias("mean"), F.max(ok).alias("hi"), F.count_if((v < 0) & (v != missing)).alias("odd_negative"))


def same_grid(rasters: DataFrame, key: str, layer: str, base: str) -> DataFrame:
    """(key, layer, same): whether a layer's grid (height, width and origin) is that of the base layer of its key."""
    grid = F.struct("height", "width", "top", "left")
    b = rasters.where(F.col(layer) == base).select(key, grid.alias("_g"))
    return rasters.where(F.col(layer) != base).join(b, key, "left").select(key, layer, F.coalesce(grid == F.col("_g"), F.lit(False)).alias("same"))


def dataset_table(fields: DataFrame, group: list[str]) -> DataFrame:
    """Distinct physical fields, farms and regions, pixels, years and yields: per group and per first column (others NULL)."""
    def part(by: list[str]) -> DataFrame:
        t = fields.groupBy(*by).agg(F.count_distinct("physical_field").alias("n_physical"), F.count_distinct("farm").alias("n_farms"), F.count_distinct("region").alias("n_regions"), F.sum("n_pixels").alias("n_pixels"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.avg("yield_mean").alias("mean"), F.stddev_samp("yield_mean").alias("sd"))
        return t.select(*[F.col(c) if c in by else F.lit(None).cast(dict(fields.dtypes)[c]).alias(c) for c in group], *t.columns[len(by) :])

    return part(group).unionByName(part(group[:1]))


def coverage(df: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """Share of present values and median of each feature by group."""
    d = long(df, by, features)
    present = d.groupBy("feature", *by).agg((F.count("value") / F.count("*")).alias("present"))
    return _beside(present, group_quantiles(d, ["feature", *by], "value", [0.5], ["median"]), ["feature", *by]).select("feature", *by, "present", "median")


def _beside(a: DataFrame, q: DataFrame, by: list[str], columns: list[str] | None = None) -> DataFrame:
    """The quantiles beside a table of the same groups."""
    names = columns or [c for c in q.columns if c not in (*by, "n")]
    q = q.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *names)
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return a.join(q, same).select(*a.columns, *names)


def quantiles(df: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """Count, mean, sample deviation and exact quantiles by group."""
    s = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return _beside(s, group_quantiles(df, by, value, at), by)


def described(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles."""
    return quantiles(df, by, value, [0.0, 0.25, 0.5, 0.75, 1.0])


def variance_share(df: DataFrame, field: str, value: str, by: list[str]) -> DataFrame:
    """Share of variance between fields: variance of the field means spread over their rows by the variance of all."""
    d = df.withColumn("_f", F.avg(value).over(Window.partitionBy(*by, field)))
    return d.groupBy(*by).agg(ratio(F.var_samp("_f"), F.var_samp(value)).alias("between_share"), F.count("*").alias("n"))


def histogram(df: DataFrame, by: list[str], value: str, bins: int, clip: tuple[float, float]) -> DataFrame:
    """Counts and density of equal bins between two percentiles of all values (broadcast: one row)."""
    edges = group_quantiles(df, [], value, list(clip), ["_lo", "_hi"]).drop("n")
    d = df.crossJoin(F.broadcast(edges)).where((F.col(value) >= F.col("_lo")) & (F.col(value) <= F.col("_hi")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    d = d.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / width)).cast("int")).withColumn("_w", width)
    c = d.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.max("_w").alias("_w"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return c.select(*by, "bin", "n", (F.col("n") / (F.sum("n").over(w) * F.col("_w"))).alias("density"))


def feature_shift(df: DataFrame, group: str, features: list[str], reference: object) -> DataFrame:
    """Median and interquartile range by group, and the median's distance to that of the reference group in its
    interquartile ranges."""
    q = group_quantiles(long(df, [group], features), ["feature", group], "value", [0.25, 0.5, 0.75]).select("feature", group, F.col("q50").alias("median"), (F.col("q75") - F.col("q25")).alias("iqr")).checkpoint()
    ref = q.where(F.col(group) == F.lit(reference)).select("feature", F.col("median").alias("_m"), F.col("iqr").alias("_r"))
    return q.join(ref, "feature", "left").select("feature", group, "median", "iqr", ratio(F.col("median") - F.col("_m"), "_r").alias("shift"))


def valid_per_step(steps: DataFrame, by: list[str], step: str, value: str) -> DataFrame:
    return steps.groupBy(*by, step).agg(F.avg(F.col(value).isNotNull().cast("int")).alias("valid"))


def valid_steps(steps: DataFrame, key: list[str], value: str) -> DataFrame:
    """How many keys have how many valid steps."""
    return steps.groupBy(*key).agg(F.count(value).alias("n_valid")).groupBy("n_valid").agg(F.count("*").alias("n"))


def seasonal_profile(steps: DataFrame, key: str, group: str, step: str, value: str) -> DataFrame:
    """Mean and deviation over the keys' means by step."""
    k = steps.groupBy(key, group, step).agg(F.avg(value).alias("_v"))
    return k.groupBy(group, step).agg(F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"), F.count("*").alias("n"))


def step_correlation(steps: DataFrame, group: str, step: str, x: str, y: str, least: int = 5) -> DataFrame:
    """Correlation by step between rows, and within groups; NULL unless there are more pairs than `least`."""
    w = Window.partitionBy(group, step)
    d = steps.select(step, F.col(x).alias("x"), F.col(y).alias("y"), (F.col(x) - F.avg(x).over(w)).alias("dx"), (F.col(y) - F.avg(y).over(w)).alias("dy"))
    return d.groupBy(step).agg(F.count("*").alias("n"), F.when(F.count("*") > least, corr("x", "y")).alias("between"), F.when(F.count("*") > least, corr("dx", "dy")).alias("within"))


def ranking(df: DataFrame, features: list[str], target: str, k: int) -> DataFrame:
    """The k features with the largest absolute correlation with the target (then by name)."""
    d = long(df, [target], features)
    s = d.groupBy("feature").agg(corr("value", target).alias("r"), F.count_distinct("value").alias("n_unique"))
    return s.orderBy(F.round(F.abs(F.coalesce("r", F.lit(0.0))), 9).desc(), "feature").limit(k)


def ranking_by_source(df: DataFrame, features: list[str], target: str, source: str, sources: list[str], k: int) -> DataFrame:
    """The ranking over all rows, with the correlation inside each source beside it."""
    d = long(df, [target, source], features)
    inside = lambda v, s: F.when(F.col(source) == s, F.col(v))
    s = d.groupBy("feature").agg(corr("value", target).alias("r"), *[corr(inside("value", x), inside(target, x)).alias(f"r_{x}".lower()) for x in sources], F.count_distinct("value").alias("n_unique"))
    return s.orderBy(F.round(F.abs(F.coalesce("r", F.lit(0.0))), 9).desc(), "feature").limit(k)


def label_sanity(df: DataFrame, by: list[str], value: str, top: float) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*by).agg(F.count_if(v.isNull()).alias("missing"), F.count_if(v <= 0).alias("not_positive"), F.count_if(v > top).alias("too_large"))


def json_profile(df: DataFrame, doc: str) -> DataFrame:
    """Per key of JSON objects: presence, the values' JSON types with their counts, numbers among the values (decimals,
    signs and exponents included) with their range and median, lengths of arrays and objects, and distinct values."""
    m = df.select(F.explode(F.from_json(doc, "map<string,string>")).alias("key", "value"))
    m = m.withColumn("_n", F.col("value").try_cast("double"))
    text = F.trim("value")
    length = F.when(text.startswith("["), F.json_array_length("value")).when(text.startswith("{"), F.size(F.json_object_keys("value")))
    kind = F.when(F.col("value").isNull(), "null").when(text.startswith("["), "array").when(text.startswith("{"), "object").when(F.col("value").isin("true", "false"), "boolean").when(F.col("_n").isNotNull(), "number").otherwise("string")
    m = m.withColumn("_k", kind).withColumn("_l", length)
    kinds = [F.count_if(F.col("_k") == k).alias(f"{k}s") for k in ("null", "array", "object", "boolean", "string")]
    n = F.col("_n")
    return m.groupBy("key").agg(F.count("*").alias("present"), F.count(n).alias("numbers"), *kinds, F.min(n).alias("lo"), F.median(n).alias("mid"), F.max(n).alias("hi"), F.min("_l").cast("bigint").alias("shortest"), F.max("_l").cast("bigint").alias("longest"), F.count_distinct("value").alias("n_values"))


def class_shares(df: DataFrame, by: list[str], kind: str) -> DataFrame:
    c = df.groupBy(*by, kind).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def completeness(df: DataFrame, by: list[str], day: str, columns: list[str]) -> DataFrame:
    """Rows, days that the dates span, and the share of missing values of each column."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), (F.max(day) - F.min(day) + 1).alias("span"), *[F.avg(F.col(c).isNull().cast("int")).alias(f"{c}_missing") for c in columns])


def counts_by_value(df: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(F.col(column) == v).alias(f"{column}_{v}".lower().replace(" ", "_")) for v in values])


def matched_ratio(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a by rows of b for each key."""
    x, y = a.groupBy(*keys).agg(F.count("*").alias("n_a")), b.groupBy(*keys).agg(F.count("*").alias("n_b"))
    return x.join(y, keys, "full_outer").withColumn("ratio", ratio("n_a", "n_b"))


def not_static(steps: DataFrame, key: str, bands: list[str], tolerance: float) -> DataFrame:
    """(band, n): keys at which a band that should be constant changes by more than the tolerance, or is missing in part."""
    d = long(steps, [key], bands).groupBy("feature", key).agg((F.max("value") - F.min("value")).alias("_d"), F.count("value").alias("_n"), F.count("*").alias("_a"))
    return d.where((F.col("_d") > tolerance) | ((F.col("_n") > 0) & (F.col("_n") < F.col("_a")))).groupBy(F.col("feature").alias("band")).agg(F.count("*").alias("n"))


def largest_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str, by: str) -> DataFrame:
    """Largest absolute difference of a value between two tables, by group."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    return j.groupBy(by).agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("difference"))


def quintile_errors(fields: DataFrame, group: str, measure: str, error: str, n: int = 5) -> DataFrame:
    """Median error by quantile of a measure inside each group (ties by field)."""
    d = fields.select(group, F.round(measure, 9).alias("_v"), "field", error)
    ranked = numbered(d, [group, "_v", "field"], "_at")
    per = ranked.groupBy(group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    bin = F.when(F.col("_n") == 1, 0).otherwise(F.greatest(F.lit(0), F.ceil((F.col("_at") - F.col("_first")) * n / (F.col("_n") - 1)) - 1)).cast("int")
    d = _beside(ranked, per, [group], ["_first", "_n"]).withColumn("bin", bin)
    return group_quantiles(d, [group, "bin"], error, [0.5], ["error"])


def bins_by_rank(df: DataFrame, key: str, measures: list[str], n: int = 5, least: int = 5) -> DataFrame:
    """(measure, value, bin, key): bins 0..n-1 by each measure's rank (ties by key), for measures with at least `least`
    different values. All measures are ranked at once, over ranges of (measure, value), so no task ranks a measure."""
    d = long(df, [key], measures).where("value is not null").select("feature", F.round("value", 9).alias("value"), key)
    ranked = numbered(d, ["feature", "value", key], "_at")
    per = ranked.groupBy("feature").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), F.count_distinct("value").alias("_k")).where(F.col("_k") >= least)
    r = F.col("_at") - F.col("_first")
    bin = F.when(F.col("_n") == 1, 0).otherwise(F.greatest(F.lit(0), F.ceil(r * n / (F.col("_n") - 1)) - 1)).cast("int")
    return ranked.join(F.broadcast(per), "feature").select(F.col("feature").alias("measure"), "value", bin.alias("bin"), key)  # a row a measure


def spearman(df: DataFrame, group: str, x: str, y: str, least: int = 10, distinct: int = 3) -> DataFrame:
    """Rank correlation with average ranks; NULL for small groups or too few different values."""
    # Values that tie may differ in the last digits by the order of summing, so they are ranked to nine digits.
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, F.round(x, 9).alias("_a"), F.round(y, 9).alias("_b"))
    d = average_ranks(average_ranks(d, [group], "_a", "_x"), [group], "_b", "_y")
    ok = (F.count("*") >= least) & (F.count_distinct("_a") >= distinct)
    return d.groupBy(group).agg(F.count("*").alias("n"), F.when(ok, corr("_x", "_y")).alias("rho"))


def band_summary(df: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """Missing values and the 1 %, 50 % and 99 % points of each feature."""
    d = long(df, by, features)
    m = d.groupBy(*by, "feature").agg(F.count_if(F.col("value").isNull()).alias("missing"))
    return _beside(m, group_quantiles(d, [*by, "feature"], "value", [0.01, 0.5, 0.99], ["p01", "p50", "p99"]), [*by, "feature"])


def catalogue(names: DataFrame, group: str, name: str) -> DataFrame:
    return names.groupBy(group).agg(F.count("*").alias("n"), F.min(name).alias("first"), F.max(name).alias("last"))


def best_step(steps: DataFrame, field: str, step: str, value: str, least: float) -> DataFrame:
    """The step with the highest median among those with more valid values than `least` (the first of equal ones)."""
    s = steps.groupBy(field, step).agg(F.median(value).alias("m"), (F.count(value) / F.count("*")).alias("v")).where(F.col("v") > least)
    return s.groupBy(field).agg(F.max_by(step, F.struct("m", -F.col(step))).alias("best_step"), F.max("m").alias("median"))


def step_band(steps: DataFrame, field: str, step: str, value: str) -> DataFrame:
    """10, 50 and 90 % points by step."""
    return group_quantiles(steps, [field, step], value, [0.1, 0.5, 0.9], ["p10", "p50", "p90"]).drop("n")
