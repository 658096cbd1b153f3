"""Exact quantiles and ranks of groups of any size: no task sees a whole group, and no value is approximated.

Quantiles come from order statistics. A range of a group's values is cut into `BINS` equal bins and counted; a wanted rank
falls into one of them, whose least and largest value are the next range. Ranges end when they hold one value or few
enough rows to be sorted; all that is ever gathered of a group are those `FEW` values and the counts of bins. Ranks come
from counts of equal values, summed over ranges of rows.

Quantiles interpolate linearly. NULL and NaN values do not count; a group without values has NULL quantiles and a count of
zero. Infinite values are ordered as such; a quantile between two different ones is not a number and comes out as NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.functions.numeric import missing
from fieldloom.operators.tables import running_sums
from fieldloom.session import checkpoint_dir

#: Bins of a range, and values of a range that are sorted at once.
BINS = 1024
FEW = 4096
#: Ranges that are sent to all tasks, some 50 bytes each.
SENT = 50_000


def _same(by: list[str]) -> Column:
    out = F.lit(True)
    for i, c in enumerate(by):
        out = out & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return out


def _keys(by: list[str]) -> list[Column]:
    return [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]


def _sent(ranges: DataFrame, n: int) -> DataFrame:
    """Ranges, sent to all tasks up to `SENT` of them, so that rows of a large group stay where they are."""
    return F.broadcast(ranges) if n <= SENT else ranges


def order_statistics(df: DataFrame, by: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """(by, rank, x): the values at the ranks, from 0, that `wanted` (by, rank) lists for the groups."""
    checkpoint_dir(df.sparkSession)
    rows = df.select(*by, missing(value).alias("_v")).where("_v is not null")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    open_ = wanted.select(*_keys(by), "rank").join(sizes, _same(by)).where((F.col("rank") >= 0) & (F.col("rank") < F.col("_n")))
    open_ = open_.select(*by, "rank", "_lo", "_hi", "_n", F.lit(0).cast("bigint").alias("_below")).checkpoint()
    large = (F.col("_lo") < F.col("_hi")) & (F.col("_n") > FEW)
    while n := open_.where(large).count():
        ranges = _sent(open_.where(large).select(*_keys(by), "_lo", "_hi").distinct(), n)
        # Halves keep the width of the widest ranges finite; infinite ends are bins of their own.
        lo, hi, v = F.greatest("_lo", F.lit(-1.7e308)), F.least("_hi", F.lit(1.7e308)), F.col("_v")
        at = F.least(F.lit(BINS - 1), F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS)).cast("int")
        bin = F.when(v == F.col("_lo"), -1).when(v == F.col("_hi"), BINS).otherwise(F.coalesce(at, F.lit(0)))
        held = rows.join(ranges, _same(by) & (v >= F.col("_lo")) & (v <= F.col("_hi")))
        bins = held.groupBy(*by, "_lo", "_hi", bin.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        before = Window.partitionBy(*by, "_lo", "_hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("_s", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        bins = bins.select(*_keys(by), F.col("_lo").alias("_l"), F.col("_hi").alias("_h"), "_c", "_a", "_b", "_s")
        inner = F.col("rank") - F.col("_below")
        met = open_.where(large).join(bins, _same(by) & (F.col("_lo") == F.col("_l")) & (F.col("_hi") == F.col("_h")) & (inner >= F.col("_s")) & (inner < F.col("_s") + F.col("_c")))
        met = met.select(*by, "rank", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.col("_c").alias("_n"), (F.col("_below") + F.col("_s")).alias("_below"))
        open_ = open_.where(~large).unionByName(met).checkpoint()
    one = open_.where("_lo = _hi").select(*by, "rank", F.col("_lo").alias("x"))
    few = open_.where("_lo < _hi")
    ranges = _sent(few.select(*_keys(by), "_lo", "_hi").distinct(), few.count())
    lists = rows.join(ranges, _same(by) & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).groupBy(*by, "_lo", "_hi").agg(F.sort_array(F.collect_list("_v")).alias("_s"))
    lists = lists.select(*_keys(by), F.col("_lo").alias("_l"), F.col("_hi").alias("_h"), "_s")
    found = few.join(lists, _same(by) & (F.col("_lo") == F.col("_l")) & (F.col("_hi") == F.col("_h"))).select(*by, "rank", F.element_at("_s", (F.col("rank") - F.col("_below") + 1).cast("int")).alias("x"))
    return one.unionByName(found)


def group_quantiles(df: DataFrame, by: list[str], value: str, at: list[float], names: list[str] | None = None) -> DataFrame:
    """(by, n, a column for each of `at`): exact quantiles of each group's values, interpolated linearly."""
    checkpoint_dir(df.sparkSession)
    names = names or [f"q{round(a * 100):02d}" for a in at]
    counts = df.groupBy(*by).agg(F.count(missing(value)).alias("n")).checkpoint()
    where = [(F.col("n") - 1) * F.lit(float(a)) for a in at]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(w), F.ceil(w)) for w in where])))
    wanted = counts.where("n > 0").select(*by, F.explode(ranks).alias("rank"))
    x = order_statistics(df, by, value, wanted)
    held = x.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("_x"))  # twice as many as quantiles
    d = counts.join(held.select(*_keys(by), "_x"), _same(by), "left")

    def quantile(w: Column) -> Column:
        lo, hi = F.try_element_at("_x", F.floor(w)), F.try_element_at("_x", F.ceil(w))
        return F.when(lo == hi, lo).otherwise(missing(lo + (hi - lo) * (w - F.floor(w))))

    return d.select(*by, "n", *[quantile(w).alias(n) for w, n in zip(where, names, strict=True)])


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds the rank of each row's value in its group, from 1; equal values share the mean of theirs. Rows without a value
    have none."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    ranked = running_sums(counts, by, [value], "_c", "_s").select(*_keys(by), F.col(value).alias("_u"), (F.col("_s") + (F.col("_c") + 1) / 2.0).alias(name))
    return df.join(ranked, _same(by) & (F.col(value) == F.col("_u")), "left").select(*df.columns, name)
