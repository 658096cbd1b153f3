"""Leakage-safe splits: representativeness scores, leave-year-out, leave-region-out, folds, checks, bootstrap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fieldloom.functions.numeric import hash_unit, ratio
from fieldloom.operators.metrics import scores
from fieldloom.operators.tables import numbered
from fieldloom.session import checkpoint_dir


def standardised(fields: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Adds z: the value standardised in its group by the sample deviation (missing or zero counts as 1)."""
    w = Window.partitionBy(*group)
    sd = F.stddev_samp(value).over(w)
    return fields.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.when(sd > 0, sd).otherwise(F.lit(1.0)))


def split_scores(candidates: DataFrame, all_fields: DataFrame, mixes: list[list[str]], share: float = 0.15) -> DataFrame:
    """Score of each held-out set: candidates is (candidate, field), fields has `z` and the mix columns.

    2 * |share of fields - share| + for each mix the total variation between the set's and everyone's mix + the
    Kolmogorov-Smirnov distance of z, row by row in the order (z, field).
    """
    n = all_fields.count()
    part = candidates.join(all_fields, "field")
    size = part.groupBy("candidate").agg(F.count("*").alias("k"))
    out = size.withColumn("score", 2 * F.abs(F.col("k") / F.lit(float(n)) - share))
    for i, mix in enumerate(mixes):
        whole = all_fields.groupBy(*mix).agg((F.count("*") / F.lit(float(n))).alias("_q"))
        own = part.groupBy("candidate", *mix).agg(F.count("*").alias("_c"))
        both = size.crossJoin(whole).join(own, ["candidate", *mix], "left")
        tv = both.groupBy("candidate").agg((F.sum(F.abs(F.coalesce("_c", F.lit(0)) / F.col("k") - F.col("_q"))) / 2).alias(f"tv{i}"))
        out = out.join(tv, "candidate").withColumn("score", F.col("score") + F.col(f"tv{i}")).drop(f"tv{i}")
    # At a set's own rows and just before them the distance is largest: only these need to be looked at.
    ranked = numbered(all_fields.select("z", "field"), ["z", "field"], "_at").select("field", (F.col("_at") + 1).alias("rn"))
    own = candidates.join(ranked, "field").join(size, "candidate")
    c = F.row_number().over(Window.partitionBy("candidate").orderBy("rn"))
    own = own.withColumn("c", c)
    after, before = F.abs(F.col("c") / F.col("k") - F.col("rn") / F.lit(float(n))), F.abs((F.col("c") - 1) / F.col("k") - (F.col("rn") - 1) / F.lit(float(n)))
    ks = own.groupBy("candidate").agg(F.max(F.greatest(after, before)).alias("ks"))
    return out.join(ks, "candidate").withColumn("score", F.col("score") + F.col("ks"))


def year_pairs(fields: DataFrame, year: str, crop: str) -> DataFrame:
    """All ordered pairs of different years (test, val) whose remaining years hold every crop."""
    years = fields.select(F.col(year).alias("test")).distinct()
    pairs = years.crossJoin(years.select(F.col("test").alias("val"))).where("test <> val")
    crops = fields.groupBy(crop).agg(F.collect_set(year).alias("ys"))
    bad = pairs.crossJoin(crops).where(F.size(F.array_except("ys", F.array("test", "val"))) == 0).select("test", "val").distinct()
    return pairs.join(bad, ["test", "val"], "left_anti")


def leave_years_out(fields: DataFrame, year: str, crop: str, country: str) -> DataFrame:
    """Score of each pair of held-out years; the smallest (then smallest years) is the split. Few rows: years squared."""
    z = standardised(fields, "yield_mean", [crop, country])
    years = fields.select("field", F.col(year).cast("string").alias("candidate"))
    per = split_scores(years, z, [[crop, country]]).select("candidate", "score")
    pairs = year_pairs(fields, year, crop)
    a = per.select(F.col("candidate").alias("_t"), F.col("score").alias("test_score"))
    b = per.select(F.col("candidate").alias("_v"), F.col("score").alias("val_score"))
    return pairs.join(a, F.col("test").cast("string") == F.col("_t")).join(b, F.col("val").cast("string") == F.col("_v")).select("test", "val", (F.col("test_score") + F.col("val_score")).alias("score"))


def best_pair(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.round("score", 9), "test", "val").limit(1)


#: Regions that one list may have, and ranges of the ordered yields that bound a trial's distance.
MOST_REGIONS = 20_000
RANGES = 64
#: Trials that are scored in full first.
FIRST_TRIALS = 32


@dataclass
class RegionCounts:
    """Regions in the order of their names, how many fields each has, and how many of them by crop and by each mix and range
    of the ordered yields: what share, mixes and a bound of the distance of any union of regions need."""

    names: list[str]
    size: np.ndarray
    crops: np.ndarray
    mixes: list[np.ndarray]
    ranges: np.ndarray

    @classmethod
    def of(cls, fields: DataFrame, region: str, crop: str, mixes: list[list[str]]) -> RegionCounts:
        """fields has `z`. One list is sent to all tasks, so more than `MOST_REGIONS` regions are an error."""
        sizes = sorted((r[0], r[1]) for r in fields.groupBy(region).agg(F.count("*")).limit(MOST_REGIONS + 1).collect())
        if len(sizes) > MOST_REGIONS:
            raise ValueError(f"more than {MOST_REGIONS} regions")
        place = {name: k for k, (name, _) in enumerate(sizes)}
        n = sum(k for _, k in sizes)

        def matrix(rows: DataFrame, by: list[str]) -> np.ndarray:
            got = rows.groupBy(region, *by).agg(F.count("*").alias("_c")).collect()
            kinds = {k: i for i, k in enumerate(sorted({tuple(r[c] for c in by) for r in got}, key=repr))}
            out = np.zeros((len(sizes), len(kinds)))
            for r in got:
                out[place[r[region]], kinds[tuple(r[c] for c in by)]] = r["_c"]
            return out

        at = numbered(fields.select(region, "z", "field"), ["z", "field"], "_at").withColumn("_range", F.floor(F.col("_at") * RANGES / max(n, 1)))
        ranges = np.zeros((len(sizes), RANGES))
        for r in at.groupBy(region, "_range").agg(F.count("*").alias("_c")).collect():
            ranges[place[r[region]], r["_range"]] = r["_c"]
        return cls([x for x, _ in sizes], np.array([k for _, k in sizes], float), matrix(fields, [crop]), [matrix(fields, m) for m in mixes], ranges)


def drawn_sets(counts: RegionCounts, trials: np.ndarray, share: float, seed: int) -> np.ndarray:
    """trials x regions: 2 where a region is tested, 1 where it validates, 0 where it trains.

    All trials take a region a step, each in an order of its own. It joins the set, test before validation, of which it
    lessens the distance to the goal more, if it does so at all; what the sets hold is one array over all trials.
    """
    goal = share * counts.size.sum()
    draws = np.array([[hashlib.md5(f"{seed}|{t}|{name}".encode()).hexdigest() for name in counts.names] for t in trials.tolist()], "S32").reshape(len(trials), len(counts.names))
    order = np.argsort(draws, axis=1, kind="stable")
    held = np.zeros((len(trials), 2))  # tested, validating
    roles = np.zeros(order.shape, np.int8)
    every = np.arange(len(trials))
    for step in order.T:
        nearer = np.abs(held - goal) - np.abs(held + counts.size[step, None] - goal)
        into = np.argmax(nearer, axis=1)
        joins = nearer[every, into] > 0
        roles[every, step] = np.where(joins, 2 - into, 0)
        held[every, into] += np.where(joins, counts.size[step], 0.0)
    return roles


def lower_bounds(counts: RegionCounts, roles: np.ndarray, share: float) -> np.ndarray:
    """A score that none of the trials can go below: share and mixes in full, the distance of the ordered yields at the ends
    of ranges only. Infinite where a set is empty or training lacks a crop. A matrix product for each table of counts."""
    total = counts.size.sum()
    out = np.zeros(len(roles))
    for s in (2, 1):
        member = (roles == s).astype(float)
        k = member @ counts.size
        k = np.where(k > 0, k, np.nan)
        out += 2 * np.abs(k / total - share)
        for m in counts.mixes:
            out += np.abs((member @ m) / k[:, None] - m.sum(axis=0) / total).sum(axis=1) / 2
        own, all_ = np.cumsum(member @ counts.ranges, axis=1), np.cumsum(counts.ranges.sum(axis=0))
        out += np.abs(own / k[:, None] - all_ / total).max(axis=1)
    trains = ((roles == 0).astype(float) @ counts.crops > 0).all(axis=1)
    return np.where(trains & ~np.isnan(out), out, np.inf)


def leave_regions_out(fields: DataFrame, region: str, crop: str, country: str, year: str, trials: int, share: float = 0.15, seed: int = 42) -> DataFrame:
    """(trial, score, scored): the best random assignment of regions to test and validation that leaves every crop to train
    on, the first of equal ones, and how many trials were scored in full; no row if there is none.

    Trials are bounded from below by region counts alone, over all tasks. Those with the lowest bounds are scored in full,
    then all others whose bound is no higher than the best of these; the rest can't be better.
    """
    spark = fields.sparkSession
    checkpoint_dir(spark)
    mixes = [[crop, country], [year]]
    z = standardised(fields, "yield_mean", [crop, country]).checkpoint()
    counts = RegionCounts.of(z, region, crop, mixes)

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 500):
                own = b["id"].to_numpy()[i : i + 500]
                yield pd.DataFrame({"trial": own, "bound": lower_bounds(counts, drawn_sets(counts, own, share, seed), share)})

    bounds = spark.range(0, trials, 1, int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(bound, "trial long, bound double").where("bound < double('Infinity')").checkpoint()

    def scored(chosen: DataFrame) -> DataFrame:
        def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                t, r = np.nonzero(roles := drawn_sets(counts, b["trial"].to_numpy(), share, seed))
                yield pd.DataFrame({"candidate": [f"{b['trial'].iloc[i]}/{roles[i, j]}" for i, j in zip(t, r, strict=True)], region: [counts.names[j] for j in r]})

        sets = chosen.select("trial").repartition("trial").mapInPandas(held, f"candidate string, `{region}` {dict(fields.dtypes)[region]}")
        s = split_scores(sets.join(z.select("field", region), region).select("candidate", "field"), z, mixes, share)
        return s.groupBy(F.split("candidate", "/")[0].cast("bigint").alias("trial")).agg(F.sum("score").alias("score"))

    by = bounds.orderBy("bound", "trial")
    first = scored(by.limit(FIRST_TRIALS)).checkpoint()
    best = first.agg(F.min("score")).first()[0]
    if best is None:
        return first.select("trial", "score", F.lit(0).cast("bigint").alias("scored"))
    rest = bounds.where(F.col("bound") <= best + 1e-9).join(first, "trial", "left_anti").checkpoint()
    every = first if rest.isEmpty() else first.unionByName(scored(rest)).checkpoint()
    n = every.count()
    return every.orderBy(F.round("score", 9), "trial").limit(1).select("trial", "score", F.lit(n).cast("bigint").alias("scored"))


def fold_roles(fields: DataFrame, year: str) -> DataFrame:
    """(fold, field, role): each year is tested once and validated by the next one, the last by the first."""
    years = fields.select(year).distinct()
    cycle = years.withColumn("val", F.coalesce(F.lead(year).over(Window.orderBy(year)), F.min(year).over(Window.partitionBy(F.lit(1)))))
    folds = cycle.select(F.col(year).alias("fold"), "val")
    role = F.when(F.col(year) == F.col("fold"), 2).when(F.col(year) == F.col("val"), 1).otherwise(0)
    return fields.crossJoin(folds).select("fold", "field", role.alias("role"))


def split_violations(split: DataFrame, fields: DataFrame, groups: list[str], crop: str, by: list[str] = ()) -> DataFrame:
    """(by, check, n) of each split, which are told apart by the columns `by`: groups on more than one side, crops that
    train lacks, fields without a role, roles that are empty."""
    splits = split.select(*by).distinct() if by else None
    every = fields.crossJoin(splits) if by else fields  # a row for each field and split: what the splits themselves have
    d = every.join(split.select(*by, "field", "role"), [*by, "field"], "left")

    def found(name: str, rows: DataFrame) -> DataFrame:
        n = rows.groupBy(*by).agg(F.count("*").alias("n"))
        n = splits.join(n, list(by), "left") if by else n
        return n.select(*by, F.lit(name).alias("check"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))

    out = found("no role", d.where("role is null"))
    for g in groups:
        out = out.unionByName(found(f"{g} on two sides", d.groupBy(*by, g).agg(F.count_distinct("role").alias("k")).where("k > 1")))
    out = out.unionByName(found("crop missing in train", d.groupBy(*by, crop).agg(F.count_if(F.col("role") == 0).alias("k")).where("k = 0")))
    return out.unionByName(d.groupBy(*by).agg((3 - F.count_distinct("role")).alias("n")).select(*by, F.lit("empty roles").alias("check"), "n"))


def composition(split: DataFrame, fields: DataFrame, mix: str, by: list[str] = ()) -> DataFrame:
    """Per split (columns `by`) and role: fields, share, pixels, mean yield of each value of `mix` (by, role, mix, ...)."""
    d = fields.join(split.select(*by, "field", "role"), "field")
    t = d.groupBy(*by, "role", mix).agg(F.count("*").alias("n_fields"), F.sum("n_pixels").alias("n_pixels"), F.avg("yield_mean").alias("yield_mean"))
    return t.withColumn("share", F.col("n_fields") / F.sum("n_fields").over(Window.partitionBy(*by, "role")))


#: Rows of a table of fields that is sent to all tasks: some 100 bytes each.
SENT_FIELDS = 200_000


def bootstrap_scores(fields: DataFrame, subset: list[str], models: list[str], draws: int, seed: int) -> DataFrame:
    """(draw, subset, model, r2, n): fields drawn with replacement, the same draws for all models.

    Draws of a subset are dealt over all tasks before their picks are made, so a large subset is as many tasks as its draws
    allow. Picks are counted to a weight a field, and one aggregate of weighted moments about the subset's mean scores all
    models of a draw.
    """
    spark = fields.sparkSession
    own = numbered(fields.select(*subset, "field", "target", *models), [*subset, "field"], "_at").checkpoint()
    per = own.groupBy(*subset).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), F.avg("target").alias("_mean"))
    y = F.col("target") - F.col("_mean")
    own = own.join(per, subset).select(*subset, (F.col("_at") - F.col("_first")).cast("int").alias("_i"), y.alias("_y"), *[F.pow(F.col("target") - F.col(m), 2).alias(f"_e{k}") for k, m in enumerate(models)])
    # Weights are very many more rows than their source lets the planner expect: they are never what is sent, nor sorted.
    own = F.broadcast(own) if fields.limit(SENT_FIELDS + 1).count() <= SENT_FIELDS else own.hint("shuffle_hash")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = per.select(*subset, "_n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).repartition(tasks, *subset, "draw")
    picks = dealt.select("*", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).alias("_k"))
    weight = picks.withColumn("_i", F.floor(hash_unit(seed, *subset, "draw", "_k") * F.col("_n")).cast("int")).groupBy(*subset, "draw", "_i").agg(F.count("*").alias("_w"))
    w = F.col("_w")
    sums = weight.join(own, [*subset, "_i"]).groupBy("draw", *subset).agg(F.sum("_w").alias("n"), F.sum(w * F.col("_y")).alias("_sy"), F.sum(w * F.col("_y") * F.col("_y")).alias("_syy"), *[F.sum(w * F.col(f"_e{k}")).alias(f"_s{k}") for k in range(len(models))])
    sst = F.col("_syy") - F.col("_sy") * F.col("_sy") / F.col("n")
    sst = F.when(sst > 1e-12 * F.col("_syy"), sst).otherwise(0.0)  # a draw of one field has none but for rounding
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (1 - ratio(F.col(f"_s{k}"), sst)).alias("r2")) for k, m in enumerate(models)]))
    return sums.select("draw", *subset, "n", each.alias("_m")).select("draw", *subset, "_m.model", "_m.r2", "n")


def bootstrap_interval(boot: DataFrame, subset: list[str], base: str) -> DataFrame:
    """Per model: 5 % and 95 % of the median over subsets, and how often its difference to the base is positive.

    Scores are summed once: summed anew for the base, in another order, the base would differ from itself.
    """
    checkpoint_dir(boot.sparkSession)
    boot = boot.checkpoint()
    ref = boot.where(F.col("model") == base).select("draw", *subset, F.col("r2").alias("_b"))
    d = boot.join(ref, ["draw", *subset]).groupBy("model", "draw").agg(F.median("r2").alias("r2"), F.median(F.col("r2") - F.col("_b")).alias("delta"))
    return d.groupBy("model").agg(F.percentile("r2", 0.05).alias("lo"), F.percentile("r2", 0.95).alias("hi"), F.median("delta").alias("delta"), F.avg((F.col("delta") > 0).cast("int")).alias("share_better"))


def resolve_folds(folds: DataFrame, own: DataFrame, stand_in: DataFrame, key: str) -> DataFrame:
    """The run that supplies each fold: its own if there is one, else a stand-in; of several the first by name."""
    have = own.select(key, "run", F.lit(0).alias("rank")).unionByName(stand_in.select(key, "run", F.lit(1).alias("rank")))
    best = have.groupBy(key).agg(F.min(F.struct("rank", "run")).alias("b"))
    return folds.join(best, key, "left").select(*folds.columns, F.col("b.run").alias("run"), F.col("b.rank").alias("rank"))


def member_scores(preds: DataFrame, subset: list[str]) -> DataFrame:
    return scores(preds, subset)
