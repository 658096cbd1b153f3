"""Evaluation of predictions at pixel and field level.

Prediction tables have one row a pixel with `target` and `pred`; fields are groups of pixels. Sums of squares about the
mean are variances times counts, which Spark sums centrally and in parts, so they keep their digits and no row meets
its group's mean; tables of moments by field (`field_moments`) merge to any subset of fields, which is scored without touching
pixels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.functions.numeric import col, corr, ratio


def field_level(preds: DataFrame, key: list[str], target: str = "target", pred: str = "pred") -> DataFrame:
    """Per field: mean target and prediction and the number of pixels; `key` names the field and what it carries."""
    return preds.groupBy(*key).agg(F.avg(target).alias("target"), F.avg(pred).alias("pred"), F.count("*").alias("n_pixels"))


def scores(df: DataFrame, by: list[str], target: str = "target", pred: str = "pred", prefix: str = "") -> DataFrame:
    """R2 and RMSE per group; R2 is NULL where the target is constant."""
    error = F.avg(F.pow(F.col(target) - F.col(pred), 2))
    return df.groupBy(*by).agg(r2(target, pred).alias(f"{prefix}r2"), F.sqrt(error).alias(f"{prefix}rmse"), F.count("*").alias(f"{prefix}n"))


def r2(target: str = "target", pred: str = "pred") -> Column:
    """R2 as an aggregate: one less the squared error by the squares about the mean."""
    return 1 - ratio(F.sum(F.pow(F.col(target) - F.col(pred), 2)), F.var_pop(target) * F.count(target))


def field_moments(preds: DataFrame, field: str, carry: list[str], target: str = "target", pred: str = "pred") -> DataFrame:
    """Of each field: n, means (my, mp), squares and products about them (m2y, m2p, cyp), and the squared error (sse). Pixels
    without a target or a prediction do not count."""
    y, p = F.col(target), F.col(pred)
    n = F.count("*")
    own = preds.where(y.isNotNull() & p.isNotNull()).groupBy(field, *carry)
    return own.agg(n.alias("n"), F.avg(y).alias("my"), F.avg(p).alias("mp"), (F.var_pop(y) * n).alias("m2y"), (F.var_pop(p) * n).alias("m2p"), (F.covar_pop(y, p) * n).alias("cyp"), F.sum(F.pow(y - p, 2)).alias("sse"))


def merged_moments(parts: DataFrame, by: list[str], extra: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    """The moments of the union of the parts of each group, for parts of any kind: fields, files, folds or merged ones.

    Squares about a part's mean move to the group's mean by n times the squared distance of the two, so nothing is
    subtracted that is much larger than what is left, however far the values are from zero. Only parts meet their group's
    mean, never rows. `extra` are further aggregates over the parts.
    """
    n = F.sum("n")
    mean = lambda c: (F.sum(F.col("n") * F.col(c)) / n).alias(f"_{c}")
    whole = parts.groupBy(*by).agg(mean("my"), mean("mp"))
    keyed = whole.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_my", "_mp")
    same = reduce(lambda x, z: x & z, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], F.lit(True))
    d = parts.join(keyed, same) if by else parts.crossJoin(keyed)  # one row
    dy, dp = F.col("my") - F.col("_my"), F.col("mp") - F.col("_mp")
    return d.groupBy(*by).agg(n.alias("n"), F.max("_my").alias("my"), F.max("_mp").alias("mp"), F.sum(F.col("m2y") + F.col("n") * dy * dy).alias("m2y"), F.sum(F.col("m2p") + F.col("n") * dp * dp).alias("m2p"), F.sum(F.col("cyp") + F.col("n") * dy * dp).alias("cyp"), F.sum("sse").alias("sse"), *[c.alias(name) for name, c in extra.items()])


def scores_from_moments(moments: DataFrame, by: list[str]) -> DataFrame:
    """Pixel and field scores of any set of fields from their moments, without the pixels."""
    field = {"field_r2": r2("my", "mp"), "field_rmse": F.sqrt(F.avg(F.pow(F.col("my") - F.col("mp"), 2))), "n_fields": F.count("*")}
    m = merged_moments(moments, by, field)
    return m.select(*by, (1 - ratio("sse", "m2y")).alias("pixel_r2"), F.sqrt(ratio("sse", "n")).alias("pixel_rmse"), "field_r2", "field_rmse", "n_fields", F.col("n").alias("n_pixels"))


def group_metrics(preds: DataFrame, field: str, groups: list[str]) -> DataFrame:
    """Field and pixel scores over all rows (level 0) and for each combination of `groups` (level 1): one scan of the pixels
    to moments by field, which then count for both levels."""
    moments = field_moments(preds, field, groups)
    kept = [c for c in moments.columns if c not in groups]
    both = moments.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("level"), *groups, *kept)
    both = both.select("level", *[F.when(F.col("level") == 1, F.col(c)).alias(c) for c in groups], *kept)
    s = scores_from_moments(both, ["level", *groups])
    return s.select("level", *groups, "field_r2", "field_rmse", "pixel_r2", "pixel_rmse", "n_fields", "n_pixels")


def members_long(preds: DataFrame, members: list[str], keep: list[str], first: int | None = None) -> DataFrame:
    """A row for each member prediction that exists, at most the first n: (keep, member, pred)."""
    have = [m for m in members if m in preds.columns][:first]
    if not have:
        raise ValueError("no member column exists")
    return preds.select(*keep, F.explode(F.array(*[F.struct(F.lit(m).alias("member"), F.col(m).alias("pred")) for m in have])).alias("_m")).select(*keep, "_m.member", "_m.pred")


def member_fields(preds: DataFrame, expected: DataFrame, key: str, n: int, prefix: str = "pred_m") -> tuple[DataFrame, DataFrame]:
    """Means by field of the target and of the first n members (columns prefix0, prefix1, ...), and one row that checks
    them: how many members there are, a note if fewer than n, and how many expected fields are missing and others there. Without
    a member, or if the fields are not the expected ones, the means are empty."""
    members = [f"{prefix}{m}" for m in range(n) if f"{prefix}{m}" in preds.columns]
    note = "" if len(members) == n else f"only {len(members)} members"
    means = preds.groupBy(key).agg(F.avg("target").alias("target"), *[F.avg(m).alias(f"m{i}") for i, m in enumerate(members)])
    own, want = means.select(key, F.lit(1).alias("_own")), expected.select(key).distinct().withColumn("_want", F.lit(1))
    check = own.join(want, key, "full_outer").agg(F.count_if(F.col("_own").isNull()).alias("missing"), F.count_if(F.col("_want").isNull()).alias("extra"))
    check = check.select(F.lit(len(members)).alias("n_members"), F.lit(note).alias("note"), "missing", "extra", ((F.col("missing") == 0) & (F.col("extra") == 0) & F.lit(bool(members))).alias("usable"))
    return means.crossJoin(F.broadcast(check.select("usable"))).where("usable").drop("usable"), check  # one row


def member_metrics(preds: DataFrame, members: list[str], field: str, groups: list[str]) -> DataFrame:
    """Scores of each member by group, averaged over members."""
    long = members_long(preds, members, [field, *groups, "target"])
    fields = long.groupBy(field, *groups, "member").agg(F.avg("target").alias("target"), F.avg("pred").alias("pred"))
    s = scores(fields, [*groups, "member"])
    return s.groupBy(*groups).agg(F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"), F.count("*").alias("n_members"))


def ensemble(members: list[str]) -> tuple[Column, Column]:
    """Mean and population deviation over member columns of a row."""
    n = float(len(members))
    mean = sum((F.col(m) for m in members[1:]), F.col(members[0])) / n
    var = sum((F.pow(F.col(m) - mean, 2) for m in members[1:]), F.pow(F.col(members[0]) - mean, 2)) / n
    return mean, F.sqrt(var)


def min_count(df: DataFrame, by: list[str], least: int) -> DataFrame:
    """Rows of groups that have at least `least` rows."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("_n") >= least).drop("_n")


def cv_scores(fields: DataFrame, group: list[str], cell: str, least: int = 10) -> DataFrame:
    """Per group (cell NULL) and per group and cell: n, R2, relative RMSE and bias in percent, number of cells."""
    out = []
    for by, extra in ((group, F.count_distinct(cell)), ([*group, cell], F.lit(1).cast("bigint"))):
        e = F.col("pred") - F.col("target")
        s = fields.groupBy(*by).agg(F.count("*").alias("n"), r2().alias("r2"), (100 * ratio(F.sqrt(F.avg(e * e)), F.avg("target"))).alias("rrmse"), (100 * ratio(F.avg(e), F.avg("target"))).alias("bias"), (extra if by is group else F.count_distinct(cell)).alias("n_cells"))
        s = s.where(F.col("n") >= least)
        out.append(s if cell in by else s.withColumn(cell, F.lit(None).cast(dict(fields.dtypes)[cell])))
    return out[0].unionByName(out[1])


def cv_headline(fields: DataFrame, scored: DataFrame, group: list[str], cell: str, fold: str, least: int = 10) -> DataFrame:
    """One row: folds, groups and cells with scores, medians over both, and the relative RMSE of all fields of cells of
    `least` fields pooled."""
    big = fields.groupBy(*group, cell).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("pred") - F.col("target"), 2)).alias("e"), F.sum("target").alias("y")).where(F.col("n") >= least)
    pooled = big.agg((100 * ratio(F.sqrt(ratio(F.sum("e"), F.sum("n"))), ratio(F.sum("y"), F.sum("n")))).alias("pooled_rrmse"))
    folds = fields.agg(F.count_distinct(fold).alias("folds"))
    own, cells = F.col(cell).isNull(), F.col(cell).isNotNull()
    medians = scored.agg(F.count_if(own).alias("n_groups"), F.count_if(cells).alias("n_cells"), *[F.median(F.when(c, F.col(v))).alias(f"{n}_{v}") for n, c in (("group", own), ("cell", cells)) for v in ("r2", "rrmse")])
    return folds.crossJoin(medians).crossJoin(pooled)  # one row each


def cv_summary(scored: DataFrame, cell: str) -> DataFrame:
    """Medians over groups and over cells."""
    level = F.when(F.col(cell).isNull(), F.lit("group")).otherwise(F.lit("cell"))
    return scored.groupBy(level.alias("level")).agg(F.median("r2").alias("r2"), F.median("rrmse").alias("rrmse"), F.median("bias").alias("bias"), F.sum("n").alias("n"), F.count("*").alias("n_rows"))


def paired(a: DataFrame, b: DataFrame, metric: str, keys: list[str], lower_is_better: bool = False) -> DataFrame:
    """Median difference a - b over common keys, how often a is better, and how many keys are common."""
    d = a.select(*keys, F.col(metric).alias("_a")).join(b.select(*keys, F.col(metric).alias("_b")), keys).where("_a is not null and _b is not null").select((F.col("_a") - F.col("_b")).alias("d"))
    better = F.round("d", 9) < 0 if lower_is_better else F.round("d", 9) > 0  # sums differ in the last digits by order
    return d.agg(F.median("d").alias("median_diff"), F.count_if(better).alias("better"), F.count("*").alias("n"))


def murphy(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean squared error split into level, scale and scatter (all population moments), shares, and R2 if the level were right."""
    y, p = F.col("target"), F.col("pred")
    s = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(y).alias("my"), F.avg(p).alias("mp"), F.stddev_pop(y).alias("sy"), F.stddev_pop(p).alias("sp"), F.coalesce(corr(y, p), F.lit(0.0)).alias("r"), F.avg(F.pow(p - y, 2)).alias("mse"))
    s = s.withColumn("level", F.pow(F.col("mp") - F.col("my"), 2)).withColumn("scale", F.pow(F.col("sp") - F.col("r") * F.col("sy"), 2)).withColumn("scatter", (1 - F.col("r") * F.col("r")) * F.col("sy") * F.col("sy"))
    share = lambda c: ratio(c, "mse").alias(f"{c}_share")
    return s.select(*by, "n", "mse", "level", "scale", "scatter", share("level"), share("scale"), share("scatter"), (1 - ratio(F.col("mse") - F.col("level"), F.pow("sy", 2))).alias("r2_level_fixed"))


def screening_stats(preds: DataFrame, field: str, by: list[str]) -> DataFrame:
    """Per subset: field R2, field correlation, share of the error that is a constant offset, correlation within fields."""
    fields = field_level(preds, [field, *by])
    e = F.col("pred") - F.col("target")
    top = scores(fields, by).join(fields.groupBy(*by).agg(corr("target", "pred").alias("corr"), ratio(F.pow(F.avg(e), 2), F.avg(e * e)).alias("offset_share")), by)
    w = Window.partitionBy(field)
    inside = preds.select(*by, (F.col("target") - F.avg("target").over(w)).alias("y"), (F.col("pred") - F.avg("pred").over(w)).alias("p"))
    return top.join(inside.groupBy(*by).agg(corr("y", "p").alias("within_corr")), by)


def screening_summary(stats: DataFrame, variant: str, member: str, subset: list[str], reference: str) -> DataFrame:
    """Per variant: medians over subsets of the members' mean, their spread, and subsets above the reference variant."""
    per = stats.groupBy(variant, *subset).agg(F.avg("r2").alias("r2"), F.stddev_pop("r2").alias("spread"))
    # The reference comes from the same pass and is compared to nine digits: no variant is above itself by the order of summing.
    ref = F.max(F.when(F.col(variant) == reference, F.round("r2", 9))).over(Window.partitionBy(*subset))
    return per.withColumn("_ref", ref).groupBy(variant).agg(F.median("r2").alias("r2"), F.median("spread").alias("spread"), F.count_if(F.round("r2", 9) > F.col("_ref")).alias("above"), F.count("*").alias("n"))


def keep_decision(summary: DataFrame, variant: str, reference: str) -> DataFrame:
    """A variant is kept if it beats the reference by more than the larger of both spreads."""
    ref = summary.where(F.col(variant) == reference).select(F.col("r2").alias("_r"), F.col("spread").alias("_s"))
    return summary.crossJoin(F.broadcast(ref)).withColumn("keep", F.coalesce(F.round("r2", 9) > F.round(F.col("_r") + F.greatest("_s", "spread"), 9), F.lit(False))).drop("_r", "_s")


def balanced_mse(preds: DataFrame, field: str, by: list[str]) -> DataFrame:
    """Mean over fields of their mean squared error."""
    per = preds.groupBy(field, *by).agg(F.avg(F.pow(F.col("pred") - F.col("target"), 2)).alias("mse"))
    return per.groupBy(*by).agg(F.avg("mse").alias("mse"), F.count("*").alias("n_fields"))


def field_z_mse(fields: DataFrame, sd: DataFrame, group: list[str], least: int = 5) -> DataFrame:
    """Squared field error over the group's deviation, mean by group, then over groups of `least` fields (all, if none has)."""
    z = fields.join(sd, group).withColumn("z2", F.pow(ratio(F.col("pred") - F.col("target"), "sd"), 2))
    g = z.groupBy(*group).agg(F.avg("z2").alias("z2"), F.count("*").alias("n"))
    big = F.avg(F.when(F.col("n") >= least, F.col("z2")))
    return g.agg(F.coalesce(big, F.avg("z2")).alias("z_mse"), F.count_if(F.col("n") >= least).alias("n_groups"))


def fallback_stats(df: DataFrame, value: str, by: list[str], want: DataFrame) -> DataFrame:
    """For each row of `want` (with columns `by`): mean and deviation of its group, of ever coarser prefixes, or of all."""
    out = want
    levels = [by[:k] for k in range(len(by), 0, -1)]
    for k, keys in enumerate(levels):
        s = df.groupBy(*keys).agg(F.avg(value).alias(f"_m{k}"), F.stddev_samp(value).alias(f"_s{k}"))
        out = out.join(s, keys, "left")
    g = df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    out = out.crossJoin(F.broadcast(g))
    usable = lambda c: F.when(F.col(c) > 0, F.col(c))
    mean = F.coalesce(*[F.col(f"_m{k}") for k in range(len(levels))], F.col("_m"))
    sd = F.coalesce(*[usable(f"_s{k}") for k in range(len(levels))], usable("_s"), F.lit(1.0))
    return out.select(*want.columns, mean.alias("mean"), sd.alias("sd"))


def peak_by_field(steps: DataFrame, field: str, step: str, value: str, least: float = 0.25) -> DataFrame:
    """Highest mean of a value over steps where at least that share of pixels is present."""
    s = steps.groupBy(field, step).agg(F.avg(value).alias("m"), (F.count(value) / F.count("*")).alias("share"))
    return s.where(F.col("share") >= least).groupBy(field).agg(F.max("m").alias("peak"))


def line_baseline(train: DataFrame, test: DataFrame, x: str, y: str, fine: list[str], coarse: list[str], least: int = 5) -> DataFrame:
    """Adds `pred` by a least-squares line per fine group (of `least` rows), else per coarse group, else the mean."""
    fit = lambda by, t: train.where(F.col(x).isNotNull()).groupBy(*by).agg(F.when(F.count("*") >= least, F.regr_slope(y, x)).alias(f"_b{t}"), F.when(F.count("*") >= least, F.regr_intercept(y, x)).alias(f"_a{t}"))
    mean = train.groupBy(*coarse).agg(F.avg(y).alias("_mean"))
    out = test.join(fit(fine, "f"), fine, "left").join(fit(coarse, "c"), coarse, "left").join(mean, coarse, "left")
    line = F.coalesce(F.col("_af") + F.col("_bf") * F.col(x), F.col("_ac") + F.col("_bc") * F.col(x), F.col("_mean"))
    return out.select(*test.columns, line.alias("pred"))


def year_structure(fields: DataFrame, group: list[str], year: str, value: str) -> DataFrame:
    """Share of variance between years (weighted by fields; NULL for a lone year), range of year means, and deviation within
    years: the mean of their sample variances by fields, a year of one field counting as 0."""
    w = Window.partitionBy(*group)
    d = fields.withColumn("_all", F.avg(value).over(w)).withColumn("_var", F.var_samp(value).over(w))
    y = d.groupBy(*group, year).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"), F.max("_all").alias("_all"), F.max("_var").alias("_var"))
    between = F.when(F.count("*") > 1, F.sum(F.col("n") * F.pow(F.col("m") - F.col("_all"), 2)) / F.sum("n"))
    return y.groupBy(*group).agg(F.count("*").alias("n_years"), ratio(between, F.max("_var")).alias("between_share"), (F.max("m") - F.min("m")).alias("mean_range"), F.sqrt(F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("within_sd"))


def year_tracking(fields: DataFrame, group: list[str], year: str) -> DataFrame:
    """How predicted year means follow actual ones: sign agreement of anomalies, correlation, slope."""
    y = fields.groupBy(*group, year).agg(F.avg("target").alias("y"), F.avg("pred").alias("p"))
    w = Window.partitionBy(*group)
    a = y.select(*group, year, (F.col("y") - F.avg("y").over(w)).alias("y"), (F.col("p") - F.avg("p").over(w)).alias("p"))
    return a.groupBy(*group).agg(F.count("*").alias("n_years"), F.count_if(F.signum("y") == F.signum("p")).alias("same_sign"), corr("y", "p").alias("corr"), F.regr_slope("p", "y").alias("slope"))


def seen_flag(rows: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """Adds `seen`: whether the key occurs in the training rows."""
    return rows.join(train.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left").withColumn("seen", F.col("_k").isNotNull()).drop("_k")


def seen_vs_new(rows: DataFrame, by: list[str]) -> DataFrame:
    """Median absolute error of seen and new fields, plain and with the subset's level removed."""
    e = F.col("pred") - F.col("target")
    d = rows.withColumn("_e", e).withColumn("_d", e - F.avg(e).over(Window.partitionBy(*by)))
    return d.groupBy(*by, "seen").agg(F.median(F.abs("_e")).alias("error"), F.median(F.abs("_d")).alias("error_level_removed"), F.count("*").alias("n"))


def gain(a: DataFrame, name: str, base: str, other: str, value: str, keys: list[str]) -> DataFrame:
    """Wins and median difference of a variant over another on common subsets."""
    wide = a.where(F.col(name).isin(base, other)).groupBy(*keys).pivot(name, [base, other]).agg(F.avg(value))
    d = wide.where(F.col(f"`{base}`").isNotNull() & F.col(f"`{other}`").isNotNull()).select((F.col(f"`{other}`") - F.col(f"`{base}`")).alias("d"))
    return d.agg(F.count_if(F.round("d", 9) > 0).alias("wins"), F.count("*").alias("n"), F.median("d").alias("median_diff"))
