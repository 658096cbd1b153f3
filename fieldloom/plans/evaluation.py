"""Queries: metrics, baselines, cross-validation, screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fieldloom.functions.numeric import r6
from fieldloom.operators import metrics as M
from fieldloom.plans.fixtures import Fx
from fieldloom.plans.registry import query


def rounded(df: DataFrame) -> DataFrame:
    """All doubles to six decimals."""
    return df.select(*[r6(F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


R2 = "1 - sum(power({y} - {p}, 2)) / nullif(sum(power({y} - {m}, 2)), 0)"


def r2(y: str = "target", p: str = "pred", m: str = "m") -> str:
    return R2.format(y=y, p=p, m=m)


FIELDS = "fl AS (SELECT field, country, crop, year, avg(target) AS target, avg(pred) AS pred, count(*) AS n_pixels FROM fx_preds GROUP BY field, country, crop, year)"


@query("SELECT field, country, crop, round(avg(target), 6) AS target, round(avg(pred), 6) AS pred, count(*) AS n_pixels FROM fx_preds GROUP BY field, country, crop")
def field_metrics(fx: Fx) -> DataFrame:
    return rounded(M.field_level(fx.preds, ["field", "country", "crop"]))


def _group_sql(level: int, keys: str) -> str:
    on = f"PARTITION BY {keys}" if keys else ""
    sel = keys or "CAST(NULL AS STRING) AS country, CAST(NULL AS STRING) AS crop"
    by = f"GROUP BY {keys}" if keys else ""
    fs = f"SELECT {sel}, round({r2()}, 6) AS field_r2, round(sqrt(avg(power(target - pred, 2))), 6) AS field_rmse, count(*) AS n_fields FROM (SELECT *, avg(target) OVER ({on}) AS m FROM fl) {by}"
    ps = f"SELECT {sel}, round({r2()}, 6) AS pixel_r2, round(sqrt(avg(power(target - pred, 2))), 6) AS pixel_rmse, count(*) AS n_pixels FROM (SELECT *, avg(target) OVER ({on}) AS m FROM fx_preds) {by}"
    return f"SELECT {level} AS level, f.country, f.crop, field_r2, field_rmse, pixel_r2, pixel_rmse, n_fields, n_pixels FROM ({fs}) f JOIN ({ps}) p ON f.country IS NOT DISTINCT FROM p.country AND f.crop IS NOT DISTINCT FROM p.crop"


@query(f"WITH {FIELDS} {_group_sql(0, '')} UNION ALL {_group_sql(1, 'country, crop')}")
def group_metrics(fx: Fx) -> DataFrame:
    return rounded(M.group_metrics(fx.preds, "field", ["country", "crop"]))


@query(f"""WITH l AS (SELECT field, crop, target, 'pred_m0' AS member, pred_m0 AS pred FROM fx_preds UNION ALL SELECT field, crop, target, 'pred_m1', pred_m1 FROM fx_preds),
    f AS (SELECT field, crop, member, avg(target) AS target, avg(pred) AS pred FROM l GROUP BY ALL), w AS (SELECT *, avg(target) OVER (PARTITION BY crop, member) AS m FROM f),
    s AS (SELECT crop, member, {r2()} AS r2, sqrt(avg(power(target - pred, 2))) AS rmse FROM w GROUP BY crop, member)
    SELECT crop, round(avg(r2), 6) AS r2, round(avg(rmse), 6) AS rmse, count(*) AS n_members FROM s GROUP BY crop""")
def member_metrics(fx: Fx) -> DataFrame:
    return rounded(M.member_metrics(fx.preds, ["pred_m0", "pred_m1", "pred_m2"], "field", ["crop"]))


@query(f"""WITH {FIELDS}, a AS (SELECT crop, {r2()} AS pixel_r2, sqrt(avg(power(target - pred, 2))) AS pixel_rmse, count(*) AS n_pixels FROM (SELECT *, avg(target) OVER (PARTITION BY crop) AS m FROM fx_preds) GROUP BY crop),
    b AS (SELECT crop, {r2()} AS field_r2, sqrt(avg(power(target - pred, 2))) AS field_rmse, count(*) AS n_fields FROM (SELECT *, avg(target) OVER (PARTITION BY crop) AS m FROM fl) GROUP BY crop)
    SELECT crop, round(pixel_r2, 6) AS pixel_r2, round(pixel_rmse, 6) AS pixel_rmse, round(field_r2, 6) AS field_r2, round(field_rmse, 6) AS field_rmse, n_fields, n_pixels FROM a JOIN b USING (crop)""")
def metrics_from_sums(fx: Fx) -> DataFrame:
    return rounded(M.scores_from_moments(M.field_moments(fx.preds, "field", ["country", "crop"]), ["crop"]))


@query("""WITH f AS (SELECT field, farm, avg(target) AS target, avg(pred_m0) AS m0, avg(pred_m1) AS m1 FROM fx_preds GROUP BY field, farm)
    SELECT 'same' AS kind, 2 AS n_members, '' AS note, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, true AS usable, count(*) AS n, round(avg(m0 + m1 - 2 * target), 6) AS bias FROM f
    UNION ALL SELECT 'short', 2, 'only 2 members', 0, 0, true, count(*), round(avg(m0 + m1 - 2 * target), 6) FROM f UNION ALL SELECT 'other', 2, '', CAST((SELECT count(*) FROM f WHERE farm % 9 = 0) AS BIGINT), CAST((SELECT count(*) FROM f WHERE farm % 9 = 1) AS BIGINT), false, 0, NULL""")
def member_fields(fx: Fx) -> DataFrame:
    """The first members of a run by field, with the shortage and the check of its set of fields."""
    p, out = fx.preds, None
    for kind, n, preds, expected in (("same", 2, p, p), ("short", 3, p, p), ("other", 2, p.where("farm % 9 <> 0"), p.where("farm % 9 <> 1"))):
        means, check = M.member_fields(preds, expected, "field", n)
        row = check.crossJoin(means.agg(F.count("*").alias("n"), F.avg(F.col("m0") + F.col("m1") - 2 * F.col("target")).alias("bias"))).withColumn("kind", F.lit(kind))  # one row each
        out = row if out is None else out.unionByName(row)
    return rounded(out)


@query("SELECT field, count(*) AS n, round(avg((pred_m0 + pred_m1) / 2), 6) AS mean, round(avg(pred_std), 6) AS sd FROM fx_preds GROUP BY field")
def ensemble_spread(fx: Fx) -> DataFrame:
    mean, sd = M.ensemble(["pred_m0", "pred_m1"])
    return rounded(fx.preds.select("field", mean.alias("m"), sd.alias("s")).groupBy("field").agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.avg("s").alias("sd")))


def _cv(fx: Fx) -> DataFrame:
    return M.cv_scores(M.field_level(fx.preds, ["field", "country", "crop", "year"]), ["country", "crop"], "year", 4)


def _cv_part(keys: str, year: str, cells: str) -> str:
    return f"SELECT country, crop, {year} AS year, count(*) AS n, {r2()} AS r2, 100 * sqrt(avg(power(pred - target, 2))) / nullif(avg(target), 0) AS rrmse, 100 * avg(pred - target) / nullif(avg(target), 0) AS bias, {cells} AS n_cells FROM (SELECT *, avg(target) OVER (PARTITION BY {keys}) AS m, count(*) OVER (PARTITION BY {keys}) AS c FROM fl) WHERE c >= 4 GROUP BY {keys}"


CV = f"{FIELDS}, cv AS ({_cv_part('country, crop', 'CAST(NULL AS BIGINT)', 'count(DISTINCT year)')} UNION ALL {_cv_part('country, crop, year', 'year', 'CAST(1 AS BIGINT)')})"


@query(f"WITH {CV} SELECT country, crop, year, n, round(r2, 6) AS r2, round(rrmse, 6) AS rrmse, round(bias, 6) AS bias, n_cells FROM cv")
def cv_scores(fx: Fx) -> DataFrame:
    return rounded(_cv(fx).select("country", "crop", "year", "n", "r2", "rrmse", "bias", "n_cells"))


@query(f"WITH {CV} SELECT CASE WHEN year IS NULL THEN 'group' ELSE 'cell' END AS level, round(median(r2), 6) AS r2, round(median(rrmse), 6) AS rrmse, round(median(bias), 6) AS bias, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_rows FROM cv GROUP BY 1")
def cv_summary(fx: Fx) -> DataFrame:
    return rounded(M.cv_summary(_cv(fx), "year"))


@query(f"""WITH {CV}, big AS (SELECT count(*) AS n, sum(power(pred - target, 2)) AS e, sum(target) AS y FROM fl GROUP BY country, crop, year HAVING count(*) >= 4)
    SELECT (SELECT count(DISTINCT year) FROM fl) AS folds, CAST(count_if(year IS NULL) AS BIGINT) AS n_groups, CAST(count_if(year IS NOT NULL) AS BIGINT) AS n_cells, round(median(CASE WHEN year IS NULL THEN r2 END), 6) AS group_r2, round(median(CASE WHEN year IS NULL THEN rrmse END), 6) AS group_rrmse,
    round(median(CASE WHEN year IS NOT NULL THEN r2 END), 6) AS cell_r2, round(median(CASE WHEN year IS NOT NULL THEN rrmse END), 6) AS cell_rrmse, round((SELECT 100 * sqrt(sum(e) / nullif(sum(n), 0)) / nullif(sum(y) / nullif(sum(n), 0), 0) FROM big), 6) AS pooled_rrmse FROM cv""")
def cv_headline(fx: Fx) -> DataFrame:
    f = M.field_level(fx.preds, ["field", "country", "crop", "year"])
    return rounded(M.cv_headline(f, _cv(fx), ["country", "crop"], "year", "year", 4))


def _member_scores(fx: Fx, member: str) -> DataFrame:
    f = M.field_level(fx.preds.withColumn("pred", F.col(member)), ["field", "country", "crop"])
    return M.scores(f, ["country", "crop"])


def _member_sql(m: str) -> str:
    return f"SELECT country, crop, {r2()} AS r2 FROM (SELECT *, avg(target) OVER (PARTITION BY country, crop) AS m FROM (SELECT field, country, crop, avg(target) AS target, avg({m}) AS pred FROM fx_preds GROUP BY field, country, crop)) GROUP BY country, crop"


@query(f"SELECT round(median(d), 6) AS median_diff, count_if(round(d, 9) > 0) AS better, count(*) AS n FROM (SELECT a.r2 - b.r2 AS d FROM ({_member_sql('pred_m0')}) a JOIN ({_member_sql('pred_m1')}) b USING (country, crop)) WHERE d IS NOT NULL".replace("count_if(round(d, 9) > 0)", "CAST(count_if(round(d, 9) > 0) AS BIGINT)"))
def cv_paired(fx: Fx) -> DataFrame:
    return rounded(M.paired(_member_scores(fx, "pred_m0"), _member_scores(fx, "pred_m1"), "r2", ["country", "crop"]))


@query(f"WITH u AS (SELECT 'pred_m0' AS variant, * FROM ({_member_sql('pred_m0')}) UNION ALL SELECT 'pred_m1', * FROM ({_member_sql('pred_m1')})) SELECT CAST(count_if(round(d, 9) > 0) AS BIGINT) AS wins, count(*) AS n, round(median(d), 6) AS median_diff FROM (SELECT max(CASE WHEN variant = 'pred_m1' THEN r2 END) - max(CASE WHEN variant = 'pred_m0' THEN r2 END) AS d FROM u GROUP BY country, crop) WHERE d IS NOT NULL")
def ensemble_gain(fx: Fx) -> DataFrame:
    u = _member_scores(fx, "pred_m0").withColumn("variant", F.lit("pred_m0")).unionByName(_member_scores(fx, "pred_m1").withColumn("variant", F.lit("pred_m1")))
    return rounded(M.gain(u, "variant", "pred_m0", "pred_m1", "r2", ["country", "crop"]))


MURPHY = "SELECT country, crop, count(*) AS n, avg(power(pred - target, 2)) AS mse, avg(target) AS my, avg(pred) AS mp, stddev_pop(target) AS sy, stddev_pop(pred) AS sp, CASE WHEN stddev_pop(target) > 1e-12 AND stddev_pop(pred) > 1e-12 THEN covar_pop(target, pred) / (stddev_pop(target) * stddev_pop(pred)) ELSE 0 END AS r FROM fx_preds GROUP BY country, crop"


@query(f"""WITH s AS ({MURPHY}), t AS (SELECT *, power(mp - my, 2) AS level, power(sp - r * sy, 2) AS scale, (1 - r * r) * sy * sy AS scatter FROM s)
    SELECT country, crop, n, round(mse, 6) AS mse, round(level, 6) AS level, round(scale, 6) AS scale, round(scatter, 6) AS scatter, round(level / nullif(mse, 0), 6) AS level_share,
    round(scale / nullif(mse, 0), 6) AS scale_share, round(scatter / nullif(mse, 0), 6) AS scatter_share, round(1 - (mse - level) / nullif(power(sy, 2), 0), 6) AS r2_level_fixed FROM t""")
def murphy_decomposition(fx: Fx) -> DataFrame:
    return rounded(M.murphy(fx.preds, ["country", "crop"]))


CORR = "CASE WHEN stddev_pop({x}) > 1e-12 AND stddev_pop({y}) > 1e-12 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


@query(f"""WITH {FIELDS}, a AS (SELECT country, {r2()} AS r2, sqrt(avg(power(target - pred, 2))) AS rmse, count(*) AS n, {CORR.format(x='target', y='pred')} AS corr, power(avg(pred - target), 2) / nullif(avg(power(pred - target, 2)), 0) AS offset_share FROM (SELECT *, avg(target) OVER (PARTITION BY country) AS m FROM fl) GROUP BY country),
    i AS (SELECT country, target - avg(target) OVER (PARTITION BY field) AS y, pred - avg(pred) OVER (PARTITION BY field) AS p FROM fx_preds), b AS (SELECT country, {CORR.format(x='y', y='p')} AS within_corr FROM i GROUP BY country)
    SELECT country, round(r2, 6) AS r2, round(rmse, 6) AS rmse, n, round(corr, 6) AS corr, round(offset_share, 6) AS offset_share, round(within_corr, 6) AS within_corr FROM a JOIN b USING (country)""")
def screening_stats(fx: Fx) -> DataFrame:
    return rounded(M.screening_stats(fx.preds, "field", ["country"]))


def _screen(fx: Fx) -> DataFrame:
    """Two variants of two members each, scored by country."""
    p = fx.preds
    v = p.select("field", "country", "target", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(m).alias("member"), (F.col(c) + b).alias("pred")) for n, m, c, b in (("base", 0, "pred_m0", 0.0), ("base", 1, "pred_m1", 0.0), ("shift", 0, "pred_m0", 0.5), ("shift", 1, "pred_m1", 0.25))])).alias("x")).select("field", "country", "target", "x.*")
    fields = v.groupBy("field", "country", "variant", "member").agg(F.avg("target").alias("target"), F.avg("pred").alias("pred"))
    return M.screening_summary(M.scores(fields, ["country", "variant", "member"]), "variant", "member", ["country"], "base")


SCREEN = f"""v AS (SELECT field, country, target, 'base' AS variant, 0 AS member, pred_m0 AS pred FROM fx_preds UNION ALL SELECT field, country, target, 'base', 1, pred_m1 FROM fx_preds
    UNION ALL SELECT field, country, target, 'shift', 0, pred_m0 + 0.5 FROM fx_preds UNION ALL SELECT field, country, target, 'shift', 1, pred_m1 + 0.25 FROM fx_preds),
    f AS (SELECT field, country, variant, member, avg(target) AS target, avg(pred) AS pred FROM v GROUP BY ALL), s AS (SELECT country, variant, member, {r2()} AS r2 FROM (SELECT *, avg(target) OVER (PARTITION BY country, variant, member) AS m FROM f) GROUP BY country, variant, member),
    per AS (SELECT variant, country, avg(r2) AS r2, stddev_pop(r2) AS spread FROM s GROUP BY variant, country),
    sm AS (SELECT p.variant, median(p.r2) AS r2, median(p.spread) AS spread, CAST(count_if(round(p.r2, 9) > round(q.r2, 9)) AS BIGINT) AS above, count(*) AS n FROM per p LEFT JOIN (SELECT * FROM per WHERE variant = 'base') q ON p.country = q.country GROUP BY p.variant)"""


@query(f"WITH {SCREEN} SELECT variant, round(r2, 6) AS r2, round(spread, 6) AS spread, above, n FROM sm")
def screening_summary(fx: Fx) -> DataFrame:
    return rounded(_screen(fx))


@query(f"WITH {SCREEN} SELECT a.variant, round(a.r2, 6) AS r2, round(a.spread, 6) AS spread, a.above, a.n, coalesce(round(a.r2, 9) > round(b.r2 + greatest(b.spread, a.spread), 9), false) AS keep FROM sm a, (SELECT * FROM sm WHERE variant = 'base') b")
def screening_decision(fx: Fx) -> DataFrame:
    return rounded(M.keep_decision(_screen(fx), "variant", "base"))


@query("SELECT country, round(avg(mse), 6) AS mse, count(*) AS n_fields FROM (SELECT field, country, avg(power(pred - target, 2)) AS mse FROM fx_preds GROUP BY field, country) GROUP BY country")
def balanced_mse(fx: Fx) -> DataFrame:
    return rounded(M.balanced_mse(fx.preds, "field", ["country"]))


@query(f"WITH {FIELDS}, g AS (SELECT country, crop, avg(power((pred - target) / nullif(sd, 0), 2)) AS z2, count(*) AS n FROM fl JOIN (SELECT country, crop, stddev_samp(target) AS sd FROM fl GROUP BY country, crop) USING (country, crop) GROUP BY country, crop) SELECT round(coalesce(avg(CASE WHEN n >= 5 THEN z2 END), avg(z2)), 6) AS z_mse, CAST(count_if(n >= 5) AS BIGINT) AS n_groups FROM g")
def field_z_mse(fx: Fx) -> DataFrame:
    f = M.field_level(fx.preds, ["field", "country", "crop"])
    sd = f.groupBy("country", "crop").agg(F.stddev_samp("target").alias("sd"))
    return rounded(M.field_z_mse(f, sd, ["country", "crop"]))


@query("""WITH tr AS (SELECT * FROM fx_fields WHERE year < 1999), te AS (SELECT field, country, crop FROM fx_fields WHERE year >= 1999),
    a AS (SELECT country, crop, avg(yield_mean) AS m, stddev_samp(yield_mean) AS s FROM tr GROUP BY country, crop), b AS (SELECT country, avg(yield_mean) AS m, stddev_samp(yield_mean) AS s FROM tr GROUP BY country), g AS (SELECT avg(yield_mean) AS m, stddev_pop(yield_mean) AS s FROM tr)
    SELECT te.country, te.crop, te.field, round(coalesce(a.m, b.m, g.m), 6) AS mean, round(coalesce(CASE WHEN a.s > 0 THEN a.s END, CASE WHEN b.s > 0 THEN b.s END, CASE WHEN g.s > 0 THEN g.s END, 1.0), 6) AS sd
    FROM te LEFT JOIN a ON te.country = a.country AND te.crop = a.crop LEFT JOIN b ON te.country = b.country CROSS JOIN g""")
def mean_baseline(fx: Fx) -> DataFrame:
    f = fx.fields
    return rounded(M.fallback_stats(f.where("year < 1999"), "yield_mean", ["country", "crop"], f.where("year >= 1999").select("country", "crop", "field")))


@query("""WITH st AS (SELECT field, prow AS step, CASE WHEN disc > 0.0305 THEN z END AS v FROM fx_pixels), s AS (SELECT field, step, avg(v) AS m, count(v) / count(*) AS share FROM st GROUP BY field, step), pk AS (SELECT field, max(m) AS peak FROM s WHERE share >= 0.25 GROUP BY field),
    d AS (SELECT f.field, f.country, f.crop, f.year, f.yield_mean, pk.peak FROM fx_fields f LEFT JOIN pk ON f.field = pk.field), tr AS (SELECT * FROM d WHERE year < 1999),
    ff AS (SELECT country, crop, CASE WHEN count(*) >= 5 THEN regr_slope(yield_mean, peak) END AS b, CASE WHEN count(*) >= 5 THEN regr_intercept(yield_mean, peak) END AS a FROM tr WHERE peak IS NOT NULL GROUP BY country, crop),
    fc AS (SELECT country, CASE WHEN count(*) >= 5 THEN regr_slope(yield_mean, peak) END AS b, CASE WHEN count(*) >= 5 THEN regr_intercept(yield_mean, peak) END AS a FROM tr WHERE peak IS NOT NULL GROUP BY country), mn AS (SELECT country, avg(yield_mean) AS m FROM tr GROUP BY country)
    SELECT d.field, round(d.peak, 6) AS peak, round(coalesce(ff.a + ff.b * peak, fc.a + fc.b * peak, mn.m), 6) AS pred FROM d LEFT JOIN ff ON d.country = ff.country AND d.crop = ff.crop LEFT JOIN fc ON d.country = fc.country LEFT JOIN mn ON d.country = mn.country WHERE d.year >= 1999""")
def peak_ols_baseline(fx: Fx) -> DataFrame:
    steps = fx.pixels.select("field", F.col("prow").alias("step"), F.when(F.col("disc") > 0.0305, F.col("z")).alias("v"))
    d = fx.fields.select("field", "country", "crop", "year", "yield_mean").join(M.peak_by_field(steps, "field", "step", "v"), "field", "left")
    return rounded(M.line_baseline(d.where("year < 1999"), d.where("year >= 1999"), "peak", "yield_mean", ["country", "crop"], ["country"]).select("field", "peak", "pred"))


@query("""WITH d AS (SELECT *, avg(yield_mean) OVER (PARTITION BY country) AS al, var_samp(yield_mean) OVER (PARTITION BY country) AS va FROM fx_fields), y AS (SELECT country, year, count(*) AS n, avg(yield_mean) AS m, coalesce(var_samp(yield_mean), 0) AS v, max(al) AS al, max(va) AS va FROM d GROUP BY country, year)
    SELECT country, count(*) AS n_years, round(CASE WHEN count(*) > 1 THEN sum(n * power(m - al, 2)) / sum(n) / nullif(max(va), 0) END, 6) AS between_share, round(max(m) - min(m), 6) AS mean_range, round(sqrt(sum(n * v) / sum(n)), 6) AS within_sd FROM y GROUP BY country""")
def year_structure(fx: Fx) -> DataFrame:
    return rounded(M.year_structure(fx.fields, ["country"], "year", "yield_mean"))


@query(f"""WITH {FIELDS}, y AS (SELECT country, year, avg(target) AS y, avg(pred) AS p FROM fl GROUP BY country, year), a AS (SELECT country, y - avg(y) OVER (PARTITION BY country) AS y, p - avg(p) OVER (PARTITION BY country) AS p FROM y)
    SELECT country, count(*) AS n_years, CAST(count_if(sign(y) = sign(p)) AS BIGINT) AS same_sign, round({CORR.format(x='y', y='p')}, 6) AS corr, round(regr_slope(p, y), 6) AS slope FROM a GROUP BY country""")
def year_level_tracking(fx: Fx) -> DataFrame:
    return rounded(M.year_tracking(M.field_level(fx.preds, ["field", "country", "crop", "year"]), ["country"], "year"))


@query(f"""WITH {FIELDS}, r AS (SELECT fl.*, f.farm % 20 < 10 OR f.year < 1998 AS x, f.farm FROM fl JOIN fx_fields f USING (field)), tr AS (SELECT DISTINCT farm FROM r WHERE year < 1997 AND farm % 3 > 0), te AS (SELECT r.*, tr.farm IS NOT NULL AS seen, pred - target AS e, pred - target - avg(pred - target) OVER (PARTITION BY country) AS d FROM (SELECT fl.*, f.farm FROM fl JOIN fx_fields f USING (field) WHERE fl.year >= 1999) r LEFT JOIN tr ON r.farm = tr.farm)
    SELECT country, seen, round(median(abs(e)), 6) AS error, round(median(abs(d)), 6) AS error_level_removed, count(*) AS n FROM te GROUP BY country, seen""")
def seen_vs_new(fx: Fx) -> DataFrame:
    f = M.field_level(fx.preds, ["field", "farm", "country", "crop", "year"])
    return rounded(M.seen_vs_new(M.seen_flag(f.where("year >= 1999"), f.where("year < 1997 and farm % 3 > 0"), "farm"), ["country"]))


@query("SELECT field, target, pred, n_pixels FROM (SELECT field, round(avg(target), 6) AS target, round(avg(pred), 6) AS pred, count(*) AS n_pixels, row_number() OVER (ORDER BY round(abs(avg(pred) - avg(target)), 6) DESC, field) AS k FROM fx_preds GROUP BY field) WHERE k <= 25")
def worst_fields(fx: Fx) -> DataFrame:
    f = M.field_level(fx.preds, ["field"])
    return rounded(f.orderBy(r6(F.abs(F.col("pred") - F.col("target"))).desc(), "field").limit(25))


@query(f"SELECT field, count(*) AS n, round(avg(target), 6) AS target, round(avg(pred), 6) AS pred, round(sqrt(avg(power(pred - target, 2))), 6) AS rmse, round({CORR.format(x='target', y='pred')}, 6) AS corr, round(quantile_cont(target, 0.02), 6) AS lo, round(quantile_cont(target, 0.98), 6) AS hi FROM fx_preds GROUP BY field")
def field_panel(fx: Fx) -> DataFrame:
    from fieldloom.functions.numeric import corr

    return rounded(fx.preds.groupBy("field").agg(F.count("*").alias("n"), F.avg("target").alias("target"), F.avg("pred").alias("pred"), F.sqrt(F.avg(F.pow(F.col("pred") - F.col("target"), 2))).alias("rmse"), corr("target", "pred").alias("corr"), F.percentile("target", 0.02).alias("lo"), F.percentile("target", 0.98).alias("hi")))
