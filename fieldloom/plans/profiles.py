"""Queries: profiles of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldloom.operators import profile as P
from fieldloom.operators import timeaxis as W
from fieldloom.plans.evaluation import CORR, rounded
from fieldloom.plans.fixtures import Fx
from fieldloom.plans.registry import query


@query("SELECT field, min(farm) AS farm, min(year) AS year, count(*) AS n_pixels, round(avg(target), 6) AS yield_mean, CAST(CASE WHEN count(DISTINCT farm) > 1 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT year) > 1 THEN 1 ELSE 0 END AS INTEGER) AS not_constant FROM fx_pixels GROUP BY field")
def field_table(fx: Fx) -> DataFrame:
    return rounded(P.field_table(fx.pixels, "field", ["farm", "year"], "target"))


DS = "SELECT {sel}, count(DISTINCT physical_field) AS n_physical, count(DISTINCT farm) AS n_farms, count(DISTINCT region) AS n_regions, CAST(sum(n_pixels) AS BIGINT) AS n_pixels, min(year) AS first_year, max(year) AS last_year, round(avg(yield_mean), 6) AS mean, round(stddev_samp(yield_mean), 6) AS sd FROM fx_fields GROUP BY {by}"


@query(DS.format(sel="country, crop", by="country, crop") + " UNION ALL " + DS.format(sel="country, NULL", by="country"))
def dataset_table(fx: Fx) -> DataFrame:
    return rounded(P.dataset_table(fx.fields, ["country", "crop"]))


@query("SELECT label, step, round(avg(value), 6) AS value_mean, count(value) AS value_n FROM fx_series GROUP BY label, step")
def field_steps(fx: Fx) -> DataFrame:
    return rounded(P.field_steps(fx.series, "label", "step", ["value"]))


@query("SELECT feature, label, round(count(v) / count(*), 6) AS present, round(median(v), 6) AS median FROM (SELECT label, 'value' AS feature, CASE WHEN value > -0.1 THEN value END AS v FROM fx_series UNION ALL SELECT label, 'step', step FROM fx_series) GROUP BY feature, label")
def coverage_by_group(fx: Fx) -> DataFrame:
    return rounded(P.coverage(fx.series.withColumn("value", F.when(F.col("value") > -0.1, F.col("value"))), ["label"], ["value", "step"]))


Q = "quantile_cont({v}, {q})"


@query("SELECT source, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS sd, " + ", ".join(f"round(quantile_cont(n_chars, {q}), 6) AS q{round(q * 100):02d}" for q in (0.01, 0.05, 0.5, 0.95, 0.99)) + " FROM fx_docs GROUP BY source")
def target_quantiles(fx: Fx) -> DataFrame:
    return rounded(P.quantiles(fx.docs, ["source"], "n_chars", [0.01, 0.05, 0.5, 0.95, 0.99]))


@query("SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS sd, " + ", ".join(f"round(quantile_cont(n_chars, {q}), 6) AS q{round(q * 100):02d}" for q in (0.0, 0.25, 0.5, 0.75, 1.0)) + " FROM fx_docs GROUP BY lang")
def described_groups(fx: Fx) -> DataFrame:
    return rounded(P.described(fx.docs, ["lang"], "n_chars"))


@query("SELECT lang, round(var_samp(f) / nullif(var_samp(n_chars), 0), 6) AS between_share, count(*) AS n FROM (SELECT *, avg(n_chars) OVER (PARTITION BY lang, source) AS f FROM fx_docs) GROUP BY lang")
def variance_share(fx: Fx) -> DataFrame:
    return rounded(P.variance_share(fx.docs, "source", "n_chars", ["lang"]))


@query("WITH e AS (SELECT quantile_cont(n_chars, 0.005) AS lo, quantile_cont(n_chars, 0.995) AS hi FROM fx_docs), b AS (SELECT lang, CAST(least(19, floor((n_chars - lo) / ((hi - lo) / 20))) AS INTEGER) AS bin, (hi - lo) / 20 AS w FROM fx_docs, e WHERE n_chars >= lo AND n_chars <= hi), c AS (SELECT lang, bin, count(*) AS n, max(w) AS w FROM b GROUP BY lang, bin) SELECT lang, bin, n, round(n / (sum(n) OVER (PARTITION BY lang) * w), 6) AS density FROM c")
def histogram(fx: Fx) -> DataFrame:
    return rounded(P.histogram(fx.docs, ["lang"], "n_chars", 20, (0.005, 0.995)))


@query("WITH l AS (SELECT label, 'value' AS feature, value AS v FROM fx_series UNION ALL SELECT label, 'square', value * value FROM fx_series), o AS (SELECT feature, label, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM l GROUP BY feature, label) SELECT o.feature, o.label, round(o.median, 6) AS median, round(o.iqr, 6) AS iqr, round((o.median - r.median) / nullif(r.iqr, 0), 6) AS shift FROM o LEFT JOIN o r ON o.feature = r.feature AND r.label = (SELECT min(label) FROM fx_series)")
def feature_shift(fx: Fx) -> DataFrame:
    return rounded(P.feature_shift(fx.series.withColumn("square", F.col("value") * F.col("value")), "label", ["value", "square"], fx.series.agg(F.min("label")).first()[0]))


HALF = "CASE WHEN value > 0 THEN value END"


def _half(fx: Fx) -> DataFrame:
    return fx.series.withColumn("value", F.when(F.col("value") > 0, F.col("value")))


@query(f"SELECT label, step, round(avg(CASE WHEN {HALF} IS NULL THEN 0 ELSE 1 END), 6) AS valid FROM fx_series GROUP BY label, step")
def valid_per_step(fx: Fx) -> DataFrame:
    return rounded(P.valid_per_step(_half(fx), ["label"], "step", "value"))


@query(f"SELECT n_valid, count(*) AS n FROM (SELECT vec_id, count({HALF}) AS n_valid FROM fx_series GROUP BY vec_id) GROUP BY n_valid")
def valid_steps(fx: Fx) -> DataFrame:
    return P.valid_steps(_half(fx), ["vec_id"], "value")


@query("SELECT label, step, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(*) AS n FROM (SELECT vec_id, label, step, avg(value) AS v FROM fx_series GROUP BY ALL) GROUP BY label, step")
def seasonal_profiles(fx: Fx) -> DataFrame:
    return rounded(P.seasonal_profile(fx.series, "vec_id", "label", "step", "value"))


@query(f"WITH d AS (SELECT step, value AS x, vec_id % 17 + value AS y, value - avg(value) OVER (PARTITION BY label, step) AS dx, vec_id % 17 + value - avg(vec_id % 17 + value) OVER (PARTITION BY label, step) AS dy FROM fx_series) SELECT step, count(*) AS n, round(CASE WHEN count(*) > 5 THEN {CORR.format(x='x', y='y')} END, 6) AS between, round(CASE WHEN count(*) > 5 THEN {CORR.format(x='dx', y='dy')} END, 6) AS within FROM d GROUP BY step".replace("AS between", 'AS "between"'))
def step_correlation(fx: Fx) -> DataFrame:
    return rounded(P.step_correlation(fx.series.withColumn("y", F.col("vec_id") % 17 + F.col("value")), "label", "step", "value", "y"))


SOIL = ["clay_0_5", "clay_100_200", "sand_0_5", "silt_0_5"]


@query("WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, pixel % 50 + clay_0_5 AS y FROM fx_soil" for c in SOIL) + f"), s AS (SELECT feature, {CORR.format(x='v', y='y')} AS r, count(DISTINCT v) AS n_unique FROM l GROUP BY feature) SELECT feature, round(r, 6) AS r, n_unique FROM s ORDER BY round(abs(coalesce(r, 0)), 9) DESC, feature LIMIT 3")
def static_ranking(fx: Fx) -> DataFrame:
    return rounded(P.ranking(fx.soil.withColumn("y", F.col("pixel") % 50 + F.col("clay_0_5")), SOIL, "y", 3))


@query("SELECT country, CAST(count_if(v IS NULL) AS BIGINT) AS missing, CAST(count_if(v <= 0) AS BIGINT) AS not_positive, CAST(count_if(v > 20) AS BIGINT) AS too_large FROM (SELECT country, CASE WHEN farm % 13 = 0 THEN NULL ELSE yield_mean - farm % 30 END AS v FROM fx_fields) GROUP BY country")
def label_sanity(fx: Fx) -> DataFrame:
    # Means of whole numbers are whole whatever the order of their sum.
    d = fx.fields.withColumn("v", F.when(F.col("farm") % 13 != 0, F.round("yield_mean", 9) - F.col("farm") % 30))
    return P.label_sanity(d, ["country"], "v", 20)


JSON_KINDS = ", ".join(f"CAST(count_if(k = '{k}') AS BIGINT) AS {k}s" for k in ("null", "array", "object", "boolean", "string"))


@query("WITH v AS (SELECT 'k' AS key, json_extract_string(props, '$.k') AS v FROM events UNION ALL SELECT 'price', CAST(l_discount - 0.05 AS STRING) FROM lineitem UNION ALL SELECT 'tags', '[1,2]' FROM region UNION ALL SELECT 'name', n_name FROM nation), t AS (SELECT *, TRY_CAST(v AS DOUBLE) AS n, CASE WHEN v IS NULL THEN 'null' WHEN v LIKE '[%' THEN 'array' WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 'number' ELSE 'string' END AS k, CASE WHEN v LIKE '[%' THEN CAST(2 AS BIGINT) END AS l FROM v) SELECT key, count(*) AS present, count(n) AS numbers, " + JSON_KINDS + ", round(min(n), 6) AS lo, round(median(n), 6) AS mid, round(max(n), 6) AS hi, min(l) AS shortest, max(l) AS longest, count(DISTINCT v) AS n_values FROM t GROUP BY key")
def schema_profile(fx: Fx) -> DataFrame:
    price = fx.lineitem.select(F.concat(F.lit('{"price": '), (F.col("l_discount") - 0.05).cast("string"), F.lit("}")).alias("props"))
    tags = fx.region.select(F.lit('{"tags": [1,2]}').alias("props"))
    names = fx.nation.select(F.to_json(F.struct(F.col("n_name").alias("name"))).alias("props"))
    return rounded(P.json_profile(fx.events.select("props").unionByName(price).unionByName(tags).unionByName(names), "props"))


@query("SELECT field, min(farm) AS farm, min(year) AS year, count(*) AS n_pixels, round(avg(target), 6) AS yield_mean, round(stddev_pop(target), 6) AS yield_sd, round(avg(z), 6) AS z_mean, round(avg(disc), 6) AS disc_mean FROM fx_pixels GROUP BY field")
def field_aggregates(fx: Fx) -> DataFrame:
    return rounded(P.field_aggregates(fx.pixels, "field", ["farm", "year"], "target", ["z", "disc"]))


@query("SELECT p.field, count(*) AS n_pixels, count(p.target) AS n_labelled, min(prow) AS min_prow, max(prow) AS max_prow, min(pcol) AS min_pcol, max(pcol) AS max_pcol, round(avg(p.target), 6) AS mean, round(stddev_samp(p.target), 6) AS sd, round(min(p.target), 6) AS lo, round(max(p.target), 6) AS hi, round(quantile_cont(p.target, 0.05), 6) AS q05, round(median(p.target), 6) AS q50, round(quantile_cont(p.target, 0.95), 6) AS q95, CAST(min(s.jan1) + CAST(min(s.sow_day) AS INTEGER) AS DATE) AS seeding_date, CAST(min(s.jan1) + CAST(min(s.harvest_day) AS INTEGER) AS DATE) AS harvesting_date, CAST(min(s.harvest_day) - min(s.sow_day) AS INTEGER) AS season_days FROM fx_pixels p LEFT JOIN fx_season s ON p.field = s.field GROUP BY p.field")
def field_years(fx: Fx) -> DataFrame:
    s = fx.season.select("field", F.date_add("jan1", F.col("sow_day").cast("int")).alias("seeding_date"), F.date_add("jan1", F.col("harvest_day").cast("int")).alias("harvesting_date"))
    return rounded(P.field_years(fx.pixels, s, "field", "target", [0.05, 0.5, 0.95]))


@query("WITH c AS (SELECT field, prow, pcol, CASE WHEN n > 1 THEN -1.0 WHEN disc > 0.09 THEN -2.0 ELSE target END AS v FROM fx_pixels) SELECT field, max(prow) - min(prow) + 1 AS height, max(pcol) - min(pcol) + 1 AS width, CAST(count_if(v >= 0) AS BIGINT) AS labelled, count(*) AS n, round(count_if(v >= 0) * 0.01, 6) AS area_ha, round(min(CASE WHEN v >= 0 THEN v END), 6) AS lo, round(avg(CASE WHEN v >= 0 THEN v END), 6) AS mean, round(max(v), 6) AS hi, CAST(count_if(v < 0 AND v <> -1) AS BIGINT) AS odd_negative FROM c GROUP BY field".replace("round(max(v), 6) AS hi", "round(max(CASE WHEN v >= 0 THEN v END), 6) AS hi"))
def raster_info(fx: Fx) -> DataFrame:
    c = fx.pixels.select("field", "prow", "pcol", F.when(F.col("n") > 1, -1.0).when(F.col("disc") > 0.09, -2.0).otherwise(F.col("target")).alias("v"))
    return rounded(P.raster_info(c, ["field"], "v"))


@query("WITH g AS (SELECT field, 'yield' AS layer, max(prow) - min(prow) AS h, max(pcol) - min(pcol) AS w, min(prow) AS t, min(pcol) AS l FROM fx_pixels GROUP BY field UNION ALL SELECT field, 'dem', max(prow) - min(prow), max(pcol) - min(pcol), min(prow), min(pcol) FROM fx_pixels WHERE disc < 0.09 GROUP BY field) SELECT d.field, d.layer, d.h = y.h AND d.w = y.w AND d.t = y.t AND d.l = y.l AS same FROM g d JOIN g y ON d.field = y.field AND y.layer = 'yield' WHERE d.layer = 'dem'")
def same_grid(fx: Fx) -> DataFrame:
    grid = lambda df, name: df.groupBy("field").agg((F.max("prow") - F.min("prow") + 1).alias("height"), (F.max("pcol") - F.min("pcol") + 1).alias("width"), F.min("prow").alias("top"), F.min("pcol").alias("left")).withColumn("layer", F.lit(name))
    return P.same_grid(grid(fx.pixels, "yield").unionByName(grid(fx.pixels.where("disc < 0.09"), "dem")), "field", "layer", "yield")


_IN = "CASE WHEN pixel % 2 = {k} THEN {v} END"


@query("WITH l AS (" + " UNION ALL ".join(f"SELECT pixel, '{c}' AS feature, {c} AS v, pixel % 50 + clay_0_5 AS y FROM fx_soil" for c in SOIL) + f"), s AS (SELECT feature, {CORR.format(x='v', y='y')} AS r, {CORR.format(x=_IN.format(k=0, v='v'), y=_IN.format(k=0, v='y'))} AS r_even, {CORR.format(x=_IN.format(k=1, v='v'), y=_IN.format(k=1, v='y'))} AS r_odd, count(DISTINCT v) AS n_unique FROM l GROUP BY feature) SELECT feature, round(r, 6) AS r, round(r_even, 6) AS r_even, round(r_odd, 6) AS r_odd, n_unique FROM s ORDER BY round(abs(coalesce(r, 0)), 9) DESC, feature LIMIT 3")
def static_ranking_by_source(fx: Fx) -> DataFrame:
    d = fx.soil.withColumn("y", F.col("pixel") % 50 + F.col("clay_0_5")).withColumn("src", F.when(F.col("pixel") % 2 == 0, "even").otherwise("odd"))
    return rounded(P.ranking_by_source(d, SOIL, "y", "src", ["even", "odd"], 3))


@query("SELECT kind, clouds % 10 AS scl, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY kind), 6) AS share FROM fx_scenes GROUP BY kind, clouds % 10")
def class_histogram(fx: Fx) -> DataFrame:
    return rounded(P.class_shares(fx.scenes.withColumn("scl", F.col("clouds") % 10), ["kind"], "scl"))


@query("SELECT field, count(*) AS n, max(day) - min(day) + 1 AS span, round(avg(CASE WHEN temp_mean > 20 THEN 0 ELSE 1 END), 6) AS warm_missing FROM fx_daily GROUP BY field")
def weather_completeness(fx: Fx) -> DataFrame:
    d = fx.daily.withColumn("warm", F.when(F.col("temp_mean") > 20, F.col("temp_mean")))
    return rounded(P.completeness(d, ["field"], "day", ["warm"]))


@query("SELECT l_returnflag, " + ", ".join(f"CAST(count_if(l_linestatus = '{v}') AS BIGINT) AS l_linestatus_{v.lower()}" for v in ("O", "F")) + " FROM lineitem GROUP BY l_returnflag")
def value_counts(fx: Fx) -> DataFrame:
    return P.counts_by_value(fx.lineitem, ["l_returnflag"], "l_linestatus", ["O", "F"])


@query("SELECT coalesce(a.field, b.field) AS field, n_a, n_b, round(n_a / nullif(n_b, 0), 6) AS ratio FROM (SELECT field, count(*) AS n_a FROM fx_pixels WHERE prow > 3 AND farm % 9 > 0 GROUP BY field) a FULL JOIN (SELECT field, count(*) AS n_b FROM fx_pixels GROUP BY field) b ON a.field = b.field")
def raw_reconciliation(fx: Fx) -> DataFrame:
    return rounded(P.matched_ratio(fx.pixels.where("prow > 3 and farm % 9 > 0"), fx.pixels, ["field"]))


@query("SELECT band, count(*) AS n FROM (SELECT farm, 'n' AS band, max(n) - min(n) AS d FROM fx_pixels GROUP BY farm UNION ALL SELECT farm, 'f', max(farm) - min(farm) FROM fx_pixels GROUP BY farm) WHERE d > 2 GROUP BY band")
def static_assertion(fx: Fx) -> DataFrame:
    return P.not_static(fx.pixels.withColumn("f", F.col("farm")), "farm", ["n", "f"], 2)


@query("SELECT farm, round(max(abs(a.target - b.target)), 6) AS difference FROM fx_pixels a JOIN (SELECT field, prow, pcol, target + (prow * 10 + pcol) / 1000 AS target FROM fx_pixels) b ON a.field = b.field AND a.prow = b.prow AND a.pcol = b.pcol GROUP BY farm")
def summary_reconciliation(fx: Fx) -> DataFrame:
    p = fx.pixels.select("field", "farm", "prow", "pcol", "target")
    return rounded(P.largest_difference(p, p.withColumn("target", F.col("target") + (F.col("prow") * 10 + F.col("pcol")) / 1000), ["field", "farm", "prow", "pcol"], "target", "farm"))


FE = "fe AS (SELECT field, country, round(avg(z), 9) AS z, round(abs(avg(pred) - avg(target)), 9) AS error FROM fx_preds GROUP BY field, country)"


def _errors(fx: Fx) -> DataFrame:
    return fx.preds.groupBy("field", "country").agg(F.avg("z").alias("z"), F.abs(F.avg("pred") - F.avg("target")).alias("error"))


@query(f"WITH {FE}, q AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY z, field) AS r, count(*) OVER (PARTITION BY country) AS n FROM fe), b AS (SELECT country, error, CAST(CASE WHEN n = 1 THEN 0 ELSE greatest(0, ceil((r - 1) * 5 / (n - 1)) - 1) END AS INTEGER) AS bin FROM q) SELECT country, bin, count(*) AS n, round(median(error), 6) AS error FROM b GROUP BY country, bin")
def error_quintiles(fx: Fx) -> DataFrame:
    return rounded(P.quintile_errors(_errors(fx), "country", "z", "error"))


@query(f"WITH {FE}, r AS (SELECT country, z, rank() OVER (PARTITION BY country ORDER BY z) + (count(*) OVER (PARTITION BY country, z) - 1) / 2.0 AS x, rank() OVER (PARTITION BY country ORDER BY error) + (count(*) OVER (PARTITION BY country, error) - 1) / 2.0 AS y FROM fe) SELECT country, count(*) AS n, round(CASE WHEN count(*) >= 10 AND count(DISTINCT z) >= 3 THEN {CORR.format(x='x', y='y')} END, 6) AS rho FROM r GROUP BY country")
def spearman_by_group(fx: Fx) -> DataFrame:
    return rounded(P.spearman(_errors(fx), "country", "z", "error"))


@query("SELECT label, 'value' AS feature, CAST(count_if(v IS NULL) AS BIGINT) AS missing, round(quantile_cont(v, 0.01), 6) AS p01, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.99), 6) AS p99 FROM (SELECT label, " + HALF + " AS v FROM fx_series) GROUP BY label")
def band_quality(fx: Fx) -> DataFrame:
    return rounded(P.band_summary(_half(fx), ["label"], ["value"]))


@query("SELECT p_type AS grp, count(*) AS n, min(p_brand) AS first, max(p_brand) AS last FROM (SELECT DISTINCT p_type, p_brand FROM part) GROUP BY p_type")
def band_catalogue(fx: Fx) -> DataFrame:
    return P.catalogue(fx.part.select(F.col("p_type").alias("grp"), "p_brand").distinct(), "grp", "p_brand")


@query(f"WITH s AS (SELECT label, step, median(v) AS m, count(v) / count(*) AS c FROM (SELECT label, step, {HALF} AS v FROM fx_series) GROUP BY label, step) SELECT label, best_step, round(m, 6) AS median FROM (SELECT label, step AS best_step, m, row_number() OVER (PARTITION BY label ORDER BY m DESC, step) AS r FROM s WHERE c > 0.4) WHERE r = 1")
def default_step(fx: Fx) -> DataFrame:
    return rounded(P.best_step(_half(fx), "label", "step", "value", 0.4))


@query("SELECT label, step, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM fx_series GROUP BY label, step")
def step_percentiles(fx: Fx) -> DataFrame:
    return rounded(P.step_band(fx.series, "label", "step", "value"))


@query("SELECT kind, day, min(doy) AS lo, round(median(doy), 6) AS mid, max(doy) AS hi FROM (SELECT kind, day, day + 1 AS doy FROM fx_scenes) GROUP BY kind, day")
def time_axis_profile(fx: Fx) -> DataFrame:
    d = fx.scenes.withColumn("doy", F.col("day") + 1)
    return rounded(d.groupBy("kind", "day").agg(F.min("doy").alias("lo"), F.median("doy").alias("mid"), F.max("doy").alias("hi")))


@query("SELECT w AS width, round(avg(CASE WHEN n > 0 THEN 1 ELSE 0 END), 6) AS observed FROM (SELECT w, g.field, k, count(s.scene) AS n FROM (SELECT DISTINCT field FROM fx_scenes) g CROSS JOIN (SELECT unnest([1, 2, 5]) AS w) CROSS JOIN (SELECT unnest(range(0, 30)) AS k) LEFT JOIN fx_scenes s ON s.field = g.field AND floor(s.day / w) = k WHERE k < 30 / w GROUP BY ALL) GROUP BY w")
def observed_share(fx: Fx) -> DataFrame:
    out = None
    for w in (1, 2, 5):
        full = W.scaffold(fx.scenes.select("field").distinct(), "k", 0, 30 // w)
        have = fx.scenes.select("field", F.floor(F.col("day") / w).alias("k")).distinct().withColumn("seen", F.lit(1))
        s = full.join(have, ["field", "k"], "left").agg(F.lit(w).alias("width"), F.avg(F.coalesce("seen", F.lit(0))).alias("observed"))
        out = s if out is None else out.unionByName(s)
    return rounded(out)


@query("WITH m AS (SELECT day % 6 AS step, CASE WHEN field % 2 = 0 THEN 'a' ELSE 'b' END AS side, field, avg(CASE WHEN clear_share >= 0.5 THEN 1 ELSE 0 END) AS s FROM fx_scenes GROUP BY ALL) SELECT step, round(median(CASE WHEN side = 'a' THEN s END), 6) AS a, round(median(CASE WHEN side = 'b' THEN s END), 6) AS b, round(median(CASE WHEN side = 'a' THEN s END) - median(CASE WHEN side = 'b' THEN s END), 6) AS d FROM m GROUP BY step")
def seasonal_coverage(fx: Fx) -> DataFrame:
    m = fx.scenes.groupBy((F.col("day") % 6).alias("step"), F.when(F.col("field") % 2 == 0, "a").otherwise("b").alias("side"), "field").agg(F.avg((F.col("clear_share") >= 0.5).cast("int")).alias("s"))
    return rounded(m.groupBy("step").pivot("side", ["a", "b"]).agg(F.median("s")).withColumn("d", F.col("a") - F.col("b")))
