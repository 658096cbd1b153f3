"""Queries: scalar projections, filters, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldloom.functions import scalars as P
from fieldloom.functions.numeric import band
from fieldloom.operators import filters as L
from fieldloom.plans.evaluation import rounded
from fieldloom.plans.fixtures import Fx
from fieldloom.plans.registry import query


@query("SELECT l_returnflag AS code, label, count(*) AS n FROM lineitem LEFT JOIN fx_codes ON l_returnflag = code GROUP BY 1, 2")
def decode_codes(fx: Fx) -> DataFrame:
    codes = fx.codes.withColumnRenamed("code", "l_returnflag")
    return P.decode(fx.lineitem.select("l_returnflag"), codes, "l_returnflag", "label", "name").groupBy(F.col("l_returnflag").alias("code"), F.col("name").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag NOT IN (SELECT code FROM fx_codes) GROUP BY l_returnflag")
def unknown_codes(fx: Fx) -> DataFrame:
    return P.unknown_codes(fx.lineitem, fx.codes.withColumnRenamed("code", "l_returnflag"), "l_returnflag")


DN = "CAST(CASE WHEN l_partkey % 11 = 0 THEN 65535 ELSE l_partkey * 7 % 9000 END AS BIGINT)"


@query(f"WITH d AS (SELECT l_orderkey % 50 AS g, CASE WHEN {DN} <> 65535 THEN {DN} / 10000.0 END AS a, CASE WHEN l_suppkey % 9 = 0 THEN 0.0 ELSE l_suppkey * 31 % 5000 / 10000.0 END AS b FROM lineitem) SELECT g, count(*) AS n, count(a) AS observed, round(avg(a), 6) AS refl, round(avg(CASE WHEN a + b <> 0 THEN greatest(-1.0, least(1.0, (a - b) / (a + b))) END), 6) AS nd FROM d GROUP BY g")
def spectral_indices(fx: Fx) -> DataFrame:
    dn = F.when(F.col("l_partkey") % 11 == 0, 65535).otherwise(P.saturate(F.col("l_partkey") * 7 % 9000))
    d = fx.lineitem.select((F.col("l_orderkey") % 50).alias("g"), P.reflectance(dn).alias("a"), F.when(F.col("l_suppkey") % 9 == 0, 0.0).otherwise(F.col("l_suppkey") * 31 % 5000 / 10000.0).alias("b"))
    return rounded(d.groupBy("g").agg(F.count("*").alias("n"), F.sum(P.observed("a")).alias("observed"), F.avg("a").alias("refl"), F.avg(P.normalized_difference("a", "b")).alias("nd")))


def _lai_sql() -> str:
    """The network written out: reflectances of fx_pixels, scaled, five neurons, and the output."""
    raw = ", ".join(f"0.02 + (prow * {3 + k} + pcol * {5 + 2 * k} + farm) % 40 / 200.0E0 AS b{k}" for k in range(8)) + ", 0.5 + tax * 4 AS b9"
    scaled = ", ".join(f"2 * (b{k} - {P.LAI_LOW[k]}) / ({P.LAI_HIGH[k]} - {P.LAI_LOW[k]}) - 1 AS x{k}" for k in (*range(8), 9)) + f", 2 * (cos(radians(5)) - {P.LAI_LOW[8]}) / (1 - {P.LAI_LOW[8]}) - 1 AS x8"
    neurons = ", ".join(f"tanh({w[0]} + " + " + ".join(f"({w[k + 1]}) * x{k}" for k in range(10)) + f") AS h{i}" for i, w in enumerate(P.LAI_HIDDEN))
    out = f"({P.LAI_OUT[0]} + " + " + ".join(f"({w}) * h{i}" for i, w in enumerate(P.LAI_OUT[1:])) + ")"
    return f"WITH r AS (SELECT field, {raw} FROM fx_pixels), x AS (SELECT field, {scaled} FROM r), h AS (SELECT field, {neurons} FROM x) SELECT field, round(avg(greatest(0, least(8, ({out} + 1) / 2 * ({P.LAI_SPAN[1]} - {P.LAI_SPAN[0]}) + {P.LAI_SPAN[0]}))), 6) AS lai, count(*) AS n FROM h GROUP BY field"


@query(_lai_sql())
def leaf_area(fx: Fx) -> DataFrame:
    bands = {b: 0.02 + (F.col("prow") * (3 + k) + F.col("pcol") * (5 + 2 * k) + F.col("farm")) % 40 / 200.0 for k, b in enumerate(P.LAI_BANDS)}
    return rounded(fx.pixels.select("field", P.snap_lai(bands, 0.5 + F.col("tax") * 4).alias("lai")).groupBy("field").agg(F.avg("lai").alias("lai"), F.count("lai").alias("n")))


_DECL = "radians(23.44 * sin(2 * pi() * (year % 365 + 284) / 365))"


@query(f"SELECT farm, year, round(greatest(0.0, least(1.0, sin(radians(farm % 60)) * sin({_DECL}) + cos(radians(farm % 60)) * cos({_DECL}) * cos(radians(-22.5)))), 6) AS cos_sz FROM fx_fields")
def sun_zenith(fx: Fx) -> DataFrame:
    return rounded(fx.fields.select("farm", "year", P.cos_sun_zenith(F.col("farm") % 60, F.col("year") % 365).alias("cos_sz")))


@query("SELECT pixel, round((clay_0_5 * 5 + clay_5_15 * 10 + clay_15_30 * 15) / 30, 6) AS top, round((clay_5_15 * 5 + clay_15_30 * 15 + clay_30_60 * 10) / 30 * 10, 6) AS mid FROM fx_soil")
def soil_depth_mean(fx: Fx) -> DataFrame:
    return rounded(fx.soil.select("pixel", P.soil_property("clay", 0, 30).alias("top"), P.soil_property("clay", 10, 40, 10.0).alias("mid")))


@query("""WITH t AS (SELECT pixel, clay_0_5 + sand_0_5 + silt_0_5 AS t, clay_0_5 AS c0, sand_0_5 AS s0, silt_0_5 AS i0 FROM fx_soil), x AS (SELECT pixel, t, 100 * s0 / t AS s, 100 * i0 / t AS i, 100 * c0 / t AS c FROM t),
    k AS (SELECT pixel, CASE WHEN t <= 0 THEN -1 WHEN i + 1.5 * c < 15 THEN 0 WHEN i + 1.5 * c >= 15 AND i + 2 * c < 30 THEN 1 WHEN (c >= 7 AND c < 20 AND s > 52 AND i + 2 * c >= 30) OR (c < 7 AND i < 50 AND i + 2 * c >= 30) THEN 2
    WHEN c >= 7 AND c < 27 AND i >= 28 AND i < 50 AND s <= 52 THEN 3 WHEN (i >= 50 AND c >= 12 AND c < 27) OR (i >= 50 AND i < 80 AND c < 12) THEN 4 WHEN i >= 80 AND c < 12 THEN 5 WHEN c >= 20 AND c < 35 AND i < 28 AND s > 45 THEN 6
    WHEN c >= 27 AND c < 40 AND s > 20 AND s <= 45 THEN 7 WHEN c >= 27 AND c < 40 AND s <= 20 THEN 8 WHEN c >= 35 AND s > 45 THEN 9 WHEN c >= 40 AND i >= 40 THEN 10 WHEN c >= 40 AND s <= 45 AND i < 40 THEN 11 ELSE -1 END AS texture FROM x)
    SELECT CAST(texture AS INTEGER) AS texture, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM k GROUP BY texture""")
def texture_classes(fx: Fx) -> DataFrame:
    n = fx.soil.count()
    d = fx.soil.select(P.texture_class("sand_0_5", "silt_0_5", "clay_0_5").alias("texture"))
    return rounded(d.groupBy("texture").agg(F.count("*").alias("n"), (F.count("*") / F.lit(float(n))).alias("share")))


@query("""SELECT field, round(avg(0.6108 * exp(17.27 * (temp_mean / 4) / (temp_mean / 4 + 237.3)) - 0.6108 * exp(17.27 * (temp_min / 4) / (temp_min / 4 + 237.3))), 6) AS vpd, round(avg(greatest(0.0, 0.6108 * exp(17.27 * (temp_min / 4) / (temp_min / 4 + 237.3)) - 0.6108 * exp(17.27 * (temp_mean / 4) / (temp_mean / 4 + 237.3)))), 6) AS vpd_clamped,
    round(sum(greatest(0.0, temp_mean / 4 - 4)), 6) AS gdd, CAST(sum(CASE WHEN temp_min / 4 - 1 < 0 THEN 1 ELSE 0 END) AS BIGINT) AS frost, CAST(sum(CASE WHEN temp_max / 4 > 30 THEN 1 ELSE 0 END) AS BIGINT) AS heat, round(avg((7 * temp_mean + 21 * temp_max + 72 * temp_min) / 100), 6) AS root, round(avg(prec * 1000 + (temp_mean - 273.15) + prec / 1000000), 6) AS units FROM fx_daily GROUP BY field""")
def vpd_gdd(fx: Fx) -> DataFrame:
    t, lo, hi = F.col("temp_mean") / 4, F.col("temp_min") / 4, F.col("temp_max") / 4
    return rounded(fx.daily.groupBy("field").agg(F.avg(P.vapour_deficit(t, lo, False)).alias("vpd"), F.avg(P.vapour_deficit(lo, t, True)).alias("vpd_clamped"), F.sum(P.growing_degrees(t, F.lit("wheat"), {"wheat": 4.0, "maize": 10.0})).alias("gdd"), F.sum(P.frost(lo - 1)).alias("frost"), F.sum(P.heat(hi)).alias("heat"), F.avg(P.root_zone("temp_mean", "temp_max", "temp_min")).alias("root"), F.avg(P.millimetres("prec") + P.celsius("temp_mean") + P.megajoules("prec")).alias("units")))


@query("SELECT field, CAST(crop = 'wheat' AS INTEGER) AS crop_wheat, CAST(crop = 'maize' AS INTEGER) AS crop_maize, CAST(crop = 'rye' AS INTEGER) AS crop_rye FROM fx_fields")
def one_hot(fx: Fx) -> DataFrame:
    return P.one_hot(fx.fields, "crop", ["wheat", "maize", "rye"]).select("field", "crop_wheat", "crop_maize", "crop_rye")


@query("SELECT field, jan1, CAST(date_diff('day', jan1, CAST(concat(CAST(year AS STRING), '-06-01') AS DATE)) - 1 AS INTEGER) AS day, jan1 + CAST(sow_day + 1 AS INTEGER) AS sow_date, concat(strftime(DATE '2001-01-01' + CAST(harvest_day % 365 AS INTEGER), '%d %b'), CASE WHEN harvest_day < 365 THEN ' Y-1' ELSE ' Y' END) AS label FROM fx_season".replace("jan1 + CAST(sow_day + 1 AS INTEGER) AS sow_date", "CAST(jan1 + CAST(sow_day + 1 AS INTEGER) AS DATE) AS sow_date"))
def calendar(fx: Fx) -> DataFrame:
    june = F.make_date("year", F.lit(6), F.lit(1))
    return fx.season.withColumn("year", F.col("year").cast("int")).select("field", "jan1", P.cube_day(june, "jan1").alias("day"), P.cube_date("sow_day", "jan1").alias("sow_date"), P.window_label("harvest_day").alias("label"))


@query("WITH a AS (SELECT c_custkey, c_custkey * 37 % 1800 - 900 AS la, c_custkey * 91 % 3600 - 1800 AS lo FROM customer) SELECT concat(CASE WHEN la < 0 THEN 's' ELSE 'n' END, printf('%05.1f', abs(la) / 10.0), '_', CASE WHEN lo < 0 THEN 'w' ELSE 'e' END, printf('%05.1f', abs(lo) / 10.0)) AS cell, count(*) AS n FROM a GROUP BY 1")
def grid_cells(fx: Fx) -> DataFrame:
    lat, lon = (F.col("c_custkey") * 37 % 1800 - 900) / 10.0, (F.col("c_custkey") * 91 % 3600 - 1800) / 10.0
    return fx.customer.select(P.cell_id(lat, lon).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))


@query("SELECT CAST(floor((x + 0.5) / 20) AS BIGINT) AS qx, CAST(floor((y - 30) / 20) AS BIGINT) AS qy, count(*) AS n FROM fx_footprint GROUP BY 1, 2")
def quantised_cells(fx: Fx) -> DataFrame:
    return fx.footprint.select(P.quantise(F.col("x") + 0.5, 20).alias("qx"), P.quantise(F.col("y") - 30, 20).alias("qy")).groupBy("qx", "qy").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN regexp_matches(p_name, '^red') THEN 'red' WHEN regexp_matches(p_name, 'ring$') THEN 'ring' ELSE 'other' END AS kind, count(*) AS n, CAST(min(regexp_extract(p_brand, '([0-9]+)', 1)) AS STRING) AS first_brand FROM part GROUP BY 1")
def name_groups(fx: Fx) -> DataFrame:
    return fx.part.groupBy(P.name_group("p_name", {"^red": "red", "ring$": "ring"}).alias("kind")).agg(F.count("*").alias("n"), F.min(F.regexp_extract("p_brand", "([0-9]+)", 1)).alias("first_brand"))


@query("WITH s AS (SELECT avg(z) AS m, stddev_pop(z) AS d FROM fx_pixels WHERE year < 1999) SELECT field, round(avg((z - m) / d), 6) AS z, round(max(abs((z - m) / d)), 6) AS top FROM fx_pixels, s GROUP BY field")
def scaler_apply(fx: Fx) -> DataFrame:
    stats = L.scaler(fx.pixels.where("year < 1999"), ["z"])
    return rounded(L.scaled(fx.pixels, stats, ["z"]).groupBy("field").agg(F.avg("z").alias("z"), F.max(F.abs("z")).alias("top")))


@query("SELECT * FROM (SELECT 'target' AS feature, round(avg(target), 6) AS mean, round(stddev_pop(target), 6) AS sd, count(target) AS n FROM fx_pixels UNION ALL SELECT 'z', round(avg(z), 6), round(stddev_pop(z), 6), count(z) FROM fx_pixels UNION ALL SELECT 'flag', 0.0, 1.0, count(*) FROM fx_pixels)")
def scaler_fit(fx: Fx) -> DataFrame:
    return rounded(L.scaler(fx.pixels.withColumn("flag", (F.col("prow") > 4).cast("int")), ["target", "z", "flag"], keep=["flag"]))


@query("SELECT CASE WHEN z > 20 AND z <= 40 THEN 0 WHEN z > 40 AND z <= 60 THEN 1 WHEN z > 60 THEN 2 END AS band, count(*) AS n FROM fx_pixels GROUP BY 1")
def right_closed_bands(fx: Fx) -> DataFrame:
    return fx.pixels.groupBy(band("z", [20, 40, 60, float("inf")]).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT p.field, count(*) AS n FROM fx_pixels p JOIN fx_fields f ON p.field = f.field WHERE f.country IN ('ASIA', 'EUROPE') AND f.crop = 'wheat' AND CAST(f.year AS STRING) IN ('1996', '1999') GROUP BY p.field HAVING true")
def select_rows(fx: Fx) -> DataFrame:
    chosen = L.member_filter(fx.fields, country=["ASIA", "EUROPE"], crop=["wheat"], year=["1996", "1999"])
    return L.rows_of(fx.pixels, chosen, "field").groupBy("field").agg(F.count("*").alias("n"))


@query("SELECT field, count(*) AS n FROM fx_pixels WHERE concat(field, '/', CAST(prow AS STRING)) IN (SELECT concat(field, '/', CAST(prow AS STRING)) FROM fx_pixels GROUP BY field, prow HAVING sum(CASE WHEN disc > 0.0455 THEN 1 ELSE 0 END) >= 4) GROUP BY field")
def min_observed(fx: Fx) -> DataFrame:
    steps = fx.pixels.withColumn("observed", (F.col("disc") > 0.0455).cast("int"))
    return L.min_observed(steps, ["field", "prow"], "observed", 4).groupBy("field").agg(F.count("*").alias("n"))


@query("SELECT crop, count(*) AS n FROM fx_fields WHERE country IN ('ASIA', 'EUROPE', 'AMERICA') AND crop IN (SELECT crop FROM fx_fields WHERE country IN ('ASIA', 'EUROPE', 'AMERICA') GROUP BY crop HAVING count(DISTINCT region) >= 3) GROUP BY crop")
def scope_subset(fx: Fx) -> DataFrame:
    return L.scope_subset(fx.fields, ["ASIA", "EUROPE", "AMERICA"], "region", "crop", 3).groupBy("crop").agg(F.count("*").alias("n"))


@query("SELECT country, crop, count(*) AS n FROM fx_fields GROUP BY country, crop HAVING count(*) >= 30")
def groups_of_size(fx: Fx) -> DataFrame:
    from fieldloom.operators.metrics import min_count

    return min_count(fx.fields, ["country", "crop"], 30).groupBy("country", "crop").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT DISTINCT country, crop, year FROM fx_fields WHERE farm % 7 < 4), v AS (SELECT crop, country, year FROM s) SELECT country, crop FROM v GROUP BY country, crop HAVING count(DISTINCT year) = (SELECT count(DISTINCT year) FROM v)")
def common_subsets(fx: Fx) -> DataFrame:
    v = fx.fields.where("farm % 7 < 4").select("country", "crop", "year").distinct()
    return L.in_all(v, "year", ["country", "crop"])


@query("SELECT country, count(*) AS n, CASE WHEN country IN ('ASIA') THEN NULL ELSE round(avg(yield_mean), 6) END AS yield_mean FROM fx_fields GROUP BY country")
def suppress_private(fx: Fx) -> DataFrame:
    t = fx.fields.groupBy("country").agg(F.count("*").alias("n"), F.avg("yield_mean").alias("yield_mean"))
    return rounded(L.suppressed(t, "country", ["ASIA"], ["yield_mean"]))


@query("WITH i AS (SELECT *, prow > 0 AND prow < 9 AND pcol > 4 AND z > 37 AS inn FROM fx_pixels) SELECT field, count(*) AS n FROM (SELECT *, bool_or(inn) OVER (PARTITION BY field) AS a FROM i) WHERE inn OR NOT a GROUP BY field")
def loss_mask(fx: Fx) -> DataFrame:
    inner = (F.col("prow") > 0) & (F.col("prow") < 9) & (F.col("pcol") > 4) & (F.col("z") > 37)
    return L.inner_or_all(fx.pixels, "field", inner).groupBy("field").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN year < 1999 THEN 'train' ELSE 'test' END AS role, count(*) AS n FROM fx_pixels WHERE year >= 1999 OR z > 40 GROUP BY 1")
def train_only_filter(fx: Fx) -> DataFrame:
    p = fx.pixels.withColumn("role", F.when(F.col("year") < 1999, "train").otherwise("test"))
    return L.on_role(p, "role", "train", F.col("z") > 40).groupBy("role").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(fx: Fx) -> DataFrame:
    return L.duplicates(fx.lineitem.withColumn("l_linenumber", F.col("l_linenumber").cast("bigint")), ["l_orderkey", "l_linenumber"])
