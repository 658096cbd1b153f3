"""Queries: samples, augmentations, set operations and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldloom.operators import resample as R
from fieldloom.operators import tables as T
from fieldloom.plans.evaluation import rounded
from fieldloom.plans.fixtures import Fx
from fieldloom.plans.registry import query
from fieldloom.plans.splitting import UNIT


@query("SELECT field, prow, pcol FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY md5(concat_ws('|', '3', field, CAST(prow AS STRING), CAST(pcol AS STRING))), field, prow, pcol) AS r FROM fx_pixels) WHERE r <= 5")
def sample_per_field(fx: Fx) -> DataFrame:
    return R.per_group(fx.pixels, ["field"], ["field", "prow", "pcol"], 5, 3).select("field", "prow", "pcol")


@query(f"SELECT field, count(*) AS n FROM fx_pixels WHERE {UNIT.format(keys=chr(39) + '4' + chr(39) + ', field, CAST(prow AS STRING), CAST(pcol AS STRING)')} < 0.2 GROUP BY field")
def sample_fraction(fx: Fx) -> DataFrame:
    return R.fraction(fx.pixels, ["field", "prow", "pcol"], 0.2, 4).groupBy("field").agg(F.count("*").alias("n"))


@query("SELECT field, round(max(abs(d)), 6) AS top, count(*) AS n FROM (SELECT field, target - avg(target) OVER (PARTITION BY field) AS d FROM fx_pixels) GROUP BY field")
def demean_within_field(fx: Fx) -> DataFrame:
    return rounded(R.demeaned(fx.pixels, ["field"], "target").groupBy("field").agg(F.max(F.abs("target")).alias("top"), F.count("*").alias("n")))


VEC = "CAST(vec_id AS STRING)"


@query(f"WITH s AS (SELECT vec_id, step + CAST(floor({UNIT.format(keys=chr(39) + '9' + chr(39) + ', ' + VEC)} * 7) AS BIGINT) - 3 AS step, value FROM fx_series), f AS (SELECT vec_id, CAST(t AS BIGINT) AS step FROM (SELECT DISTINCT vec_id FROM fx_series), (SELECT unnest(range(0, 64)) AS t)) SELECT f.step, count(*) AS n, count(s.vec_id) AS observed, round(avg(value), 6) AS mean FROM f LEFT JOIN s ON f.vec_id = s.vec_id AND f.step = s.step GROUP BY f.step")
def augment_shift(fx: Fx) -> DataFrame:
    s = R.shifted(fx.series.select("vec_id", "step", "value"), "vec_id", "step", ["value"], 3, 64, 9)
    return rounded(s.groupBy("step").agg(F.count("*").alias("n"), F.sum("observed").cast("bigint").alias("observed"), F.avg("value").alias("mean")))


@query(f"SELECT vec_id, count(*) AS n, CAST(count_if({UNIT.format(keys=chr(39) + '8' + chr(39) + ', ' + VEC + ', CAST(step AS STRING)')} >= 0.3) AS BIGINT) AS kept FROM fx_series GROUP BY vec_id")
def augment_drop(fx: Fx) -> DataFrame:
    return R.dropped(fx.series, "vec_id", "step", ["value"], 0.3, 8).groupBy("vec_id").agg(F.count("*").alias("n"), F.count("value").alias("kept"))


@query(f"WITH u AS (SELECT vec_id, step, value, {UNIT.format(keys=chr(39) + '6' + chr(39) + ', ' + VEC)} AS u, {UNIT.format(keys=chr(39) + '7' + chr(39) + ', ' + VEC)} AS v FROM fx_series) SELECT vec_id, round(avg(value + 0.1 * sqrt(-2 * ln(greatest(u, 1e-12))) * cos(2 * 3.141592653589793 * v)), 6) AS mean, count(*) AS n FROM u GROUP BY vec_id")
def augment_noise(fx: Fx) -> DataFrame:
    return rounded(R.noisy(fx.series, "vec_id", ["value"], 0.1, 6).groupBy("vec_id").agg(F.avg("value").alias("mean"), F.count("*").alias("n")))


@query(f"SELECT field, min(day + CAST(floor({UNIT.format(keys=chr(39) + '2' + chr(39) + ', CAST(field AS STRING)')} * 5) AS BIGINT) - 2) AS first, count(*) AS n FROM fx_scenes GROUP BY field")
def augment_day_jitter(fx: Fx) -> DataFrame:
    return R.jittered(fx.scenes, "field", "day", 2, 2).groupBy("field").agg(F.min("day").alias("first"), F.count("*").alias("n"))


def _unit(seed: int) -> str:
    return UNIT.format(keys=f"'{seed}', field, CAST(draw AS STRING)")


#: Windows of five cells; a pixel, a turn and a place of each, then the turns written out one by one.
CROP = f"""o AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY prow, pcol) - 1 AS i FROM fx_pixels), b AS (SELECT field, min(prow) AS top, min(pcol) AS lft, max(prow) - min(prow) + 1 AS h, max(pcol) - min(pcol) + 1 AS w, count(*) AS cnt FROM fx_pixels GROUP BY field),
    pk AS (SELECT *, CAST(floor({_unit(5)} * cnt) AS BIGINT) AS i, CAST(floor({_unit(6)} * 8) AS BIGINT) AS t, {_unit(7)} AS u, {_unit(8)} AS v FROM b, (SELECT unnest(range(0, 2)) AS draw)),
    lm AS (SELECT pk.*, CASE WHEN h > 5 THEN greatest(0, prow - top - 4) ELSE h - 5 END AS rl, CASE WHEN h > 5 THEN least(prow - top, h - 5) ELSE 0 END AS rh, CASE WHEN w > 5 THEN greatest(0, pcol - lft - 4) ELSE w - 5 END AS cl, CASE WHEN w > 5 THEN least(pcol - lft, w - 5) ELSE 0 END AS ch FROM pk JOIN o ON pk.field = o.field AND pk.i = o.i),
    x AS (SELECT p.field, draw, t, p.prow - top - rl - CAST(floor(u * (rh - rl + 1)) AS BIGINT) AS r, p.pcol - lft - cl - CAST(floor(v * (ch - cl + 1)) AS BIGINT) AS c FROM lm JOIN fx_pixels p ON p.field = lm.field),
    y AS (SELECT field, draw, CASE t WHEN 0 THEN r WHEN 1 THEN c WHEN 2 THEN 4 - r WHEN 3 THEN 4 - c WHEN 4 THEN r WHEN 5 THEN c WHEN 6 THEN 4 - r ELSE 4 - c END AS r, CASE t WHEN 0 THEN c WHEN 1 THEN 4 - r WHEN 2 THEN 4 - c WHEN 3 THEN r WHEN 4 THEN 4 - c WHEN 5 THEN r WHEN 6 THEN c ELSE 4 - r END AS c FROM x WHERE r BETWEEN 0 AND 4 AND c BETWEEN 0 AND 4)"""


@query(f"WITH {CROP} SELECT field, CAST(draw AS INTEGER) AS draw, count(*) AS n, CAST(sum(r * 7 + c) AS BIGINT) AS mark FROM y GROUP BY field, draw")
def window_crops(fx: Fx) -> DataFrame:
    return R.window_crop(fx.pixels, "field", 5, 2, 5).groupBy("field", "draw").agg(F.count("*").alias("n"), F.sum(F.col("r") * 7 + F.col("c")).alias("mark"))


@query("SELECT field, row_number() OVER (ORDER BY field) - 1 AS code FROM (SELECT DISTINCT field FROM fx_pixels)")
def integer_codes(fx: Fx) -> DataFrame:
    return T.integer_codes(fx.pixels, "field").select("field", F.col("code").cast("bigint").alias("code"))


@query("SELECT farm, year, 'old' AS origin FROM fx_fields WHERE year <> 1997 UNION ALL SELECT farm, year, 'new' FROM fx_fields WHERE year = 1997 AND farm % 2 = 0 UNION ALL SELECT farm, year, 'old' FROM fx_fields WHERE year = 1997 AND farm % 2 = 1")
def concat_override(fx: Fx) -> DataFrame:
    f = fx.fields.select("farm", "year", F.lit("old").alias("origin"))
    return T.replaced(f, f.where("year = 1997 and farm % 2 = 0").withColumn("origin", F.lit("new")), ["farm", "year"])


@query("WITH a AS (SELECT DISTINCT farm FROM fx_fields WHERE farm % 3 > 0), b AS (SELECT DISTINCT farm FROM fx_fields WHERE farm % 4 > 0) SELECT 'left' AS side, farm FROM a WHERE farm NOT IN (SELECT farm FROM b) UNION ALL SELECT 'right', farm FROM b WHERE farm NOT IN (SELECT farm FROM a)")
def set_difference(fx: Fx) -> DataFrame:
    farms = fx.fields.select("farm").distinct()
    return T.symmetric_difference(farms.where("farm % 3 > 0"), farms.where("farm % 4 > 0"))


@query("SELECT DISTINCT farm FROM fx_fields WHERE farm % 3 > 0 AND farm % 4 > 0 AND farm % 5 > 0")
def key_intersection(fx: Fx) -> DataFrame:
    farms = fx.fields.select("farm").distinct()
    return T.in_every([farms.where(f"farm % {k} > 0") for k in (3, 4, 5)])


@query("SELECT farm, year, field FROM (SELECT *, row_number() OVER (PARTITION BY farm ORDER BY yield_mean DESC, field) AS r FROM fx_fields) WHERE r = 1")
def distinct_on_key(fx: Fx) -> DataFrame:
    return T.one_per_key(fx.fields, ["farm"], [F.col("yield_mean").desc(), F.col("field")]).select("farm", "year", "field")


@query("SELECT country, crop, year, n FROM (SELECT *, rank() OVER (PARTITION BY country ORDER BY n DESC) AS r FROM (SELECT country, crop, year, count(*) AS n FROM fx_fields GROUP BY ALL)) WHERE r = 1")
def best_rows(fx: Fx) -> DataFrame:
    return T.best_rows(fx.fields.groupBy("country", "crop", "year").agg(F.count("*").alias("n")), ["country"], "n")


@query("WITH a AS (SELECT country, round(avg(CASE WHEN crop = 'wheat' THEN yield_mean END), 9) AS wheat, avg(CASE WHEN crop = 'maize' THEN yield_mean END) AS maize FROM fx_fields GROUP BY country), b AS (SELECT * FROM a UNION ALL SELECT 'median', median(wheat), median(maize) FROM a) SELECT country, round(wheat, 6) AS wheat, round(maize, 6) AS maize, round(maize - wheat, 6) AS d_maize FROM b")
def wide_delta_table(fx: Fx) -> DataFrame:
    return rounded(T.wide_with_deltas(fx.fields, "country", "crop", ["wheat", "maize"], "yield_mean", "wheat"))


_YEARS = range(1995, 2002)


@query("WITH a AS (SELECT country, " + ", ".join(f"count_if(year = {y}) AS y{y}" for y in _YEARS) + ", count(*) AS total FROM fx_fields GROUP BY country), b AS (SELECT * FROM a UNION ALL SELECT 'total', " + ", ".join(f"sum(y{y})" for y in _YEARS) + ", (SELECT count(*) FROM fx_fields) FROM a) SELECT country, " + ", ".join(f"CAST(y{y} AS BIGINT) AS y{y}" for y in _YEARS) + ", CAST(total AS BIGINT) AS total FROM b")
def crosstab_margins(fx: Fx) -> DataFrame:
    return T.crosstab(fx.fields, "country", "year", list(_YEARS))


@query("SELECT crop, n, CAST(row_number() OVER (ORDER BY CASE crop WHEN 'wheat' THEN 0 WHEN 'soybean' THEN 1 ELSE 2 END, crop) AS INTEGER) AS place FROM (SELECT crop, count(*) AS n FROM fx_fields GROUP BY crop)")
def report_order(fx: Fx) -> DataFrame:
    from pyspark.sql import Window

    t = fx.fields.groupBy("crop").agg(F.count("*").alias("n"))
    return t.withColumn("place", F.row_number().over(Window.orderBy(T.ranked_order(t, "crop", ["wheat", "soybean"]), "crop")))


@query("WITH b AS (SELECT field, prow, pcol, CASE WHEN prow = 3 AND pcol = 4 THEN target + 1 ELSE target END AS target, z FROM fx_pixels WHERE NOT (prow = 1 AND pcol = 1)) SELECT coalesce(a.field, b.field) AS field, 'target' AS \"column\", count(*) AS n FROM fx_pixels a FULL JOIN b ON a.field = b.field AND a.prow = b.prow AND a.pcol = b.pcol WHERE b.field IS NULL OR a.target IS DISTINCT FROM b.target GROUP BY 1 UNION ALL SELECT coalesce(a.field, b.field), 'z', count(*) FROM fx_pixels a FULL JOIN b ON a.field = b.field AND a.prow = b.prow AND a.pcol = b.pcol WHERE b.field IS NULL OR a.z IS DISTINCT FROM b.z GROUP BY 1")
def build_difference(fx: Fx) -> DataFrame:
    p = fx.pixels.select("field", "prow", "pcol", F.round("target", 9).alias("target"), F.round("z", 9).alias("z"))
    b = p.where("not (prow = 1 and pcol = 1)").withColumn("target", F.when((F.col("prow") == 3) & (F.col("pcol") == 4), F.col("target") + 1).otherwise(F.col("target")))
    return T.cell_differences(p, b, ["field", "prow", "pcol"], ["target", "z"]).groupBy("field", "column").agg(F.count("*").alias("n"))


#: A reference of one scene a farm; in a third of the farms one pixel less, in a third without its fifth window.
SOURCES = "s AS (SELECT farm, prow // 2 AS k, year AS scene, prow, pcol, n FROM fx_pixels), r AS (SELECT farm, k, prow, pcol, n FROM s WHERE scene = 1995 + farm % 7 AND NOT (farm % 3 = 1 AND prow = 0 AND pcol = (SELECT min(pcol) FROM fx_pixels)) AND NOT (farm % 3 = 2 AND k = 4))"


def _sources(fx: Fx) -> tuple[DataFrame, DataFrame]:
    s = fx.pixels.select("farm", F.expr("prow div 2").alias("k"), F.col("year").alias("scene"), "prow", "pcol", "n")
    least = fx.pixels.agg(F.min("pcol")).first()[0]
    gone = ((F.col("farm") % 3 == 1) & (F.col("prow") == 0) & (F.col("pcol") == least)) | ((F.col("farm") % 3 == 2) & (F.col("k") == 4))
    return s, s.where((F.col("scene") == 1995 + F.col("farm") % 7) & ~gone).drop("scene")


@query(f"WITH {SOURCES}, w AS (SELECT farm, k, list((prow, pcol, n) ORDER BY prow, pcol) AS x FROM r GROUP BY farm, k), t AS (SELECT farm, k, scene, list((prow, pcol, n) ORDER BY prow, pcol) AS x FROM s GROUP BY farm, k, scene) SELECT t.farm, t.k, t.scene FROM t JOIN w ON t.farm = w.farm AND t.k = w.k AND t.x = w.x")
def source_attribution(fx: Fx) -> DataFrame:
    """The scenes whose pixels are those of a window of the reference, no more and no fewer."""
    s, r = _sources(fx)
    return T.attributed(s, r, ["farm", "k"], ["prow", "pcol"], "scene", ["n"])


@query(f"WITH {SOURCES} SELECT farm, k, count(DISTINCT scene) AS n_sources FROM s WHERE (farm, k) NOT IN (SELECT farm, k FROM r) GROUP BY farm, k")
def empty_windows(fx: Fx) -> DataFrame:
    """Windows of the reference that are empty although there are scenes."""
    s, r = _sources(fx)
    return T.empty_windows(s, r, ["farm", "k"], "scene")


@query("""WITH b AS (SELECT farm, prow, pcol, year - 1995 AS k, n, round(z, 9) AS z FROM fx_pixels), a AS (SELECT farm, prow, pcol, k, n, CASE WHEN prow = 3 AND k = 4 THEN z + 1 ELSE z END AS z FROM b WHERE NOT (pcol = 1 AND k = 5) AND k >= 2),
    d AS (SELECT coalesce(a.farm, b.farm) AS farm, coalesce(a.prow, b.prow) AS prow, coalesce(a.pcol, b.pcol) AS pcol, coalesce(a.k, b.k) AS k FROM (SELECT * FROM a WHERE k >= 2) a FULL JOIN (SELECT * FROM b WHERE k >= 2) b ON a.farm = b.farm AND a.prow = b.prow AND a.pcol = b.pcol AND a.k = b.k WHERE a.n IS DISTINCT FROM b.n OR a.z IS DISTINCT FROM b.z),
    e AS (SELECT farm, count(DISTINCT (prow, pcol)) AS n_early FROM b WHERE k < 2 AND farm % 2 = 0 GROUP BY farm), p AS (SELECT farm, count(DISTINCT (prow, pcol)) AS n_pixels, array_to_string(list_sort(list(DISTINCT k)), ',') AS windows FROM d GROUP BY farm)
    SELECT coalesce(p.farm, e.farm) AS farm, coalesce(n_pixels, 0) AS n_pixels, coalesce(windows, '') AS windows, coalesce(n_early, 0) AS n_early, false AS passes FROM p FULL JOIN e ON p.farm = e.farm""")
def build_report(fx: Fx) -> DataFrame:
    """What differs between a build and its reference, by field, with the windows, and early values of the reference."""
    b = fx.pixels.select("farm", "prow", "pcol", (F.col("year") - 1995).alias("k"), "n", F.round("z", 9).alias("z"))
    a = b.where("not (pcol = 1 and k = 5) and k >= 2").withColumn("z", F.when((F.col("prow") == 3) & (F.col("k") == 4), F.col("z") + 1).otherwise(F.col("z")))
    r = T.build_report(a, b.where("k >= 2 or farm % 2 = 0"), "farm", ["prow", "pcol"], "k", ["n", "z"], 2)
    return r.withColumn("windows", F.array_join("windows", ","))
