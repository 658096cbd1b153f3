"""Queries: stores of runs and pixels, attribute joins, feature assembly."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from fieldloom.operators import filters as L
from fieldloom.operators import joins as J
from fieldloom.operators import metrics as M
from fieldloom.operators import spatial as G
from fieldloom.operators.load import PIXEL, Tables, fit_scaler, load
from fieldloom.plans.evaluation import rounded
from fieldloom.plans.fixtures import Fx
from fieldloom.plans.registry import query
from fieldloom.session import checkpoint_dir
from fieldloom.sources import tables as S


@query("WITH u AS (SELECT farm, pcol, prow, target, tax, 'a' AS part FROM fx_pixels WHERE farm % 2 = 0 AND target > 20 UNION ALL SELECT farm, pcol, prow, target, NULL, 'b' FROM fx_pixels WHERE farm % 2 = 1 AND target > 20) SELECT part, count(DISTINCT farm) AS n_keys, count(*) AS n_steps, count(tax) AS n_tax FROM u GROUP BY part")
def extract_pixels(fx: Fx) -> DataFrame:
    p = fx.pixels.select("farm", "pcol", "prow", F.when(F.col("target") > 20, F.col("target")).alias("target"), "tax")
    steps, pixels = S.extract_pixels({"a": p.where("farm % 2 = 0"), "b": p.where("farm % 2 = 1").drop("tax")}, "target", ["pcol"], "farm", "part")
    return steps.groupBy("part").agg(F.count("*").alias("n_steps"), F.count("tax").alias("n_tax")).join(pixels.groupBy("part").agg(F.count("*").alias("n_keys")), "part").select("part", "n_keys", "n_steps", "n_tax")


@query("SELECT CAST(l_linenumber AS BIGINT) AS line, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 900 GROUP BY 1")
def row_range(fx: Fx) -> DataFrame:
    return rounded(S.row_range(fx.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", 100, 900).groupBy(F.col("l_linenumber").cast("bigint").alias("line")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")))


@query("SELECT l_returnflag, count(*) AS n, count(CASE WHEN l_quantity <> 7 THEN 1 END) AS valid FROM lineitem GROUP BY l_returnflag")
def sentinel_to_null(fx: Fx) -> DataFrame:
    return S.cleaned(fx.lineitem.select("l_returnflag", "l_quantity"), {"l_quantity": 7.0}).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("l_quantity").alias("valid"))


@query("SELECT field, min(prow * 10 + pcol) AS first, max(prow * 10 + pcol) AS last, min(prow) AS min_prow, max(prow) AS max_prow, min(pcol) AS min_pcol, max(pcol) AS max_pcol FROM fx_pixels GROUP BY field")
def field_index(fx: Fx) -> DataFrame:
    return S.field_index(fx.pixels.withColumn("pixel", F.col("prow") * 10 + F.col("pcol")), "field", "pixel")


@query("SELECT country, count(*) AS n, min(mark) AS mark FROM (SELECT country, 'old' AS mark FROM fx_fields WHERE country NOT IN (SELECT country FROM fx_fields WHERE country IN ('ASIA', 'EUROPE') AND farm % 2 = 0) UNION ALL SELECT country, 'new' FROM fx_fields WHERE country IN ('ASIA', 'EUROPE') AND farm % 2 = 0) GROUP BY country")
def partial_rebuild(fx: Fx) -> DataFrame:
    f = fx.fields.select("country", "farm", F.lit("old").alias("mark"))
    new = f.where("country in ('ASIA', 'EUROPE') and farm % 2 = 0").withColumn("mark", F.lit("new"))
    return S.rebuilt(f, new, "country").groupBy("country").agg(F.count("*").alias("n"), F.min("mark").alias("mark"))


_CFG = "concat('cfg', CAST(farm % 7 AS STRING))"
_SPL = "concat('y', CAST(year AS STRING))"
_FILE = "CASE WHEN (farm + year) % 5 = 0 THEN 'metrics.json' WHEN farm % 3 = 0 THEN concat('val_', CAST(farm AS STRING)) ELSE concat('test_', CAST(farm AS STRING)) END"


def _listing(fx: Fx) -> DataFrame:
    """The files of a tree of run folders that is written from the table of fields: one file for each field with a line a
    field, 99 characters for each of its pixels and a line break."""
    path = f"{checkpoint_dir(fx.spark)}/runs-{uuid.uuid4().hex}"
    lines = fx.fields.select(F.expr(_CFG).alias("config"), F.expr(_SPL).alias("split"), F.expr(_FILE).alias("file"), "n_pixels")
    S.write_texts(lines, path, ["config", "split", "file"], F.repeat(F.lit("x"), (F.col("n_pixels") * 99).cast("int")))
    return S.listed_paths(S.list_files(fx.spark, path, "part-*"), path)


_TREE = f"tr AS (SELECT {_CFG} AS config, {_SPL} AS split, {_FILE} AS file, CAST(sum(n_pixels * 99 + 1) AS BIGINT) AS size FROM fx_fields GROUP BY 1, 2, 3)"


@query(f"WITH {_TREE} SELECT concat(config, '/', split, '/', file) AS path, size AS length FROM tr")
def file_listing(fx: Fx) -> DataFrame:
    """Paths and sizes of the files of a tree of folders."""
    return _listing(fx).select("path", "length")


@query(f"WITH {_TREE} SELECT config, split, bool_or(file = 'metrics.json') AS done, bool_or(file LIKE 'val%') AS has_val, count(*) AS n_files FROM tr GROUP BY config, split")
def run_listing(fx: Fx) -> DataFrame:
    return S.runs_of(_listing(fx), "path")


@query(f"WITH {_TREE} SELECT split AS folder, CASE WHEN regexp_matches(file, '^val_') THEN 'validation' WHEN regexp_matches(file, 'json$') THEN 'metrics' ELSE 'other' END AS kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(file) AS first, max(file) AS last FROM tr GROUP BY 1, 2")
def file_inventory(fx: Fx) -> DataFrame:
    return S.inventory(_listing(fx), "path", "length", {"^val_": "validation", "json$": "metrics"})


_DOC = """concat('{"metrics": {"val": {"all": {"r2": ', CAST(s AS STRING), ', "rmse": 2, "n": ', CAST(n AS STRING), '}, "', country, '|wheat": {"r2": 0.25, "rmse": 1.5, "n": 3}}, "test": {"all": {"r2": 0.5, "rmse": 1, "n": 4}}}, "members": [{"all": {"r2": ', CAST(s AS STRING), ', "rmse": 2, "n": 1}}, {"all": {"r2": 0.5, "rmse": 2, "n": 1}}]}')"""


def _runs(fx: Fx) -> DataFrame:
    return fx.fields.groupBy("country", "year").agg((F.count("*") % 8 / 8.0).alias("s"), F.count("*").alias("n")).select(F.concat_ws("-", "country", "year").alias("run"), F.expr(_DOC).alias("doc"))


@query("WITH r AS (SELECT country, year, count(*) % 8 / 8.0 AS s, count(*) AS n FROM fx_fields GROUP BY country, year) SELECT concat_ws('-', country, CAST(year AS STRING)) AS run, 'val' AS set, 'all' AS \"group\", 'all' AS country, CAST(NULL AS STRING) AS crop, CAST(s AS DOUBLE) AS r2, 2.0E0 AS rmse, n FROM r UNION ALL SELECT concat_ws('-', country, CAST(year AS STRING)), 'val', concat(country, '|wheat'), country, 'wheat', 0.25E0, 1.5E0, 3 FROM r UNION ALL SELECT concat_ws('-', country, CAST(year AS STRING)), 'test', 'all', 'all', NULL, 0.5E0, 1.0E0, 4 FROM r")
def run_metrics_long(fx: Fx) -> DataFrame:
    return S.metrics_long(_runs(fx), ["run"], "doc")


@query("WITH r AS (SELECT country, year, CAST(count(*) % 8 / 8.0 AS DOUBLE) AS s FROM fx_fields GROUP BY country, year) SELECT concat_ws('-', country, CAST(year AS STRING)) AS run, 'all' AS \"group\", round((s + 0.5) / 2, 6) AS r2, round(abs(s - 0.5) / 2, 6) AS spread, CAST(2 AS BIGINT) AS n_members FROM r")
def run_member_spread(fx: Fx) -> DataFrame:
    return rounded(S.member_spread(_runs(fx), ["run"], "doc"))


@query(f"SELECT config, count(DISTINCT split) AS n_splits, min(split) AS first, max(split) AS last, count(DISTINCT split) = 7 AS complete, CAST(sum(n_pixels) AS BIGINT) AS seconds FROM (SELECT {_CFG} AS config, {_SPL} AS split, n_pixels FROM fx_fields WHERE NOT (farm % 7 = 3 AND year = 1999)) GROUP BY config")
def setups(fx: Fx) -> DataFrame:
    d = fx.fields.where("not (farm % 7 = 3 and year = 1999)").select(F.expr(_CFG).alias("config"), F.expr(_SPL).alias("split"), "n_pixels")
    return d.groupBy("config").agg(F.count_distinct("split").alias("n_splits"), F.min("split").alias("first"), F.max("split").alias("last"), (F.count_distinct("split") == 7).alias("complete"), F.sum("n_pixels").alias("seconds"))


@query("WITH s AS (SELECT country, crop, CASE WHEN year % 2 = 0 THEN 'even' ELSE 'odd' END AS model, avg(yield_mean) AS v FROM fx_fields GROUP BY ALL), b AS (SELECT country, crop, arg_max(model, (round(v, 9), model)) AS model FROM s GROUP BY country, crop) SELECT s.model, round(median(v), 6) AS median, count(*) AS n, (SELECT count(*) FROM b WHERE b.model = s.model) AS best FROM s GROUP BY s.model")
def overview_best(fx: Fx) -> DataFrame:
    s = fx.fields.groupBy("country", "crop", F.when(F.col("year") % 2 == 0, "even").otherwise("odd").alias("model")).agg(F.avg("yield_mean").alias("v"))
    best = s.groupBy("country", "crop").agg(F.max_by("model", F.struct(F.round("v", 9), F.col("model"))).alias("model")).groupBy("model").agg(F.count("*").alias("best"))
    return rounded(s.groupBy("model").agg(F.median("v").alias("median"), F.count("*").alias("n")).join(best, "model", "left"))


@query("WITH g AS (SELECT country, crop, count(*) AS n, avg(yield_mean) AS m FROM fx_fields GROUP BY country, crop), r AS (SELECT country, crop, count(*) AS n_fields FROM fx_fields WHERE NOT (crop = 'wheat' AND farm % 5 = 0) GROUP BY country, crop) SELECT r.country, r.crop, n_fields, round(CASE WHEN n_fields = n THEN m END, 6) AS yield_mean FROM r LEFT JOIN g ON r.country = g.country AND r.crop = g.crop")
def checked_group_means(fx: Fx) -> DataFrame:
    f = fx.fields
    means = f.groupBy("country", "crop").agg(F.count("*").alias("n"), F.avg("yield_mean").alias("yield_mean"))
    rows = f.where("not (crop = 'wheat' and farm % 5 = 0)").groupBy("country", "crop").agg(F.count("*").alias("n_fields"))
    return rounded(J.checked(rows, means, ["country", "crop"], "n_fields", "n", "yield_mean"))


@query("SELECT f.country, p.year, count(*) AS n, round(avg(p.z), 6) AS z FROM fx_pixels p LEFT JOIN fx_fields f ON p.field = f.field GROUP BY 1, 2")
def attach_attributes(fx: Fx) -> DataFrame:
    j = J.attach(fx.pixels, fx.fields.select("field", "country"), ["field"])
    return rounded(j.groupBy("country", "year").agg(F.count("*").alias("n"), F.avg("z").alias("z")))


@query("SELECT p.field, count(*) AS n, round(avg(d.temp_mean), 6) AS temp, count(d.temp_mean) AS present FROM (SELECT field, farm % 15 AS user_id, prow AS day FROM fx_pixels) p LEFT JOIN fx_daily d ON d.field = p.user_id AND d.day = p.day GROUP BY p.field")
def series_onto_pixels(fx: Fx) -> DataFrame:
    p = fx.pixels.select(F.col("field").alias("own"), (F.col("farm") % 15).alias("field"), F.col("prow").alias("day"))
    j = J.series_onto(p, fx.daily.select("field", "day", "temp_mean"), "field", "day")
    return rounded(j.groupBy(F.col("own").alias("field")).agg(F.count("*").alias("n"), F.avg("temp_mean").alias("temp"), F.count("temp_mean").alias("present")))


@query("WITH s AS (SELECT field, farm % 5 AS cell, jan1 FROM fx_season), d AS (SELECT s.field, CAST(floor((date_diff('day', s.jan1, c.date) - 60) / 30.0) AS BIGINT) AS k, v FROM s JOIN fx_cell_daily c ON s.cell = c.cell) SELECT field, k, count(*) AS n_days, round(avg(v), 6) AS v FROM d WHERE k >= 0 AND k < 8 GROUP BY field, k")
def cell_windows(fx: Fx) -> DataFrame:
    s = fx.season.select("field", (F.col("farm") % 5).alias("cell"), "jan1")
    return rounded(J.cell_windows(s, fx.cell_daily, "cell", "jan1", 60, 30, 8, [F.avg("v").alias("v")]))


@query("SELECT origin, count(*) AS n FROM (SELECT CASE WHEN farm IN (SELECT farm FROM fx_fields WHERE farm % 4 = 0) THEN 'dup1' WHEN farm IN (SELECT farm FROM fx_fields WHERE farm % 3 = 0) THEN 'dup2' ELSE 'own' END AS origin FROM fx_fields) GROUP BY origin")
def origin_tags(fx: Fx) -> DataFrame:
    f = fx.fields
    return J.origin_tag(f, {"dup1": f.where("farm % 4 = 0"), "dup2": f.where("farm % 3 = 0")}, "farm", "own").groupBy("origin").agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT country, count(*) AS n FROM fx_fields GROUP BY country) SELECT a.country, n, CASE country WHEN 'ASIA' THEN 0.4E0 WHEN 'EUROPE' THEN 0.6E0 END AS published FROM a")
def reference_results(fx: Fx) -> DataFrame:
    ref = fx.spark.createDataFrame([("ASIA", 0.4), ("EUROPE", 0.6)], "country string, published double")
    return J.reference_results(fx.fields.groupBy("country").agg(F.count("*").alias("n")), ref, ["country"])


def _chosen(name: str, years: str) -> str:
    """Pixels of some years: away from the edge, seen three times, six a field; and their steps about sowing."""
    return f"""{name}p AS (SELECT p.*, f.country, f.crop, s.sow_day FROM fx_masked p JOIN fx_fields f ON p.field = f.field JOIN fx_season s ON p.field = s.field WHERE p.year {years} AND f.country <> 'ASIA'),
    {name}e AS (SELECT * FROM {name}p p WHERE 4 = (SELECT count(*) FROM {name}p q WHERE q.field = p.field AND abs(q.prow - p.prow) + abs(q.pcol - p.pcol) = 1)),
    {name}o AS (SELECT e.* FROM {name}e e WHERE 3 <= (SELECT count(B04) FROM fx_steps t WHERE t.field = e.field AND t.prow = e.prow AND t.pcol = e.pcol)),
    {name}k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY md5(concat_ws('|', '3', field, CAST(prow AS VARCHAR), CAST(pcol AS VARCHAR))), prow, pcol) AS r FROM {name}o) WHERE r <= 6),
    {name}s AS (SELECT k.field, k.prow, k.pcol, m, CASE WHEN B08 + B04 <> 0 THEN greatest(-1, least(1, (B08 - B04) / (B08 + B04))) END AS ndvi, CASE WHEN B04 IS NULL THEN 0.0 ELSE 1.0 END AS observed FROM {name}k k CROSS JOIN (SELECT unnest(range(-2, 3)) AS m) LEFT JOIN fx_steps t ON t.field = k.field AND t.prow = k.prow AND t.pcol = k.pcol AND t.k = CAST(floor((sow_day - 200) / 20.0) AS BIGINT) + m)"""


def _tables(fx: Fx) -> Tables:
    fields = fx.fields.select("field", "country", "crop", "year").join(fx.season.select("field", "sow_day", "harvest_day", "jan1"), "field")
    split = fx.fields.select("field", F.when(F.col("year") < 1999, "train").otherwise("test").alias("role"))
    steps = lambda keys: fx.over(pixels=fx.pixels.join(keys.select(*PIXEL), PIXEL, "left_semi")).steps  # noqa: E731 - a pixel has six
    return Tables(fx.masked.select("field", "prow", "pcol", "target", F.col("z").alias("elevation")), steps, fields, 20, 200, split)


@query(f"""WITH {_chosen('a', '< 1999')}, {_chosen('b', '>= 1999')}, sd AS (SELECT avg(ndvi) AS m, stddev_pop(ndvi) AS d FROM as_), se AS (SELECT avg(z) AS m, stddev_pop(z) AS d FROM ak),
    st AS (SELECT field, count(*) AS n_steps, avg(coalesce((ndvi - m) / d, 0)) AS ndvi, avg(observed) AS observed FROM (SELECT b.*, sd.m AS m, sd.d AS d FROM (SELECT field, ndvi, observed FROM bs) b, sd) GROUP BY field),
    pt AS (SELECT field, max(crop) AS crop, count(*) AS n, avg((z - m) / d) AS elevation, avg(CASE WHEN crop = 'wheat' THEN 1.0 ELSE 0.0 END) AS wheat FROM bk, se GROUP BY field)
    SELECT pt.field, crop, n, n_steps, round(ndvi, 6) AS ndvi, round(observed, 6) AS observed, round(elevation, 6) AS elevation, round(wheat, 6) AS wheat FROM pt JOIN st ON pt.field = st.field""".replace("as AS (SELECT k.field", "as_ AS (SELECT k.field"))
def load_features(fx: Fx) -> DataFrame:
    """The test role of a split with its features, scaled by the train role: split, country, edge, clear steps, sample, and
    steps counted from sowing."""
    options = {"align": "sowing", "season": (-40, 60), "countries": ["AFRICA", "AMERICA", "EUROPE", "MIDDLE EAST"], "edge_buffer_m": 10.0, "min_observed": 3, "pixels_per_field": 6, "seed": 3}
    specs = ["indices:ndvi", "observed", "terrain:elevation", "crop"]
    t = _tables(fx.kept("pixels", "fields"))
    test = load(t, specs, ["test"], scaler=fit_scaler(load(t, specs, ["train"], **options)), **options)
    steps = test.steps.groupBy("field").agg(F.count("*").alias("n_steps"), F.avg("ndvi").alias("ndvi"), F.avg("observed").alias("observed"))
    pixels = test.pixels.groupBy("field").agg(F.max("crop").alias("crop"), F.count("*").alias("n"), F.avg("elevation").alias("elevation"), F.avg("crop=wheat").alias("wheat"))
    return rounded(pixels.join(steps, "field").select("field", "crop", "n", "n_steps", "ndvi", "observed", "elevation", "wheat"))


@query("WITH l AS (SELECT field, crop, 'val' AS role, avg(target) AS target, avg(pred) AS pred FROM fx_preds WHERE year = 1999 GROUP BY field, crop UNION ALL SELECT field, crop, 'test', avg(target), avg(pred) FROM fx_preds WHERE year = 2000 GROUP BY field, crop) SELECT role, crop, count(*) AS n, round(avg(target), 6) AS yield_mean, round(sqrt(avg(power(pred - target, 2))) / avg(target), 6) AS rel_rmse FROM l GROUP BY role, crop")
def group_yield_means(fx: Fx) -> DataFrame:
    l = fx.preds.where("year in (1999, 2000)").withColumn("role", F.when(F.col("year") == 1999, "val").otherwise("test"))  # noqa: E741
    f = M.field_level(l, ["field", "crop", "role"])
    return rounded(f.groupBy("role", "crop").agg(F.count("*").alias("n"), F.avg("target").alias("yield_mean"), (F.sqrt(F.avg(F.pow(F.col("pred") - F.col("target"), 2))) / F.avg("target")).alias("rel_rmse")))


@query("SELECT field, set, n, round(rmse, 6) AS rmse FROM (SELECT 'all' AS set, country AS field, count(*) AS n, sqrt(avg(power(pred - target, 2))) AS rmse FROM (SELECT field, country, farm, avg(target) AS target, avg(pred) AS pred FROM fx_preds WHERE year >= 1999 GROUP BY ALL) GROUP BY country UNION ALL SELECT CASE WHEN farm % 3 > 0 THEN 'seen' ELSE 'new' END, country, count(*), sqrt(avg(power(pred - target, 2))) FROM (SELECT field, country, farm, avg(target) AS target, avg(pred) AS pred FROM fx_preds WHERE year >= 1999 GROUP BY ALL) GROUP BY 1, 2)")
def results_fieldset(fx: Fx) -> DataFrame:
    p = fx.preds
    f = M.seen_flag(M.field_level(p.where("year >= 1999"), ["field", "farm", "country"]), p.where("year < 1999 and farm % 3 > 0"), "farm")
    rows = f.withColumn("set", F.explode(F.array(F.lit("all"), F.when(F.col("seen"), "seen").otherwise("new"))))
    return rounded(rows.groupBy(F.col("country").alias("field"), "set").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("pred") - F.col("target"), 2))).alias("rmse")))
