"""Queries: windows of scenes and days, alignment, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldloom.functions.scalars import growing_degrees, season_overlap, in_season
from fieldloom.operators import timeaxis as W
from fieldloom.plans.evaluation import rounded
from fieldloom.plans.fixtures import Fx
from fieldloom.plans.registry import query

K = "CAST(floor((day - {a}) / {w}.0) AS BIGINT)"


def _best_sql(order: str, cols: str) -> str:
    return f"SELECT field, k, n_scenes, {cols} FROM (SELECT *, {K.format(a=-5, w=10)} AS k, count(*) OVER (PARTITION BY field, {K.format(a=-5, w=10)}) AS n_scenes, row_number() OVER (PARTITION BY field, {K.format(a=-5, w=10)} ORDER BY {order}, day DESC, scene DESC) AS r FROM fx_scenes) WHERE r = 1"


@query(_best_sql("clouds", "scene, day, clouds"))
def best_scene_per_window(fx: Fx) -> DataFrame:
    return W.fewest_clouds(fx.scenes, "field", -5, 10)


@query(_best_sql("clear_share DESC", "scene, day, clear_share"))
def clearest_scene_per_window(fx: Fx) -> DataFrame:
    return W.clearest(fx.scenes, "field", -5, 10)


CAUSES = {"cloud": "8, 9", "cirrus": "10", "shadow": "3", "snow": "11", "dark": "2, 7", "nodata": "0, 1", "water": "6"}
SHARES = f"""sh AS (SELECT field, day, scene, count_if(code IN (8, 9)) AS clouds, count_if(inside AND code IN (4, 5)) / count_if(inside) AS valid, {", ".join(f"count_if(inside AND code IN ({v})) / count_if(inside) AS {c}" for c, v in CAUSES.items())} FROM fx_scene_cells GROUP BY field, day, scene)"""


def _shares(fx: Fx) -> DataFrame:
    return W.scene_shares(fx.scene_cells, ["field", "day", "scene"], "code", F.col("inside"))


@query(f"WITH {SHARES} SELECT field, day, scene, clouds, {', '.join(f'round({c}, 6) AS {c}' for c in ('valid', *CAUSES))} FROM sh")
def scene_shares(fx: Fx) -> DataFrame:
    return rounded(_shares(fx))


@query(f"WITH {SHARES} SELECT CAST(floor(min(CASE WHEN day >= 0 AND day < 24 AND valid > 0 THEN day END) / 7.0) * 7 AS BIGINT) AS start, CAST(count_if(NOT (day >= 0 AND day < 24)) AS BIGINT) AS outside, count(*) AS n FROM sh")
def scene_grid_start(fx: Fx) -> DataFrame:
    return W.grid_start(_shares(fx), 7, 24)


@query("SELECT field, count(*) AS n, round(avg(clear_share), 6) AS clear_share FROM fx_scenes WHERE day >= 3 AND day < 25 AND clear_share >= 0.05 GROUP BY field")
def clear_scenes(fx: Fx) -> DataFrame:
    return rounded(W.clear_scenes(fx.scenes, 3, 25, 0.05).groupBy("field").agg(F.count("*").alias("n"), F.avg("clear_share").alias("clear_share")))


#: Windows of three days from day 1 on, as the rules state them.
WINDOWS = f"""{SHARES}, se AS (SELECT *, coalesce(sow_day, 1) AS lo, coalesce(harvest_day, 28) AS hi FROM fx_grounds),
    ws AS (SELECT sh.*, lo, hi, (day - 1) // 3 AS k FROM sh JOIN se ON sh.field = se.field WHERE day >= 1 AND day < 28),
    wn AS (SELECT field, k, count(*) AS n_scenes, count_if(day >= lo AND day < hi) AS n_in_season, max(valid) AS best_valid FROM ws GROUP BY field, k),
    wc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field, k ORDER BY clouds, day DESC, scene DESC) AS r FROM ws) WHERE r = 1),
    wg AS (SELECT se.*, CAST(k AS BIGINT) AS k, 1 + 3 * CAST(k AS BIGINT) AS a FROM se, (SELECT unnest(range(0, 9)) AS k)),
    wl AS (SELECT field, k, arg_min(cause, p) AS cause FROM (SELECT *, max(s) OVER (PARTITION BY field, k) AS m FROM ({" UNION ALL ".join(f"SELECT field, k, '{c}' AS cause, {i} AS p, {c} AS s FROM wc" for i, c in enumerate(CAUSES))})) WHERE s = m AND s > 0 GROUP BY field, k),
    win AS (SELECT wg.field, country, crop, jan1, wg.k, a AS start_day, a < wg.hi AND a + 3 > wg.lo AS in_season, coalesce(n_scenes, 0) AS n_scenes, coalesce(n_in_season, 0) AS n_in_season, wc.day AS chosen_day, wc.valid AS chosen_valid, best_valid, {", ".join(f"wc.{c} AS chosen_{c}" for c in CAUSES)},
        CASE WHEN NOT (a < wg.hi AND a + 3 > wg.lo) THEN 'out_of_season' WHEN wc.day IS NULL THEN 'no_scene' WHEN best_valid < 0.05 THEN 'all_unusable' WHEN wc.valid < 0.05 AND best_valid >= 0.5 THEN 'rule_loss' WHEN wc.valid >= 0.5 THEN 'valid' ELSE 'partly_valid' END AS class, coalesce(cause, 'none') AS cause
        FROM wg LEFT JOIN wn ON wg.field = wn.field AND wg.k = wn.k LEFT JOIN wc ON wg.field = wc.field AND wg.k = wc.k LEFT JOIN wl ON wg.field = wl.field AND wg.k = wl.k)"""
OF_WINDOWS = ["field", "k", "start_day", "in_season", "n_scenes", "n_in_season", "chosen_day", "chosen_valid", "best_valid", *[f"chosen_{c}" for c in CAUSES], "class", "cause"]


def _windows(fx: Fx) -> DataFrame:
    return W.season_windows(_shares(fx), fx.grounds, "field", 1, 3, 9)


@query(f"WITH {WINDOWS} SELECT {', '.join(f'round({c}, 6) AS {c}' if c.startswith('chosen_') and c != 'chosen_day' or c == 'best_valid' else c for c in OF_WINDOWS)} FROM win")
def window_classes(fx: Fx) -> DataFrame:
    return rounded(_windows(fx).select(*OF_WINDOWS))


def _share(c: str, name: str) -> str:
    return f"round(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 6) AS {name}"


@query(f"WITH {WINDOWS} SELECT country, crop, count(DISTINCT field) AS n_fields, count(*) AS n, round(avg(n_scenes), 6) AS scenes_per_window, {_share(chr(39).join(['class = ', 'no_scene', '']), 'no_scene')}, {_share('chosen_valid >= 0.05', 'usable')}, {_share('chosen_valid >= 0.5', 'valid')}, {_share('best_valid >= 0.05', 'best_usable')}, {_share('best_valid >= 0.5', 'best_valid')}, {_share(chr(39).join(['class = ', 'rule_loss', '']), 'rule_loss')} FROM win WHERE in_season GROUP BY country, crop")
def availability_headline(fx: Fx) -> DataFrame:
    return rounded(W.availability(_windows(fx), ["country", "crop"], "field"))


@query(f"""WITH {WINDOWS}, wm AS (SELECT *, month(jan1 + CAST(start_day + 1 AS INTEGER)) AS month FROM win WHERE in_season), a AS (SELECT country, crop, month, count(*) AS n, {', '.join(_share(f"class = '{c}'", c) for c in W.CLASSES[1:])} FROM wm GROUP BY ALL),
    t AS (SELECT country, crop, month, cause, count(*) AS c FROM wm WHERE chosen_valid < 0.05 GROUP BY ALL), u AS (SELECT *, row_number() OVER (PARTITION BY country, crop, month ORDER BY c DESC, cause) AS r, c / sum(c) OVER (PARTITION BY country, crop, month) AS s FROM t)
    SELECT a.country, a.crop, CAST(a.month AS INTEGER) AS month, n, {', '.join(W.CLASSES[1:])}, u.cause, round(u.s, 6) AS cause_share FROM a LEFT JOIN u ON a.country = u.country AND a.crop = u.crop AND a.month = u.month AND u.r = 1""")
def availability_monthly(fx: Fx) -> DataFrame:
    w = _windows(fx).withColumn("month", F.month(F.date_add("jan1", (F.col("start_day") + 1).cast("int"))))
    return rounded(W.class_shares(w, ["country", "crop", "month"]))


@query("SELECT event_type, CAST(ts AS DATE) AS date, round(avg(value), 6) AS mean, round(max(value), 6) AS high, round(min(value), 6) AS low, round(sum(value), 6) AS total, count(*) AS n FROM events GROUP BY 1, 2")
def daily_resample(fx: Fx) -> DataFrame:
    return rounded(W.daily(fx.events, ["event_type"], "ts", "value"))


KINDS = ("click", "error", "view", "purchase", "signup")


@query("SELECT CAST(ts AS DATE) AS date, " + ", ".join(f"nullif(count_if(event_type = '{k}'), 0) AS {k}" for k in KINDS) + " FROM events GROUP BY 1")
def merge_variables(fx: Fx) -> DataFrame:
    """Tables of one variable each, merged on their date."""
    per = [fx.events.where(F.col("event_type") == k).groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias(k)) for k in KINDS]
    out = per[0]
    for p in per[1:]:
        out = W.merge_on(out, p, ["date"])
    return out


WW = "WITH d AS (SELECT *, CAST(floor(day / 5.0) AS BIGINT) AS k FROM fx_daily), p AS (SELECT field, k, count(*) AS n_days, CASE WHEN count(*) = 5 THEN avg(temp_mean) END AS temp_mean_mean, CASE WHEN count(*) = 5 THEN coalesce(sum(prec), 0) END AS prec_sum, CASE WHEN count(*) = 5 THEN arg_max(temp_max, day) END AS temp_max_last FROM d GROUP BY field, k), g AS (SELECT field, CAST(k AS BIGINT) AS k FROM (SELECT DISTINCT field FROM fx_daily), (SELECT unnest(range(0, 5 + 1)) AS k))"


@query(WW + " SELECT g.field, g.k, coalesce(n_days, 0) AS n_days, round(temp_mean_mean, 6) AS temp_mean_mean, round(prec_sum, 6) AS prec_sum, round(temp_max_last, 6) AS temp_max_last FROM g LEFT JOIN p ON g.field = p.field AND g.k = p.k")
def weather_windows(fx: Fx) -> DataFrame:
    return rounded(W.weather_windows(fx.daily, "field", 0, 5, 6, ["temp_mean"], ["prec"], ["temp_max"]))


@query("SELECT field, day, round(CASE WHEN day >= field % 10 THEN sum(CASE WHEN day >= field % 10 AND day <= field % 10 + 12 THEN prec ELSE 0 END) OVER (PARTITION BY field ORDER BY day ROWS UNBOUNDED PRECEDING) END, 6) AS prec_cum FROM fx_daily")
def cumulative_since_sowing(fx: Fx) -> DataFrame:
    d = fx.daily.withColumn("sow", F.col("field") % 10).withColumn("end", F.col("field") % 10 + 12)
    return rounded(W.since_event(d, "field", "prec", "sow", "end").select("field", "day", "prec_cum"))


CLIM = """b AS (SELECT cell, CAST(least(dayofyear(date), 365) AS BIGINT) AS doy, avg(v) AS m FROM fx_cell_daily WHERE year(date) BETWEEN 1995 AND 1998 GROUP BY 1, 2),
    n AS (SELECT a.cell, a.doy, avg(b.m) AS normal FROM b a JOIN b ON a.cell = b.cell AND least(abs(a.doy - b.doy), 365 - abs(a.doy - b.doy)) <= 15 GROUP BY a.cell, a.doy)"""


@query(f"WITH {CLIM} SELECT cell, doy, round(normal, 6) AS normal FROM n")
def climatology(fx: Fx) -> DataFrame:
    return rounded(W.climatology(fx.cell_daily, "cell", "date", "v", 1995, 1998))


@query(f"WITH {CLIM} SELECT d.cell, d.date, round(v - normal, 6) AS anomaly FROM fx_cell_daily d LEFT JOIN n ON d.cell = n.cell AND least(dayofyear(d.date), 365) = n.doy WHERE year(d.date) > 1998")
def climatology_anomaly(fx: Fx) -> DataFrame:
    c = fx.cell_daily
    return rounded(W.anomalies(c.where(F.year("date") > 1998), W.climatology(c, "cell", "date", "v", 1995, 1998), "cell", "date", "v").select("cell", "date", "anomaly"))


#: Weather with gaps; heat above a base by crop; rules by half and crop without country C, barley of the north by its wheat.
HEAT = """hd AS (SELECT d.field, day, greatest(temp_mean - CASE crop WHEN 'maize' THEN 10 ELSE 0 END, 0) AS heat FROM fx_daily d JOIN fx_grounds g ON d.field = g.field WHERE (d.field + day) % 3 > 0 AND day BETWEEN 2 AND 27),
    hs AS (SELECT half, crop, CAST(greatest(2, floor((quantile_cont(sow_day, 0.05) + 35 - 30) / 10) * 10) AS BIGINT) AS start, count(*) AS n FROM fx_grounds WHERE country <> 'C' GROUP BY half, crop),
    hh AS (SELECT g.field, g.half, g.crop, coalesce((SELECT sum(heat) FROM hd WHERE hd.field = g.field AND hd.day >= hs.start AND hd.day <= greatest(2, least(27, g.harvest_day))), 0) AS s FROM fx_grounds g JOIN hs ON g.half = hs.half AND g.crop = hs.crop WHERE country <> 'C' AND harvest_day IS NOT NULL),
    hw AS (SELECT half, crop, round(quantile_cont(s, 0.95) / 7 + 1e-9, 1) AS width FROM hh GROUP BY half, crop),
    hr AS (SELECT hs.half, hs.crop, start, width, n, CAST(NULL AS VARCHAR) AS stands_for FROM hs LEFT JOIN hw ON hs.half = hw.half AND hs.crop = hw.crop),
    ru AS (SELECT * FROM hr UNION ALL SELECT 'north', 'barley', start, width, n, 'north|wheat' FROM hr WHERE half = 'north' AND crop = 'wheat' AND NOT EXISTS (SELECT 1 FROM hr WHERE half = 'north' AND crop = 'barley'))"""


def _heat(fx: Fx) -> tuple[DataFrame, DataFrame]:
    """Daily heat with gaps in the days, and the rules."""
    g = fx.grounds.withColumn("sow_day", F.col("sow_day") + 35)
    d = fx.daily.where("(field + day) % 3 > 0").join(g.select("field", "crop"), "field").withColumn("heat", growing_degrees("temp_mean", "crop", {"maize": 10.0}))
    return d, W.heat_rules(g, d, "field", ["half", "crop"], "heat", F.col("country") != "C", 8, 2, 27, {("north", "barley"): ("north", "wheat")})


@query(f"WITH {HEAT}, su AS (SELECT s.field, s.scene, s.day, s.clear_share, CAST(floor(coalesce((SELECT sum(heat) FROM hd WHERE hd.field = s.field AND hd.day >= ru.start AND hd.day <= s.day), 0) / width) AS BIGINT) AS k FROM fx_scenes s JOIN fx_grounds g ON s.field = g.field JOIN ru ON g.half = ru.half AND g.crop = ru.crop WHERE s.day >= ru.start) SELECT field, k, count(*) AS n, arg_max(scene, (clear_share, day, scene)) AS best_scene FROM su WHERE k < 8 GROUP BY field, k")
def thermal_windows(fx: Fx) -> DataFrame:
    """Scenes by windows of heat, and the clearest one of each; a third of the days have no weather."""
    d, rules = _heat(fx)
    own = fx.grounds.select("field", "half", "crop").join(rules, ["half", "crop"]).select("field", "start", "width")
    w = W.thermal_windows(fx.scenes, d, own, "field", "heat", 8, 2, 27)
    return w.groupBy("field", "k").agg(F.count("*").alias("n"), F.max_by("scene", F.struct("clear_share", "day", "scene")).alias("best_scene"))


@query(f"WITH {HEAT} SELECT half, crop, start, width, n, stands_for FROM ru")
def heat_rule(fx: Fx) -> DataFrame:
    return _heat(fx)[1]


EVENT = "SELECT DISTINCT vec_id, CAST(200 + vec_id % 97 AS BIGINT) AS event_day FROM fx_series"
ALIGN = f"e AS (SELECT vec_id, CAST(floor((event_day - 210) / 10.0) AS BIGINT) AS k0 FROM ({EVENT})), g AS (SELECT vec_id, k0, CAST(m AS BIGINT) AS m, k0 + m AS k FROM e, (SELECT unnest(range(-4, 12)) AS m)), al AS (SELECT g.vec_id, g.m, g.k, s.value, CASE WHEN s.vec_id IS NULL THEN 0 ELSE 1 END AS observed FROM g LEFT JOIN fx_series s ON g.vec_id = s.vec_id AND g.k = s.step)"


def _aligned(fx: Fx) -> DataFrame:
    event = fx.series.select("vec_id").distinct().withColumn("event_day", F.lit(200) + F.col("vec_id") % 97)
    return W.align(fx.series.withColumnRenamed("step", "k"), "vec_id", event, 10, 210, -4, 12, ["value"])


@query(f"WITH {ALIGN} SELECT vec_id, m, k, round(value, 6) AS value, CAST(observed AS INTEGER) AS observed FROM al")
def align_event(fx: Fx) -> DataFrame:
    return rounded(_aligned(fx))


@query(f"WITH {ALIGN} SELECT m, count(*) AS n, CAST(sum(observed) AS BIGINT) AS observed, round(avg(value), 6) AS mean FROM al WHERE m >= ceil(-15 / 10.0) AND m < ceil(55 / 10.0) GROUP BY m")
def season_slice(fx: Fx) -> DataFrame:
    return rounded(W.season_slice(_aligned(fx), "m", 10, -15, 55).groupBy("m").agg(F.count("*").alias("n"), F.sum("observed").cast("bigint").alias("observed"), F.avg("value").alias("mean")))


@query("SELECT field, scene, day, row_number() OVER (PARTITION BY field ORDER BY day, scene) - 1 AS k, day - lag(day, 1, -3) OVER (PARTITION BY field ORDER BY day, scene) AS gap FROM fx_scenes WHERE clear_share >= 0.5")
def scene_sequence(fx: Fx) -> DataFrame:
    return W.scene_sequence(fx.scenes.where("clear_share >= 0.5"), "field", -3).select("field", "scene", "day", F.col("k").cast("bigint").alias("k"), "gap")


@query("WITH a AS (SELECT field, list(clear_share ORDER BY scene) AS v FROM fx_scenes GROUP BY field), b AS (SELECT field, CASE WHEN len(v) > 12 THEN v[len(v) - 11:] ELSE v END AS v FROM a) SELECT field, CAST(len(v) AS BIGINT) AS real, array_to_string(list_transform(list_concat(list_transform(range(0, 12 - len(v)), lambda x: CAST(NULL AS DOUBLE)), v), lambda x: coalesce(CAST(CAST(round(x * 100) AS BIGINT) AS STRING), '-')), ' ') AS padded FROM b")
def pad_sequences(fx: Fx) -> DataFrame:
    p = W.left_padded(fx.scenes, "field", "scene", "clear_share", 12)
    return p.select("field", "real", F.array_join(F.transform("padded", lambda x: F.coalesce(F.round(x * 100).cast("bigint").cast("string"), F.lit("-"))), " ").alias("padded"))


@query("WITH l AS (SELECT field, count(*) AS length FROM fx_scenes GROUP BY field), c AS (SELECT *, (row_number() OVER (ORDER BY md5('5|' || CAST(field AS STRING)), field) - 1) // 32 AS chunk FROM l) SELECT field, length, chunk, row_number() OVER (PARTITION BY chunk ORDER BY length, field) AS place FROM c")
def length_chunks(fx: Fx) -> DataFrame:
    out = W.length_chunks(fx.scenes.groupBy("field").agg(F.count("*").alias("length")), "field", 5, 32)
    return out.withColumn("place", F.col("place").cast("bigint"))


@query("WITH d AS (SELECT DISTINCT field, day FROM fx_scenes), g AS (SELECT *, day - lag(day) OVER (PARTITION BY field ORDER BY day) AS gap FROM d) SELECT field, count(*) AS n, min(day) AS first, max(day) AS last, max(gap) AS max_gap, round(median(gap), 6) AS median_gap FROM g GROUP BY field")
def gap_stats(fx: Fx) -> DataFrame:
    return rounded(W.gaps(fx.scenes, "field"))


@query("SELECT user_id % 20 AS run, event_id, round(max(value) OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS best FROM events")
def best_so_far(fx: Fx) -> DataFrame:
    e = fx.events.withColumn("run", F.col("user_id") % 20)
    return rounded(W.best_so_far(e, ["run"], ["ts", "event_id"], "value").select("run", "event_id", "best"))


@query("""WITH e AS (SELECT vec_id AS run, step AS epoch, round(value, 6) AS score FROM fx_series), t AS (SELECT *, coalesce(score < min(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS nw FROM e),
    u AS (SELECT *, max(CASE WHEN nw THEN epoch END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS att FROM t), s AS (SELECT run, coalesce(min(CASE WHEN epoch - att >= 6 THEN epoch END), max(epoch)) AS stop_epoch FROM u GROUP BY run)
    SELECT u.run, arg_min(epoch, score * 1000000 + epoch * 0.0001) AS best_epoch, min(score) AS best, max(stop_epoch) AS stop_epoch FROM u JOIN s ON u.run = s.run AND u.epoch <= s.stop_epoch GROUP BY u.run""")
def early_stopping(fx: Fx) -> DataFrame:
    e = rounded(fx.series.select(F.col("vec_id").alias("run"), F.col("step").alias("epoch"), F.col("value").alias("score")))
    return W.stop_trace(e, ["run"], "epoch", "score", 6)


@query("SELECT field, round(avg(greatest(0, least(s + 9, harvest_day) - greatest(s, sow_day) + 1) / 10.0), 6) AS overlap, CAST(count_if(s < harvest_day AND s + 10 > sow_day) AS BIGINT) AS inside, count(*) AS n FROM fx_season, (SELECT unnest(range(210, 720, 10)) AS s) GROUP BY field")
def season_windows(fx: Fx) -> DataFrame:
    w = fx.season.select("*", F.explode(F.sequence(F.lit(210), F.lit(710), F.lit(10))).alias("s"))
    return rounded(w.groupBy("field").agg(F.avg(season_overlap("s", 10, "sow_day", "harvest_day")).alias("overlap"), F.count_if(in_season("s", F.col("s") + 10, "sow_day", "harvest_day", (210, 720))).alias("inside"), F.count("*").alias("n")))


@query("SELECT farm, year, coalesce(lead(year) OVER (PARTITION BY farm ORDER BY year), min(year) OVER (PARTITION BY farm)) AS next FROM fx_fields")
def next_cv_year(fx: Fx) -> DataFrame:
    return W.next_in_cycle(fx.fields.select("farm", "year"), ["farm"], "year")
