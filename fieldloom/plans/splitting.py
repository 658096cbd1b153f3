"""Queries: splits, folds, checks, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldloom.operators import metrics as M
from fieldloom.operators import splits as S
from fieldloom.plans.evaluation import rounded
from fieldloom.plans.fixtures import Fx
from fieldloom.plans.registry import query

Z = "zf AS (SELECT *, (yield_mean - avg(yield_mean) OVER (PARTITION BY crop, country)) / CASE WHEN stddev_samp(yield_mean) OVER (PARTITION BY crop, country) > 0 THEN stddev_samp(yield_mean) OVER (PARTITION BY crop, country) ELSE 1 END AS z FROM fx_fields)"


def score_sql(candidates: str) -> str:
    """CTEs up to `sc` (candidate, score) for a query of (candidate, field)."""
    return f"""{Z}, cand AS ({candidates}), nn AS (SELECT count(*) AS n FROM zf), sz AS (SELECT candidate, count(*) AS k FROM cand GROUP BY candidate),
    q AS (SELECT country, crop, count(*) / (SELECT n FROM nn) AS q FROM zf GROUP BY country, crop), o AS (SELECT candidate, country, crop, count(*) AS c FROM cand JOIN zf USING (field) GROUP BY ALL),
    tv AS (SELECT sz.candidate, sum(abs(coalesce(c, 0) / k - q)) / 2 AS tv FROM sz CROSS JOIN q LEFT JOIN o ON o.candidate = sz.candidate AND o.country = q.country AND o.crop = q.crop GROUP BY sz.candidate),
    rk AS (SELECT field, row_number() OVER (ORDER BY z, field) AS rn FROM zf),
    cu AS (SELECT sz.candidate, k, rn, sum(CASE WHEN cand.field IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY sz.candidate ORDER BY rn) AS c FROM sz CROSS JOIN rk LEFT JOIN cand ON cand.candidate = sz.candidate AND cand.field = rk.field),
    ks AS (SELECT candidate, max(abs(c / k - rn / (SELECT n FROM nn))) AS ks FROM cu GROUP BY candidate),
    sc AS (SELECT sz.candidate, 2 * abs(k / (SELECT n FROM nn) - 0.15) + tv + ks AS score, k, ks FROM sz JOIN tv USING (candidate) JOIN ks USING (candidate))"""


BY_YEAR = score_sql("SELECT CAST(year AS STRING) AS candidate, field FROM fx_fields")
PAIRS = f"{BY_YEAR}, ys AS (SELECT DISTINCT year FROM fx_fields), pr AS (SELECT a.year AS test, b.year AS val FROM ys a, ys b WHERE a.year <> b.year), bad AS (SELECT DISTINCT test, val FROM pr, (SELECT DISTINCT crop FROM fx_fields) c WHERE NOT EXISTS (SELECT 1 FROM fx_fields f WHERE f.crop = c.crop AND f.year <> test AND f.year <> val)), ps AS (SELECT test, val, t.score + v.score AS score FROM pr JOIN sc t ON CAST(test AS STRING) = t.candidate JOIN sc v ON CAST(val AS STRING) = v.candidate WHERE (test, val) NOT IN (SELECT test, val FROM bad))"


@query(f"WITH {BY_YEAR} SELECT candidate, k, round(ks, 6) AS ks, round(score, 6) AS score FROM sc")
def split_score(fx: Fx) -> DataFrame:
    c = fx.kept("fields").fields.select("field", F.col("year").cast("string").alias("candidate"))
    return rounded(S.split_scores(c, S.standardised(fx.fields, "yield_mean", ["crop", "country"]), [["country", "crop"]]).select("candidate", "k", "ks", "score"))


@query(f"WITH {PAIRS} SELECT test, val, round(score, 6) AS score FROM ps")
def loyo_pairs(fx: Fx) -> DataFrame:
    return rounded(S.leave_years_out(fx.kept("fields").fields, "year", "crop", "country"))


@query(f"WITH {PAIRS} SELECT test, val, round(score, 6) AS score FROM ps ORDER BY round(score, 9), test, val LIMIT 1")
def loyo_split(fx: Fx) -> DataFrame:
    return rounded(S.best_pair(S.leave_years_out(fx.kept("fields").fields, "year", "crop", "country")))


TRIALS = 20_000

#: Every trial takes its regions in the order of their draws, one a round; then all sets of all trials are scored in full.
DRAWN = f"""{Z}, nn AS (SELECT count(*) AS n FROM zf), rs AS (SELECT region, count(*) AS size FROM zf GROUP BY region), tn AS (SELECT unnest(range(0, {TRIALS})) AS trial),
    od AS (SELECT trial, region, size, row_number() OVER (PARTITION BY trial ORDER BY md5(concat_ws('|', '42', CAST(trial AS VARCHAR), region))) AS k FROM tn, rs),
    gr AS (SELECT trial, CAST(0 AS BIGINT) AS k, CAST('' AS VARCHAR) AS region, 0 AS role, CAST(0 AS DOUBLE) AS t, CAST(0 AS DOUBLE) AS v FROM tn
        UNION ALL SELECT trial, k, region, role, t + CASE WHEN role = 2 THEN size ELSE 0 END, v + CASE WHEN role = 1 THEN size ELSE 0 END
        FROM (SELECT g.trial, o.k, o.region, o.size, g.t, g.v, CASE WHEN greatest(abs(t - 0.15 * n) - abs(t + size - 0.15 * n), abs(v - 0.15 * n) - abs(v + size - 0.15 * n)) <= 0 THEN 0 WHEN abs(t - 0.15 * n) - abs(t + size - 0.15 * n) >= abs(v - 0.15 * n) - abs(v + size - 0.15 * n) THEN 2 ELSE 1 END AS role FROM gr g JOIN od o ON g.trial = o.trial AND o.k = g.k + 1 CROSS JOIN nn)),
    ok AS (SELECT trial FROM gr WHERE role > 0 GROUP BY trial HAVING count(DISTINCT role) = 2 INTERSECT SELECT trial FROM gr JOIN zf USING (region) WHERE role = 0 GROUP BY trial HAVING count(DISTINCT crop) = (SELECT count(DISTINCT crop) FROM zf)),
    cand AS (SELECT trial * 3 + role AS candidate, field, country, crop, year FROM gr JOIN zf USING (region) WHERE role > 0 AND trial IN (SELECT trial FROM ok)),
    sz AS (SELECT candidate, count(*) AS k FROM cand GROUP BY candidate),
    q AS (SELECT country, crop, count(*) / (SELECT n FROM nn) AS q FROM zf GROUP BY country, crop), o AS (SELECT candidate, country, crop, count(*) AS c FROM cand GROUP BY ALL),
    tv AS (SELECT sz.candidate, sum(abs(coalesce(c, 0) / k - q)) / 2 AS tv FROM sz CROSS JOIN q LEFT JOIN o ON o.candidate = sz.candidate AND o.country = q.country AND o.crop = q.crop GROUP BY sz.candidate),
    yq AS (SELECT year, count(*) / (SELECT n FROM nn) AS q FROM zf GROUP BY year), yo AS (SELECT candidate, year, count(*) AS c FROM cand GROUP BY ALL),
    yv AS (SELECT sz.candidate, sum(abs(coalesce(c, 0) / k - q)) / 2 AS yv FROM sz CROSS JOIN yq LEFT JOIN yo ON yo.candidate = sz.candidate AND yo.year = yq.year GROUP BY sz.candidate),
    rk AS (SELECT field, row_number() OVER (ORDER BY z, field) AS rn FROM zf),
    cu AS (SELECT candidate, rn, row_number() OVER (PARTITION BY candidate ORDER BY rn) AS c FROM cand JOIN rk USING (field)),
    ks AS (SELECT sz.candidate, max(greatest(abs(c / k - rn / n), abs((c - 1) / k - (rn - 1) / n))) AS ks FROM cu JOIN sz ON cu.candidate = sz.candidate CROSS JOIN nn GROUP BY sz.candidate),
    sc AS (SELECT sz.candidate // 3 AS trial, 2 * abs(k / (SELECT n FROM nn) - 0.15) + tv + yv + ks AS score FROM sz JOIN tv USING (candidate) JOIN yv USING (candidate) JOIN ks USING (candidate))"""


@query(f"WITH RECURSIVE {DRAWN} SELECT trial, round(sum(score), 6) AS score FROM sc GROUP BY trial ORDER BY round(sum(score), 9), trial LIMIT 1")
def loro_split(fx: Fx) -> DataFrame:
    """The best of random assignments of regions."""
    return rounded(S.leave_regions_out(fx.kept("fields").fields, "region", "crop", "country", "year", TRIALS).select("trial", "score"))


FOLDS = "cy AS (SELECT year AS fold, coalesce(lead(year) OVER (ORDER BY year), min(year) OVER ()) AS val FROM (SELECT DISTINCT year FROM fx_fields)), fo AS (SELECT fold, field, CASE WHEN year = fold THEN 2 WHEN year = val THEN 1 ELSE 0 END AS role FROM fx_fields, cy)"


@query(f"WITH {FOLDS} SELECT fold, field, CAST(role AS INTEGER) AS role FROM fo")
def cv_folds(fx: Fx) -> DataFrame:
    return S.fold_roles(fx.fields, "year").select("fold", "field", "role")


ALL = f"{FOLDS}, ff AS (SELECT DISTINCT fold FROM fo), d AS (SELECT g.fold, f.*, role FROM ff g CROSS JOIN fx_fields f LEFT JOIN fo ON f.field = fo.field AND fo.fold = g.fold)"


def _check_sql(name: str, rows: str) -> str:
    return f"SELECT f.fold, '{name}' AS \"check\", count(r.fold) AS n FROM ff f LEFT JOIN ({rows}) r ON f.fold = r.fold GROUP BY f.fold"


@query(f"WITH {ALL} " + " UNION ALL ".join([
    _check_sql("no role", "SELECT fold FROM d WHERE role IS NULL"), _check_sql("year on two sides", "SELECT fold, year FROM d GROUP BY fold, year HAVING count(DISTINCT role) > 1"),
    _check_sql("physical_field on two sides", "SELECT fold, physical_field FROM d GROUP BY fold, physical_field HAVING count(DISTINCT role) > 1"), _check_sql("crop missing in train", "SELECT fold, crop FROM d GROUP BY fold, crop HAVING count_if(role = 0) = 0"),
    "SELECT fold, 'empty roles', 3 - count(DISTINCT role) FROM d GROUP BY fold"]))
def split_checks(fx: Fx) -> DataFrame:
    fx = fx.kept("fields")
    return S.split_violations(S.fold_roles(fx.fields, "year"), fx.fields, ["year", "physical_field"], "crop", ["fold"])


@query(f"WITH {ALL} SELECT fold, CAST(role AS INTEGER) AS role, crop, count(*) AS n_fields, CAST(sum(n_pixels) AS BIGINT) AS n_pixels, round(avg(yield_mean), 6) AS yield_mean, round(count(*) / sum(count(*)) OVER (PARTITION BY fold, role), 6) AS share FROM d GROUP BY fold, role, crop")
def split_composition(fx: Fx) -> DataFrame:
    fx = fx.kept("fields")
    return rounded(S.composition(S.fold_roles(fx.fields, "year"), fx.fields, "crop", ["fold"]))


@query(f"WITH {FOLDS} SELECT fold, 'field' AS kind, country, count(*) AS n FROM fo JOIN fx_fields USING (field) WHERE role > 0 GROUP BY fold, country")
def split_membership(fx: Fx) -> DataFrame:
    fx = fx.kept("fields")
    return S.fold_roles(fx.fields, "year").where("role > 0").join(fx.fields.select("field", "country"), "field").groupBy("fold", F.lit("field").alias("kind"), "country").agg(F.count("*").alias("n"))


def _boot(fx: Fx) -> DataFrame:
    p = fx.preds.groupBy("field", "country").agg(F.avg("target").alias("target"), F.avg("pred_m0").alias("m0"), F.avg("pred_m1").alias("m1"))
    return S.bootstrap_scores(p, ["country"], ["m0", "m1"], 1000, 7)


UNIT = "CAST(('0x' || substr(md5(concat_ws('|', {keys})), 1, 8))::BIGINT / 4294967296.0 AS DOUBLE)"
BOOT = f"""pf AS (SELECT field, country, avg(target) AS target, avg(pred_m0) AS m0, avg(pred_m1) AS m1 FROM fx_preds GROUP BY field, country), ow AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY field) - 1 AS i, count(*) OVER (PARTITION BY country) AS n FROM pf),
    pk AS (SELECT country, draw, CAST(floor({UNIT.format(keys="'7', country, CAST(draw AS STRING), CAST(k AS STRING)")} * n) AS BIGINT) AS i FROM (SELECT country, n, draw, unnest(range(0, n)) AS k FROM (SELECT country, count(*) AS n, unnest(range(0, 1000)) AS draw FROM pf GROUP BY country))),
    bd AS (SELECT pk.country, draw, target, m0, m1, avg(target) OVER (PARTITION BY pk.country, draw) AS m FROM pk JOIN ow ON pk.country = ow.country AND pk.i = ow.i),
    bo AS (SELECT draw, country, 'm0' AS model, 1 - sum(power(target - m0, 2)) / nullif(sum(power(target - m, 2)), 0) AS r2, count(*) AS n FROM bd GROUP BY draw, country UNION ALL SELECT draw, country, 'm1', 1 - sum(power(target - m1, 2)) / nullif(sum(power(target - m, 2)), 0), count(*) FROM bd GROUP BY draw, country)"""


@query(f"WITH {BOOT} SELECT CAST(draw AS INTEGER) AS draw, country, model, round(r2, 6) AS r2, n FROM bo")
def paired_bootstrap(fx: Fx) -> DataFrame:
    return rounded(_boot(fx).select("draw", "country", "model", "r2", "n"))


@query(f"WITH {BOOT}, dd AS (SELECT a.model, a.draw, median(a.r2) AS r2, median(a.r2 - b.r2) AS delta FROM bo a JOIN bo b ON a.draw = b.draw AND a.country = b.country AND b.model = 'm0' GROUP BY a.model, a.draw) SELECT model, round(quantile_cont(r2, 0.05), 6) AS lo, round(quantile_cont(r2, 0.95), 6) AS hi, round(median(delta), 6) AS delta, round(avg(CASE WHEN delta > 0 THEN 1 ELSE 0 END), 6) AS share_better FROM dd GROUP BY model")
def bootstrap_ci(fx: Fx) -> DataFrame:
    return rounded(S.bootstrap_interval(_boot(fx), ["country"], "m0"))


@query("WITH f AS (SELECT DISTINCT year FROM fx_fields), h AS (SELECT DISTINCT year, concat('own-', CAST(year % 3 AS STRING)) AS run, 0 AS rank FROM fx_fields WHERE year % 2 = 0 UNION ALL SELECT DISTINCT year, concat('other-', CAST(farm % 2 AS STRING)), 1 FROM fx_fields WHERE year < 2000) SELECT f.year, run, CAST(rank AS INTEGER) AS rank FROM f LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY year ORDER BY rank, run) AS q FROM h) h ON f.year = h.year AND q = 1")
def fold_resolution(fx: Fx) -> DataFrame:
    f = fx.kept("fields").fields
    own = f.where("year % 2 = 0").select("year", F.concat(F.lit("own-"), (F.col("year") % 3).cast("string")).alias("run")).distinct()
    other = f.where("year < 2000").select("year", F.concat(F.lit("other-"), (F.col("farm") % 2).cast("string")).alias("run")).distinct()
    return S.resolve_folds(f.select("year").distinct(), own, other, "year")


@query("""WITH tr AS (SELECT * FROM fx_preds WHERE year < 1999), s AS (SELECT avg(z) AS m, stddev_pop(z) AS d FROM tr), g AS (SELECT crop, avg(target) AS m, stddev_samp(target) AS d FROM tr GROUP BY crop), c AS (SELECT field, row_number() OVER (ORDER BY field) - 1 AS code FROM (SELECT DISTINCT field FROM fx_preds))
    SELECT CASE WHEN p.year < 1999 THEN 'train' ELSE 'test' END AS role, p.crop, count(*) AS n, round(avg((z - s.m) / s.d), 6) AS x, round(avg((target - g.m) / g.d), 6) AS y, max(code) AS code FROM fx_preds p CROSS JOIN s JOIN g ON p.crop = g.crop JOIN c ON p.field = c.field GROUP BY 1, 2""")
def normalised_export(fx: Fx) -> DataFrame:
    from fieldloom.operators import filters as L
    from fieldloom.operators.tables import integer_codes

    role = F.when(F.col("year") < 1999, "train").otherwise("test").alias("role")
    p = fx.stored(fx.kept("pixels").preds.select("field", "crop", "z", "target", role), "preds")  # met five times
    train = p.where("role = 'train'")
    x = L.scaled(p, L.scaler(train, ["z"]), ["z"])
    x = x.join(M.fallback_stats(train, "target", ["crop"], p.select("crop").distinct()), "crop").join(integer_codes(p, "field"), "field")
    return rounded(x.groupBy("role", "crop").agg(F.count("*").alias("n"), F.avg("z").alias("x"), F.avg((F.col("target") - F.col("mean")) / F.col("sd")).alias("y"), F.max("code").alias("code")))
