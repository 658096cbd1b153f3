"""Queries: space."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldloom.operators import profile as P
from fieldloom.operators import spatial as G
from fieldloom.operators.quantiles import group_quantiles
from fieldloom.plans.evaluation import rounded
from fieldloom.plans.fixtures import Fx
from fieldloom.plans.registry import query
from fieldloom.session import checkpoint_dir

PX = "px AS (SELECT field, prow, pcol, z, target FROM fx_masked)"
ALL_PX = "px AS (SELECT field, prow, pcol, z, target FROM fx_pixels)"


def _px(fx: Fx) -> DataFrame:
    """Pixels of fields with holes and ragged edges, for what depends on these."""
    return fx.masked.select("field", "prow", "pcol", "z", "target")


def _all(fx: Fx) -> DataFrame:
    return fx.pixels.select("field", "prow", "pcol", "z", "target")


@query(f"WITH {ALL_PX}, b AS (SELECT field, min(prow) AS r0, min(pcol) AS c0, max(prow) - min(prow) + 1 AS h, max(pcol) - min(pcol) + 1 AS w FROM px GROUP BY field) SELECT px.field, prow - r0 AS r, pcol - c0 AS c, h, w FROM px JOIN b ON px.field = b.field")
def local_image(fx: Fx) -> DataFrame:
    return G.local_image(_all(fx), "field").select("field", "r", "c", "h", "w")


OFF = "o AS (SELECT CAST((r + 1) * 3 + c + 1 AS INTEGER) AS \"offset\", r, c FROM (SELECT unnest(range(-1, 2)) AS r), (SELECT unnest(range(-1, 2)) AS c))"


@query(f"WITH {ALL_PX}, {OFF} SELECT a.field, o.\"offset\", count(*) AS n, count(b.field) AS there FROM px a CROSS JOIN o LEFT JOIN px b ON b.field = a.field AND b.prow = a.prow + o.r AND b.pcol = a.pcol + o.c GROUP BY 1, 2")
def neighbours(fx: Fx) -> DataFrame:
    return G.neighbours(_all(fx), "field", 3).groupBy("field", "offset").agg(F.count("*").alias("n"), F.count_if("there").alias("there"))


@query(f"WITH {ALL_PX}, {OFF} SELECT a.field, round(avg(s), 6) AS patch_sum, CAST(sum(k) AS BIGINT) AS present FROM (SELECT a.field, a.prow, a.pcol, sum(coalesce(b.z, 0)) AS s, count(b.field) AS k FROM px a CROSS JOIN o LEFT JOIN px b ON b.field = a.field AND b.prow = a.prow + o.r AND b.pcol = a.pcol + o.c GROUP BY 1, 2, 3) a GROUP BY a.field")
def patch_gather(fx: Fx) -> DataFrame:
    p = G.patch_values(_all(fx), "field", "z", 3)
    total = lambda c, zero: F.aggregate(c, zero, lambda x, y: x + y)
    return rounded(p.groupBy("field").agg(F.avg(total("patch", F.lit(0.0))).alias("patch_sum"), F.sum(total("present", F.lit(0))).alias("present")))


EDGE = f"{PX}, cells AS (SELECT field, r, c FROM (SELECT DISTINCT field FROM px), (SELECT unnest(range(-1, 11)) AS r), (SELECT unnest(range(-1, 11)) AS c)), em AS (SELECT * FROM cells WHERE NOT EXISTS (SELECT 1 FROM px WHERE px.field = cells.field AND px.prow = r AND px.pcol = c)), ed AS (SELECT px.field, px.prow, px.pcol, sqrt(min(power(px.prow - r, 2) + power(px.pcol - c, 2))) * 10 AS edge FROM px JOIN em ON px.field = em.field GROUP BY ALL)"


@query(f"WITH {EDGE} SELECT field, prow, pcol, round(edge, 6) AS edge FROM ed")
def edge_distance(fx: Fx) -> DataFrame:
    return rounded(G.edge_distance(_px(fx), "field"))


@query(f"WITH {EDGE} SELECT field, count(*) AS n FROM ed WHERE edge > 10 GROUP BY field")
def edge_buffer(fx: Fx) -> DataFrame:
    return G.beyond_edge(_px(fx), "field", 10.0).groupBy("field").agg(F.count("*").alias("n"))


@query(f"WITH {EDGE} SELECT CASE WHEN edge > 0 AND edge <= 10 THEN 0 WHEN edge > 10 AND edge <= 20 THEN 1 WHEN edge > 20 THEN 2 END AS band, count(*) AS n, round(stddev_pop(p.target), 6) AS sd, round(sqrt(avg(power(p.pred - p.target, 2))), 6) AS rmse, round(median(abs(p.pred - p.target) / p.target), 6) AS rel FROM ed JOIN fx_preds p ON ed.field = p.field AND ed.prow = p.prow AND ed.pcol = p.pcol GROUP BY 1")
def distance_bands(fx: Fx) -> DataFrame:
    from fieldloom.functions.numeric import band

    d = G.edge_distance(_px(fx), "field").join(fx.preds, ["field", "prow", "pcol"])
    e = F.col("pred") - F.col("target")
    return rounded(d.groupBy(band("edge", [0, 10, 20, float("inf")]).alias("band")).agg(F.count("*").alias("n"), F.stddev_pop("target").alias("sd"), F.sqrt(F.avg(e * e)).alias("rmse"), F.median(F.abs(e) / F.col("target")).alias("rel")))


@query(f"WITH {PX}, k AS (SELECT a.field, a.prow, a.pcol, count(b.field) AS n FROM px a LEFT JOIN px b ON a.field = b.field AND abs(a.prow - b.prow) + abs(a.pcol - b.pcol) = 1 GROUP BY ALL) SELECT field, count(*) AS n FROM k WHERE n < 4 GROUP BY field")
def outline_cells(fx: Fx) -> DataFrame:
    return G.outline(_px(fx), "field").groupBy("field").agg(F.count("*").alias("n"))


#: Empty cells that the outside does not reach are holes; those that touch by sides are one.
HOLES = f"""{EDGE}, ou AS (SELECT DISTINCT field, CAST(-1 AS BIGINT) AS r, CAST(-1 AS BIGINT) AS c FROM px UNION SELECT em.field, em.r, em.c FROM ou JOIN em ON ou.field = em.field AND abs(ou.r - em.r) + abs(ou.c - em.c) = 1),
    hc AS (SELECT em.field, em.r, em.c FROM em ANTI JOIN ou ON em.field = ou.field AND em.r = ou.r AND em.c = ou.c),
    hl AS (SELECT field, r, c, r * 100 + c AS mark FROM hc UNION SELECT h.field, h.r, h.c, hl.mark FROM hl JOIN hc h ON h.field = hl.field AND abs(h.r - hl.r) + abs(h.c - hl.c) = 1),
    ho AS (SELECT field, mark, count(*) AS size FROM (SELECT field, r, c, min(mark) AS mark FROM hl GROUP BY field, r, c) GROUP BY field, mark),
    hs AS (SELECT field, count(*) AS holes, sum(size) AS empty, count_if(size < 25) AS small FROM ho GROUP BY field),
    dl AS (SELECT px.field, px.prow, px.pcol, sqrt(min(power(px.prow - r, 2) + power(px.pcol - c, 2))) * 10 AS to_outline FROM px JOIN ou ON px.field = ou.field GROUP BY ALL),
    dh AS (SELECT px.field, px.prow, px.pcol, sqrt(min(power(px.prow - r, 2) + power(px.pcol - c, 2))) * 10 AS to_hole FROM px JOIN hc ON px.field = hc.field GROUP BY ALL),
    ds AS (SELECT dl.*, to_hole FROM dl LEFT JOIN dh ON dl.field = dh.field AND dl.prow = dh.prow AND dl.pcol = dh.pcol),
    ns AS (SELECT field, count(*) AS n, avg(CASE WHEN to_outline <= 20 THEN 1 ELSE 0 END) AS edge_share, avg(CASE WHEN to_outline > 20 AND to_hole <= 20 THEN 1 ELSE 0 END) AS gap_share FROM ds GROUP BY field),
    pt AS (SELECT ns.field, n * 0.01 AS area_ha, CAST(coalesce(holes, 0) AS BIGINT) AS holes, coalesce(empty, 0) / (n + coalesce(empty, 0)) AS hole_share, coalesce(holes, 0) / ((n + coalesce(empty, 0)) * 0.01) AS holes_per_ha, small / holes AS small_holes, edge_share, gap_share FROM ns LEFT JOIN hs ON ns.field = hs.field)"""

MEASURES = ["hole_share", "holes_per_ha", "small_holes", "edge_share", "gap_share", "area_ha"]

#: Errors of each field-year, measures one below the other, and their bins by rank.
PATCHED = f"""{HOLES}, er AS (SELECT field, country, crop, abs(avg(pred - target)) / avg(target) * 100 AS abs_rel, CASE WHEN count(*) > 2 AND stddev_pop(pred) > 1e-12 AND stddev_pop(target) > 1e-12 THEN covar_pop(pred, target) / (stddev_pop(pred) * stddev_pop(target)) END AS within_r, sqrt(avg(power(pred - target, 2))) / avg(target) * 100 AS rmse_rel FROM fx_preds GROUP BY field, country, crop),
    ms AS ({" UNION ALL ".join(f"SELECT field, '{m}' AS measure, round({m}, 9) AS value FROM pt WHERE {m} IS NOT NULL" for m in MEASURES)}),
    rk AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY value, field) - 1 AS r, count(*) OVER (PARTITION BY measure) AS n, count(DISTINCT value) OVER (PARTITION BY measure) AS k FROM ms),
    bn AS (SELECT field, measure, value, CAST(CASE WHEN n = 1 THEN 0 ELSE greatest(0, ceil(r * 5 / (n - 1)) - 1) END AS INTEGER) AS bin FROM rk WHERE k >= 5)"""


def _patchy(fx: Fx) -> DataFrame:
    return G.patchiness(_px(fx), "field")


def _patchy_once(fx: Fx) -> DataFrame:
    """Walked once, as ranking reads them more than once: a row a field."""
    checkpoint_dir(fx.spark)
    return _patchy(fx).checkpoint()


@query(f"WITH RECURSIVE {HOLES} SELECT field, round(area_ha, 6) AS area_ha, holes, {', '.join(f'round({m}, 6) AS {m}' for m in MEASURES[:5])} FROM pt")
def patchiness(fx: Fx) -> DataFrame:
    """Holes need a walk over the grid of a field."""
    return rounded(_patchy(fx))


@query(f"WITH RECURSIVE {HOLES} SELECT field, prow, pcol, round(to_outline, 6) AS to_outline, round(to_hole, 6) AS to_hole FROM ds")
def patch_distances(fx: Fx) -> DataFrame:
    return rounded(G.patch_distances(_px(fx), "field"))


@query(f"WITH RECURSIVE {PATCHED} SELECT measure, bin, round(min(value), 6) AS lo, round(max(value), 6) AS hi, count(*) AS n, round(median(abs_rel), 6) AS abs_rel, round(median(within_r), 6) AS within_r, round(median(rmse_rel), 6) AS rmse_rel FROM bn JOIN er ON bn.field = er.field GROUP BY measure, bin")
def patchiness_vs_error(fx: Fx) -> DataFrame:
    """Errors of field-years by quintile of each measure."""
    errors = ["abs_rel", "within_r", "rmse_rel"]
    b = P.bins_by_rank(_patchy_once(fx), "field", MEASURES)
    d = b.join(G.field_errors(fx.preds, "field"), "field").checkpoint()
    out = d.groupBy("measure", "bin").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    # A measure has five bins however many fields there are, so no task may hold a bin.
    q = group_quantiles(P.long(d, ["measure", "bin"], errors).withColumnRenamed("feature", "error"), ["measure", "bin", "error"], "value", [0.5], ["mid"])
    mid = q.groupBy("measure", "bin").agg(*[F.max(F.when(F.col("error") == c, F.col("mid"))).alias(c) for c in errors])
    return rounded(out.join(mid, ["measure", "bin"]))


@query(f"""WITH RECURSIVE {PATCHED}, lg AS (SELECT ms.field, concat(measure, '|', country, '|', crop) AS subset, value AS a, abs_rel, within_r, rmse_rel FROM ms JOIN er ON ms.field = er.field),
    ee AS (SELECT subset, 'abs_rel' AS error, a, round(abs_rel, 9) AS b FROM lg WHERE abs_rel IS NOT NULL UNION ALL SELECT subset, 'within_r', a, round(within_r, 9) FROM lg WHERE within_r IS NOT NULL UNION ALL SELECT subset, 'rmse_rel', a, round(rmse_rel, 9) FROM lg WHERE rmse_rel IS NOT NULL),
    rr AS (SELECT subset, error, a, rank() OVER (PARTITION BY subset, error ORDER BY a) + (count(*) OVER (PARTITION BY subset, error, a) - 1) / 2 AS x, rank() OVER (PARTITION BY subset, error ORDER BY b) + (count(*) OVER (PARTITION BY subset, error, b) - 1) / 2 AS y FROM ee),
    rs AS (SELECT subset, error, CASE WHEN count(*) >= 10 AND count(DISTINCT a) >= 3 AND stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS rho FROM rr GROUP BY subset, error)
    SELECT split_part(subset, '|', 1) AS measure, error, count(rho) AS n_subsets, round(median(rho), 6) AS rho FROM rs GROUP BY 1, 2""")
def patchiness_correlation(fx: Fx) -> DataFrame:
    """Median over country and crop of the rank correlation of each measure with each error."""
    errors = ["abs_rel", "within_r", "rmse_rel"]
    f = G.field_errors(fx.preds, "field", ["country", "crop"])
    d = P.long(_patchy_once(fx), ["field"], MEASURES).where("value is not null").join(f, "field")
    d = P.long(d.select(F.concat_ws("|", "feature", "country", "crop").alias("subset"), F.col("value").alias("a"), *errors), ["subset", "a"], errors).where("value is not null")
    s = P.spearman(d.select(F.concat_ws("|", "subset", "feature").alias("subset"), "a", "value"), "subset", "a", "value")
    part = F.split("subset", r"\|")
    return rounded(s.groupBy(part[0].alias("measure"), part[3].alias("error")).agg(F.count("rho").alias("n_subsets"), F.median("rho").alias("rho")))


@query()
def terrain_fit(fx: Fx) -> DataFrame:
    """Weighted least squares around each pixel; held against exact surfaces in the tests."""
    return rounded(G.terrain(_px(fx), "field", "z"))


@query(f"WITH {ALL_PX}, m AS (SELECT field, median(z) AS m FROM px GROUP BY field) SELECT px.field, prow, pcol, round(z - m, 6) AS rel_z FROM px JOIN m ON px.field = m.field")
def relative_elevation(fx: Fx) -> DataFrame:
    return rounded(G.relative(_all(fx), "field", "z").select("field", "prow", "pcol", "rel_z"))


@query(f"WITH {ALL_PX}, im AS (SELECT px.*, prow - min(prow) OVER (PARTITION BY field) AS r, pcol - min(pcol) OVER (PARTITION BY field) AS c FROM px), s AS (SELECT unnest(range(0, 10, 2)) AS s), t AS (SELECT field, prow, pcol, z, a.s AS tr, b.s AS tc FROM im, s a, s b WHERE r >= a.s AND r < a.s + 4 AND c >= b.s AND c < b.s + 4), v AS (SELECT *, avg(z) OVER (PARTITION BY field, tr, tc) AS t FROM t) SELECT field, prow, pcol, round(avg(t), 6) AS value, count(*) AS n_tiles FROM v GROUP BY field, prow, pcol")
def tile_average(fx: Fx) -> DataFrame:
    return rounded(G.tile_average(_all(fx), "field", F.col("z"), 4, 2))


FOOT = "s AS (SELECT a.field AS a, b.field AS b, count(*) AS shared FROM fx_footprint a JOIN fx_footprint b ON a.x = b.x AND a.y = b.y AND a.field < b.field GROUP BY 1, 2), k AS (SELECT field, count(*) AS n FROM fx_footprint GROUP BY field), iou AS (SELECT a, b, shared, shared / (p.n + q.n - shared) AS iou FROM s JOIN k p ON a = p.field JOIN k q ON b = q.field)"


@query(f"WITH {FOOT} SELECT a, b, shared, round(iou, 6) AS iou FROM iou WHERE iou > 0.3")
def footprint_iou(fx: Fx) -> DataFrame:
    return rounded(G.footprint_overlap(fx.footprint, "field", 0.3))


@query(f"WITH RECURSIVE {FOOT}, e AS (SELECT a, b FROM iou WHERE iou > 0.3 UNION SELECT b, a FROM iou WHERE iou > 0.3), w AS (SELECT DISTINCT field AS node, field AS label FROM fx_footprint UNION SELECT e.b, w.label FROM w JOIN e ON w.node = e.a) SELECT node, min(label) AS label FROM w GROUP BY node")
def physical_fields(fx: Fx) -> DataFrame:
    return G.components(G.footprint_links(fx.footprint, "field", 0.3), fx.footprint.select(F.col("field").alias("node")).distinct())


NEAR = "nr AS (SELECT a.farm AS a, b.farm AS b, greatest(0, sqrt(min(power(a.x - b.x, 2) + power(a.y - b.y, 2))) - 20) AS gap FROM fx_outline a JOIN fx_outline b ON a.farm < b.farm WHERE abs(a.x - b.x) <= 10020 AND abs(a.y - b.y) <= 10020 GROUP BY 1, 2)"


@query(f"WITH {NEAR} SELECT a, b, round(gap, 6) AS gap FROM nr WHERE gap <= 10000")
def proximity_pairs(fx: Fx) -> DataFrame:
    return rounded(G.proximity(fx.outline, "farm", 10_000))


#: Farms and the physical fields they hold in some year: neighbours in number hold one together now and then.
SHARED = "pf AS (SELECT farm, farm AS physical FROM fx_outline UNION ALL SELECT farm, farm - 60 FROM fx_outline WHERE farm % 25 = 3)"


@query(f"WITH RECURSIVE {NEAR}, {SHARED}, e AS (SELECT a, b FROM nr WHERE gap <= 10000 UNION SELECT b, a FROM nr WHERE gap <= 10000 UNION SELECT p.farm, q.farm FROM pf p JOIN pf q ON p.physical = q.physical AND p.farm <> q.farm), w AS (SELECT farm AS node, farm AS label FROM fx_outline UNION SELECT e.b, w.label FROM w JOIN e ON w.node = e.a), l AS (SELECT node, min(label) AS label FROM w GROUP BY node) SELECT label, string_agg(CAST(node AS STRING), '+' ORDER BY CAST(node AS STRING)) AS name, count(*) AS n FROM l GROUP BY label")
def regions(fx: Fx) -> DataFrame:
    """Farms joined by proximity or a physical field that they share, named by their members."""
    farms = fx.outline
    held = farms.select("farm", F.col("farm").alias("physical")).unionByName(farms.where("farm % 25 = 3").select("farm", (F.col("farm") - 60).alias("physical")))
    return G.joined_names(G.region_labels(farms, held, "farm", "physical", 10_000))


@query("WITH p AS (SELECT n_nationkey, n_nationkey * 3.0 AS lat, n_nationkey * 7.0 % 90 AS lon FROM nation) SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(6371.0 * sqrt(power(radians(b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), 2) + power(radians(b.lat - a.lat), 2)), 6) AS km FROM p a JOIN p b ON a.n_nationkey < b.n_nationkey")
def centre_distances(fx: Fx) -> DataFrame:
    p = fx.nation.select("n_nationkey", (F.col("n_nationkey") * 3.0).alias("lat"), (F.col("n_nationkey") * 7.0 % 90).alias("lon"))
    return rounded(G.centre_distances(p, "n_nationkey"))


@query(f"WITH {ALL_PX} SELECT field, round(avg((pcol + 0.5) * 10), 6) AS x, round(avg((prow + 0.5) * 10), 6) AS y FROM px GROUP BY field")
def field_centroid(fx: Fx) -> DataFrame:
    return rounded(G.centroid(_all(fx), "field"))
