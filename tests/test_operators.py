"""Hand fixtures with known answers, brute force, and metamorphic checks."""

import itertools
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import features as X, numeric as N, scalars as P
from fieldloom.operators import filters as L, metrics as M, profile as R, resample as A, spatial as G, splits as S, tables as B, timeaxis as W
from fieldloom.sources import tables as IO


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def pixels(spark, mask, field="f"):
    return spark.createDataFrame([(field, int(r), int(c)) for r, c in zip(*np.where(mask))], "field string, prow long, pcol long")


def test_r2_and_constant_target(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 3.0, 4.0), ("b", 2.0, 1.0), ("b", 2.0, 3.0)], "g string, target double, pred double")
    out = {r.g: r for r in M.scores(df, ["g"]).collect()}
    assert out["a"].r2 == 0.5 and math.isclose(out["a"].rmse, math.sqrt(1 / 3)) and out["b"].r2 is None
    assert M.scores(df, []).first().n == 5


def test_murphy_is_the_mean_squared_error(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in rng.normal(size=(50, 2))], "g string, target double, pred double")
    r = M.murphy(df, ["g"]).first()
    assert math.isclose(r.level + r.scale + r.scatter, r.mse, rel_tol=1e-9)
    assert math.isclose(r.level_share + r.scale_share + r.scatter_share, 1.0, rel_tol=1e-9)


def test_paired(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 4.0), (4, 9.0), (5, None)], "k int, r2 double")
    b = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0), (9, 0.0), (5, 1.0)], "k int, r2 double")
    assert tuple(M.paired(a, b, "r2", ["k"]).first()) == (0.0, 1, 3)


def test_fallback_mean(spark):
    train = spark.createDataFrame([("x", "p", 1.0), ("x", "p", 3.0), ("x", "q", 8.0), ("y", "p", 5.0)], "a string, b string, v double")
    want = spark.createDataFrame([("x", "p"), ("x", "z"), ("w", "p")], "a string, b string")
    got = {(r.a, r.b): r.mean for r in M.fallback_stats(train, "v", ["a", "b"], want).collect()}
    assert got == {("x", "p"): 2.0, ("x", "z"): 4.0, ("w", "p"): 4.25}


def test_window_ties_and_negative_days(spark):
    s = spark.createDataFrame([("f", 10, 5, 1), ("f", 11, 5, 2), ("f", 12, 3, 3), ("f", -5, 1, 4)], "field string, day long, clouds long, scene long")
    assert rows(W.fewest_clouds(s, "field", 0, 10).select("k", "day")) == [(-1, -5), (1, 12)]
    assert rows(W.fewest_clouds(s.where("day <> 12"), "field", 0, 10).select("k", "day")) == [(-1, -5), (1, 11)]


def test_coverage_rule_and_missing_sum(spark):
    d = spark.createDataFrame([("f", k, 1.0 if k < 9 else None) for k in range(10)] + [("g", k, 1.0) for k in range(9)], "field string, day long, x double")
    out = {r.field: r for r in W.weather_windows(d, "field", 0, 10, 1, ["x"], ["x"], ["x"]).collect()}
    assert out["f"].x_mean == 1.0 and out["f"].x_sum == 9.0 and out["f"].x_last is None
    assert out["g"].x_mean is None and out["g"].n_days == 9


def test_circular_climatology(spark):
    d = spark.sql("select 1 as cell, d as date, 3.5D as v from (select explode(sequence(date'1995-01-01', date'1997-12-31')) as d)")
    n = W.climatology(d, "cell", "date", "v", 1995, 1996)
    assert n.count() == 365
    assert W.anomalies(d, n, "cell", "date", "v").where("abs(anomaly) > 1e-12 or anomaly is null").count() == 0


def test_align_to_event(spark):
    steps = spark.createDataFrame([("f", k, float(k)) for k in range(0, 10)], "field string, k long, v double")
    event = spark.createDataFrame([("f", 235)], "field string, event_day int")
    out = {r.m: r for r in W.align(steps, "field", event, 10, 210, -3, 3, ["v"]).collect()}
    assert out[0].v == 2.0 and out[-3].v is None and out[-3].observed == 0 and out[-2].v == 0.0


def test_stop_trace(spark):
    e = spark.createDataFrame([(1, k, s) for k, s in enumerate([5.0, 4.0, 4.0, 6.0, 7.0, 1.0])], "run int, epoch int, score double")
    assert tuple(W.stop_trace(e, ["run"], "epoch", "score", 3).first()) == (1, 1, 4.0, 4)
    assert tuple(W.stop_trace(e, ["run"], "epoch", "score", 9).first()) == (1, 5, 1.0, 5)


def test_index_and_texture(spark):
    d = spark.createDataFrame([(0.0, 0.0), (3.0, 1.0)], "a double, b double")
    assert rows(d.select(P.normalized_difference("a", "b"))) == [(0.5,), (None,)]
    t = spark.createDataFrame([(90.0, 5.0, 5.0), (0.0, 0.0, 0.0), (20.0, 20.0, 60.0), (None, 1.0, 1.0), (40.0, 40.0, 20.0)], "s double, i double, c double")
    assert [r[0] for r in t.select(P.texture_class("s", "i", "c")).collect()] == [0, -1, 11, -1, 3]


def test_bands_and_quantile_bins(spark):
    d = spark.createDataFrame([(0.0,), (10.0,), (10.0001,), (float("inf"),)], "x double")
    assert [r[0] for r in d.select(N.band("x", [0, 10, 20, float("inf")])).collect()] == [None, 0, 1, 2]
    q = spark.createDataFrame([("g", k) for k in range(1, 8)], "g string, v int").withColumn("b", N.quantile_bin(F.col("v"), 5, "g"))
    assert [r.b for r in q.orderBy("v").collect()] == [0, 0, 1, 2, 3, 4, 4]


def test_corr_of_constants(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0)], "g string, x double, y double")
    assert {r.g: r.r for r in d.groupBy("g").agg(N.corr("x", "y").alias("r")).collect()} == {"a": None, "b": pytest.approx(1.0)}


def test_specs():
    names = lambda *specs: [f.name for f in X.resolve(list(specs), {"crop": ["b", "a"], "country": ["c"]})]
    assert names("indices:ndvi,ndmi", "observed", "lai", "s2:B04", "weather:gdd", "era5land:t2m_c,swvl1") == ["ndvi", "ndmi", "observed", "lai", "B04", "gdd", "e5_t2m_c", "e5_swvl1"]
    assert names("soil:clay,sand@10-40", "soil:0-5", "crop", "country")[:3] == ["soil_clay_10-40cm", "soil_sand_10-40cm", "soil_clay_0-5cm"] and names("crop") == ["crop=b", "crop=a"]
    assert len(names("s2")) == 12 and len(names("weather")) == 9 and len(names("weather:all")) == 13 and len(names("terrain", "coords")) == 9 and len(names("era5land")) == 6
    for bad in (["what"], ["indices:x"], ["indices", "indices:ndvi"], ["soil:clay@30-10"], ["soil:gold"], ["ndvi"]):
        with pytest.raises(ValueError):
            X.resolve(bad)
    assert P.expand_columns(["b02", "b03", "z"], "z", "b.*") == ["z", "b02", "b03"]
    with pytest.raises(ValueError):
        P.expand_columns(["a"], "q")
    assert P.depth_weights(0, 30) == pytest.approx({(0, 5): 5 / 30, (5, 15): 10 / 30, (15, 30): 15 / 30})


def test_cells_round_halves_to_even(spark):
    d = spark.createDataFrame([(47.25, 8.35), (-0.05, -8.54)], "a double, b double")
    assert [r[0] for r in d.select(P.cell_id("a", "b")).collect()] == ["n047.2_e008.4", "n000.0_w008.5"]


def test_scaler(spark):
    d = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, c double")
    out = {r.feature: (r["mean"], r.sd, r.n) for r in L.scaler(d, ["x", "c"]).collect()}
    assert out == {"x": (2.0, 1.0, 2), "c": (5.0, 1.0, 3)}
    assert rows(L.scaled(d, L.scaler(d, ["x", "c"]), ["x", "c"])) == [(-1.0, 0.0), (0.0, 0.0), (1.0, 0.0)]


def test_edge_distance_square_and_brute_force(spark):
    square = np.ones((5, 5), bool)
    got = {(r.prow, r.pcol): r.edge for r in G.edge_distance(pixels(spark, square), "field").collect()}
    assert got[0, 2] == 10.0 and got[1, 1] == 20.0 and got[2, 2] == 30.0
    mask = np.random.default_rng(5).random((9, 9)) < 0.7
    p = np.pad(mask, 1)
    empty = np.argwhere(~p) - 1
    got = {(r.prow, r.pcol): r.edge for r in G.edge_distance(pixels(spark, mask), "field").collect()}
    for r, c in np.argwhere(mask):
        assert math.isclose(got[r, c], 10 * np.sqrt(((empty - (r, c)) ** 2).sum(axis=1).min()))
    inner = {(r.prow, r.pcol) for r in pixels(spark, mask).join(G.within_edge(pixels(spark, mask), "field", 2), ["field", "prow", "pcol"], "left_anti").collect()}
    assert inner == {k for k, v in got.items() if v > 20}


def test_hole(spark):
    mask = np.ones((5, 5), bool)
    mask[2, 2] = False
    r = G.patchiness(pixels(spark, mask), "field").first()
    assert (r.holes, r.small_holes) == (1, 1.0) and math.isclose(r.hole_share, 1 / 25) and math.isclose(r.area_ha, 0.24) and math.isclose(r.holes_per_ha, 4)
    assert math.isclose(r.edge_share, 24 / 24) and r.gap_share == 0.0
    mask[0, 2] = mask[1, 2] = False  # now the gap reaches the outside
    assert G.patchiness(pixels(spark, mask), "field").first().holes == 0


def test_patches_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    mask = np.ones((14, 17), bool)
    mask[rng.integers(0, 14, 20), rng.integers(0, 17, 20)] = False
    mask[5:11, 4:9] = False  # a hole of 30 cells
    outside, todo = set(), [(-1, -1)]
    empty = {(r, c) for r in range(-1, 15) for c in range(-1, 18) if not (0 <= r < 14 and 0 <= c < 17 and mask[r, c])}
    while todo:
        x = todo.pop()
        if x in empty and x not in outside:
            outside.add(x)
            todo += [(x[0] + 1, x[1]), (x[0] - 1, x[1]), (x[0], x[1] + 1), (x[0], x[1] - 1)]
    hole = empty - outside
    own = [(int(r), int(c)) for r, c in zip(*np.where(mask), strict=True)]
    near = lambda p, cells: 10 * min(math.dist(p, q) for q in cells)
    got = {(r.prow, r.pcol): (r.to_outline, r.to_hole) for r in G.patch_distances(pixels(spark, mask), "field").collect()}
    assert all(math.isclose(got[p][0], near(p, outside)) and math.isclose(got[p][1], near(p, hole)) for p in own)
    r = G.patchiness(pixels(spark, mask), "field").first()
    assert math.isclose(r.edge_share, np.mean([near(p, outside) <= 20 for p in own])) and math.isclose(r.gap_share, np.mean([near(p, outside) > 20 and near(p, hole) <= 20 for p in own]))
    assert math.isclose(r.small_holes, (r.holes - 1) / r.holes) and math.isclose(r.hole_share, len(hole) / (len(hole) + len(own)))
    assert G.patch_distances(pixels(spark, np.ones((3, 3), bool)), "field").where("to_hole is not null").count() == 0


def test_holes_that_count_as_field(spark):
    mask = np.ones((9, 9), bool)
    mask[4, 4] = mask[1, 7] = mask[2, 7] = False
    whole = {(r.prow, r.pcol): r.edge for r in G.edge_distance(pixels(spark, np.ones((9, 9), bool)), "field").collect()}
    got = {k: {(r.prow, r.pcol): r.edge for r in G.edge_distance(pixels(spark, mask), "field", min_hole=k).collect()} for k in (0, 2, 3)}
    assert got[0][4, 3] == 10.0 and got[2][4, 3] == whole[4, 3] and got[2][1, 6] == 10.0
    assert got[3] == {k: v for k, v in whole.items() if mask[k]}


def test_terrain_of_a_plane(spark):
    d = spark.createDataFrame([("f", r, c, 2.0 * c + 1.0 * r) for r in range(13) for c in range(13)], "field string, prow long, pcol long, z double")
    mid = G.terrain(d, "field", "z").where("prow = 6 and pcol = 6").first()
    assert math.isclose(mid.slope, math.degrees(math.atan(math.hypot(0.2, 0.1))), rel_tol=1e-6)
    # It rises eastwards and southwards, so it falls to the west and north.
    assert abs(mid.curvature) < 1e-6 and math.isclose(mid.aspect_sin, -0.2 / math.hypot(0.2, 0.1), rel_tol=1e-6) and math.isclose(mid.aspect_cos, 0.1 / math.hypot(0.2, 0.1), rel_tol=1e-6)
    dome = spark.createDataFrame([("f", r, c, -0.01 * ((r - 6) ** 2 + (c - 6) ** 2)) for r in range(13) for c in range(13)], "field string, prow long, pcol long, z double")
    top = G.terrain(dome, "field", "z").where("prow = 6 and pcol = 6").first()
    assert math.isclose(top.curvature, 2 * 2 * 0.01 / 100 * 1000, rel_tol=1e-6) and top.aspect_sin == 0.0 and top.aspect_cos == 0.0  # convex is positive, a flat top has no aspect
    few = G.terrain(d.where("prow < 4 and pcol < 4"), "field", "z")
    assert few.where("slope is not null").count() == 0


def test_terrain_against_least_squares(spark):
    rng = np.random.default_rng(3)
    mask, z = rng.random((12, 12)) < 0.7, rng.normal(size=(12, 12)) * 5 + 400
    d = spark.createDataFrame([("f", int(r), int(c), float(z[r, c])) for r, c in np.argwhere(mask)], "field string, prow long, pcol long, z double")
    for got in G.terrain(d, "field", "z").collect():
        near = [(r, c) for r, c in np.argwhere(mask) if abs(r - got.prow) <= 5 and abs(c - got.pcol) <= 5]
        e, n = (np.array([10.0 * (c - got.pcol) for _, c in near]), np.array([-10.0 * (r - got.prow) for r, _ in near]))
        w = np.sqrt(np.exp(-(e**2 + n**2) / (2 * 15.0**2)))
        x = np.linalg.lstsq(np.stack([np.ones_like(e), e, n, e * e, e * n, n * n], axis=1) * w[:, None], np.array([z[r, c] for r, c in near]) * w, rcond=None)[0]
        steep = math.hypot(x[1], x[2])
        assert len(near) >= 18
        assert np.allclose([got.slope, got.aspect_sin, got.aspect_cos, got.curvature], [math.degrees(math.atan(steep)), -x[1] / steep, -x[2] / steep, -2000 * (x[3] + x[5])], rtol=1e-6, atol=1e-8)


def test_overlap(spark):
    cells = spark.createDataFrame([("a", k, 0) for k in range(4)] + [("b", k, 0) for k in range(1, 5)], "field string, x long, y long")
    assert rows(G.footprint_overlap(cells, "field", 0.5)) == [("a", "b", 3, 0.6)]


def test_proximity_against_brute_force(spark):
    rng = np.random.default_rng(7)
    pts = [(int(k), float(x), float(y)) for k, (x, y) in zip(rng.integers(0, 40, 200), rng.uniform(0, 60_000, (200, 2)))]
    got = {(r.a, r.b): r.gap for r in G.proximity(spark.createDataFrame(pts, "farm long, x double, y double"), "farm", 3000.0).collect()}
    want = {}
    for (a, x, y), (b, u, v) in itertools.permutations(pts, 2):
        if a < b:
            d = max(0.0, math.hypot(x - u, y - v) - 20)
            want[a, b] = min(d, want.get((a, b), math.inf))
    want = {k: v for k, v in want.items() if v <= 3000}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)


def test_points_that_meet_are_not_sorted(spark):
    """Keys of one and of several points against brute force; the points' joins by tile hash one side, so none of it spills."""
    rng = np.random.default_rng(9)
    pts = [(k if k < 60 else 60 + k % 20, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-9_000, 9_000, (120, 2)))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = G.proximity(spark.createDataFrame(pts, "farm long, x double, y double"), "farm", 3000.0)
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = [(r.a, r.b, r.gap) for r in df.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin [tx" in plan and "SortMergeJoin [tx" not in plan
    want = {}
    for (a, x, y), (b, u, v) in itertools.permutations(pts, 2):
        if a < b:
            want[a, b] = min(max(0.0, math.hypot(x - u, y - v) - 20), want.get((a, b), math.inf))
    want = {k: v for k, v in want.items() if v <= 3000}
    assert len(got) == len(want) and all(math.isclose(want[a, b], gap, abs_tol=1e-6) for a, b, gap in got)


def _parts(spark, edges, nodes):
    return {r.node: r.label for r in G.components(edges.select("a", "b"), spark.createDataFrame([(n,) for n in nodes], "node long")).collect()}


def test_links_join_what_pairs_join(spark, monkeypatch):
    """Dense and sparse places, several points a key; copies of footprints. Fewer links than pairs, the same parts."""
    monkeypatch.setattr(G, "FIRST_POINTS", 1)
    rng = np.random.default_rng(3)
    pts = [(k % 150, float(x), float(y)) for k, (x, y) in enumerate(np.concatenate([rng.uniform(0, 2_500, (100, 2)), rng.uniform(0, 60_000, (100, 2)), rng.uniform(5_000, 7_000, (60, 2))]))]
    df = spark.createDataFrame(pts, "farm long, x double, y double")
    pairs, links = G.proximity(df, "farm", 3000.0), G.proximity_links(df, "farm", 3000.0)
    assert links.count() < pairs.count() and _parts(spark, links, range(150)) == _parts(spark, pairs, range(150))
    sets = [sorted(rng.choice(12, 6, replace=False).tolist()) for _ in range(30)] * 3
    cells = spark.createDataFrame([(k, 5, c) for k, own in enumerate(sets) for c in own], "field long, x long, y long")
    want = {(i, j): (len(set(p) & set(q)), len(set(p) & set(q)) / len(set(p) | set(q))) for i, p in enumerate(sets) for j, q in enumerate(sets) if i < j}
    want = {k: v for k, v in want.items() if v[1] > 0.4}
    pairs, links = G.footprint_overlap(cells, "field", 0.4), G.footprint_links(cells, "field", 0.4)
    assert {(r.a, r.b): (r.shared, r.iou) for r in pairs.collect()} == want and pairs.count() == len(want)
    assert links.count() < len(want) and _parts(spark, links, range(90)) == _parts(spark, pairs, range(90))


def test_overlaps_of_many_footprints(spark, monkeypatch):
    """2,000 footprints that share few cells: 2 million pairs meet, which comparing arrays row by row takes minutes for; and the
    same where runs of footprints are dealt."""
    from time import perf_counter

    rng = np.random.default_rng(5)
    sets = [sorted(rng.choice(40, 9, replace=False).tolist()) for _ in range(2000)]
    spark.createDataFrame([(k, 5, sets[k]) for k in range(2000)], "field long, x long, y array<long>").selectExpr("field", "x", "explode(y) y").createOrReplaceTempView("many")
    held = np.zeros((2000, 40), np.float32)
    for k, own in enumerate(sets):
        held[k, own] = 1
    shared = (held @ held.T).astype(int)
    want = {(int(a), int(b), int(shared[a, b])) for a, b in zip(*np.nonzero(np.triu(shared / (18 - shared) > 0.3, 1)), strict=True)}
    nodes = spark.range(2000).withColumnRenamed("id", "node")
    for run in (G.RUN, 300):
        monkeypatch.setattr(G, "RUN", run)
        began = perf_counter()
        got = [(r.a, r.b, r.shared) for r in G.footprint_overlap(spark.table("many"), "field", 0.3).collect()]
        assert perf_counter() - began < 45
        assert len(got) == len(want) and set(got) == want
        links = G.footprint_links(spark.table("many"), "field", 0.3)
        assert links.count() < len(want)
        assert {r.label for r in G.components(links, nodes).collect()} == {0}


def test_base_does_not_differ_from_itself(spark):
    """Scores whose last digits change each time they are computed, as those of sums over a shuffle may."""
    import random

    noisy = F.udf(lambda v: v + random.random() * 1e-12, "double").asNondeterministic()
    boot = spark.range(200).selectExpr("cast(id % 50 as int) draw", "concat('c', cast(id div 100 as string)) country", "concat('m', cast(id div 50 % 2 as string)) model", "id / 1000d r2").withColumn("r2", noisy("r2"))
    got = {r.model: (r.delta, r.share_better) for r in S.bootstrap_interval(boot, ["country"], "m0").collect()}
    assert got["m0"] == (0.0, 0.0) and math.isclose(got["m1"][0], 0.05, abs_tol=1e-9) and got["m1"][1] == 1.0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2)) if a != b] + [(k, k + 1) for k in range(100, 130)]
    nodes = list(range(140))
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in G.components(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(n,) for n in nodes], "node long")).collect()}
    assert got == {n: root(n) for n in nodes}
    named = G.joined_names(spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "node string, label string"))
    assert rows(named) == [("a", "a+b", 2), ("c", "c", 1)]


def test_identical_mix_scores_zero(spark):
    f = spark.createDataFrame([(str(k), "x", "w", float(k % 7)) for k in range(20)], "field string, country string, crop string, yield_mean double")
    z = S.standardised(f, "yield_mean", ["crop", "country"])
    r = S.split_scores(f.select("field", F.lit("all").alias("candidate")), z, [["country", "crop"]]).first()
    assert math.isclose(r.score, 2 * 0.85) and r.ks == 0.0


def test_row_wise_ks(spark):
    f = spark.createDataFrame([("a", "x", 0.1), ("b", "x", 0.1), ("c", "x", 0.5)], "field string, crop string, z double")
    r = S.split_scores(spark.createDataFrame([("m", "a"), ("m", "c")], "candidate string, field string"), f, [["crop"]]).first()
    assert math.isclose(r.ks, 1 / 6)


def test_years_with_a_lone_crop_are_not_held_out(spark):
    f = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 2, "x"), ("d", 3, "x"), ("e", 3, "x")], "field string, year int, crop string")
    pairs = {(r.test, r.val) for r in S.year_pairs(f, "year", "crop").collect()}
    assert pairs == {(2, 3), (3, 2)}


def test_folds_cycle(spark):
    f = spark.createDataFrame([(str(y), y) for y in range(2018, 2024)], "field string, year int")
    got = {r.field: r.role for r in S.fold_roles(f, "year").where("fold = 2023").collect()}
    assert got["2023"] == 2 and got["2018"] == 1 and sum(v == 0 for v in got.values()) == 4


def test_violations(spark):
    f = spark.createDataFrame([("a", "r", "x"), ("b", "r", "y"), ("c", "q", "x")], "field string, region string, crop string")
    s = spark.createDataFrame([("a", 0), ("b", 1)], "field string, role int")
    got = dict(rows(S.split_violations(s, f, ["region"], "crop")))
    assert got == {"no role": 1, "region on two sides": 1, "crop missing in train": 1, "empty roles": 1}


def _counts(f):
    """RegionCounts of (field, region, crop, country, yield, year) rows without ordered yields."""
    names = sorted({x[1] for x in f})
    size = np.array([float(sum(x[1] == r for x in f)) for r in names])
    return S.RegionCounts(names, size, np.ones((len(names), 1)), [], np.zeros((len(names), S.RANGES)))


def test_drawn_regions_follow_the_rule():
    counts = _counts([(str(k), f"r{k % 12}", "x", "c", 1.0, 1) for k in range(12 * 12 - 30)])
    roles = S.drawn_sets(counts, np.arange(40), 0.15, 42)
    size, goal = dict(zip(counts.names, counts.size, strict=True)), 0.15 * counts.size.sum()
    for t in range(40):
        order = sorted(counts.names, key=lambda r: hashlib.md5(f"42|{t}|{r}".encode()).hexdigest())  # noqa: B023
        tested = validating = 0.0
        for r in order:
            a, b = abs(tested - goal) - abs(tested + size[r] - goal), abs(validating - goal) - abs(validating + size[r] - goal)
            want = 0 if max(a, b) <= 0 else 2 if a >= b else 1
            assert roles[t, counts.names.index(r)] == want
            tested, validating = tested + size[r] * (want == 2), validating + size[r] * (want == 1)
    assert (roles == S.drawn_sets(counts, np.arange(40), 0.15, 42)).all() and (S.drawn_sets(counts, np.array([7]), 0.15, 42)[0] == roles[7]).all()


def test_trials_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "FIRST_TRIALS", 3)
    monkeypatch.setattr(S, "RANGES", 6)
    rng = np.random.default_rng(9)
    f = [(f"f{k:03d}", f"r{k % 11}", "xy"[k % 2], "cd"[k // 40], float(v), int(rng.integers(2000, 2004))) for k, v in enumerate(rng.normal(size=77))]
    df = spark.createDataFrame(f, "field string, region string, crop string, country string, yield_mean double, year int")
    z = {r.field: r.z for r in S.standardised(df, "yield_mean", ["crop", "country"]).collect()}
    order = sorted(z, key=lambda k: (z[k], k))
    counts, want = _counts(f), {}
    roles = S.drawn_sets(counts, np.arange(60), 0.15, 42)
    for t in range(60):
        by, total = dict(zip(counts.names, roles[t].tolist(), strict=True)), 0.0
        if {x[2] for x in f if by[x[1]] == 0} != {"x", "y"} or not {1, 2} <= set(by.values()):
            continue
        for s in (1, 2):
            own = [x for x in f if by[x[1]] == s]
            total += 2 * abs(len(own) / 77 - 0.15)
            for part in (lambda x: (x[2], x[3]), lambda x: x[5]):
                total += sum(abs(sum(part(x) == c for x in own) / len(own) - sum(part(x) == c for x in f) / 77) for c in {part(x) for x in f}) / 2
            held, ks, n = {x[0] for x in own}, 0.0, 0
            for i, k in enumerate(order):
                n += k in held
                ks = max(ks, abs(n / len(own) - (i + 1) / 77))
            total += ks
        want[t] = total
    got = S.leave_regions_out(df, "region", "crop", "country", "year", 60).first()
    assert (got.trial, round(got.score, 9)) == min(((t, round(v, 9)) for t, v in want.items()), key=lambda x: (x[1], x[0]))
    assert got.scored < len(want)
    bounds = S.lower_bounds(S.RegionCounts.of(S.standardised(df, "yield_mean", ["crop", "country"]), "region", "crop", [["crop", "country"], ["year"]]), roles, 0.15)
    assert all(bounds[t] <= v + 1e-9 for t, v in want.items()) and {int(t) for t in np.flatnonzero(np.isfinite(bounds))} == set(want)
    lone = df.withColumn("crop", F.col("region"))
    assert S.leave_regions_out(lone, "region", "crop", "country", "year", 10).count() == 0


def test_bootstrap_of_equal_models(spark):
    rng = np.random.default_rng(2)
    f = spark.createDataFrame([(str(k), "s", float(a), float(b), float(b)) for k, (a, b) in enumerate(rng.normal(size=(30, 2)))], "field string, sub string, target double, m0 double, m1 double")
    ci = {r.model: r for r in S.bootstrap_interval(S.bootstrap_scores(f, ["sub"], ["m0", "m1"], 15, 1), ["sub"], "m0").collect()}
    assert ci["m1"].delta == 0 and ci["m1"].share_better == 0 and ci["m0"].lo == ci["m1"].lo


def test_bootstrap_never_sends_the_weights(spark, monkeypatch):
    """Many fields: the fields are hashed where the weights meet them; the scores are those of fields that are sent."""
    f = spark.createDataFrame([(f"f{k}", "ab"[k % 2], float(k % 7), float(k % 5)) for k in range(40)], "field string, country string, target double, m0 double")
    sent = rows(S.bootstrap_scores(f, ["country"], ["m0"], 3, 1))
    monkeypatch.setattr(S, "SENT_FIELDS", 10)
    d = S.bootstrap_scores(f, ["country"], ["m0"], 3, 1)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=shuffle_hash" in plan and [(*x[:3], round(x[3], 9), x[4]) for x in rows(d)] == [(*x[:3], round(x[3], 9), x[4]) for x in sent]


def test_augmentations(spark):
    s = spark.range(40).select(F.col("id").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("step")).withColumn("x", (F.col("v") * 100 + F.col("step")).cast("double"))
    m = A.shifted(s, "v", "step", ["x"], 3, 20, 1)
    per = m.where("observed = 1").groupBy("v").agg(F.count_distinct(F.col("x") - F.col("step")).alias("k"), F.max(F.abs(F.col("x") - F.col("step") - F.col("v") * 100)).alias("d")).collect()
    assert m.count() == 800 and all(r.k == 1 and r.d <= 3 for r in per) and len({r.d for r in per}) > 1
    lost = A.dropped(s, "v", "step", ["x"], 0.3, 2).where("x is null").count()
    assert 160 < lost < 320
    n = A.noisy(s, "v", ["x"], 0.5, 3).join(s.withColumnRenamed("x", "y"), ["v", "step"]).withColumn("d", F.round(F.col("x") - F.col("y"), 9))
    assert n.groupBy("v").agg(F.count_distinct("d").alias("k")).where("k <> 1").count() == 0
    assert 0.2 < n.agg(F.stddev("d")).first()[0] < 0.9
    assert A.shifted(s, "v", "step", ["x"], 0, 20, 1).where("x <> v * 100 + step or observed = 0").count() == 0


def test_sets_and_codes(spark):
    a = spark.createDataFrame([(k,) for k in (5, 3, 9, 3, None)], "k int")
    assert rows(B.integer_codes(a, "k")) == [(3, 0), (5, 1), (9, 2)]
    x, y = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(B.symmetric_difference(x, y)) == [(1, "left"), (3, "right")]
    assert rows(B.replaced(x.withColumn("v", F.lit("o")), y.withColumn("v", F.lit("n")), ["k"])) == [(1, "o"), (2, "n"), (3, "n")]
    assert rows(B.in_every([x, y])) == [(2,)]
    ties = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4)], "g string, k int, v int")
    assert rows(B.best_rows(ties, ["g"], "v").select("k")) == [(1,), (2,)]


def test_builds_differ(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 1.0, None), (2, 2.0, None), (3, 0.0, 0.0)], "k int, x double, y double")
    assert rows(B.cell_differences(a, b, ["k"], ["x", "y"])) == [(2, "y"), (3, "x"), (3, "y")]


def test_json_profile(spark):
    d = spark.createDataFrame([('{"a": 1, "b": "x", "c": [1, 2, 3], "d": {"p": 1}, "e": true}',), ('{"a": -2.5, "b": null, "c": []}',), ('{"a": 1e3}',), ('{"a": 12345678901}',), (None,), ("broken",)], "doc string")
    got = {r.key: r for r in R.json_profile(d, "doc").collect()}
    assert (got["a"].present, got["a"].numbers, got["a"].lo, got["a"].mid, got["a"].hi) == (4, 4, -2.5, 500.5, 12345678901.0)
    assert got["b"].numbers == 0 and (got["b"].strings, got["b"].nulls) == (1, 1) and (got["c"].arrays, got["c"].shortest, got["c"].longest) == (2, 0, 3)
    assert got["d"].objects == 1 and got["d"].longest == 1 and got["e"].booleans == 1


def test_no_variant_is_above_itself(spark):
    rows_ = [(v, m, s, x + add + m / 10) for s, x in (("p", 0.1), ("q", 0.3)) for v, add in (("base", 0.0), ("same", 0.0), ("up", 0.2)) for m in (0, 1)]
    out = {r.variant: r.above for r in M.screening_summary(spark.createDataFrame(rows_, "variant string, member int, sub string, r2 double"), "variant", "member", ["sub"], "base").collect()}
    assert out == {"base": 0, "same": 0, "up": 2}


def test_length_chunks_are_full(spark):
    d = spark.createDataFrame([(k, k % 7) for k in range(100)], "key long, length long")
    out = W.length_chunks(d, "key", 5, 32)
    assert sorted(r["count"] for r in out.groupBy("chunk").count().collect()) == [4, 32, 32, 32]


def test_sources(spark, tmp_path):
    base = f"file://{tmp_path}"
    df = spark.createDataFrame([("a", 1, 65535.0), ("a", 2, float("nan")), ("b", 3, 7.0)], "country string, k long, x double")
    assert [r.x for r in IO.cleaned(df, {"x": 65535.0}).orderBy("k").collect()] == [None, None, 7.0]
    IO.write_partitioned(df, f"{base}/p", ["country"], ["k"])
    IO.write_partitioned(df.where("country = 'a'").withColumn("x", F.lit(0.0)), f"{base}/p", ["country"])
    assert rows(IO.read_parquet(spark, f"{base}/p", ["k", "x"])) == [(1, 0.0), (2, 0.0), (3, 7.0)]
    assert {r.path.rsplit("/", 2)[1] for r in IO.list_files(spark, f"{base}/p", "*.parquet").collect()} == {"country=a", "country=b"}
    (tmp_path / "w.csv").write_text("date,temp\n2020-01-01,3.5\n2020-01-02,\n")
    w = IO.read_weather(spark, f"{base}/w.csv", "date date, temp double", {"dew": "double"})
    assert w.columns == ["date", "temp", "dew"] and w.where("temp is null").count() == 1
    (tmp_path / "s.json").write_text('{"field": "f", "seeding_date": "01.10.2019", "harvesting_date": "20.07.2020"}\n{"field": "g", "seeding_date": null, "harvesting_date": "20.07.2020"}\n')
    s = {r.field: r for r in IO.read_seasons(spark, f"{base}/s.json").collect()}
    assert str(s["f"].jan1) == "2019-01-01" and s["f"].sow_day == 272 and s["f"].harvest_day == 565 and s["g"].sow_day is None
    split = spark.createDataFrame([("eu", 0, "a"), ("eu", 2, "b"), ("us", 0, "c")], "scope string, role int, field string")
    IO.write_partitioned(split, f"{base}/sp", ["scope"])
    of = spark.createDataFrame([("eu", "loyo"), ("us", "loro")], "scope string, method string")
    IO.write_split(spark.createDataFrame([("eu", "a", 0), ("eu", "b", 2), ("us", "c", 1)], "scope string, field string, role int"), of, f"{base}/sp2", ["scope"])
    IO.write_split(spark.createDataFrame([("us", "d", 1)], "scope string, field string, role int"), of.withColumn("method", F.lit("cv")), f"{base}/sp2", ["scope"])
    fields, attributes = IO.read_split(spark, f"{base}/sp2", scope="eu")
    assert rows(fields.select("field", "role")) == [("a", 0), ("b", 2)] and rows(attributes.select("method")) == [("loyo",)]
    assert rows(IO.read_split(spark, f"{base}/sp2", scope="us")[0].select("field")) == [("d",)] and rows(IO.read_split(spark, f"{base}/sp2", scope="us")[1].select("method")) == [("cv",)]
    IO.write_report(df, f"{base}/r", ["k"])
    assert IO.markdown(df.select("country", "k"), ["k"]).splitlines()[2] == "| a | 1 |"
    with pytest.raises(ValueError):
        IO.markdown(df, ["k"], most=2)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "field string, prow long, pcol long, z double, target double, pred double, g string")
    assert M.field_level(e, ["field"]).count() == M.murphy(e, ["g"]).count() == G.edge_distance(e, "field").count() == G.patchiness(e, "field").count() == 0
    assert G.components(e.select(F.col("prow").alias("a"), F.col("pcol").alias("b")), e.select(F.col("prow").alias("node"))).count() == 0
    assert R.coverage(e, ["g"], ["z"]).count() == 0


def test_plans_have_no_pairwise_join(spark, sf):
    from fieldloom.plans import registry

    for name in ("proximity_pairs", "footprint_iou", "neighbours", "edge_distance", "weather_windows", "thermal_windows"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_clamped_values_keep_missing(spark):
    d = spark.createDataFrame([(None, "wheat"), (5.0, "wheat"), (20.0, "rye")], "t double, crop string")
    got = d.select(P.growing_degrees("t", "crop", {"wheat": 10.0}), P.vapour_deficit("t", "t", True), P.cos_sun_zenith("t", F.lit(170)).isNull(), P.season_overlap(F.lit(10), 10, "t", F.lit(40)), P.frost("t")).collect()
    assert [r[0] for r in got] == [None, 0.0, 20.0] and [r[1] for r in got] == [None, 0.0, 0.0] and [r[2] for r in got] == [True, False, False]
    assert [r[3] for r in got] == [None, 1.0, 0.0] and [r[4] for r in got] == [0, 0, 0]


# Sources.


def test_weather_goes_by_each_header(spark, tmp_path):
    files = {"a.csv": "\ufeffDate,Temp_mean,RH_mean\n2020-01-01,10.5,70\n2020-01-02,,71\n", "b.csv": "Date,RH_mean,Temp_mean\n2020-01-01,70,10.5\n", "sub/c.csv": "Total_prec, Temp_mean ,Date,Date\n0.001,280,2020-01-03,x\n\nnan,abc,2020-01-04,y\n", "empty.csv": "", "only.csv": "Date,Temp_mean\n"}
    (tmp_path / "sub").mkdir()
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = sorted(rows(IO.read_weather(spark, f"file://{tmp_path}", "Date string, Temp_mean double", {"RH_mean": "double", "Total_prec": "double", "S_rad": "double"})), key=repr)
    assert got == sorted([("2020-01-01", 10.5, 70.0, None, None), ("2020-01-02", None, 71.0, None, None), ("2020-01-01", 10.5, 70.0, None, None), ("2020-01-03", 280.0, None, 0.001, None), ("2020-01-04", None, None, None, None)], key=repr)
    with pytest.raises(ValueError, match="lacks a column"):
        IO.read_weather(spark, f"file://{tmp_path}", "Date string, Temp_max double", {})


def test_classes_of_windows(spark):
    """One window for each class, by hand: cells of scenes as (field, day, scene, [codes inside], [codes outside])."""
    scenes = [
        ("f", 0, 1, [4, 5, 8, 8], [4]), ("f", 1, 2, [4, 4, 4, 10], [8, 8, 8]),  # the first has fewer cloud cells: half of it is clear
        ("f", 2, 3, [0, 0, 11, 11], [4]), ("f", 3, 4, [4, 4, 4, 9], [8, 8]),  # chosen without clouds and without a clear cell
        ("f", 4, 5, [2, 7, 3, 8], [4]), ("f", 5, 6, [6, 6, 8, 8], [4]),  # neither has a clear cell; the first has fewer clouds
        ("f", 6, 7, [4, 8, 8, 8], [4]),
        ("f", 12, 8, [4, 4, 4, 4], [4]), ("f", 40, 9, [4] * 4, [4]), ("f", -1, 10, [4] * 4, [4]),
    ]
    cells = spark.createDataFrame([(f, d, s, c, i < len(a)) for f, d, s, a, b in scenes for i, c in enumerate(a + b)], "field string, day long, scene long, code int, inside boolean")
    shares = W.scene_shares(cells, ["field", "day", "scene"], "code", F.col("inside"))
    seasons = spark.createDataFrame([("f", 0, 11), ("g", None, None)], "field string, sow_day long, harvest_day long")
    got = {(r.field, r.k): r for r in W.season_windows(shares, seasons, "field", 0, 2, 8).collect()}
    assert len(got) == 16 and [got["f", k]["class"] for k in range(8)] == ["valid", "rule_loss", "all_unusable", "partly_valid", "no_scene", "no_scene", "out_of_season", "out_of_season"]
    assert [got["f", k].cause for k in range(4)] == ["cloud", "snow", "dark", "cloud"] and got["f", 4].cause == "none"
    assert got["f", 0].chosen_day == 0 and got["f", 0].chosen_valid == 0.5 and got["f", 0].best_valid == 0.75 and got["f", 6].n_scenes == 1 and got["f", 6].n_in_season == 0
    assert {got["g", k]["class"] for k in range(8)} == {"no_scene"}
    a = {r.field: r for r in W.availability(spark.createDataFrame(list(got.values())), ["field"], "field").collect()}
    assert a["f"].n == 6 and math.isclose(a["f"].rule_loss, 1 / 6) and math.isclose(a["f"].usable, 2 / 6) and math.isclose(a["f"].best_usable, 3 / 6)
    c = W.class_shares(spark.createDataFrame(list(got.values())), ["field"]).where("field = 'f'").first()
    assert (c.cause, c.cause_share) == ("dark", 0.5)
    start = W.grid_start(shares, 5, 20).first()
    assert (start.start, start.outside, start.n) == (0, 2, 10)


def test_heat_on_days_without_weather(spark):
    days = spark.createDataFrame([("f", d, 10.0) for d in (0, 1, 2, 5, 9)] + [("g", 3, 4.0)], "field string, day long, heat double")
    scenes = spark.createDataFrame([("f", d, f"s{d}") for d in (0, 1, 3, 4, 5, 8, 20)] + [("g", 2, "x"), ("h", 4, "y")], "field string, day long, scene string")
    rules = spark.createDataFrame([("f", 1, 15.0), ("g", 0, 100.0), ("h", 0, 5.0)], "field string, start long, width double")
    got = {(r.field, r.day): (r.k, r.scene) for r in W.thermal_windows(scenes, days, rules, "field", "heat", 3, 0, 9).collect()}
    # Heat up to the day from day 1 on: 10, 20, 20, 30, 30, 40.
    assert got == {("f", 1): (0, "s1"), ("f", 3): (1, "s3"), ("f", 4): (1, "s4"), ("f", 5): (2, "s5"), ("f", 8): (2, "s8"), ("f", 20): (2, "s20"), ("g", 2): (0, "x"), ("h", 4): (0, "y")}


def test_whole_windows_of_heat_do_not_depend_on_the_sum(spark):
    days = spark.createDataFrame([("a", 1, 0.7), ("a", 2, 0.1)], "field string, day long, heat double")  # 0.7999999999999999
    scenes = spark.createDataFrame([("a", 2, 7)], "field string, day long, scene long")
    rules = spark.createDataFrame([("a", 0, 0.8)], "field string, start long, width double")
    assert [r.k for r in W.thermal_windows(scenes, days, rules, "field", "heat", 3, 0, 9).collect()] == [1]


def test_whole_means_do_not_depend_on_the_sum(spark):
    from types import SimpleNamespace

    from fieldloom.plans import profiles

    rows = [("A", farm, mean) for farm, own in ((597, 27.0), (1597, 27.0)) for mean in (np.nextafter(own, 0), own, np.nextafter(own, 99))]
    fields = spark.createDataFrame([(c, f, float(m)) for c, f, m in rows], "country string, farm long, yield_mean double")
    r = profiles.label_sanity(SimpleNamespace(fields=fields)).first()
    assert (r.missing, r.not_positive, r.too_large) == (0, 3, 0)


def test_heat_rules_by_group(spark):
    fields = [(f"n{k}", "n", "w", "A", 60 + k, 5 + k) for k in range(11)] + [("s0", "s", "w", "A", 40, None), ("x", "n", "b", "C", 50, 8)]
    df = spark.createDataFrame(fields, "field string, half string, crop string, country string, sow_day long, harvest_day long")
    days = df.select("field", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("day"), F.lit(2.0).alias("heat")).where("day <> 3")
    got = {(r.half, r.crop): r for r in W.heat_rules(df, days, "field", ["half", "crop"], "heat", F.col("country") != "C", 5, 0, 9, {("n", "b"): ("n", "w"), ("s", "w"): ("n", "w")}).collect()}
    assert set(got) == {("n", "w"), ("s", "w"), ("n", "b")}
    n = got["n", "w"]
    assert (n.start, n.n) == (30, 11) and n.width == 0.0  # heat counts from day 30, behind the days there are
    assert got["s", "w"].n == 1 and got["s", "w"].width is None and got["n", "b"].stands_for == "n|w"
    early = W.heat_rules(df.withColumn("sow_day", F.lit(30)), days, "field", ["half"], "heat", F.col("country") != "C", 5, 0, 9).where("half = 'n'").first()
    sums = [2.0 * (len([d for d in range(10) if d <= min(5 + k, 9) and d != 3])) for k in range(11)]
    assert early.start == 0 and early.width == round(float(np.percentile(sums, 95)) / 4, 1)


def test_quantiles_of_ranges(spark, monkeypatch):
    from fieldloom.operators import quantiles as Q

    monkeypatch.setattr(Q, "FEW", 30)
    monkeypatch.setattr(Q, "BINS", 16)
    rng = np.random.default_rng(4)
    values = {"wide": [*rng.normal(size=300) * 10.0 ** rng.integers(-2, 3, 300)], "ties": [1.0] * 200 + [2.0] * 90 + [1.5], "one": [3.0], "far": [1e8 + x for x in rng.normal(size=200)], None: [*rng.random(60)], "ends": [-1.7e308, 1.7e308, 0.0] * 20}
    data = [(g, float(v)) for g, vs in values.items() for v in vs] + [("ties", None), ("ties", float("nan")), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    at = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r for r in Q.group_quantiles(df, ["g"], "v", at).collect()}
    for g, vs in values.items():
        own = np.sort(vs)
        w = [(len(own) - 1) * a for a in at]
        want = [own[math.floor(x)] if own[math.floor(x)] == own[math.ceil(x)] else own[math.floor(x)] + (own[math.ceil(x)] - own[math.floor(x)]) * (x - math.floor(x)) for x in w]
        assert got[g].n == len(vs) and all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got[g][2:], want, strict=True))
    assert got["none"].n == 0 and got["none"].q50 is None and len(got) == len(values) + 1
    whole = Q.group_quantiles(df.where("g = 'far'"), [], "v", [0.5]).first()
    assert math.isclose(whole.q50, float(np.median(values["far"])), rel_tol=1e-14)
    assert Q.group_quantiles(df.where("false"), ["g"], "v", at).count() == 0


def test_average_ranks(spark):
    from fieldloom.operators import quantiles as Q

    data = [("a", x) for x in (3.0, 1.0, 1.0, 2.0, 3.0, 3.0, None)] + [(None, 5.0), (None, 4.0)]
    got = rows(Q.average_ranks(spark.createDataFrame(data, "g string, v double"), ["g"], "v", "r"))
    assert got == sorted([("a", 3.0, 5.0)] * 3 + [("a", 1.0, 1.5)] * 2 + [("a", 2.0, 3.0), ("a", None, None), (None, 5.0, 2.0), (None, 4.0, 1.0)], key=repr)


def test_no_window_or_list_holds_a_group(spark, sf):
    """Quantiles and ranks by group: windows run inside parts of a group, lists are of few values."""
    from fieldloom.plans import registry

    for name in ("error_quintiles", "spearman_by_group", "feature_shift", "coverage_by_group"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "median(" not in plan


def test_moments_far_from_zero(spark):
    rng = np.random.default_rng(12)
    y = 1e8 + rng.normal(size=900)
    p = y + 0.5 * rng.normal(size=900)
    df = spark.createDataFrame([(f"f{k % 30}", "ab"[k % 30 // 20], float(a), float(b)) for k, (a, b) in enumerate(zip(y, p, strict=True))], "field string, g string, target double, pred double")
    m = M.field_moments(df.unionByName(df.limit(1).withColumn("pred", F.lit(None).cast("double"))), "field", ["g"])
    for by, rows_ in (([], np.ones(900, bool)), (["g"], np.arange(900) % 30 < 20)):
        s = M.scores_from_moments(m, by).where("g = 'a'" if by else "true").first()
        t, q = y[rows_], p[rows_]
        assert math.isclose(1 - s.pixel_r2, ((t - q) ** 2).sum() / ((t - t.mean()) ** 2).sum(), rel_tol=5e-9) and s.n_pixels == len(t)  # a mean near 1e8 is a double to 7e-9
    whole, parts = M.merged_moments(m, []).first(), M.merged_moments(M.merged_moments(m, ["g"]), []).first()
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(whole, parts, strict=True))
    assert math.isclose(whole.cyp, ((y - y.mean()) * (p - p.mean())).sum(), rel_tol=1e-8)
    assert M.scores_from_moments(m.where("false"), ["g"]).count() == 0


def test_windows_at_random_places(spark):
    """Every window holds what its place and turn say, for fields larger and smaller than it, in all eight turns."""
    rng = np.random.default_rng(6)
    fields = {f"f{k}": sorted({(int(r), int(c)) for r, c in zip(rng.integers(3, 3 + h, 30), rng.integers(-2, w - 2, 30), strict=True)}) for k, (h, w) in enumerate([(12, 9), (2, 3), (1, 20), (6, 5)])}
    df = spark.createDataFrame([(f, r, c) for f, cells in fields.items() for r, c in cells], "field string, prow long, pcol long")
    got, turns, corners = {}, set(), set()
    for x in A.window_crop(df, "field", 5, 25, 3).collect():
        got.setdefault((x.field, x.draw), []).append(x)
    assert len(got) == 100
    for (f, _), own in got.items():
        t = own[0].turn
        turns.add(t)
        at = {}
        for x in own:
            r, c = x.r, 4 - x.c if t >= 4 else x.c
            for _ in range(t % 4):  # a quarter turn back
                r, c = 4 - c, r
            assert 0 <= r < 5 and 0 <= c < 5
            at[x.prow, x.pcol] = (r, c)
        corner = {(p - r, q - c) for (p, q), (r, c) in at.items()}
        assert len(corner) == 1
        r0, c0 = corner.pop()
        assert set(at) == {(p, q) for p, q in fields[f] if r0 <= p < r0 + 5 and c0 <= q < c0 + 5} != set()
        for first, lines in ((r0, [p for p, _ in fields[f]]), (c0, [q for _, q in fields[f]])):
            small = max(lines) - min(lines) < 5
            assert first <= min(lines) and first + 4 >= max(lines) if small else min(lines) <= first and first + 4 <= max(lines)
        corners.add((f, r0, c0))
    assert turns == set(range(8)) and len({x for x in corners if x[0] == "f1"}) > 3


def test_a_source_with_one_more_pixel_is_no_match(spark):
    ref = spark.createDataFrame([("f", 0, p, 1.0 * p) for p in range(4)] + [("f", 1, 0, None)], "field string, k int, pixel int, v double")
    scenes = {"s1": [(p, 1.0 * p) for p in range(4)], "s2": [(p, 1.0 * p) for p in range(5)], "s3": [(p, 1.0 * p) for p in range(3)], "s4": [(p, 1.0) for p in range(4)]}
    rows_ = spark.createDataFrame([("f", 0, p, v, s) for s, own in scenes.items() for p, v in own] + [("f", 1, 0, None, "s5"), ("f", 2, 0, 1.0, "s6"), ("f", 2, 1, 1.0, "s7")], "field string, k int, pixel int, v double, scene string")
    assert rows(B.attributed(rows_, ref, ["field", "k"], ["pixel"], "scene", ["v"])) == [("f", 0, "s1"), ("f", 1, "s5")]
    assert rows(B.empty_windows(rows_, ref, ["field", "k"], "scene")) == [("f", 2, 2)]


def test_report_of_a_build(spark):
    b = spark.createDataFrame([("f", p, k, 1.0) for p in range(3) for k in range(4)] + [("g", 0, 2, 1.0), ("h", 0, 3, None)], "field string, pixel int, k int, v double")
    a = b.where("k >= 1").withColumn("v", F.when(F.col("field") == "g", F.lit(None)).when((F.col("pixel") == 1) & (F.col("k") > 1), F.lit(2.0)).otherwise(F.col("v")))
    got = {r.field: r for r in B.build_report(a, b, "field", ["pixel"], "k", ["v"], 1).collect()}
    assert set(got) == {"f", "g"} and (got["f"].n_pixels, got["f"].windows, got["f"].n_early) == (1, [2, 3], 3) and (got["g"].n_pixels, got["g"].windows) == (1, [2])
    assert not got["f"].passes and not B.build_report(a, b.where("k >= 1"), "field", ["pixel"], "k", ["v"], 1, 1).first().passes
    assert B.build_report(a, b.where("k >= 1"), "field", ["pixel"], "k", ["v"], 1, 2).first().passes


def test_totals_count_values_that_are_not_listed(spark):
    got = rows(B.crosstab(spark.createDataFrame([("a", 1), ("a", 9), ("b", 1)], "g string, v int"), "g", "v", [1, 2]))
    assert got == [("a", 1, 0, 2), ("b", 1, 0, 1), ("total", 2, 0, 3)]


def test_bootstrap_against_picks(spark):
    rng = np.random.default_rng(1)
    data = [(f"f{k:02d}", "ab"[k % 2], 1e6 + float(y), 1e6 + float(y + e)) for k, (y, e) in enumerate(rng.normal(size=(31, 2)))] + [("z", "one", 5.0, 4.0)]
    df = spark.createDataFrame(data, "field string, s string, target double, m double")
    got = {(r.s, r.draw): (r.r2, r.n) for r in S.bootstrap_scores(df, ["s"], ["m"], 6, 7).collect()}
    for s in ("a", "b"):
        own = sorted(x for x in data if x[1] == s)
        for draw in range(6):
            pick = [own[int(int(hashlib.md5(f"7|{s}|{draw}|{k}".encode()).hexdigest()[:8], 16) / 2**32 * len(own))] for k in range(len(own))]
            y, p = np.array([x[2] for x in pick]), np.array([x[3] for x in pick])
            assert math.isclose(got[s, draw][0], 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel_tol=1e-6) and got[s, draw][1] == len(own)
    assert got["one", 0] == (None, 1)
    plan = S.bootstrap_scores(df, ["s"], ["m"], 40, 7)
    assert plan.count() == 120


def test_year_structure_of_lone_fields(spark):
    df = spark.createDataFrame([("g", 1, 1.0), ("g", 1, 3.0), ("g", 2, 5.0), ("h", 1, 2.0), ("h", 1, 4.0)], "g string, year int, v double")
    got = {r.g: r for r in M.year_structure(df, ["g"], "year", "v").collect()}
    assert math.isclose(got["g"].within_sd, math.sqrt(2 * 2.0 / 3)) and got["h"].between_share is None and math.isclose(got["h"].within_sd, math.sqrt(2.0))


def test_leaf_area_network(spark):
    """The network by numpy, in single steps."""
    b = [0.06, 0.05, 0.1, 0.25, 0.3, 0.35, 0.2, 0.12]
    d = spark.createDataFrame([(*b, 0.7), (*[0.0] * 8, 0.5), (*[0.3] * 7, None, 0.7)], ", ".join(f"{x} double" for x in (*P.LAI_BANDS, "sun")))
    got = [r.lai for r in d.select(P.snap_lai({x: F.col(x) for x in P.LAI_BANDS}, F.col("sun"), None, 0.25).alias("lai")).collect()]
    w = np.array(P.LAI_HIDDEN)
    x = 2 * (np.array([*b, math.cos(math.radians(5)), 0.7]) - P.LAI_LOW) / (np.array(P.LAI_HIGH) - P.LAI_LOW) - 1
    y = P.LAI_OUT[0] + np.tanh(w[:, 0] + w[:, 1:11] @ x + w[:, 11] * 0.25) @ np.array(P.LAI_OUT[1:])
    assert math.isclose(got[0], float(np.clip((y + 1) / 2 * (P.LAI_SPAN[1] - P.LAI_SPAN[0]) + P.LAI_SPAN[0], 0, 8)), rel_tol=1e-9) and 0 <= got[1] <= 8 and got[2] is None
    label = spark.range(1).select(P.window_label(F.lit(0)), P.window_label(F.lit(364)), P.window_label(F.lit(365)), P.window_label(F.lit(500))).first()
    assert tuple(label) == ("01 Jan Y-1", "31 Dec Y-1", "01 Jan Y", "16 May Y")


def test_load_keeps_its_order(spark):
    """Country, edge, clear steps, then the sample; steps from sowing; z-scores by the train role."""
    from fieldloom.operators import load as D

    cells = [(f, r, c) for f in ("a", "b", "x") for r in range(5) for c in range(5)]
    pixels_ = spark.createDataFrame([(*p, float(p[1]), 10.0 * p[2], 300.0, 300.0, 600.0) for p in cells], "field string, prow long, pcol long, target double, elevation double, clay_0_5 double, clay_5_15 double, clay_15_30 double")
    steps = spark.createDataFrame([(*p, k, None if (p[1] == 2 and k > 0) else 0.1 * (k + 1), 0.5) for p in cells for k in range(4)], "field string, prow long, pcol long, k long, B04 double, B08 double")
    fields = spark.createDataFrame([("a", "A", "wheat", 2000, 45.0, 115), ("b", "A", "maize", 2001, 45.0, 139), ("x", "B", "rye", 2000, 45.0, None)], "field string, country string, crop string, year int, lat double, sow_day long").withColumn("jan1", F.lit("2000-01-01").cast("date"))
    series = {"weather": spark.createDataFrame([(f, k, 5.0 + k) for f in "ab" for k in range(4)], "field string, k long, tmean_c double"), "era5land": spark.createDataFrame([("a", 1, 0.3)], "field string, k long, swvl1 double")}
    t = D.Tables(pixels_, steps, fields, 20, 100, spark.createDataFrame([("a", "train"), ("b", "test"), ("x", "test")], "field string, role string"), series)
    specs = ["indices:ndvi", "observed", "weather:tmean_c", "era5land:swvl1", "terrain:elevation", "soil:clay", "crop"]
    got = D.load(t, specs, ["train", "test"], align="sowing", season=(-20, 40), countries=["A"], edge_buffer_m=10.0, min_observed=2)
    inner = {(f, r, c) for f in "ab" for r in (1, 3) for c in (1, 2, 3)}  # row 2 is seen once, border pixels lie at the edge
    assert {tuple(r[:3]) for r in got.pixels.collect()} == inner
    s = {(r.field, r.prow, r.pcol, r.m): r for r in got.steps.collect()}
    assert len(s) == len(inner) * 3 and {k[3] for k in s} == {-1, 0, 1}
    one = s["a", 1, 1, 1]  # sown in window 0, so step 1 is window 1
    assert math.isclose(one.ndvi, (0.5 - 0.2) / 0.7) and (one.observed, one.tmean_c, one.e5_swvl1, one.day) == (1.0, 6.0, 0.3, 20)
    assert s["a", 1, 1, -1].ndvi is None and s["a", 1, 1, -1].observed == 0.0 and s["b", 1, 1, 1].tmean_c == 7.0
    p = got.pixels.where("field = 'a' and prow = 1 and pcol = 2").first()
    assert (p.elevation, p["soil_clay_0-30cm"], p["crop=maize"], p["crop=rye"], p["crop=wheat"]) == (20.0, pytest.approx(45.0), 0.0, 0.0, 1.0)
    few = D.load(t, ["observed"], fields=["a"], min_observed=2, pixels_per_field=4, n_windows=4)
    assert few.pixels.count() == 4 and few.pixels.where("prow = 2").count() == 0 and few.steps.count() == 16
    train = D.load(t, specs, ["train"], season=(100, 180))
    z = D.load(t, specs, ["train"], season=(100, 180), scaler=D.fit_scaler(train))
    m = z.steps.agg(F.avg("tmean_c"), F.stddev_pop("tmean_c"), F.count_if(F.col("e5_swvl1").isNull()), F.max("observed")).first()
    assert math.isclose(m[0], 0.0, abs_tol=1e-9) and math.isclose(m[1], 1.0) and m[2] == 0 and m[3] == 1.0
    with pytest.raises(ValueError, match="no sowing date"):
        D.load(t, ["observed"], ["test"], align="sowing")
    with pytest.raises(ValueError, match="other features"):
        D.load(t, ["observed"], ["train"], scaler=D.fit_scaler(train))
    lai = D.load(D.Tables(pixels_, steps.select("*", *[F.lit(0.2).alias(b) for b in P.LAI_BANDS if b != "B04"]), fields, 20, 100), ["lai"], fields=["a"], n_windows=4)
    assert lai.steps.where("lai is null and prow <> 2").count() == 0


def test_farms_that_share_a_field_are_one_region(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("b", 500.0, 0.0), ("c", 90_000.0, 0.0), ("d", 0.0, 90_000.0)], "farm string, x double, y double")
    held = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 3), ("e", 9), ("c", None), ("a", None)], "farm string, physical int")
    assert {r.node: r.label for r in G.region_labels(points, held, "farm", "physical", 10_000).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e"}


def test_members_of_other_fields_are_not_used(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("b", 1.0, 2.0, 3.0)], "field string, target double, pred_m0 double, pred_m2 double")
    means, check = M.member_fields(df, df, "field", 3)
    assert means.count() == 2 and means.columns == ["field", "target", "m0", "m1"] and tuple(check.first()) == (2, "only 2 members", 0, 0, True)
    means, check = M.member_fields(df, df.where("field = 'a'"), "field", 1)
    assert means.count() == 0 and tuple(check.first()) == (1, "", 0, 1, False)
    assert not M.member_fields(df.select("field", "target"), df, "field", 2)[1].first().usable


def test_edge_distance_of_odd_fields(spark):
    """Fields in two distant parts, with holes and with repeated pixels, against all pairs."""
    rng = np.random.default_rng(14)
    mask = np.ones((16, 19), bool)
    mask[rng.integers(0, 16, 12), rng.integers(0, 19, 12)] = False
    cells = [(int(r) - 3, int(c)) for r, c in zip(*np.where(mask), strict=True)] + [(5, 100_000_000 + c) for c in range(4)]
    df = spark.createDataFrame([("f", r, c) for r, c in cells + cells[:20]] + [("g", 0, 0)], "field string, prow int, pcol long")
    got = {(r.field, r.prow, r.pcol): r.edge for r in G.edge_distance(df, "field").collect()}
    empty = [(r, c) for r in range(-4, 14) for c in range(-1, 20) if (r, c) not in set(cells)]
    assert len(got) == len(cells) + 1 and got["g", 0, 0] == 10.0 and got["f", 5, 100_000_001] == 10.0
    assert all(math.isclose(got["f", r, c], 10 * min(math.dist((r, c), e) for e in empty)) for r, c in cells if c < 100)
    assert G.edge_distance(df, "field").schema["prow"].dataType.simpleString() == "int"


def test_files_are_written_and_listed_by_tasks(spark, tmp_path):
    base = f"file://{tmp_path}/t"
    df = spark.range(300).select((F.col("id") % 2).cast("string").alias("a"), F.when(F.col("id") % 100 > 0, F.concat(F.lit("k:"), F.col("id") % 100)).alias("b"), F.lit(7).alias("n"))
    IO.write_texts(df, base, ["a", "b"], F.repeat(F.lit("x"), F.col("n")))
    files = IO.list_files(spark, base, "part-*")
    assert "binaryFile" not in files._jdf.queryExecution().toString()  # such a scan has the driver list and hold all files
    want = df.groupBy("a", "b").agg(F.count("*").alias("n")).collect()
    name = lambda r: f"file:{tmp_path}/t/a={r.a}/b={'__HIVE_DEFAULT_PARTITION__' if r.b is None else r.b.replace(':', '%3A')}/part-0"
    assert rows(files.select("path", "length")) == sorted(((name(r), 8 * r.n) for r in want), key=repr)
    theirs = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(base)
    assert rows(theirs.select("path", "length", F.date_trunc("second", "modificationTime"))) == rows(files.select("path", "length", F.date_trunc("second", "modificationTime")))
    assert rows(spark.read.schema("value string, a string, b string").text(base).groupBy("a", "b").count()) == rows(df.groupBy("a", "b").count())
    IO.write_texts(df.where("a = 'none'"), f"{base}-empty", ["a"], F.lit("x"))
    assert IO.list_files(spark, f"{base}-empty").count() == 0


def test_fields_are_measured_together(spark):
    rng = np.random.default_rng(11)
    masks = {f"f{k}": rng.random((int(rng.integers(1, 40)), int(rng.integers(1, 40)))) < 0.8 for k in range(60)}
    masks["f60"] = rng.random((300, 280)) < 0.9  # an image of its own
    d = spark.createDataFrame([(f, int(r), int(c), float(r * c % 7)) for f, m in masks.items() for r, c in np.argwhere(m)], "field string, prow long, pcol long, z double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    seen = rows(G.by_fields(d, "field", ["prow"], lambda p: p.groupby(["field", "_f"], as_index=False).agg(n=("prow", "size"))[["field", "n"]], "field string, n long", least=120))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen == sorted(((f, int(m.sum())) for f, m in masks.items() if m.any()), key=repr)  # each field once and whole
    for of, key in ((G.patchiness, 1), (G.patch_distances, 3), (lambda p, f: G.edge_distance(p, f, min_hole=3), 3), (lambda p, f: G.terrain(p, f, "z"), 3)):
        out = of(d, "field")
        plan = out._jdf.queryExecution().toString()
        assert "MapInPandas" in plan and "FlatMapGroups" not in plan  # no call a field
        got = {tuple(r)[:key]: tuple(r)[key:] for r in out.collect()}
        for f in ("f3", "f17", "f60"):
            alone = {tuple(r)[:key]: tuple(r)[key:] for r in of(d.where(F.col("field") == f), "field").collect()}
            assert alone and all(all(x is y is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(v, got[k], strict=True)) for k, v in alone.items())


def test_no_task_holds_a_bin_of_patchiness(spark, sf):
    from fieldloom.plans import registry

    plan = registry.queries()["patchiness_vs_error"](spark, sf)._jdf.queryExecution().toString()
    assert "median(" not in plan and "percentile(" not in plan
    assert "MapInPandas" not in plan  # fields are walked once, before they are ranked


def test_neighbours_shuffle_pixels_once(spark):
    mask = np.random.default_rng(2).random((9, 8)) < 0.6
    d = pixels(spark, mask).withColumn("z", F.when(F.col("prow") != 3, F.col("prow") * 10.0 + F.col("pcol")))
    for df in (G.neighbours(d, "field", 3), G.patch_values(d, "field", "z", 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    there = lambda r, c: 0 <= r < 9 and 0 <= c < 8 and bool(mask[r, c])
    around = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
    got = {(x.prow, x.pcol, x.offset): (x.nrow, x.ncol, x.there) for x in G.neighbours(d, "field", 3).collect()}
    assert got == {(r, c, i): (r + y, c + x, there(r + y, c + x)) for r, c in np.argwhere(mask).tolist() for i, (y, x) in enumerate(around)}
    for p in G.patch_values(d, "field", "z", 3).collect():
        near = [(p.prow + y, p.pcol + x) for y, x in around]
        assert p.present == [int(there(*q)) for q in near]
        assert p.patch == [q[0] * 10.0 + q[1] if there(*q) and q[0] != 3 else 0.0 for q in near]


def test_edges_without_joins_and_with_repeated_pixels(spark):
    """Bands of windows against the distances; pixels are dealt once, neither joined nor multiplied."""
    rng = np.random.default_rng(21)
    cells = [("f", int(r), int(c)) for r, c in np.argwhere(rng.random((13, 11)) < 0.85)] + [("g", 0, c) for c in range(3)]
    df = spark.createDataFrame([(*k, i) for i, k in enumerate(cells + cells[:25])], "field string, prow int, pcol long, own int")
    edge = {(r.field, r.prow, r.pcol): r.edge for r in G.edge_distance(df, "field").collect()}
    for buffer in (0.0, 10.0, 14.2, 20.0, 25.0, 1000.0):
        got = G.beyond_edge(df, "field", buffer).collect()
        assert sorted(r.own for r in got) == [i for i, k in enumerate(cells + cells[:25]) if edge[k] > buffer]
    have = set(cells)
    lacking = [i for i, (f, r, c) in enumerate(cells + cells[:25]) if not {(f, r - 1, c), (f, r + 1, c), (f, r, c - 1), (f, r, c + 1)} <= have]
    assert sorted(r.own for r in G.outline(df, "field").collect()) == lacking
    for made in (G.outline(df, "field"), G.within_edge(df, "field", 2), G.beyond_edge(df, "field", 10.0)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_tile_averages_of_odd_fields(spark):
    """Ragged fields, missing values, repeated pixels and tiles that leave gaps, against loops; pixels are not multiplied."""
    rng = np.random.default_rng(22)
    cells = [(f, int(r) - 4, int(c) + 10**9 * k) for k, f in enumerate(("f", "g", None)) for r, c in np.argwhere(rng.random((9, 8)) < 0.6)]
    rows = [(*k, None if rng.random() < 0.2 else float(rng.random())) for k in cells + cells[:9]]
    df = spark.createDataFrame(rows, "field string, prow int, pcol long, z double")
    for size, step in ((4, 2), (3, 2), (2, 3), (5, 1)):
        tiles, of = {}, {}
        low = {f: (min(k[1] for k in cells if k[0] == f), min(k[2] for k in cells if k[0] == f)) for f in ("f", "g", None)}
        for f, r, c, z in rows:
            at = [[s for s in range(0, 9, step) if s <= x < s + size] for x in (r - low[f][0], c - low[f][1])]
            for t in [(f, a, b) for a in at[0] for b in at[1]]:
                tiles.setdefault(t, []).append(z)
                of.setdefault((f, r, c), []).append(t)
        mean = lambda v: sum(v) / len(v) if (v := [x for x in v if x is not None]) else None
        want = {k: (mean([mean(tiles[t]) for t in ts]), len(ts)) for k, ts in of.items()}
        made = G.tile_average(df, "field", F.col("z"), size, step)
        got = made.collect()
        assert len(got) == len(want)
        for r in got:
            value, n = want[r.field, r.prow, r.pcol]
            assert r.n_tiles == n and (r.value is None if value is None else math.isclose(r.value, value))
        assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()


def test_load_makes_steps_of_chosen_pixels_only(spark):
    from fieldloom.operators import load as D

    cells = [(f, r, c) for f in ("a", "b") for r in range(4) for c in range(4)]
    px = spark.createDataFrame([(*p, 1.0) for p in cells], "field string, prow long, pcol long, target double")
    fields = spark.createDataFrame([("a", "A", "wheat", 2000), ("b", "B", "rye", 2000)], "field string, country string, crop string, year int")
    asked = []

    def steps(keys):
        asked.append({tuple(r) for r in keys.select("field", "prow", "pcol").collect()})
        return keys.withColumn("k", F.lit(1).cast("long")).withColumn("B04", F.lit(0.1)).withColumn("B08", F.lit(0.3))

    got = D.load(D.Tables(px, steps, fields, 20, 0), ["indices:ndvi"], n_windows=2, countries=["A"], edge_buffer_m=10.0, min_observed=1)
    inner = {("a", r, c) for r in (1, 2) for c in (1, 2)}
    assert len(asked) == 2 and all(x == inner for x in asked)
    assert {(r.m, None if r.ndvi is None else round(r.ndvi, 6)) for r in got.steps.collect()} == {(0, None), (1, 0.5)}


@pytest.mark.parametrize("name", ["load_features", "loyo_pairs", "loyo_split", "split_score", "split_store", "normalised_export", "split_checks"])
def test_pixels_are_made_once(spark, sf, monkeypatch, name):
    """Queries that meet the pixels many times read them from where they were stored once."""
    from fieldloom.plans import registry
    from fieldloom.plans.fixtures import Fx

    read, kept = [], []
    table, stored = Fx.table, Fx.stored
    monkeypatch.setattr(Fx, "table", lambda self, t: (read.append(t), table(self, t))[1])
    monkeypatch.setattr(Fx, "stored", lambda self, df, n: (kept.append(n), stored(self, df, n))[1])
    out = registry.queries()[name](spark, sf)
    assert read.count("lineitem") == 1 and kept
    assert "l_orderkey" not in out._jdf.queryExecution().optimizedPlan().toString()
