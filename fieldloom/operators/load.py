"""Inputs and target of one role of a split: rows are chosen in a fixed order, steps aligned, features computed and scaled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from fieldloom.functions import features as X
from fieldloom.functions.numeric import floor_window
from fieldloom.functions.scalars import cos_sun_zenith
from fieldloom.operators import filters as L
from fieldloom.operators import spatial as G
from fieldloom.operators.resample import per_group
from fieldloom.operators.timeaxis import scaffold
from fieldloom.session import checkpoint_dir

PIXEL = ["field", "prow", "pcol"]


@dataclass
class Tables:
    """What is loaded from. pixels: (field, prow, pcol, target, static columns); steps: (field, prow, pcol, k, bands) with the
    windows a pixel has, or a function that makes them of the pixels (field, prow, pcol) it is given; fields: (field, country,
    crop, year, lat, jan1, sow_day, harvest_day); split: (field, role); series: (field, k, columns) by group, `weather` or
    `era5land`. Windows are `width` days from day `start` on."""

    pixels: DataFrame
    steps: DataFrame | Callable[[DataFrame], DataFrame]
    fields: DataFrame
    width: int
    start: int
    split: DataFrame | None = None
    series: dict[str, DataFrame] | None = None
    observed: str = "B04"


@dataclass
class Loaded:
    """steps: (field, prow, pcol, m, day, dynamic features); pixels: (field, prow, pcol, country, crop, year, target, static
    features). The features with their units."""

    steps: DataFrame
    pixels: DataFrame
    features: list[X.Feature]


def _rows(t: Tables, roles: list[str] | None, fields: list[str] | None, countries: list[str] | None, crops: list[str] | None, years: list | None, edge_buffer_m: float, min_observed: int, pixels_per_field: int | None, seed: int) -> DataFrame:
    """The chosen pixels: the split's role or the named fields, then countries, crops and years, then away from the edge, then
    seen often enough, and of those at most so many a field. The order decides which pixels a sample is drawn from; the edge
    is that of the chosen fields' own pixels."""
    own = t.fields
    if roles is not None:
        if t.split is None:
            raise ValueError("a role needs a split")
        own = L.rows_of(own, t.split.where(F.col("role").isin(roles)), "field")
    if fields is not None:
        own = own.where(F.col("field").isin(fields))
    own = L.member_filter(own, **{k: v for k, v in (("country", countries), ("crop", crops), ("year", years)) if v is not None})
    keys = L.rows_of(t.pixels.select(*PIXEL), own, "field")
    if edge_buffer_m:
        keys = G.beyond_edge(keys, "field", edge_buffer_m)
    if min_observed:
        keys = keys.checkpoint()
        enough = _steps_of(t, keys).where(F.col(t.observed).isNotNull()).groupBy(*PIXEL).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_observed)
        keys = keys.join(enough.select(*PIXEL), PIXEL, "left_semi")
    return per_group(keys, ["field"], PIXEL, pixels_per_field, seed) if pixels_per_field else keys


def _steps_of(t: Tables, keys: DataFrame) -> DataFrame:
    """The pixels' own steps."""
    return t.steps(keys) if callable(t.steps) else t.steps.join(keys.select(*PIXEL), PIXEL, "left_semi")


def load(t: Tables, features: list[str], roles: list[str] | None = None, fields: list[str] | None = None, align: str = "calendar", season: tuple[int, int] | None = None, n_windows: int = 24, countries: list[str] | None = None, crops: list[str] | None = None, years: list | None = None, edge_buffer_m: float = 0.0, min_observed: int = 0, pixels_per_field: int | None = None, seed: int = 0, scaler: DataFrame | None = None) -> Loaded:
    """The chosen pixels with their features.

    Step m is the window m after the origin: day 0 (`calendar`), sowing or harvest; those that start within `season` days of it
    are kept, by default the grid's `n_windows`. Every pixel has every step; a step beyond the grid, or that the pixel has no
    row for, is NULL and not observed. A field without the date to align by is an error. One-hot columns are of all fields'
    crops and countries, whatever is loaded. With a scaler (`fit_scaler`) features are z-scores, and missing ones 0.
    """
    event = {"calendar": None, "sowing": "sow_day", "harvest": "harvest_day"}[align]
    checkpoint_dir(t.pixels.sparkSession)
    categories = {c: sorted(str(r[0]) for r in t.fields.select(c).where(F.col(c).isNotNull()).distinct().collect()) for c in X.CATEGORICAL if any(s.partition(":")[0] == c for s in features)}  # one-hot columns need their names
    found = X.resolve(features, categories)
    dynamic, static = [f for f in found if f.dynamic], [f for f in found if not f.dynamic]
    keys = _rows(t, roles, fields, countries, crops, years, edge_buffer_m, min_observed, pixels_per_field, seed).checkpoint()  # chosen once, met three times
    attributes = L.rows_of(t.fields, keys, "field")
    if event and (n := attributes.where(F.col(event).isNull()).count()):
        raise ValueError(f"{n} fields have no {align} date")
    origin = floor_window(F.lit(0) if event is None else F.col(event), t.start, t.width)
    lo, hi = season or (t.start, t.start + n_windows * t.width)
    first, last = -(-lo // t.width), -(-hi // t.width)
    grid = scaffold(attributes.select("field", origin.alias("_k0"), *[c for c in ("lat", "jan1") if c in attributes.columns]), "m", first, last).withColumn("k", F.col("_k0") + F.col("m"))
    d = keys.join(grid, "field").join(_steps_of(t, keys), [*PIXEL, "k"], "left")
    for group, table in (t.series or {}).items():
        if any(f.group == group for f in dynamic):
            named = table.select("field", "k", *[F.col(c).alias(f"e5_{c}" if group == "era5land" else c) for c in table.columns if c not in ("field", "k")])
            d = d.join(named, ["field", "k"], "left")
    sun = None
    if any(f.group == "lai" for f in dynamic):
        middle = F.lit(t.start) + F.col("k") * t.width + t.width / 2.0
        sun = cos_sun_zenith("lat", F.dayofyear(F.date_add("jan1", (F.floor(middle) + 1).cast("int"))))
    steps = d.select(*PIXEL, "m", (F.col("m") * t.width).alias("day"), *[X.column(f, t.observed, sun) for f in dynamic])
    own = keys.join(t.pixels, PIXEL).join(t.fields.select("field", "country", "crop", "year"), "field")
    pixels = own.select(*PIXEL, "country", "crop", "year", "target", *[X.column(f) for f in static])
    if scaler is not None:
        have = {r[0] for r in scaler.select("feature").collect()}  # a row a feature
        if have != {f.name for f in found}:
            raise ValueError("the scaler was fitted on other features")
        steps = L.scaled(steps, scaler, [f.name for f in dynamic]) if dynamic else steps
        pixels = L.scaled(pixels, scaler, [f.name for f in static]) if static else pixels
    return Loaded(steps, pixels, found)


def fit_scaler(loaded: Loaded) -> DataFrame:
    """(feature, mean, sd, n) of loaded features that are not scaled; whether a step was observed and one-hot columns stay."""
    keep = [f.name for f in loaded.features if f.group == "observed" or f.group in X.CATEGORICAL]
    out = None
    for df, names in ((loaded.steps, [f.name for f in loaded.features if f.dynamic]), (loaded.pixels, [f.name for f in loaded.features if not f.dynamic])):
        if names:
            s = L.scaler(df, names, keep)
            out = s if out is None else out.unionByName(s)
    if out is not None:
        checkpoint_dir(out.sparkSession)
        out = out.checkpoint()  # a row a feature, met once for each table that is scaled
    return out
