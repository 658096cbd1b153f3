"""Feature specifications: `group` or `group:names`, resolved to features and to the columns that compute them.

Dynamic features have a value for each time step, static ones one for each pixel. Indices, leaf area, whether a step was
observed, soil properties over a depth and one-hot columns are computed; the others are columns of the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from fieldloom.functions import scalars as P

#: Names, units and defaults of the features.
BANDS = ("B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B11", "B12")
INDICES = {"ndvi": ("B08", "B04"), "ndre": ("B08", "B05"), "ndmi": ("B08", "B11")}
WEATHER = {"tmean_c": "degC", "tmax_c": "degC", "tmin_c": "degC", "prec_mm": "mm", "gdd": "degC d", "gdd_cum": "degC d", "prec_cum_mm": "mm", "frost_days": "d", "heat_days": "d", "rh_mean": "%", "srad": "Wh m-2 d-1", "vpd_kpa": "kPa", "season_frac": "0-1"}
WEATHER_DEFAULT = tuple(WEATHER)[:9]
REANALYSIS = {"swvl1": "m3 m-3", "swvl2": "m3 m-3", "swvl3": "m3 m-3", "swvl_rz": "m3 m-3", "swvl1_anom": "m3 m-3", "swvl_rz_anom": "m3 m-3", "t2m_c": "degC", "tmax_c": "degC", "tp_mm": "mm", "ssrd_mj": "MJ m-2 d-1", "vpd_kpa": "kPa", "t2m_anom_c": "degC", "tp_anom_mm": "mm", "vpd_anom_kpa": "kPa"}
REANALYSIS_DEFAULT = tuple(REANALYSIS)[:6]
TERRAIN = {"elevation": "m", "rel_elevation": "m", "slope": "deg", "aspect_sin": "-1..1", "aspect_cos": "-1..1", "curvature": "1/km"}
COORDS = ("coord_x", "coord_y", "coord_z")
SOIL = {"clay": (0.1, "%"), "sand": (0.1, "%"), "silt": (0.1, "%"), "soc": (0.1, "g/kg"), "nitrogen": (0.01, "g/kg"), "phh2o": (0.1, "pH"), "cec": (0.1, "cmol(c)/kg"), "cfvo": (0.1, "vol %")}
SOIL_DEPTH = (0, 30)
DYNAMIC = ("s2", "indices", "observed", "lai", "weather", "era5land")
CATEGORICAL = ("crop", "country")


@dataclass(frozen=True)
class Feature:
    """A feature: its name and unit, whether it changes over time, and what it is made of (a column, a category, depths)."""

    name: str
    group: str
    unit: str
    of: tuple

    @property
    def dynamic(self) -> bool:
        return self.group in DYNAMIC


def _chosen(arg: str, known: tuple, default: tuple) -> list[str]:
    names = list(known) if arg == "all" else [a.strip() for a in arg.split(",")] if arg else list(default)
    if wrong := [n for n in names if n not in known]:
        raise ValueError(f"unknown features {wrong}; known are {list(known)}")
    return names


def _soil(arg: str) -> tuple[list[str], int, int]:
    """Properties and depth of `properties`, `top-bottom` or `properties@top-bottom`."""
    props, _, depth = arg.replace(" ", "").partition("@")
    if not depth and props[:1].isdigit():
        props, depth = "", props
    top, bottom = (int(x) for x in depth.removesuffix("cm").split("-")) if depth else SOIL_DEPTH
    P.depth_weights(top, bottom)
    if not 0 <= top < bottom <= P.DEPTHS[-1][1]:
        raise ValueError(f"no soil layer between {top} and {bottom} cm")
    return _chosen(props, tuple(SOIL), tuple(SOIL)), top, bottom


def resolve(specs: list[str], categories: dict[str, list[str]] = {}) -> list[Feature]:  # noqa: B006
    """The features of the specifications in their order; unknown groups or names and repeated features are errors."""
    out: list[Feature] = []
    for spec in specs:
        group, _, arg = spec.partition(":")
        if group == "s2":
            out += [Feature(b, group, "reflectance", (b,)) for b in _chosen(arg, BANDS, BANDS)]
        elif group == "indices":
            out += [Feature(i, group, "-1..1", INDICES[i]) for i in _chosen(arg, tuple(INDICES), tuple(INDICES))]
        elif group in ("observed", "lai"):
            out.append(Feature(group, group, {"observed": "0/1", "lai": "m2 m-2"}[group], ()))
        elif group == "weather":
            out += [Feature(w, group, WEATHER[w], (w,)) for w in _chosen(arg, tuple(WEATHER), WEATHER_DEFAULT)]
        elif group == "era5land":
            out += [Feature(f"e5_{w}", group, REANALYSIS[w], (w,)) for w in _chosen(arg, tuple(REANALYSIS), REANALYSIS_DEFAULT)]
        elif group == "terrain":
            out += [Feature(t, group, TERRAIN[t], (t,)) for t in _chosen(arg, tuple(TERRAIN), tuple(TERRAIN))]
        elif group == "soil":
            props, top, bottom = _soil(arg)
            out += [Feature(f"soil_{p}_{top}-{bottom}cm", group, SOIL[p][1], (p, top, bottom)) for p in props]
        elif group == "coords":
            out += [Feature(c, group, "as delivered", (c,)) for c in COORDS]
        elif group in CATEGORICAL:
            out += [Feature(f"{group}={c}", group, "one-hot", (c,)) for c in categories[group]]
        else:
            raise ValueError(f"unknown feature group {group!r}")
    names = [f.name for f in out]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"features named twice: {twice}")
    return out


def column(f: Feature, observed: str = "B04", cos_sun: Column | None = None) -> Column:
    """The feature's value from a row that has the bands, series, static columns or attributes it is made of. `observed` is
    the band that tells whether a step was seen; leaf area needs the cosine of the sun's zenith angle."""
    if f.group == "indices":
        value = P.normalized_difference(F.col(f.of[0]), F.col(f.of[1]))
    elif f.group == "observed":
        value = P.observed(observed)
    elif f.group == "lai":
        value = P.snap_lai({b: F.col(b) for b in P.LAI_BANDS}, cos_sun)
    elif f.group == "era5land":
        value = F.col(f"e5_{f.of[0]}")
    elif f.group == "soil":
        value = P.soil_property(*f.of, SOIL[f.of[0]][0])
    elif f.group in CATEGORICAL:
        value = F.coalesce(F.col(f.group) == f.of[0], F.lit(False))
    else:
        value = F.col(f.of[0])
    return value.cast("double").alias(f.name)
