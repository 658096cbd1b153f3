"""Projections of observations: reflectances, indices, weather, soil, calendar. All are column expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.functions.numeric import clamp, col, ratio


def decode(df: DataFrame, codes: DataFrame, code: str, label: str, out: str) -> DataFrame:
    """Adds the label of a code (NULL if unknown); codes is (code, label)."""
    names = codes.select(F.col(code).alias("_code"), F.col(label).alias(out))
    return df.join(names, F.col(code) == F.col("_code"), "left").drop("_code")


def unknown_codes(df: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """(code, n) of rows whose code has no label."""
    return df.join(codes.select(code), code, "left_anti").groupBy(code).agg(F.count("*").alias("n"))


def reflectance(dn: Column | str, missing: int = 65535, scale: float = 10000.0) -> Column:
    dn = col(dn)
    return F.when(dn != missing, dn / F.lit(scale))


def saturate(dn: Column | str, top: int = 65534) -> Column:
    """Digital numbers that would collide with the missing mark are held just below it."""
    return F.when(col(dn).isNotNull(), F.least(col(dn), F.lit(top)))


def normalized_difference(a: Column | str, b: Column | str) -> Column:
    """(a - b) / (a + b) in [-1, 1]; NULL if the sum is zero."""
    a, b = col(a), col(b)
    return clamp(ratio(a - b, a + b), -1, 1)


def observed(band: Column | str) -> Column:
    return col(band).isNotNull().cast("int")


def cos_sun_zenith(lat: Column | str, doy: Column | str, hour: float = 10.5) -> Column:
    """Cosine of the sun's zenith angle at a solar hour, in [0, 1]."""
    lat = F.radians(col(lat))
    decl = F.radians(F.lit(23.44) * F.sin(F.lit(2 * math.pi / 365.0) * (col(doy) + 284)))
    angle = F.lit(math.radians(15.0 * (hour - 12.0)))
    return clamp(F.sin(lat) * F.sin(decl) + F.cos(lat) * F.cos(decl) * F.cos(angle), 0, 1)


def leaf_area(inputs: list[Column], low: list[float], high: list[float], hidden: list[list[float]], bias: list[float], out: list[float], out_bias: float, span: tuple[float, float], top: float) -> Column:
    """A small network as one expression: inputs scaled to [-1, 1], a tanh layer, a linear output that is scaled back to its
    span and held in [0, top]."""
    x = [2 * (c - lo) / (hi - lo) - 1 for c, lo, hi in zip(inputs, low, high, strict=True)]
    h = [F.tanh(sum((F.lit(w) * c for w, c in zip(row, x, strict=True)), F.lit(b))) for row, b in zip(hidden, bias, strict=True)]
    y = sum((F.lit(w) * c for w, c in zip(out, h, strict=True)), F.lit(out_bias))
    return clamp((y + 1) / 2 * (span[1] - span[0]) + span[0], 0, top)


#: The published leaf area network for eight bands. Ranges of the bands, of the cosines of view and sun zenith,
#: and of the output; five neurons, each a bias, eight bands, view zenith, sun zenith and relative azimuth; the output layer.
LAI_BANDS = ("B03", "B04", "B05", "B06", "B07", "B8A", "B11", "B12")
LAI_LOW = [0.0, 0.0, 0.0, 0.006637972542253, 0.013972727018939, 0.026690138082061, 0.016388074192258, 0.0, 0.918595400582046, 0.342022871159208]
LAI_HIGH = [0.253061520471542, 0.290393577911328, 0.305398915248555, 0.608900395797889, 0.753827384322927, 0.782011770669178, 0.493761397883092, 0.493025984460231, 1.0, 0.936206429175402]
LAI_SPAN = (0.000319182538301, 14.4675094548151)
LAI_HIDDEN = [
    [4.96238030555279, -0.023406878966470, 0.921655164636366, 0.135576544080099, -1.938331472397950, -3.342495816122680, 0.902277648009576, 0.205363538258614, -0.040607844721716, -0.083196409727092, 0.260029270773809, 0.284761567218845],
    [1.416008443981500, -0.132555480856684, -0.139574837333540, -1.014606016898920, -1.330890038649270, 0.031730624503341, -1.433583541317050, -0.959637898574699, 1.133115706551000, 0.216603876541632, 0.410652303762839, 0.064760155543506],
    [1.075897047213310, 0.086015977724868, 0.616648776881434, 0.678003876446556, 0.141102398644968, -0.096682206883546, -1.128832638862200, 0.302189102741375, 0.434494937299725, -0.021903699490589, -0.228492476802263, -0.039460537589826],
    [1.533988264655420, -0.109366593670404, -0.071046262972729, 0.064582411478320, 2.906325236823160, -0.673873108979163, -3.838051868280840, 1.695979344531530, 0.046950296081713, -0.049709652688365, 0.021829545430994, 0.057483827104091],
    [3.024115930757230, -0.089939416159969, 0.175395483106147, -0.081847329172620, 2.219895367487790, 1.713873975136850, 0.713069186099534, 0.138970813499201, -0.060771761518025, 0.124263341255473, 0.210086140404351, -0.183878138700341],
]
LAI_OUT = [1.096963107077220, -1.500135489728730, -0.096283269121503, -0.194935930577094, -0.352305895755591, 0.075107415847473]
LAI_TOP = 8.0
VIEW_ZENITH_DEG = 5.0


def snap_lai(bands: dict[str, Column], cos_sun: Column, cos_view: float | None = None, cos_azimuth: float = 0.0) -> Column:
    """Leaf area (m2 m-2) of reflectances by band, in [0, 8]; NULL if a band is missing."""
    view = math.cos(math.radians(VIEW_ZENITH_DEG)) if cos_view is None else cos_view
    inputs = [bands[b] for b in LAI_BANDS] + [F.lit(view), cos_sun]
    bias = [row[0] + row[11] * cos_azimuth for row in LAI_HIDDEN]  # the azimuth is not scaled
    return leaf_area(inputs, LAI_LOW, LAI_HIGH, [row[1:11] for row in LAI_HIDDEN], bias, LAI_OUT[1:], LAI_OUT[0], LAI_SPAN, LAI_TOP)


def celsius(kelvin: Column | str) -> Column:
    return col(kelvin) - 273.15


def millimetres(metres: Column | str) -> Column:
    return col(metres) * 1000.0


def megajoules(joules: Column | str) -> Column:
    return col(joules) / 1e6


def vapour_pressure(t: Column | str) -> Column:
    """Tetens, kPa at t degrees Celsius."""
    t = col(t)
    return F.lit(0.6108) * F.exp(F.lit(17.27) * t / (t + 237.3))


def vapour_deficit(t: Column | str, dew: Column | str, at_least_zero: bool) -> Column:
    vpd = vapour_pressure(t) - vapour_pressure(dew)
    return clamp(vpd, 0) if at_least_zero else vpd


def growing_degrees(mean: Column | str, crop: Column | str, base: dict[str, float]) -> Column:
    """max(0, mean - base of the crop); crops without a base have base 0."""
    b = F.lit(0.0)
    for name, value in base.items():
        b = F.when(col(crop) == name, F.lit(value)).otherwise(b)
    return clamp(col(mean) - b, 0)


def frost(low: Column | str) -> Column:
    return F.coalesce(col(low) < 0, F.lit(False)).cast("int")


def heat(high: Column | str, limit: float = 30.0) -> Column:
    return F.coalesce(col(high) > limit, F.lit(False)).cast("int")


def root_zone(l1: Column | str, l2: Column | str, l3: Column | str) -> Column:
    """Soil water of the top metre, weighted by layer thickness in cm."""
    return (7 * col(l1) + 21 * col(l2) + 72 * col(l3)) / 100.0


#: Standard soil depth layers in cm.
DEPTHS = [(0, 5), (5, 15), (15, 30), (30, 60), (60, 100), (100, 200)]


def depth_weights(top: int, bottom: int) -> dict[tuple[int, int], float]:
    """Share of each layer in a depth range."""
    over = {d: max(0, min(bottom, d[1]) - max(top, d[0])) for d in DEPTHS}
    if top >= bottom or not sum(over.values()):
        raise ValueError(f"no soil layer between {top} and {bottom} cm")
    return {d: x / sum(over.values()) for d, x in over.items() if x}


def soil_property(name: str, top: int, bottom: int, unit: float = 1.0) -> Column:
    """Thickness-weighted mean of columns `<name>_<top>_<bottom>`."""
    parts = [F.lit(w * unit) * F.col(f"{name}_{a}_{b}") for (a, b), w in depth_weights(top, bottom).items()]
    return sum(parts[1:], parts[0])


#: Texture classes in the order in which their rules are tried.
TEXTURES = ["sand", "loamy sand", "sandy loam", "loam", "silt loam", "silt", "sandy clay loam", "clay loam", "silty clay loam", "sandy clay", "silty clay", "clay"]


def texture_class(sand: Column | str, silt: Column | str, clay: Column | str) -> Column:
    """Index into TEXTURES by the USDA triangle, shares scaled to 100 %; -1 if they sum to nothing."""
    total = col(sand) + col(silt) + col(clay)
    s, i, c = (ratio(100.0 * col(x), total) for x in (sand, silt, clay))
    # The bounds of the public USDA soil texture triangle, in the order of TEXTURES.
    rules = [
        i + 1.5 * c < 15,
        (i + 1.5 * c >= 15) & (i + 2 * c < 30),
        (c >= 7) & (c < 20) & (s > 52) & (i + 2 * c >= 30) | (c < 7) & (i < 50) & (i + 2 * c >= 30),
        (c >= 7) & (c < 27) & (i >= 28) & (i < 50) & (s <= 52),
        (i >= 50) & (c >= 12) & (c < 27) | (i >= 50) & (i < 80) & (c < 12),
        (i >= 80) & (c < 12),
        (c >= 20) & (c < 35) & (i < 28) & (s > 45),
        (c >= 27) & (c < 40) & (s > 20) & (s <= 45),
        (c >= 27) & (c < 40) & (s <= 20),
        (c >= 35) & (s > 45),
        (c >= 40) & (i >= 40),
        (c >= 40) & (s <= 45) & (i < 40),
    ]
    out = F.when(F.coalesce(total <= 0, F.lit(True)), F.lit(-1))
    for k, rule in enumerate(rules):
        out = out.when(rule, F.lit(k))
    return out.otherwise(F.lit(-1))


def cube_day(date: Column | str, jan1: Column | str) -> Column:
    """Days since 1 January of the year before harvest, less one."""
    return F.datediff(col(date), col(jan1)) - 1


def cube_date(day: Column | str, jan1: Column | str) -> Column:
    return F.date_add(col(jan1), (col(day) + 1).cast("int"))


def window_label(day: Column | str) -> Column:
    """`dd Mon Y-1` or `dd Mon Y` of a window's first day: day 0 is 1 January of the year before harvest, and both years
    have 365 days."""
    text = F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), F.pmod(col(day), F.lit(365)).cast("int")), "dd MMM")
    return F.concat(text, F.when(col(day) < 365, F.lit(" Y-1")).otherwise(F.lit(" Y")))


def one_hot(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """A 0/1 column for each category; other values are all zeros."""
    return df.select("*", *[F.coalesce(F.col(column) == c, F.lit(False)).cast("int").alias(f"{column}_{c}") for c in categories])


def standardize(x: Column | str, mean: Column | str, sd: Column | str, fill: float = 0.0) -> Column:
    return F.coalesce((col(x) - col(mean)) / F.nullif(col(sd), F.lit(0.0)), F.lit(fill))


def expand_columns(columns: list[str], *specs: str) -> list[str]:
    """Columns that equal a name or fully match a pattern, in table order, each once; an empty match is an error."""
    out: list[str] = []
    for spec in specs:
        hit = [c for c in columns if c == spec] or [c for c in columns if re.fullmatch(spec, c)]
        if not hit:
            raise ValueError(f"no column matches {spec!r}")
        out += [c for c in hit if c not in out]
    return out


def cell_id(lat: Column | str, lon: Column | str) -> Column:
    """Name of the nearest 0.1 degree cell; halves go to the even neighbour."""
    def part(x: Column, pos: str, neg: str) -> Column:
        y = F.bround(x * 10) / 10
        return F.concat(F.when(y < 0, F.lit(neg)).otherwise(F.lit(pos)), F.format_string("%05.1f", F.abs(y)))

    return F.concat_ws("_", part(col(lat), "n", "s"), part(col(lon), "e", "w"))


def quantise(x: Column | str, size: float) -> Column:
    return F.floor(col(x) / F.lit(float(size))).cast("bigint")


def name_group(name: Column | str, rules: dict[str, str]) -> Column:
    """Label of the first pattern that a name matches, else 'other'."""
    out = None
    for pattern, label in rules.items():
        hit = col(name).rlike(pattern)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit("other"))


def season_overlap(start: Column | str, width: int, sow: Column | str, harvest: Column | str) -> Column:
    """Share of a window's days inside [sow, harvest]."""
    lo, hi = col(start), col(start) + (width - 1)
    days = F.greatest(F.lit(0), F.least(hi, col(harvest)) - F.greatest(lo, col(sow)) + 1)
    return F.when(lo.isNotNull() & col(sow).isNotNull() & col(harvest).isNotNull(), days / F.lit(float(width)))


def in_season(start: Column | str, end: Column | str, sow: Column | str, harvest: Column | str, grid: tuple[int, int]) -> Column:
    """Whether [start, end) meets [sow, harvest); missing dates are the grid's bounds."""
    return (col(start) < F.coalesce(col(harvest), F.lit(grid[1]))) & (col(end) > F.coalesce(col(sow), F.lit(grid[0])))
