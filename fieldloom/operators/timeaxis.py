"""Time windows of scenes and daily series, event alignment, sequences.

Days are integers; window k of width w covers [start + k*w, start + (k+1)*w). Windows come from arithmetic on the day,
never from a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.functions.numeric import col, floor_window


def best_scene(scenes: DataFrame, field: str, start: int, width: int, prefer: list[Column], columns: list[str]) -> DataFrame:
    """Per field and window the scene that is first by `prefer` (all descending): its `columns`, and how many there were."""
    keyed = scenes.withColumn("k", floor_window("day", start, width))
    best = F.max_by(F.struct(*columns), F.struct(*[p.alias(f"p{i}") for i, p in enumerate(prefer)]))
    return keyed.groupBy(field, "k").agg(best.alias("best"), F.count("*").alias("n_scenes")).select(field, "k", "n_scenes", "best.*")


def fewest_clouds(scenes: DataFrame, field: str, start: int, width: int) -> DataFrame:
    """The scene with the fewest cloud pixels of each window, the latest of equal ones."""
    return best_scene(scenes, field, start, width, [-col("clouds"), col("day"), col("scene")], ["scene", "day", "clouds"])


def clearest(scenes: DataFrame, field: str, start: int, width: int) -> DataFrame:
    """The scene with the largest clear share of each window, the latest of equal ones."""
    return best_scene(scenes, field, start, width, [col("clear_share"), col("day"), col("scene")], ["scene", "day", "clear_share"])


def grid_start(scenes: DataFrame, width: int, end: int, share: str = "valid") -> DataFrame:
    """Start of the grid: the earliest day of [0, end) with a clear pixel, floored to a window; and how many scenes of all lie
    outside [0, end)."""
    inside = (F.col("day") >= 0) & (F.col("day") < end)
    first = F.min(F.when(inside & (F.col(share) > 0), F.col("day")))
    return scenes.agg((F.floor(first / F.lit(float(width))) * width).cast("bigint").alias("start"), F.count_if(~inside).alias("outside"), F.count("*").alias("n"))


def clear_scenes(scenes: DataFrame, lo: int, hi: int, least: float) -> DataFrame:
    """Scenes of days [lo, hi) with at least that clear share."""
    return scenes.where((F.col("day") >= lo) & (F.col("day") < hi) & (F.col("clear_share") >= least))


#: Codes of the scene classification. The order of the causes breaks ties.
CLEAR = (4, 5)
CLOUD = (8, 9)
CAUSES = {"cloud": CLOUD, "cirrus": (10,), "shadow": (3,), "snow": (11,), "dark": (2, 7), "nodata": (0, 1), "water": (6,)}
CLASSES = ("out_of_season", "no_scene", "all_unusable", "rule_loss", "partly_valid", "valid")
USABLE, VALID = 0.05, 0.5


def scene_shares(cells: DataFrame, keys: list[str], code: str, inside: Column, causes: dict[str, tuple[int, ...]] = CAUSES) -> DataFrame:
    """Per scene, from the class code of each of its cells: cloud cells of the whole scene, and of the cells inside the field
    the share that is clear and the shares of the other groups of codes (NULL without a cell inside)."""
    own = F.when(inside, F.col(code))
    share = lambda codes: F.try_divide(F.count_if(own.isin(*codes)), F.count_if(inside))
    return cells.groupBy(*keys).agg(F.count_if(F.col(code).isin(*CLOUD)).alias("clouds"), share(CLEAR).alias("valid"), *[share(v).alias(c) for c, v in causes.items()])


def season_windows(scenes: DataFrame, seasons: DataFrame, field: str, start: int, width: int, n_windows: int, causes: list[str] = tuple(CAUSES), usable: float = USABLE, valid: float = VALID) -> DataFrame:
    """Every window of every field of `seasons` (sow_day, harvest_day; a missing one opens the season to that side), whether it
    overlaps [sowing, harvest), its scenes and those in the season, the chosen scene (fewest cloud cells, the later of equal
    ones) with its shares, the best clear share, a class, and the chosen scene's dominant cause: the largest of its shares, the
    first of equal ones, if it is above zero."""
    end = start + n_windows * width
    lo, hi = F.coalesce("sow_day", F.lit(start)), F.coalesce("harvest_day", F.lit(end))
    grid = scenes.where((F.col("day") >= start) & (F.col("day") < end)).join(seasons.select(field, lo.alias("_lo"), hi.alias("_hi")), field)
    chosen = F.max_by(F.struct("day", "valid", *causes), F.struct(-F.col("clouds"), F.col("day"), F.col("scene")))
    per = grid.withColumn("k", floor_window("day", start, width)).groupBy(field, "k").agg(F.count("*").alias("n_scenes"), F.count_if((F.col("day") >= F.col("_lo")) & (F.col("day") < F.col("_hi"))).alias("n_in_season"), F.max("valid").alias("best_valid"), chosen.alias("_c"))
    full = scaffold(seasons, "k", 0, n_windows).join(per, [field, "k"], "left")
    a = F.lit(start) + F.col("k") * width
    within = (a < hi) & (a + width > lo)
    top = F.greatest(*[F.coalesce(F.col(f"_c.{c}"), F.lit(0.0)) for c in causes])
    cause = F.lit("none")
    for c in reversed(list(causes)):
        cause = F.when((top > 0) & (F.coalesce(F.col(f"_c.{c}"), F.lit(0.0)) == top), c).otherwise(cause)
    ch, best = F.col("_c.valid"), F.col("best_valid")
    kind = F.when(~within, "out_of_season").when(F.col("_c").isNull(), "no_scene").when(best < usable, "all_unusable").when((ch < usable) & (best >= valid), "rule_loss").when(ch >= valid, "valid").otherwise("partly_valid")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return full.select(*seasons.columns, "k", a.cast("bigint").alias("start_day"), within.alias("in_season"), zero("n_scenes"), zero("n_in_season"), F.col("_c.day").alias("chosen_day"), ch.alias("chosen_valid"), best.alias("best_valid"), *[F.col(f"_c.{c}").alias(f"chosen_{c}") for c in causes], kind.alias("class"), cause.alias("cause"))


def availability(windows: DataFrame, by: list[str], field: str, usable: float = USABLE, valid: float = VALID) -> DataFrame:
    """Per group over the windows in season: fields, windows, scenes a window, the shares without a scene, usable and valid by
    the chosen scene and by the best one, and lost by the rule."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    ch, best = F.col("chosen_valid"), F.col("best_valid")
    return windows.where("in_season").groupBy(*by).agg(F.count_distinct(field).alias("n_fields"), F.count("*").alias("n"), F.avg("n_scenes").alias("scenes_per_window"), share(F.col("class") == "no_scene").alias("no_scene"), share(ch >= usable).alias("usable"), share(ch >= valid).alias("valid"), share(best >= usable).alias("best_usable"), share(best >= valid).alias("best_valid"), share(F.col("class") == "rule_loss").alias("rule_loss"))


def class_shares(windows: DataFrame, by: list[str], usable: float = USABLE) -> DataFrame:
    """Per group over the windows in season: their number and the share of each class, and of those whose chosen scene is not
    usable the most frequent cause (first by name of equal ones) with its share of them."""
    own = windows.where("in_season")
    wide = own.groupBy(*by).agg(F.count("*").alias("n"), *[(F.count_if(F.col("class") == c) / F.count("*")).alias(c) for c in CLASSES[1:]])
    causes = own.where(F.col("chosen_valid") < usable).groupBy(*by, F.col("cause").alias("_cause")).agg(F.count("*").alias("_c"))
    top = causes.groupBy(*by).agg(F.min_by(F.struct(F.col("_cause").alias("cause"), F.col("_c").alias("n")), F.struct(-F.col("_c"), "_cause")).alias("_t"), F.sum("_c").alias("_s"))
    return wide.join(top.select(*by, F.col("_t.cause").alias("cause"), (F.col("_t.n") / F.col("_s")).alias("cause_share")), by, "left")


def scaffold(keys: DataFrame, step: str, lo: int, hi: int) -> DataFrame:
    """Every key with every step of [lo, hi)."""
    return keys.select("*", F.explode(F.sequence(F.lit(lo).cast("bigint"), F.lit(hi - 1).cast("bigint"))).alias(step))


def daily(readings: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Mean, highest, lowest, sum and number of readings per key and day."""
    v = F.col(value)
    return readings.groupBy(*keys, F.to_date(ts).alias("date")).agg(F.avg(v).alias("mean"), F.max(v).alias("high"), F.min(v).alias("low"), F.sum(v).alias("total"), F.count("*").alias("n"))


def merge_on(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Outer merge of two tables of variables on their common time key."""
    return a.join(b, keys, "full_outer")


def weather_windows(days: DataFrame, field: str, start: int, width: int, n_windows: int, means: list[str], sums: list[str], last: list[str]) -> DataFrame:
    """Means, sums and last values per window; NULL unless all days of the window have a row. All windows are there."""
    full = F.count("*") == width
    cols = [F.when(full, F.avg(c)).alias(f"{c}_mean") for c in means] + [F.when(full, F.coalesce(F.sum(c), F.lit(0.0))).alias(f"{c}_sum") for c in sums] + [F.when(full, F.max_by(c, "day")).alias(f"{c}_last") for c in last]
    per = days.withColumn("k", floor_window("day", start, width)).groupBy(field, "k").agg(F.count("*").alias("n_days"), *cols)
    out = scaffold(days.select(field).distinct(), "k", 0, n_windows).join(per, [field, "k"], "left")
    return out.withColumn("n_days", F.coalesce("n_days", F.lit(0)))


def since_event(days: DataFrame, field: str, value: str, start: str, end: str) -> DataFrame:
    """Adds the running sum of a value over the days from start to end, both included; NULL before, held at its end after."""
    w = Window.partitionBy(field).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    inside = (F.col("day") >= F.col(start)) & (F.col("day") <= F.col(end))
    run = F.sum(F.when(inside, F.coalesce(F.col(value), F.lit(0.0))).otherwise(0.0)).over(w)
    return days.withColumn(f"{value}_cum", F.when(F.col("day") >= F.col(start), run))


def climatology(days: DataFrame, cell: str, date: str, value: str, first: int, last: int, span: int = 31) -> DataFrame:
    """(cell, doy, normal): mean per day of year (capped at 365) over years [first, last], smoothed over `span` days of a ring."""
    doy = F.least(F.dayofyear(date), F.lit(365)).cast("bigint")
    base = days.where(F.year(date).between(first, last)).groupBy(cell, doy.alias("doy")).agg(F.avg(value).alias("m"))
    ring = base.select(cell, "m", F.explode(F.array(F.lit(-365), F.lit(0), F.lit(365))).alias("shift"), "doy").select(cell, "m", (F.col("doy") + F.col("shift")).alias("at"))
    half = span // 2
    w = Window.partitionBy(cell).orderBy("at").rangeBetween(-half, half)
    return ring.withColumn("normal", F.avg("m").over(w)).where(F.col("at").between(1, 365)).select(cell, F.col("at").alias("doy"), "normal")


def anomalies(days: DataFrame, normals: DataFrame, cell: str, date: str, value: str) -> DataFrame:
    doy = F.least(F.dayofyear(date), F.lit(365)).cast("bigint")
    d = days.withColumn("doy", doy)
    return d.join(normals, [cell, "doy"], "left").withColumn("anomaly", F.col(value) - F.col("normal"))


def heat_rules(fields: DataFrame, days: DataFrame, field: str, by: list[str], heat: str, reference: Column, steps: int, first_day: int, last_day: int, stand_ins: dict[tuple, tuple] = {}) -> DataFrame:  # noqa: B006
    """(by, start, width, n, stands_for): per group of the fields that `reference` holds for, the day from which heat counts
    (5 % point of sowing less 30 days, floored to 10, `first_day` at least) and the heat of a window (95 % point of the sums from
    that day to harvest, by steps - 1, to a tenth). Days span [first_day, last_day]; harvest is held in them, and days
    without a value add nothing. A group that has no rule takes that of its stand-in."""
    ref = fields.where(reference)
    start = F.greatest(F.lit(first_day), F.floor((F.percentile("sow_day", 0.05) - 30) / 10) * 10).cast("bigint")
    starts = ref.groupBy(*by).agg(start.alias("start"), F.count("*").alias("n"))
    harvest = F.greatest(F.lit(first_day), F.least(F.lit(last_day), F.col("harvest_day")))
    ends = ref.where("harvest_day is not null").select(field, *by, harvest.alias("_end")).join(starts, by)
    own = days.where(F.col("day").between(first_day, last_day)).select(F.col(field).alias("_f"), F.col("day").alias("_day"), F.col(heat).alias("_heat"))
    sums = ends.join(own, (F.col(field) == F.col("_f")) & (F.col("_day") >= F.col("start")) & (F.col("_day") <= F.col("_end")), "left").groupBy(field, *by).agg(F.coalesce(F.sum("_heat"), F.lit(0.0)).alias("_sum"))
    widths = sums.groupBy(*by).agg(F.round(F.percentile("_sum", 0.95) / (steps - 1) + 1e-9, 1).alias("width"))
    rules = starts.join(widths, by, "left").select(*by, "start", "width", "n", F.lit(None).cast("string").alias("stands_for"))
    own = rules
    for of, by_whom in stand_ins.items():
        same = F.expr(" and ".join(f"`{c}` = '{v}'" for c, v in zip(by, by_whom, strict=True)))
        own = own.unionByName(rules.where(same).select(*[F.lit(v).alias(c) for c, v in zip(by, of, strict=True)], "start", "width", "n", F.lit("|".join(map(str, by_whom))).alias("stands_for")))
    kept = F.min_by(F.struct("start", "width", "n", "stands_for"), F.coalesce("stands_for", F.lit("")))  # a group's own rule before one that stands in
    return own.groupBy(*by).agg(kept.alias("_r")).select(*by, "_r.*")


def thermal_windows(scenes: DataFrame, days: DataFrame, rules: DataFrame, field: str, heat: str, steps: int, first_day: int, last_day: int) -> DataFrame:
    """Scenes with the window k of accumulated heat they fall into: the sum from the rule's start up to the scene's day by the
    rule's width, floored. `rules` is (field, start, width). A scene on a day without a row has the sum of the days before;
    scenes before the start and beyond the last window are not kept."""
    ahead = [c for c in scenes.columns if c not in (field, "day")]
    own = days.where(F.col("day").between(first_day, last_day)).select(field, "day", F.col(heat).alias("_heat"), F.lit(0).alias("_scene"), F.lit(None).alias("_row"))
    seen = scenes.select(field, "day", F.lit(0.0).alias("_heat"), F.lit(1).alias("_scene"), F.struct(*ahead).alias("_row"))
    both = seen.unionByName(own).join(rules.select(field, "start", "width"), field).where(F.col("day") >= F.col("start"))
    w = Window.partitionBy(field).orderBy("day", "_scene").rowsBetween(Window.unboundedPreceding, 0)
    # Heat that is a whole number of widths is one whatever the order of its sum: it is rounded before it is floored.
    k = F.floor(F.round(F.try_divide(F.sum(F.coalesce("_heat", F.lit(0.0))).over(w), "width"), 9)).cast("bigint")
    return both.withColumn("k", k).where((F.col("_scene") == 1) & (F.col("k") < steps)).select(field, "day", "k", "_row.*")


def align(steps: DataFrame, key: str, event: DataFrame, width: int, start: int, lo: int, hi: int, values: list[str]) -> DataFrame:
    """Windows counted from the window of an event: step m is window k_event + m; steps without one are NULL, observed 0."""
    origin = event.select(key, F.floor((F.col("event_day") - start) / F.lit(float(width))).cast("bigint").alias("k0"))
    want = scaffold(origin, "m", lo, hi).withColumn("k", F.col("k0") + F.col("m"))
    have = steps.withColumn("_there", F.lit(1))
    out = want.join(have, [key, "k"], "left")
    return out.select(key, "m", "k", *values, F.coalesce("_there", F.lit(0)).alias("observed"))


def season_slice(steps: DataFrame, step: str, width: int, lo: int, hi: int) -> DataFrame:
    """Steps that start inside [lo, hi) days."""
    return steps.where((F.col(step) >= -(-lo // width)) & (F.col(step) < -(-hi // width)))


def scene_sequence(scenes: DataFrame, field: str, first_day: int) -> DataFrame:
    """Scenes numbered by day with the gap to the one before (the first counts from `first_day`)."""
    w = Window.partitionBy(field).orderBy("day", "scene")
    return scenes.withColumn("k", F.row_number().over(w) - 1).withColumn("gap", F.col("day") - F.lag("day", 1, first_day).over(w))


def left_padded(seq: DataFrame, field: str, order: str, value: str, length: int) -> DataFrame:
    """Per field the last `length` values as an array padded with NULL at the front, and how many are real."""
    got = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    out = seq.groupBy(field).agg(got.alias("v")).withColumn("v", F.slice("v", F.greatest(F.lit(1), F.size("v") - length + 1), length))
    pad = F.array_repeat(F.lit(None).cast("double"), F.lit(length) - F.size("v"))
    return out.select(field, F.concat(pad, "v").alias("padded"), F.size("v").cast("bigint").alias("real"))


def length_chunks(lengths: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    """Keys in random chunks of `size` (the last may be smaller), ordered by length inside a chunk; keys are numbered in a
    random order over ranges of it, so no task sees them all."""
    from fieldloom.functions.numeric import hash_rank
    from fieldloom.operators.tables import numbered

    order = numbered(lengths.withColumn("_h", hash_rank(seed, key)), ["_h", key], "_at")
    chunk = F.floor(F.col("_at") / size).cast("bigint")
    return order.withColumn("chunk", chunk).drop("_h", "_at").withColumn("place", F.row_number().over(Window.partitionBy("chunk").orderBy("length", key)))


def gaps(scenes: DataFrame, field: str) -> DataFrame:
    """Number of dates, first, last, largest and median gap between them."""
    d = scenes.select(field, "day").distinct()
    g = d.withColumn("gap", F.col("day") - F.lag("day").over(Window.partitionBy(field).orderBy("day")))
    return g.groupBy(field).agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"), F.max("gap").alias("max_gap"), F.median("gap").alias("median_gap"))


def best_so_far(runs: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("best", F.max(value).over(w))


def stop_trace(epochs: DataFrame, by: list[str], epoch: str, score: str, patience: int) -> DataFrame:
    """First epoch of the lowest score, and where training would stop after `patience` epochs without a new low."""
    w = Window.partitionBy(*by).orderBy(epoch)
    low = F.min(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = epochs.withColumn("_new", F.coalesce(F.col(score) < low, F.lit(True))).withColumn("_at", F.max(F.when(F.col("_new"), F.col(epoch))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stop = t.groupBy(*by).agg(F.min(F.when(F.col(epoch) - F.col("_at") >= patience, F.col(epoch))).alias("stop"), F.max(epoch).alias("_last"))
    stopped = t.join(stop, by).where(F.col(epoch) <= F.coalesce("stop", "_last"))
    return stopped.groupBy(*by).agg(F.min_by(epoch, F.struct(score, epoch)).alias("best_epoch"), F.min(score).alias("best"), F.max(F.coalesce("stop", "_last")).alias("stop_epoch"))


def next_in_cycle(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The next value of a column in its group; after the last comes the first."""
    w = Window.partitionBy(*by).orderBy(order)
    first = F.first(order).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("next", F.coalesce(F.lead(order).over(w), first))
