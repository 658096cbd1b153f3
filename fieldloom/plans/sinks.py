"""Queries: sources and sinks, each a round trip of a given table through a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from fieldloom.functions.features import column, resolve
from fieldloom.functions.scalars import expand_columns
from fieldloom.operators import splits as X
from fieldloom.plans.evaluation import rounded
from fieldloom.plans.fixtures import Fx
from fieldloom.plans.registry import query
from fieldloom.session import checkpoint_dir
from fieldloom.sources import tables as S


def _folder(fx: Fx, name: str) -> str:
    return f"{checkpoint_dir(fx.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY l_returnflag")
def column_scan(fx: Fx) -> DataFrame:
    """Two columns of a wide table; the scan reads no others."""
    scan = S.read_parquet(fx.spark, f"{fx.sf_dir}/lineitem.parquet", ["l_returnflag", "l_quantity"])
    return rounded(scan.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")))


@query("SELECT field, count(*) AS n, round(avg(temp_mean), 6) AS temp, round(sum(CASE WHEN field % 3 < 2 AND prec > 100 THEN prec END), 6) AS prec, round(avg(CASE WHEN field % 3 = 1 THEN temp_min END), 6) AS dew, CAST(count(CASE WHEN field % 3 = 1 THEN 1 END) AS BIGINT) AS n_dew, CAST(0 AS BIGINT) AS wind FROM fx_daily GROUP BY field")
def weather_files(fx: Fx) -> DataFrame:
    """Daily weather through CSV files whose headers differ in order and lack different columns; some cells are empty."""
    path = _folder(fx, "weather")
    d = fx.daily.select("field", "day", "temp_mean", F.when(F.col("prec") > 100, F.col("prec")).alias("prec"), F.col("temp_min").alias("dew"), F.lit("x").alias("note"))
    for k, columns in enumerate((["field", "day", "temp_mean", "prec"], ["dew", "prec", "note", "day", "field", "temp_mean"], ["temp_mean", "day", "field"])):
        d.where(F.pmod("field", F.lit(3)) == k).select(*columns).write.option("header", True).csv(f"{path}/part{k}")
    back = S.read_weather(fx.spark, path, "field bigint, day bigint, temp_mean double", {"prec": "double", "dew": "double", "wind": "double"})
    return rounded(back.groupBy("field").agg(F.count("*").alias("n"), F.avg("temp_mean").alias("temp"), F.sum("prec").alias("prec"), F.avg("dew").alias("dew"), F.count("dew").alias("n_dew"), F.count("wind").alias("wind")))


@query("SELECT field, CAST(make_date(year(jan1 + CAST(harvest_day AS INTEGER)) - 1, 1, 1) AS DATE) AS jan1, CAST(date_diff('day', make_date(year(jan1 + CAST(harvest_day AS INTEGER)) - 1, 1, 1), jan1 + CAST(sow_day AS INTEGER)) - 1 AS INTEGER) AS sow_day, CAST(date_diff('day', make_date(year(jan1 + CAST(harvest_day AS INTEGER)) - 1, 1, 1), jan1 + CAST(harvest_day AS INTEGER)) - 1 AS INTEGER) AS harvest_day FROM fx_season")
def season_files(fx: Fx) -> DataFrame:
    """Season dates through JSON files."""
    path = _folder(fx, "seasons")
    text = lambda c: F.date_format(F.date_add("jan1", F.col(c).cast("int")), "dd.MM.yyyy")
    fx.season.select("field", text("sow_day").alias("seeding_date"), text("harvest_day").alias("harvesting_date"), F.lit("own").alias("seeding_date_type")).write.json(path)
    return S.read_seasons(fx.spark, path).select("field", "jan1", "sow_day", "harvest_day")


@query("WITH y AS (SELECT year, coalesce(lead(year) OVER (ORDER BY year), min(year) OVER ()) AS val FROM (SELECT DISTINCT year FROM fx_fields)), r AS (SELECT y.year AS fold, y.val, CASE WHEN f.year = y.year THEN 2 WHEN f.year = y.val THEN 1 ELSE 0 END AS role, f.field FROM fx_fields f CROSS JOIN y) SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n, min(field) AS first, max(field) AS last, CASE WHEN fold = 1997 THEN 'anew' ELSE 'first' END AS method, CAST(max(val) AS BIGINT) AS val_year FROM r WHERE fold <> 1997 OR role > 0 GROUP BY fold, role")
def split_store(fx: Fx) -> DataFrame:
    """Folds with their attributes through a partitioned store of which one partition is then built anew, a fold at a time."""
    path, fx = _folder(fx, "splits"), fx.kept("fields")
    roles = X.fold_roles(fx.fields, "year").select(F.col("fold").cast("int").alias("fold"), "field", "role")
    of = roles.where("role = 1").join(fx.fields.select("field", "year"), "field").groupBy("fold").agg(F.max("year").alias("val_year"))
    S.write_split(roles, of.withColumn("method", F.lit("first")), path, ["fold"])
    S.write_split(roles.where("fold = 1997 and role > 0"), of.withColumn("method", F.lit("anew")), path, ["fold"])
    folds = [r.fold for r in fx.spark.read.parquet(f"{path}/fields").select("fold").distinct().orderBy("fold").collect()]  # a fold is a year
    parts = []
    for k in folds:
        fields, attributes = S.read_split(fx.spark, path, fold=k)
        parts.append(fields.join(attributes, "fold").groupBy("fold", "role", "method", "val_year").agg(F.count("*").alias("n"), F.min("field").alias("first"), F.max("field").alias("last")))
    return S.union_by_name(parts)


@query("SELECT country, count(*) AS n, round(avg(pred), 6) AS pred FROM fx_preds GROUP BY country")
def prediction_store(fx: Fx) -> DataFrame:
    """Predictions through a store with a folder for each country."""
    path = _folder(fx, "predictions")
    S.write_partitioned(fx.preds.select("country", "field", "prow", "pcol", "pred"), path, ["country"], ["field"])
    return rounded(S.read_parquet(fx.spark, path, ["country", "pred"]).groupBy("country").agg(F.count("*").alias("n"), F.avg("pred").alias("pred")))


@query("SELECT CAST(row_number() OVER (ORDER BY country) AS INTEGER) AS place, country, count(*) AS n FROM fx_fields GROUP BY country")
def report_files(fx: Fx) -> DataFrame:
    """A small table as one ordered CSV file with a header."""
    path = _folder(fx, "report")
    S.write_report(fx.fields.groupBy("country").agg(F.count("*").alias("n")), path, ["country"])
    back = fx.spark.read.option("header", True).schema("country string, n bigint").csv(path)
    return back.select((F.monotonically_increasing_id() + 1).cast("int").alias("place"), "country", "n")


@query("SELECT round(avg((clay_0_5 * 5 + clay_5_15 * 10 + clay_15_30 * 15) / 30 * 0.1), 6) AS \"soil_clay_0-30cm\", round(avg((clay_5_15 * 5 + clay_15_30 * 15) / 20 * 0.1), 6) AS \"soil_clay_10-30cm\", round(avg(greatest(-1, least(1, (sand_0_5 - clay_0_5) / (sand_0_5 + clay_0_5)))), 6) AS ndvi, CAST(count_if(clay_0_5 > 20) AS DOUBLE) / count(*) AS observed, round(avg(silt_0_5), 6) AS e5_swvl1, round(avg(CASE WHEN pixel % 3 = 1 THEN 1.0 ELSE 0.0 END), 6) AS \"crop=b\" FROM fx_soil".replace("CAST(count_if(clay_0_5 > 20) AS DOUBLE) / count(*)", "round(CAST(count_if(clay_0_5 > 20) AS DOUBLE) / count(*), 6)"))
def feature_names(fx: Fx) -> DataFrame:
    """The features that a list of specifications names, computed from the columns they are made of."""
    kinds = F.when(F.col("pixel") % 3 == 1, "b").when(F.col("pixel") % 3 == 2, "a")
    d = fx.soil.select("*", F.col("sand_0_5").alias("B08"), F.when(F.col("clay_0_5") > 20, F.col("clay_0_5")).alias("B03"), F.col("clay_0_5").alias("B04"), F.col("silt_0_5").alias("e5_swvl1"), kinds.alias("crop"))
    found = resolve(["soil:clay", "soil:clay@10-30", "indices:ndvi", "observed", "era5land:swvl1", "crop"], {"crop": ["b"]})
    return rounded(d.agg(*[F.avg(column(f, "B03")).alias(f.name) for f in found]))


@query("SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("sand_0_5", "clay_0_5", "clay_5_15", "clay_15_30", "clay_30_60", "clay_60_100", "clay_100_200")) + " FROM fx_soil")
def column_patterns(fx: Fx) -> DataFrame:
    """The columns that names and patterns select, in their order."""
    d = fx.soil
    return rounded(d.agg(*[F.avg(c).alias(c) for c in expand_columns(d.columns, "sand_0_5", "clay_.*")]))
