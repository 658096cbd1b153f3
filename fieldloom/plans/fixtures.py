"""Adapters: shapes of field observations over the given tables, as SQL that Spark and DuckDB both run.

`Fx(spark, sf_dir).pixels` and so on are DataFrames; `with_fixtures(sql)` puts the adapters that a query names before it
as common table expressions, for the SQL oracles.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from fieldloom.session import checkpoint_dir

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")

#: Adapters in order of dependency. Where the engines differ, a pair (Spark, DuckDB).
ADAPTERS: dict[str, str | tuple[str, str]] = {
    "fx_pixels": """SELECT concat(CAST(l_suppkey AS STRING), '_', CAST(year(l_shipdate) AS STRING)) AS field, l_suppkey AS farm,
        CAST(year(l_shipdate) AS BIGINT) AS year, CAST(l_orderkey % 10 AS BIGINT) AS prow, CAST(l_partkey % 10 AS BIGINT) AS pcol,
        avg(l_quantity) AS target, avg(l_extendedprice) / 1000 AS z, count(*) AS n, avg(l_discount) AS disc, avg(l_tax) AS tax
        FROM {lineitem} GROUP BY l_suppkey, year(l_shipdate), l_orderkey % 10, l_partkey % 10""",
    # The same with gaps: fields have holes and ragged edges.
    "fx_masked": "SELECT * FROM fx_pixels WHERE (prow * 7 + pcol * 3 + farm) % 5 > 0",
    "fx_fields": """SELECT p.field, p.farm, p.year, r_name AS country, n_name AS region,
        CASE (p.farm + p.year) % 4 WHEN 0 THEN 'wheat' WHEN 1 THEN 'maize' WHEN 2 THEN 'soybean' ELSE 'barley' END AS crop,
        p.farm AS physical_field, count(*) AS n_pixels, avg(p.target) AS yield_mean
        FROM fx_pixels p JOIN {supplier} ON p.farm = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
        GROUP BY p.field, p.farm, p.year, r_name, n_name""",
    "fx_preds": """SELECT p.field, p.farm, p.year, f.country, f.crop, p.prow, p.pcol, p.target, 25 + 200 * (p.disc - 0.05) AS pred_m0,
        25 + 200 * (p.tax - 0.04) AS pred_m1, (25 + 200 * (p.disc - 0.05) + 25 + 200 * (p.tax - 0.04)) / 2 AS pred,
        abs(200 * (p.disc - 0.05) - 200 * (p.tax - 0.04)) / 2 AS pred_std, p.z
        FROM fx_pixels p JOIN fx_fields f ON p.field = f.field""",
    "fx_season": """SELECT field, farm, year, crop, country, CAST(240 + farm % 50 AS BIGINT) AS sow_day, CAST(240 + farm % 50 + 200 + year % 10 AS BIGINT) AS harvest_day,
        CAST(concat(CAST(year - 1 AS STRING), '-01-01') AS DATE) AS jan1 FROM fx_fields""",
    # Two bands of each pixel in six windows, a quarter of them not seen.
    "fx_steps": tuple(
        """SELECT field, prow, pcol, k, CASE WHEN (prow * 3 + pcol * 5 + k * 7 + farm) % 4 > 0 THEN 0.05E0 + ((prow * 31 + pcol * 17 + k * 13 + farm * 7) % 100) / 400.0E0 END AS B04,
        CASE WHEN (prow * 3 + pcol * 5 + k * 7 + farm) % 4 > 0 THEN 0.10E0 + ((prow * 11 + pcol * 29 + k * 3 + farm) % 100) / 300.0E0 END AS B08 FROM (SELECT *, """ + each + " AS k FROM fx_pixels)" for each in ("explode(sequence(0L, 5L))", "unnest(range(0, 6))")
    ),
    "fx_scenes": """SELECT user_id AS field, CAST(day(ts) - 1 AS BIGINT) AS day, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS clouds,
        (100 - CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) / 100.0E0 AS clear_share, event_id AS scene, event_type AS kind, value FROM {events}""",
    # Class codes of twelve cells of each scene, nine of them inside the field.
    "fx_scene_cells": tuple(
        """SELECT field, day, scene, cell, cell < 9 AS inside, CAST(CASE WHEN scene % 7 = 0 THEN 0 WHEN field % 10 = 3 THEN 8 + cell % 2 WHEN (scene * 7 + cell * 13) % 100 >= clouds THEN 4 + (scene + cell) % 2 WHEN scene % 5 = 0 THEN 9
        ELSE CASE (scene + cell * 5) % 11 WHEN 0 THEN 8 WHEN 1 THEN 8 WHEN 2 THEN 9 WHEN 3 THEN 10 WHEN 4 THEN 3 WHEN 5 THEN 11 WHEN 6 THEN 2 WHEN 7 THEN 7 WHEN 8 THEN 0 WHEN 9 THEN 6 ELSE 1 END END AS BIGINT) AS code
        FROM (SELECT *, """ + each + " AS cell FROM fx_scenes WHERE (field * 3 + CAST(floor(day / 6.0) AS BIGINT)) % 4 > 0)" for each in ("explode(sequence(0L, 11L))", "unnest(range(0, 12))")
    ),
    "fx_grounds": """SELECT DISTINCT user_id AS field, CASE WHEN user_id % 13 <> 0 THEN CAST(user_id % 9 AS BIGINT) END AS sow_day, CASE WHEN user_id % 17 <> 0 THEN CAST(14 + user_id % 12 AS BIGINT) END AS harvest_day,
        CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS country, CASE WHEN user_id % 3 = 1 THEN 'south' ELSE 'north' END AS half, CASE WHEN user_id % 3 = 2 AND user_id % 4 = 3 THEN 'barley' WHEN user_id % 2 = 0 THEN 'wheat' ELSE 'maize' END AS crop,
        CAST('2020-01-11' AS DATE) AS jan1 FROM {events}""",
    "fx_daily": """SELECT user_id AS field, CAST(day(ts) - 1 AS BIGINT) AS day, avg(value) AS temp_mean, max(value) AS temp_max, min(value) AS temp_min,
        sum(value) AS prec, count(*) AS n_obs FROM {events} GROUP BY user_id, day(ts)""",
    "fx_cell_daily": """SELECT CAST(n_regionkey AS BIGINT) AS cell, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 10000 AS v, sum(o_totalprice) / 10000 AS s, count(*) AS n_obs
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_regionkey, CAST(o_orderdate AS DATE)""",
    "fx_series": (
        "SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(step AS BIGINT) AS step, CAST(value AS DOUBLE) AS value FROM (SELECT vec_id, label, posexplode(embedding) AS (step, value) FROM {embeddings})",
        "SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(s - 1 AS BIGINT) AS step, CAST(embedding[s] AS DOUBLE) AS value FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS s FROM {embeddings})",
    ),
    "fx_soil": """SELECT p_partkey AS pixel, CAST(p_size AS DOUBLE) AS clay_0_5, p_size * 1.1E0 AS clay_5_15, p_size * 1.2E0 AS clay_15_30, p_size * 1.3E0 AS clay_30_60,
        p_size * 1.4E0 AS clay_60_100, p_size * 1.5E0 AS clay_100_200, p_retailprice / 100 AS sand_0_5, 20.0E0 + p_size % 7 AS silt_0_5 FROM {part}""",
    "fx_codes": "SELECT code, label FROM (SELECT 'A' AS code, 'accepted' AS label UNION ALL SELECT 'N' AS code, 'none' AS label)",
    "fx_docs": """SELECT d.doc_id, d.source, d.lang, d.n_chars, CAST(l.quality AS BIGINT) AS quality FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "fx_footprint": """SELECT o_custkey AS field, CAST(o_custkey % 40 AS BIGINT) AS x, CAST(o_orderkey % 40 AS BIGINT) AS y FROM {orders} GROUP BY o_custkey, o_orderkey % 40""",
    "fx_outline": """SELECT c_custkey AS farm, CAST((c_custkey * 7919) % 300000 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 300000 AS DOUBLE) AS y FROM {customer}""",
}


def _text(name: str, spark: bool) -> str:
    sql = ADAPTERS[name]
    return sql if isinstance(sql, str) else sql[0 if spark else 1]


class Fx:
    """Adapters and tables as DataFrames, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in TABLES:
            return self.table(name)
        if name not in self._made:
            sql = _text(f"fx_{name}", True)
            used = {t: self.table(t) for t in re.findall(r"\{(\w+)\}", sql)}
            own = {f: getattr(self, f[3:]) for f in dict.fromkeys(re.findall(r"\bfx_\w+", sql))}
            for f in own:
                sql = re.sub(rf"\b{f}\b", "{" + f + "}", sql)
            self._made[name] = self.spark.sql(sql, **used, **own)
        return self._made[name]

    def over(self, **made: DataFrame) -> Fx:
        """Adapters made from these DataFrames in place of adapters of their names."""
        out = Fx(self.spark, self.sf_dir)
        out._made.update(made)
        return out

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """The same rows, computed once and read from the shared folder."""
        path = f"{checkpoint_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def kept(self, *names: str) -> Fx:
        """With these adapters, in order of dependency, stored for all that is made from them."""
        for name in names:
            self._made[name] = self.stored(getattr(self, name), name)
        return self


def with_fixtures(sql: str) -> str:
    """DuckDB SQL with the adapters that it names, and those that they need."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bfx_\w+", text)):
            if name in ADAPTERS and name not in need:
                add(_text(name, False))
                need.append(name)

    add(sql)
    if not need:
        return sql
    parts = [f"{n} AS ({re.sub(r'[{}]', '', _text(n, False))})" for n in need]
    sql = sql.strip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(opening):
            return opening + ", ".join(parts) + ", " + sql[len(opening) :]
    return "WITH " + ", ".join(parts) + " " + sql
