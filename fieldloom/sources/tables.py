"""Sources and sinks: pixel tables, seasons, weather, splits, predictions, run metrics, file inventories, reports.

All are Spark readers and writers; columns are matched by name, sentinels and NaN become NULL once, and partial rebuilds
overwrite only the partitions they hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatchcase
from urllib.parse import urlparse
from uuid import uuid4

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldloom.functions.numeric import missing
from fieldloom.session import checkpoint_dir


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Only the named columns are scanned."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def row_range(df: DataFrame, key: str, a: int, b: int) -> DataFrame:
    """Rows of keys [a, b): a filter that Parquet statistics prune on files sorted by the key."""
    return df.where((F.col(key) >= a) & (F.col(key) < b))


def cleaned(df: DataFrame, sentinels: dict[str, float | int]) -> DataFrame:
    """Sentinels and NaN to NULL."""
    kinds = dict(df.dtypes)
    out = []
    for c in df.columns:
        if c in sentinels:
            x = F.when(F.col(c) != sentinels[c], F.col(c))
            out.append((missing(x) if kinds[c] in ("double", "float") else x).alias(c))
        elif kinds[c] in ("double", "float"):
            out.append(F.nanvl(c, F.lit(None).cast(kinds[c])).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    """All parts by column name; a column that a part lacks is NULL there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def extract_pixels(sources: dict[str, DataFrame], target: str, static: list[str], key: str, group: str) -> tuple[DataFrame, DataFrame]:
    """Labelled rows of all sources: (steps with dynamic columns, one row a pixel with its static columns)."""
    rows = union_by_name([df.where(F.col(target).isNotNull()).withColumn(group, F.lit(name)) for name, df in sources.items()])
    dynamic = [c for c in rows.columns if c not in static]
    pixels = rows.groupBy(group, key).agg(*[F.min(c).alias(c) for c in [*static, target]])
    return rows.select(*dynamic), pixels


def write_partitioned(df: DataFrame, path: str, by: list[str], sort: list[str] = ()) -> None:
    """Overwrites only the partitions that df holds; rows are dealt by partition so that each has few files."""
    out = df.repartition(*by)
    if sort:
        out = out.sortWithinPartitions(*by, *sort)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_split(roles: DataFrame, attributes: DataFrame, path: str, by: list[str]) -> None:
    """Splits by their keys: (by, field, role) and one row of attributes (by, ...) each. Only splits that `roles` holds are
    written anew, with their attributes."""
    write_partitioned(roles, f"{path}/fields", by, ["role", "field"])
    write_partitioned(attributes.join(roles.select(*by).distinct(), by, "left_semi"), f"{path}/attributes", by)


def read_split(spark: SparkSession, path: str, **where: str) -> tuple[DataFrame, DataFrame]:
    """(field, role) of the splits with these keys, a row a field, and their attributes; filters on the keys prune folders."""
    out = [spark.read.parquet(f"{path}/{part}") for part in ("fields", "attributes")]
    for c, v in where.items():
        out = [df.where(F.col(c) == v) for df in out]
    return out[0], out[1]


def rebuilt(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """The old table without the groups that new holds, and new."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new.select(*old.columns))


def _headers(lines: DataFrame) -> DataFrame:
    """(path, header) of each file: its first line, without a byte order mark. A file may be read in several parts."""
    first = F.min_by("value", F.struct("start", "id"))
    return lines.withColumn("id", F.monotonically_increasing_id()).groupBy("path").agg(F.regexp_replace(first, "^\ufeff", "").alias("header"))


def read_by_header(spark: SparkSession, path: str, schema: str, optional: dict[str, str] = {}, pattern: str = "*.csv") -> DataFrame:  # noqa: B006
    """CSV files of which each names its own columns: values go by the header of their file, whatever its order.

    Headers are one line a file and meet the lines in an equi join; each line is cut into as many parts as the widest
    header has, and a column is the part where its name stands in the file's header (the first, if it stands there twice).
    Columns of `schema` must be in every file, `optional` ones that a file lacks are NULL; others are not kept. Values
    that are no such number, empty ones and NaN are NULL. A line equal to its file's header is no row. Files may be in
    folders below; empty ones have no rows, and a folder without files gives an empty table.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    cut = lambda c, n: F.from_csv(c, ", ".join(f"c{k} string" for k in range(n)))
    heads = _headers(lines)
    width = heads.agg(F.max(F.length("header") - F.length(F.replace(F.col("header"), F.lit(","))))).first()[0]
    n = (width or 0) + 1
    names = F.transform(F.array(*[F.col(f"h.c{k}") for k in range(n)]), lambda x: F.trim(x))
    heads = heads.select("path", "header", cut("header", n).alias("h")).select("path", "header", names.alias("names"))
    wanted = dict(x.strip().split() for x in schema.split(",")) | optional
    must = [c for c in wanted if c not in optional]
    lacking = heads.where(~F.forall(F.array(*[F.lit(c) for c in must]), lambda c: F.array_contains("names", c))).select("path", "header").first() if must else None
    if lacking:
        raise ValueError(f"{lacking['path']} lacks a column of {must}: {lacking['header']}")
    rows = lines.join(heads, "path").where((F.regexp_replace("value", "^\ufeff", "") != F.col("header")) & (F.trim("value") != ""))
    rows = rows.select("names", cut("value", n).alias("v")).select("names", F.array(*[F.col(f"v.c{k}") for k in range(n)]).alias("parts"))

    def value(c: str, kind: str) -> Column:
        at = F.array_position("names", F.lit(c))
        x = F.when(at > 0, F.get("parts", (at - 1).cast("int"))).try_cast(kind)
        return (F.nanvl(x, F.lit(None).cast(kind)) if kind in ("double", "float") else x).alias(c)

    return rows.select(*[value(c, kind) for c, kind in wanted.items()])


def read_weather(spark: SparkSession, path: str, schema: str, optional: dict[str, str]) -> DataFrame:
    """Daily weather files, whose columns differ in order and number; optional ones that a file lacks are NULL in its rows."""
    return read_by_header(spark, path, schema, optional)


def read_seasons(spark: SparkSession, path: str) -> DataFrame:
    """Season JSON (field, seeding_date, harvesting_date as dd.MM.yyyy) with 1 January before harvest and cube days."""
    df = spark.read.schema("field string, seeding_date string, harvesting_date string, seeding_date_type string").json(path)
    return season_days(df)


def season_days(df: DataFrame) -> DataFrame:
    day = lambda c: F.coalesce(*[F.try_to_date(c, f) if hasattr(F, "try_to_date") else F.to_date(c, f) for f in ("dd.MM.yyyy",)])
    d = df.withColumn("seeding_date", day("seeding_date")).withColumn("harvesting_date", day("harvesting_date"))
    d = d.withColumn("jan1", F.make_date(F.year("harvesting_date") - 1, F.lit(1), F.lit(1)))
    return d.withColumn("sow_day", F.datediff("seeding_date", "jan1") - 1).withColumn("harvest_day", F.datediff("harvesting_date", "jan1") - 1)


def field_index(pixels: DataFrame, field: str, key: str) -> DataFrame:
    """Per field: range of pixel keys and bounding box."""
    return pixels.groupBy(field).agg(F.min(key).alias("first"), F.max(key).alias("last"), *[f(c).alias(f"{n}_{c}") for c in ("prow", "pcol") for n, f in (("min", F.min), ("max", F.max))])


def runs_of(paths: DataFrame, path: str) -> DataFrame:
    """One row a run from `.../<config>/<split>/<file>`: whether it is done (has metrics) and has validation results."""
    parts = F.split(path, "/")
    d = paths.select(F.element_at(parts, -3).alias("config"), F.element_at(parts, -2).alias("split"), F.element_at(parts, -1).alias("file"))
    return d.groupBy("config", "split").agg(F.bool_or(F.col("file") == "metrics.json").alias("done"), F.bool_or(F.col("file").startswith("val")).alias("has_val"), F.count("*").alias("n_files"))


def _opened_by_tasks(spark: SparkSession, path: str) -> str | None:
    """The path with its scheme, if pyarrow knows the file system, so that tasks can open it by themselves."""
    if not urlparse(path).scheme:
        path = f"{urlparse(spark.sparkContext._jsc.hadoopConfiguration().get('fs.defaultFS')).scheme}://{path}"
        if not path.startswith("file:///"):
            return None
    try:
        FileSystem.from_uri(path)
    except (pa.ArrowException, OSError):
        return None
    return path


def write_texts(df: DataFrame, path: str, by: list[str], value: Column) -> None:
    """Lines of text, a file for each key: `path/a=x/b=y/part-0`. All tasks write, and a file is written by one of them.

    Spark's writer asks a local or remote file system several times a file and has the driver move them all, so it is used only where
    tasks can't open the file system themselves. A file appears when it is whole; one that is written again is replaced.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.repartition(n, *by)  # a number keeps adaptive execution from giving all files to one task, as texts shrink when shuffled
    root = _opened_by_tasks(spark, path)
    if root is None:
        keyed.select(*by, value.alias("value")).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*by).text(path)
        return
    escaped = lambda v: "__HIVE_DEFAULT_PARTITION__" if v is None or v == "" else re.sub(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", v)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(root)
        at, out, made, n = None, None, "", 0

        def close() -> None:
            nonlocal n
            if out is not None:
                out.close()
                fs.move(made, f"{base}/{at}/part-0")
                n += 1

        for b in batches:
            keys, texts = list(zip(*[c.to_pylist() for c in b.columns[:-1]], strict=True)), b.column(b.num_columns - 1)
            for key, text in zip(keys, texts, strict=True):
                folder = "/".join(f"{c}={escaped(v)}" for c, v in zip(by, key, strict=True))
                if folder != at:
                    close()
                    at = folder
                    fs.create_dir(f"{base}/{at}", recursive=True)
                    made = f"{base}/{at}/.{uuid4().hex}"
                    out = fs.open_output_stream(made)
                out.write((text.as_py() or "").encode() + b"\n")
        close()
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    FileSystem.from_uri(root)[0].create_dir(FileSystem.from_uri(root)[1], recursive=True)  # also if there is no row
    keyed.sortWithinPartitions(*by).select(*[F.col(c).cast("string").alias(c) for c in by], value.alias("value")).mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of the files below a folder; contents are not read.

    Folders are dealt over all tasks, a level of the tree at a time, and each task lists its own, so the driver neither asks for
    nor holds the files (a task holds those of one folder). Names that begin with `_` or `.` are left out, as by Spark.
    """
    root = None if re.search(r"[{\\^]", pattern) else _opened_by_tasks(spark, path)
    if root is None:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")
    checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names, kinds = ["rel", "folder", "length", "ns"], [pa.string(), pa.bool_(), pa.int64(), pa.int64()]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(root)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for rel in b.column(0).to_pylist():
                for f in fs.get_file_info(FileSelector(base + rel)):
                    folder = f.type == FileType.Directory
                    hidden = f.base_name.startswith(".") or f.base_name.startswith("_") and "=" not in f.base_name
                    if not hidden and (folder or fnmatchcase(f.base_name, pattern)):
                        rows.append((f"{rel}/{f.base_name}", folder, None if folder else f.size, f.mtime_ns))
                if len(rows) >= 10_000:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()

    todo, files = spark.createDataFrame([("",)], "rel string"), []
    while not todo.isEmpty():
        seen = todo.repartition(n).mapInArrow(look, "rel string, folder boolean, length bigint, ns bigint").checkpoint()
        files.append(seen.where("not folder"))
        todo = seen.where("folder").select("rel")
    shown = re.sub("^file:/+", "file:/", root.rstrip("/"))
    return union_by_name(files).select(F.concat(F.lit(shown), "rel").alias("path"), "length", F.timestamp_micros(F.floor(F.col("ns") / 1000).cast("bigint")).alias("modificationTime"))


def listed_paths(files: DataFrame, root: str) -> DataFrame:
    """(path, length) of files below a root, without it, without the keys of partition folders (`a=x` is x), and with the part
    files of a folder as one file that bears the folder's name."""
    below = F.regexp_replace(F.substring_index("path", "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/", -1), "(^|/)[^/=]+=", "$1")
    folder = F.regexp_replace(below, "/part-[^/]*$", "")
    return files.groupBy(folder.alias("path")).agg(F.sum("length").alias("length"))


def inventory(files: DataFrame, path: str, size: str, kinds: dict[str, str]) -> DataFrame:
    """Per folder: files and bytes by kind (the first pattern that the name matches), first and last name."""
    from fieldloom.functions.scalars import name_group

    d = files.select(F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract(path, "([^/]+)$", 1).alias("name"), F.col(size).alias("size"))
    return d.groupBy("folder", name_group("name", kinds).alias("kind")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("name").alias("first"), F.max("name").alias("last"))


METRICS = "struct<metrics: map<string, map<string, struct<r2: double, rmse: double, n: bigint>>>, members: array<map<string, struct<r2: double, rmse: double, n: bigint>>>>"


def metrics_long(runs: DataFrame, keep: list[str], doc: str) -> DataFrame:
    """(keep, set, group, part..., r2, rmse, n): a row for each set and group of nested run metrics."""
    d = runs.select(*keep, F.from_json(doc, METRICS).alias("m"))
    d = d.select(*keep, F.explode("m.metrics").alias("set", "groups")).select(*keep, "set", F.explode("groups").alias("group", "v"))
    parts = F.split("group", r"\|")
    return d.select(*keep, "set", "group", F.get(parts, 0).alias("country"), F.get(parts, 1).alias("crop"), "v.r2", "v.rmse", "v.n")


def member_spread(runs: DataFrame, keep: list[str], doc: str) -> DataFrame:
    """(keep, group, r2, spread, n_members) over the members' metrics."""
    d = runs.select(*keep, F.from_json(doc, METRICS).alias("m")).select(*keep, F.posexplode("m.members").alias("member", "g")).select(*keep, "member", F.explode("g").alias("group", "v"))
    return d.groupBy(*keep, "group").agg(F.avg("v.r2").alias("r2"), F.stddev_pop("v.r2").alias("spread"), F.count("*").alias("n_members"))


def write_report(df: DataFrame, path: str, order: list[str]) -> None:
    """A small ordered table as one CSV file with a header."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, order: list[str], most: int = 1000) -> str:
    """A small ordered table as Markdown; more than `most` rows is an error."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    line = lambda x: "| " + " | ".join("" if v is None else str(v) for v in x) + " |"
    return "\n".join([line(df.columns), "|" + "---|" * len(df.columns), *map(line, rows)])
