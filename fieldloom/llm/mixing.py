"""Mixing sources to target weights, in DataFrame operations only.

Each source gets a budget of words. Its documents stand in the order of a hash-random key: rows are ranged by (source, key)
over all partitions, each partition sums its own rows, sums of the partitions before are added, and the source is cut where
the running sum meets its budget. Whole passes over a source (epochs) come first if the budget is above the source's size,
so a cut document may count `most` times at most and a source's taken words are its budget rounded down.

A budget is a source's weight times a common level, `most` times its size at most. What a full source can't take goes to the
others by weight, until none is above: sources fill in the order of size over weight, so the full ones are those whose
share of what the ones before left is above their limit, and no rounds are needed.

No partition gathers a source: a hot source is spread by its keys, repeated ids and rows by their place as well. What
meets every row is one line a partition and source, sent to all tasks only up to `SENT` lines and joined otherwise.

Results for odd input: null and empty texts have no words, are taken with none, and count for nothing. Null sources are one
source, the last. Repeated ids and equal rows are documents of their own; of equal rows any may be the one that is cut, which
shows in no result. A source without words has a target of zero, and so has every source of a table without words. A very
long text is one number here. An empty table gives an empty result. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.llm.text import narrow
from fieldloom.operators.tables import numbered
from fieldloom.session import checkpoint_dir

#: Lines of a table that is sent to all tasks: some 100 bytes each.
SENT = 50_000


def hash_key(seed: int, doc_id: Column) -> Column:
    """A number of 60 bits from the md5 of seed and id; a null id is a space."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(" ")))
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 15), 16, 10).cast("bigint")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, place): each document's words, counted once and written; `place` tells equal rows apart."""
    checkpoint_dir(docs.sparkSession)
    d = narrow(docs, (id_col, "doc_id", "bigint"), (text_col, "text", "string"), (source_col, "source", "string"))
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    return d.select("doc_id", "source", n.alias("size"), F.monotonically_increasing_id().alias("place")).checkpoint()


def budgets(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, weight, target) of each source; weights go round by the sources' order, nulls last."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    ranked = numbered(per, ["none", "source"], "rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.select("source", "source_size", "rank", weight.alias("weight"), (F.col("source_size") * float(most)).alias("limit")).withColumn("fill", F.col("limit") / F.col("weight"))
    # Running sums of limits and weights in the order of filling, over partitions as well.
    ranged = ranked.repartitionByRange("fill", "rank").withColumn("part", F.spark_partition_id()).checkpoint()
    sums = ranged.groupBy("part").agg(F.sum("limit").alias("limits"), F.sum("weight").alias("weights"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}_before") for c in ("limits", "weights")])
    own = Window.partitionBy("part").orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = ranged.join(_small(sums), "part").select("*", *[(F.col(f"{c}s_before") + F.coalesce(F.sum(c).over(own), F.lit(0.0))).alias(c[0]) for c in ("limit", "weight")])
    every = ranged.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, all_weights = share * float(every["size"] or 0), float(every["weight"] or 0)
    full = F.col("weight") * (F.lit(total) - F.col("l")) > F.col("limit") * (F.lit(all_weights) - F.col("w"))
    filled = filled.withColumn("full", full).checkpoint()
    taken = filled.where("full").agg(F.sum("limit").alias("limit"), F.sum("weight").alias("weight")).first()
    left, free = total - (taken["limit"] or 0.0), all_weights - (taken["weight"] or 0.0)
    open_share = F.col("weight") * F.lit(left) / F.lit(free or 1.0)
    return filled.select("source", "source_size", "weight", F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", open_share)).alias("target"))


def _small(df: DataFrame) -> DataFrame:
    """The table, sent to all tasks if it has few rows."""
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 12, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): the words of each document that the mix takes, repeats counted."""
    sized = sizes(docs, id_col, text_col, source_col)
    target = budgets(sized, weights, share, most)
    # Parts are fixed by being written: their sums and their rows must not be ranged differently.
    order = ["none", "source", "key", "doc_id", "size", "place"]
    keyed = sized.select("doc_id", "source", F.col("source").isNull().alias("none"), "size", "place", hash_key(seed, F.col("doc_id")).alias("key"))
    ranged = keyed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).checkpoint()
    sums = ranged.groupBy("source", "part").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lines = sums.join(target, sums.source.eqNullSafe(target.source)).select(sums.source.alias("of"), "part", "before", "source_size", "target").checkpoint()
    own = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", "place").rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0))).withColumnRenamed("part", "in")
    placed = running.join(_small(lines), (F.col("in") == F.col("part")) & F.col("source").eqNullSafe(F.col("of")))
    budget = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = budget - epochs * F.col("source_size") - F.col("before") - F.col("own")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def epochs_of(mixed: DataFrame) -> DataFrame:
    """(doc_id, source, epoch, words): a row for each time the mix takes a document, epochs from 0, with the words it takes
    (all of them, or the first ones where the budget ends); the table to read the mix by."""
    whole = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    each = mixed.where("taken > 0").select("doc_id", "source", "size", "taken", F.explode(F.sequence(F.lit(0), whole - 1)).alias("epoch"))
    return each.select("doc_id", "source", "epoch", F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")).alias("words"))
