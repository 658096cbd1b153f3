"""Token ids of a corpus as raw payload shards in id order, with a minimal perfect hash index for keyed access.

`<path>/payload` has one row a shard: raw little-endian ids (2 bytes where the vocabulary allows it, else 4), the keys
of its documents and where their ids end. `<path>/index` has one row a bucket of keys: a minimal perfect hash (a seed
for every few keys) that takes a key to a slot, where a 32-bit fingerprint (against keys that are not stored) and the
shard, position and number of rows in it stand, one entry for each shard that has the key. Looking up a key reads one
bucket, one slot and one slice of each of its shards; the key that stands beside the ids confirms it. Both tables go
through Spark's writers, so lost executors and repeated tasks leave no half files, on any store that Spark writes.

Results for odd input: null or empty text: the end id alone. A very long text is one slice of one shard. Rows that share
an id are all stored, in the order of their texts' hashes (ties: equal rows), and a lookup returns them all, whatever
shards they are in. Null ids come first; they have no key, so only `read_store` returns them. An empty table makes empty
files. Other columns are not looked at.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldloom.llm import text as T
from fieldloom.llm.token_ids import SLICE_BYTES, begin, encoder
from fieldloom.session import checkpoint_dir

#: Text of a range of ids that one task writes, ids of a shard, and keys of an index bucket.
RANGE_BYTES = 16 << 20
SHARD_IDS = 1 << 20
#: Parts whose sizes are summed in one task.
PARTS_AT_ONCE = 1024
BUCKET_KEYS = 4096

_PAYLOAD = "part int, shard int, start_in_part long, width int, n_docs int, n_ids long, doc_ids binary, null_ids int, ends binary, payload binary"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place that all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _shards(vocabulary: str, end_id: int):
    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard, before
            key, flat, size = pa.concat_arrays(keys), np.concatenate(ids), np.concatenate(sizes)
            width = 2 if encoder(vocabulary).library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
            row = [part, shard, before, width, len(size), len(flat), key.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), key.null_count, np.cumsum(size).astype("<i8").tobytes(), flat.astype(f"<u{width}").tobytes()]
            shard, before = shard + 1, before + len(flat)
            keys.clear(), ids.clear(), sizes.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _PAYLOAD.split(", ")])

        for b in batches:
            texts = T.as_strings(b.column(1))
            for i, j in T.slices(texts, SLICE_BYTES):
                flat, counts = encoder(vocabulary).encode(texts.slice(i, j - i))
                keys.append(b.column(0).slice(i, j - i))
                ids.append(np.insert(flat, np.cumsum(counts), end_id))
                sizes.append(counts + 1)
                if sum(map(len, ids)) >= SHARD_IDS:
                    yield flush()
        if keys:
            yield flush()

    return mapper


# The minimal perfect hash.


def _hash(keys: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    return T.mixed(keys.view(np.uint64) ^ (np.atleast_1d(np.asarray(seed, np.uint64)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds by small bucket, and the slot of each of the distinct keys; a bucket of one key stores its slot itself."""
    n = len(keys)
    small = max(1, n // 4)
    bucket = (_hash(keys, 0) % np.uint64(small)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=small)
    first = np.cumsum(size) - size
    seeds, slots, taken = np.zeros(small, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    for b in np.argsort(-size, kind="stable"):
        if size[b] < 2:
            break
        own = order[first[b] : first[b] + size[b]]
        seed = 1
        while True:
            tries = np.arange(seed, seed + 64)
            at = (_hash(keys[own][None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
            good = ~taken[at].any(axis=1) & (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                seeds[b], slots[own] = tries[k], at[k]
                taken[at[k]] = True
                break
            seed += 64
    single = np.flatnonzero(size == 1)
    free = np.flatnonzero(~taken)[: len(single)]
    seeds[single] = -free - 1
    slots[order[first[single]]] = free
    return seeds, slots


def slot_of(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    seed = seeds[(_hash(keys, 0) % np.uint64(len(seeds))).astype(np.int64)]
    return np.where(seed < 0, -seed - 1, (_hash(keys, np.maximum(seed, 0)) % np.uint64(n)).astype(np.int64))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1 << 40) >> np.uint64(32)).astype("<u4")


_INDEX = "bucket long, n int, seeds binary, fingerprints binary, heads binary, parts binary, shards binary, positions binary, counts binary"


def _index(key: tuple, t: pa.Table) -> pa.Table:
    """A bucket's entries by slot: slot k has those from heads[k] to heads[k + 1]."""
    t = t.sort_by([("doc_id", "ascending"), ("part", "ascending"), ("shard", "ascending")])
    own = t.column("doc_id").to_numpy()
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    size = np.diff(np.append(first, len(own)))
    ids = own[first]
    seeds, slots = perfect_hash(ids)
    order = np.argsort(slots)
    heads = np.append(0, np.cumsum(size[order]))
    entry = np.arange(len(own)) + np.repeat(first[order] - heads[:-1], size[order])
    row = [key[0].as_py(), len(ids), seeds.astype("<i8").tobytes(), _fingerprint(ids)[order].tobytes(), heads.astype("<i4").tobytes()]
    row += [t.column(c).to_numpy()[entry].astype("<i4").tobytes() for c in _PLACE]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 7]
    return pa.table([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])


_PLACE = ("part", "shard", "position", "count")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, shard, position, count) of each key of a payload row, where its first row is and how many it has."""
    for b in batches:
        for r in b.to_pylist():
            ids = np.frombuffer(r["doc_ids"], "<i8")[r["null_ids"] :]
            at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
            n = len(at)
            yield pa.record_batch([pa.array(ids[at]), pa.array(np.full(n, r["part"], np.int32)), pa.array(np.full(n, r["shard"], np.int32)), pa.array((at + r["null_ids"]).astype(np.int32)), pa.array(np.diff(np.append(at, len(ids))).astype(np.int32))], names=["doc_id", *_PLACE])


def _bucket(n: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("bucket")


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes payload and index below `path`, in ascending order of ids."""
    spark = docs.sparkSession
    docs = T.narrow(docs, (id_col, "doc_id", "bigint"), (text_col, "text", "string"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / RANGE_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.mapInArrow(_shards(vocabulary, end_id), _PAYLOAD).write.option("compression", "zstd").parquet(f"{path}/payload")
    payload = spark.read.parquet(f"{path}/payload")
    n = max(1, math.ceil((payload.agg(F.sum("n_docs")).first()[0] or 0) / BUCKET_KEYS))
    keys = payload.select("doc_ids", "null_ids", "part", "shard").mapInArrow(_keys, "doc_id long, part int, shard int, position int, count int")
    keys.withColumn("bucket", _bucket(n)).groupBy("bucket").applyInArrow(_index, _INDEX).withColumn("buckets", F.lit(n)).write.option("compression", "zstd").parquet(f"{path}/index")


_ROW = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _bases(payload: DataFrame) -> DataFrame:
    """(part, base): the ids before each part, summed in two steps, so that no task sees all parts."""
    sizes = payload.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("run", F.floor(F.col("part") / PARTS_AT_ONCE))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = sizes.select("part", "run", before(Window.partitionBy("run").orderBy("part")).alias("inside"))
    whole = sizes.groupBy("run").agg(F.sum("n").alias("n")).select("run", before(Window.orderBy("run")).alias("whole"))
    return inside.join(whole, "run").select("part", (F.col("inside") + F.col("whole")).alias("base"))


def _described(start: int, ids: np.ndarray, opens: np.ndarray, ends: np.ndarray) -> list[np.ndarray | list]:
    """start, n_tokens and ids_crc32 of slices of a shard whose first id is id `start` of all."""
    view = memoryview(ids.astype("<u4")).cast("B")
    crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(opens.tolist(), ends.tolist(), strict=True)]
    return [start + opens, ends - opens, crc]


def read_store(spark: SparkSession, path: str, nulls_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, or of those without an id, by reading all shards that have
    some; `start` counts the ids of all before."""
    payload = spark.read.parquet(f"{path}/payload")
    bases = _bases(payload)
    rows = (payload.where("null_ids > 0") if nulls_only else payload).join(bases, "part")
    rows = rows.select((F.col("base") + F.col("start_in_part")).alias("start"), "width", "null_ids", "doc_ids", "ends", "payload")

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                start, width, nulls, keys, ends, flat = (b.column(c)[k].as_py() for c in range(6))
                keys, ends = np.frombuffer(keys, "<i8"), np.frombuffer(ends, "<i8")
                n = nulls if nulls_only else len(keys)
                got = _described(start, np.frombuffer(flat, f"<u{width}"), np.append(0, ends)[:n], ends[:n])
                yield pa.record_batch([pa.array(keys[:n], mask=np.arange(n) < nulls), *[pa.array(x, pa.int64()) for x in got]], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(mapper, _ROW)


def located(keys: DataFrame, path: str, key_col: str = "doc_id") -> DataFrame:
    """(doc_id, part, shard, position, count) of the given keys through the index: bucket, slot, fingerprint. A key that
    is not stored may come by a fingerprint that agrees by chance; the shard decides."""
    index = keys.sparkSession.read.parquet(f"{path}/index")
    n = (index.select("buckets").first() or [1])[0]
    asked = keys.select(F.col(f"`{key_col}`").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct().withColumn("bucket", _bucket(n))

    def find(key: tuple, want: pa.Table, have: pa.Table) -> pa.Table:
        ids = want.column("doc_id").to_numpy()
        out = {c: np.zeros(0, np.int64) for c in ("doc_id", *_PLACE)}
        if have.num_rows and len(ids):
            r = have.to_pylist()[0]
            slot = slot_of(ids, np.frombuffer(r["seeds"], "<i8"), r["n"])
            hit = np.frombuffer(r["fingerprints"], "<u4")[slot] == _fingerprint(ids)
            heads = np.frombuffer(r["heads"], "<i4").astype(np.int64)
            first, size = heads[slot[hit]], np.diff(heads)[slot[hit]]
            entry = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
            out = {"doc_id": np.repeat(ids[hit], size)} | {c: np.frombuffer(r[f"{c}s"], "<i4")[entry] for c in _PLACE}
        return pa.table({c: pa.array(x, pa.int64() if c == "doc_id" else pa.int32()) for c, x in out.items()})

    return asked.groupBy("bucket").cogroup(index.drop("buckets").groupBy("bucket")).applyInArrow(find, "doc_id long, part int, shard int, position int, count int")


def _at_places(places: DataFrame, payload: DataFrame, make, schema: str) -> DataFrame:
    """Rows that `make` builds from (start, ids, doc_ids, opens, ends) of each shard's slices that are asked for."""

    def cut(key: tuple, want: pa.Table, have: pa.Table) -> pa.Table:
        at, base = np.zeros(0, np.int64), 0
        flat, ends, own = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if have.num_rows and want.num_rows:
            r = have.to_pylist()[0]
            base = want.column("base")[0].as_py() + r["start_in_part"]
            flat, ends, own = np.frombuffer(r["payload"], f"<u{r['width']}"), np.frombuffer(r["ends"], "<i8"), np.frombuffer(r["doc_ids"], "<i8")
            asked, first, n = (want.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "position", "count"))
            at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
            at = at[own[at] == np.repeat(asked, n)]  # the key itself decides
        return make(base, flat, own[at], np.append(0, ends)[at], ends[at])

    return places.groupBy("part", "shard").cogroup(payload.groupBy("part", "shard")).applyInArrow(cut, schema)


def documents_of(keys: DataFrame, path: str, key_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the given keys that are stored, through the index."""
    payload = keys.sparkSession.read.parquet(f"{path}/payload")

    def make(base: int, flat: np.ndarray, own: np.ndarray, opens: np.ndarray, ends: np.ndarray) -> pa.Table:
        return pa.table([pa.array(own), *[pa.array(x, pa.int64()) for x in _described(base, flat, opens, ends)]], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _at_places(located(keys, path, key_col).join(_bases(payload), "part"), payload, make, _ROW)


def lookup(keys: DataFrame, path: str, key_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the given keys that are stored, through the index."""
    payload = keys.sparkSession.read.parquet(f"{path}/payload")

    def make(base: int, flat: np.ndarray, own: np.ndarray, opens: np.ndarray, ends: np.ndarray) -> pa.Table:
        ids = [flat[x:y].tolist() for x, y in zip(opens.tolist(), ends.tolist(), strict=True)]
        return pa.table({"doc_id": pa.array(own), "ids": pa.array(ids, pa.list_(pa.int64()))})

    return _at_places(located(keys, path, key_col).withColumn("base", F.lit(0).cast("bigint")), payload, make, "doc_id long, ids array<long>")
