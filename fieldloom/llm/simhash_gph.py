"""SimHash near-duplicates: fingerprints, and links at a small Hamming distance by the generalised pigeonhole.

With m groups of bits and thresholds t_1..t_m that sum to radius - m + 1 (a threshold of -1 skips its group), two
fingerprints within the radius agree on some group i up to t_i bits. Correlated bits go to the same group, and the
thresholds come from a dynamic program over the candidates that each group would cost, estimated on a bounded sample.
Copies share a fingerprint and are one node, so a group of copies of any size makes no pairs. A bucket with more
fingerprints than `BUCKET` (one large cluster of near copies) makes no pairs either: its members list the 65 values
within one bit of themselves; two fingerprints are at most two bits apart exactly if they share such a value, so
linking every member to the smallest one at the same value loses no link and no value has more than 65 members.

That is one fingerprint of three-word shingles at a fixed radius. Texts of a given similarity are further apart: a share
of 0.8 of all five-word shingles leaves 15 % of the bits different, which no radius over 64 bits tells from chance.
`similar_texts` therefore takes several blocks of 64 bits as one wide fingerprint of the distinct shingles, in groups of
correlated bits again. Each group's threshold (none, equal, one bit) comes from a dynamic program that reaches the
wanted probability of meeting at least once, for a pair just similar enough, at the least estimated number of probes
and candidates. Rows of a bucket are compared by 128 of the bits, which travel with them; what passes is compared by the
whole fingerprint, and pairs that it leaves in doubt are verified by their sets of shingles, unless certain links join
their texts already. A bucket with more than `LINKS` links a member tells only a tree of the shortest, so large clusters make
no pairs. If verification takes such a tree apart, all links of that bucket between its parts are told and verified, so
that no link is lost for a rejected one. A bucket of more than `RUN` rows is dealt by runs of them to several tasks, each
pair of runs once, so that no link between runs is lost and no task holds more than two.

Results for odd input: null or empty text has no words and fingerprint zero, linked like any other; a very long text is
one row of one task; rows repeated with one id are nodes like others; null ids keep their row, with the component of
their fingerprint; of equally small ids the row with the smaller hash stays; an empty table gives an empty result. Other
columns are not looked at.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldloom.llm import text as T
from fieldloom.llm.components import contracted, joined, smallest_reachable
from fieldloom.llm.xxh64 import xxh64
from fieldloom.session import checkpoint_dir

#: Fingerprints of a bucket that are compared pair by pair.
BUCKET = 32
#: Fingerprints that the groups of bits and their thresholds are chosen from.
SAMPLE = 4000
_ALL = (1 << 64) - 1


def _majority(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each of n documents the 64 bits that are set in over half of its values (in order of document)."""
    size = np.bincount(doc, minlength=n)
    opens = np.cumsum(size) - size
    count = np.zeros((n, 64), np.int64)
    if len(values):
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Byte sums of up to 255 rows at once, then sums of these for each text.
        cut = np.unique(np.concatenate([x + opens[size > x] for x in range(0, int(size.max()), 255)]))
        part = np.add.reduceat(bits.view(np.uint64), cut, axis=0).view(np.uint8).reshape(-1, 64)
        owner = doc[cut]
        new = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        count[owner[new]] = np.add.reduceat(part.astype(np.int64), new, axis=0)
    return np.packbits((2 * count > size[:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()


def _shingles(w: T.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, last word) of every shingle; a text of fewer words is one."""
    first, n = w.first, w.counts
    shingles = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    opens = np.append(0, np.cumsum(shingles))
    doc = np.repeat(np.arange(len(n)), shingles)
    at = first[doc] + np.arange(opens[-1]) - opens[doc]
    return doc, at, np.minimum(at + size, first[doc + 1]) - 1


def _fingerprints(texts: pa.Array, size: int) -> np.ndarray:
    out = []
    for i, j in T.slices(texts):
        w = T.words(texts.slice(i, j - i), T.LOWER)
        doc, at, to = _shingles(w, size)
        out.append(_majority(xxh64(w.buf, w.start[at], w.end[to]), doc, j - i))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, fp): a bit is set if it is set in over half the XXH64 values of the text's word shingles."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = _fingerprints(T.as_strings(b.column(2)), size)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "row_key", "fp"])

    docs = T.narrow(docs, (id_col, "doc_id", "bigint"), (text_col, "text", "string"))
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(mapper, "doc_id long, row_key long, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    """A row of zeros and ones for each fingerprint, of one or several 64-bit words."""
    words = fps.reshape(len(fps), -1)
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")


def bit_sets(bits: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of like size; each takes the bits that go with those it has."""
    own = bits - bits.mean(axis=0)
    sd = np.maximum(own.std(axis=0), 1e-9)
    going = np.abs(own.T @ own / max(1, len(own))) / np.outer(sd, sd)
    width, free, out = bits.shape[1], np.ones(bits.shape[1], bool), []
    for size in [width // m + (k < width % m) for k in range(m)]:
        group = [int(np.argmax(free))]
        free[group[0]] = False
        score = going[group[0]].copy()
        while len(group) < size:
            group.append(int(np.argmax(np.where(free, score, -1.0))))
            free[group[-1]] = False
            score += going[group[-1]]
        out.append(sorted(group))
    return out


def bit_groups(fps: np.ndarray, m: int) -> list[int]:
    """Masks of m groups of the 64 bits."""
    return [sum(1 << b for b in g) for g in bit_sets(_bits(fps).astype(float), m)]


def thresholds(fps: np.ndarray, masks: list[int], radius: int, n: int) -> tuple[float, list[int]]:
    """The thresholds of least cost: probes, and candidate pairs as the sample has them, carried on to n fingerprints."""
    pairs = max(1, len(fps) * (len(fps) - 1) // 2)
    cost = []
    for mask in masks:
        own = fps & np.uint64(mask)
        bits, row = bin(mask).count("1"), {-1: 0.0}
        hist = np.zeros(65)
        for k in range(1, len(own)):
            hist += np.bincount(np.bitwise_count(own[k:] ^ own[:-k]), minlength=65)
        probes = 1
        for t in range(radius + 1):
            probes += 0 if t == 0 else int(np.prod([bits - x for x in range(t)]) / np.prod(range(1, t + 1)))
            seen = hist[: t + 1].sum() / pairs
            even = sum(np.prod([bits - x for x in range(y)]) / max(1, np.prod(range(1, y + 1))) for y in range(t + 1)) / 2.0**bits
            row[t] = n * probes + max(seen, even) * n * (n - 1) / 2
        cost.append(row)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for (total, (c, chosen)), (t, x) in itertools.product(best.items(), row.items()):
            if c + x < step.get(total + t, (np.inf, []))[0]:
                step[total + t] = (c + x, [*chosen, t])
        best = step
    return best[radius - len(masks) + 1]


def plan(fps: np.ndarray, n: int, radius: int) -> list[tuple[int, int]]:
    """(mask, threshold) of each group of bits that is probed."""
    found = []
    for m in range(1, radius + 3):
        masks = bit_groups(fps, m)
        found.append((*thresholds(fps, masks, radius, n), masks))
    _, chosen, masks = min(found, key=lambda x: x[0])
    return [(mask, t) for mask, t in zip(masks, chosen, strict=True) if t >= 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(mask: int, t: int) -> list[int]:
    bits = [1 << b for b in range(64) if mask >> b & 1]
    return [_signed(sum(c)) for k in range(t + 1) for c in itertools.combinations(bits, k)]


def links(nodes: DataFrame, groups: list[tuple[int, int]], radius: int) -> DataFrame:
    """(a, b) of distinct fingerprints `fp` that connect all pairs within the radius."""
    own = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, (m, _) in enumerate(groups)])).alias("x")).select("fp", "x.part", "x.key")
    sizes = own.groupBy("part", "key").agg(F.count("*").alias("n"))
    if any(t for _, t in groups):
        sizes = sizes.checkpoint()
    else:
        sizes = sizes.where("n > 1").checkpoint()
    small, large = sizes.where(F.col("n") <= BUCKET), sizes.where(F.col("n") > BUCKET)
    # Probes: the values within a group's threshold of one's own; the value itself is among them.
    flips = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in _flips(m, t)]) for m, t in groups])
    probe = own.select(F.col("fp").alias("a"), "part", F.explode(F.get(flips, F.col("part"))).alias("flip"), F.col("key").alias("own_key"))
    probe = probe.select("a", "part", F.col("own_key").bitwiseXOR(F.col("flip")).alias("key"))
    within = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    kept = own.join(small.select("part", "key"), ["part", "key"]).select("part", "key", F.col("fp").alias("b"))
    pairs = probe.join(kept, ["part", "key"]).where((F.col("a") != F.col("b")) & within)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # Members of large buckets, and whatever probes them.
    near = probe.join(large.select("part", "key"), ["part", "key"]).select(F.col("a").alias("fp")).distinct()
    ball = F.array(*[F.lit(x).cast("bigint") for x in _flips(_ALL, 1)])
    at = near.select("fp", F.explode(ball).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    stars = at.groupBy("value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, row_key, fp, root): 16 hex digits, and the smallest id reachable over links.
    `root` names the component even where all its ids are null; `row_key` is the hash of a row's id and text."""
    if radius != 2:
        raise ValueError("large buckets are linked for a radius of 2")
    checkpoint_dir(docs.sparkSession)
    made = fingerprints(docs, size, id_col, text_col).checkpoint()
    nodes = made.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).checkpoint()
    n = nodes.count()
    sample = T.sampled(nodes.select("fp", F.xxhash64("fp").alias("at")), "at", SAMPLE).select("fp").collect()
    fps = np.array(sorted(r.fp for r in sample), np.int64).view(np.uint64)
    labels = nodes.select("fp", "rep", F.col("fp").alias("root"))
    if n > 1:
        edges = links(nodes, plan(fps, n, radius), radius).checkpoint()
        comp = smallest_reachable(edges, nodes.select(F.col("fp").alias("node"), F.col("rep").alias("label")))
        labels = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", F.when(F.col("node").isNull(), F.col("rep")).otherwise(F.col("label")).alias("rep"), F.coalesce("root", "fp").alias("root")).checkpoint()
    out = made.join(labels, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("rep").alias("component_id"), "row_key", "fp", "root")


def one_of_each(docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without near-duplicates of a kept row: of each component the row with the smallest
    id stays (rows without an id only where none has one; of rows that share the id, the one with the smallest hash)."""
    groups = near_duplicates(docs, size, radius, id_col, text_col)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("best"))
    kept = first.select(F.col("best.row_key").alias("_row_key")).checkpoint()
    own = docs.withColumn("_row_key", F.xxhash64(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`").cast("string")))
    return own.join(kept, "_row_key", "left_semi").dropDuplicates(["_row_key"]).drop("_row_key")


# Texts of a given similarity.

#: 64-bit blocks of a wide fingerprint, fingerprints that its groups of bits are chosen from, and sizes of a group.
BLOCKS = 16
WIDE_SAMPLE = 500
WIDTHS = (14, 16, 18, 20, 24, 28, 32)
#: The probability that a pair which is just similar enough meets in a bucket.
RECALL = 0.99
#: Deviations that a distance may be off before a pair is taken for certain, or given up.
DOUBT = 3.0
#: Pairs of a bucket that are compared at once; members of a bucket, and links a member, up to which all links are told.
AT_ONCE, FEW, LINKS = 1 << 18, 8, 4
#: Rows of a bucket that one task compares with each other; larger ones are dealt by pairs of runs.
RUN = 20_000
#: 64-bit words of the fingerprint that travel with the rows of a bucket.
SKETCH = 2
#: Rows of 16 bytes that are broadcast after a count.
SMALL_ROWS = 300_000


def differing(share: float) -> float:
    """The share of bits that differ between the fingerprints of two sets with this Jaccard similarity."""
    return math.acos(2 * share / (1 + share)) / math.pi


def _limit(share: float, bits: int, deviations: float) -> int:
    p = differing(share)
    return int(p * bits + deviations * math.sqrt(bits * p * (1 - p)))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, shingles, document): the distinct shingles of texts i to j, in order of document and shingle."""
    for i, j in T.slices(texts):
        w = T.words(texts.slice(i, j - i), T.LOWER)
        doc, at, to = _shingles(w, size)
        made = T.runs(T.prints(w), tuple(range(1, size + 1)))
        prints = np.zeros(len(at), np.uint64)
        for k in range(1, size + 1):
            some = to - at == k - 1
            prints[some] = made[k][at[some]]
        order = np.lexsort((prints, doc))
        prints, doc = prints[order], doc[order]
        new = np.ones(len(prints), bool)
        new[1:] = (prints[1:] != prints[:-1]) | (doc[1:] != doc[:-1])
        yield i, j, prints[new], doc[new]


def wide_fingerprints(docs: DataFrame, size: int, blocks: int) -> DataFrame:
    """(doc_id, row_key, fp) of rows (doc_id, row_key, text): `blocks` words of 64 bits, each by a hash of its own."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.fresh()
        for b in batches:
            for i, j, prints, doc in shingle_sets(T.as_strings(b.column(2)), size):
                words = np.stack([_majority(T.joined(prints, np.full(len(prints), k, np.uint64), k), doc, j - i) for k in range(blocks)], axis=1)
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * blocks), j - i, [None, pa.py_buffer(np.ascontiguousarray(words))])
                yield pa.record_batch([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), flat.cast(pa.binary())], names=["doc_id", "row_key", "fp"])

    return docs.mapInArrow(mapper, "doc_id long, row_key long, fp binary")


def wide_plan(bits: np.ndarray, n: int, share: float, recall: float = RECALL) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the groups that are probed: the cheapest that give the recall, over groups of several widths.

    A group that a pair meets in with probability q adds -log(1 - q) to what the recall needs; its cost is its probes and
    the candidates that the sample shows for it, carried on to n fingerprints.
    """
    p, unit = differing(share), 0.005
    need = math.ceil(-math.log(1 - recall) / unit)
    pairs = max(1, len(bits) * (len(bits) - 1) // 2)
    found: list[tuple[float, list[tuple[list[int], int]]]] = []
    for width in WIDTHS:
        groups = bit_sets(bits.astype(np.float32), max(1, bits.shape[1] // width))
        best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for g in groups:
            own = bits[:, g].astype(np.uint64) @ (np.uint64(1) << np.arange(len(g), dtype=np.uint64))
            near = np.zeros(3)
            for k in range(1, len(own)):
                near += np.bincount(np.minimum(np.bitwise_count(own[k:] ^ own[:-k]), 2), minlength=3)
            step = dict(best)
            for t in (0, 1):
                probes = 1 + t * len(g)
                even = (1 + t * len(g)) / 2.0 ** len(g)
                cost = 8.0 * n * probes + max(near[: t + 1].sum() / pairs, even) * n * (n - 1) / 2
                q = (1 - p) ** len(g) + t * len(g) * p * (1 - p) ** (len(g) - 1)
                gain = int(-math.log(1 - q) / unit)
                for have, (c, chosen) in best.items():
                    to = min(need, have + gain)
                    if gain and c + cost < step.get(to, (math.inf, ()))[0]:
                        step[to] = (c + cost, (chosen, (g, t)))
            best = step
        if need in best:
            cost, chosen = best[need]
            groups = []
            while chosen:
                chosen, last = chosen
                groups.append(last)
            found.append((cost, groups))
    if not found:
        raise ValueError("no groups of so few bits reach the recall")
    return min(found, key=lambda x: x[0])[1]


_PROBE = ["bucket", "own", "node", *(f"s{k}" for k in range(SKETCH))]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of sketches, over the last axis."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _sketches(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(c).to_numpy().view(np.uint64) for c in _PROBE[3:]], axis=1)


def _key_rows(groups: list[tuple[list[int], int]]):
    """Arrow mapper: (node, fp) to (bucket, own, node, s0, s1), a row for each group and each value it probes."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                node = b.column(0).slice(i, 2000).to_numpy()
                words = np.frombuffer(b"".join(b.column(1).slice(i, 2000).to_pylist()), np.uint64).reshape(len(node), -1)
                bits, sketch = _bits(words), [pa.array(np.ascontiguousarray(words[:, k - SKETCH]).view(np.int64)) for k in range(SKETCH)]
                for k, (g, t) in enumerate(groups):
                    value = bits[:, g].astype(np.int64) @ (np.int64(1) << np.arange(len(g)))
                    for flip in [0, *(1 << x for x in range(t * len(g)))]:
                        bucket = np.int64(k) << 40 | value ^ flip
                        yield pa.record_batch([pa.array(bucket), pa.array(np.full(len(node), flip == 0)), pa.array(node), *sketch], names=_PROBE)

    return mapper


def _tree(node: np.ndarray, own: np.ndarray, sketch: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shortest links that connect what all links within the limit connect. The tree grows by the nearest
    member outside, so the memory is that of the members; ties go to the smaller node, so that buckets which hold the same
    members tell the same links."""
    m, far = len(node), 1 << 20
    near, by, out = np.full(m, far, np.int64), np.zeros(m, np.int64), np.ones(m, bool)
    a, b = [], []
    rank = np.empty(m, np.int64)
    rank[np.argsort(node, kind="stable")] = np.arange(m)
    order = np.argsort(rank)
    at = int(order[0])
    seen = 0
    for _ in range(m):
        out[at] = False
        apart = _apart(sketch, sketch[at])
        ok = out & (apart <= limit) & (own | own[at]) & (node != node[at])
        new = ok & ((apart < near) | (apart == near) & (rank[at] < rank[by]))
        near[new], by[new] = apart[new], at
        if not out.any():
            break
        nearest = np.where(out, near, far)
        least = int(nearest.min())
        if least < far:
            tied = np.flatnonzero(nearest == least)
            at = int(tied[np.argmin(rank[tied])])
            a.append(at)
            b.append(int(by[at]))
        else:  # nothing outside is near: a new tree from the smallest member that is left
            while not out[order[seen]]:
                seen += 1
            at = int(order[seen])
    return np.array(a, np.int64), np.array(b, np.int64)


def _links_of(node: np.ndarray, own: np.ndarray, sketch: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Links of one large bucket, and whether some were left out: all of them while there are up to `LINKS` a member, else
    a tree of the shortest."""
    m, told = len(node), []
    step, count = max(1, AT_ONCE // m), 0
    for i in range(0, m, step):
        rows = np.arange(i, min(i + step, m))
        cols = np.arange(rows[-1])
        apart = _apart(sketch[rows][:, None], sketch[cols][None, :])
        x, y = np.nonzero((apart <= limit) & (cols[None, :] < rows[:, None]) & (own[rows][:, None] | own[cols][None, :]) & (node[rows][:, None] != node[cols][None, :]))
        told.append((rows[x], cols[y]))
        count += len(x)
        if count > LINKS * m:
            x, y = _tree(node, own, sketch, limit)
            return node[x], node[y], True
    x, y = (np.concatenate(z) for z in zip(*told, strict=True))
    return node[x], node[y], False


def _bucket_links(limit: int, most: int | None):
    """Arrow mapper over rows sorted by bucket: (a, b, thinned) of members whose sketches are near; two visitors are no
    pair. `thinned` is the bucket if it left links out, else null. A bucket of more than `most` rows is not held: it tells
    only (null, rows, bucket)."""

    def small(cut: np.ndarray, size: np.ndarray, own: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ahead = np.repeat(np.cumsum(size), size) - np.arange(size.sum()) - 1
        at = np.repeat(cut - (np.cumsum(size) - size), size) + np.arange(size.sum())
        a = np.repeat(np.arange(len(at)), ahead)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
        a, b = at[a], at[b]
        near = (_apart(sketch[a], sketch[b]) <= limit) & (own[a] | own[b]) & (node[a] != node[b])
        return node[a[near]], node[b[near]]

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.fresh()
        held: list[tuple[np.ndarray, ...]] = []
        large: list[int] = []  # an open bucket of too many rows, and its rows so far

        def links(last: bool) -> Iterator[pa.RecordBatch]:
            bucket, own, node, sketch = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            size = np.diff(np.append(cut, len(bucket)))
            done = len(cut) if last else len(cut) - 1  # the last bucket may go on
            held.clear()
            if not last:
                held.append((bucket[cut[-1] :], own[cut[-1] :], node[cut[-1] :], sketch[cut[-1] :]))
            few = np.flatnonzero((size[:done] > 1) & (size[:done] <= FEW))
            for i in range(0, len(few), AT_ONCE // FEW**2 * 2):
                some = few[i : i + AT_ONCE // FEW**2 * 2]
                yield _pairs(*small(cut[some], size[some], own, node, sketch))
            for k in np.flatnonzero(size[:done] > FEW).tolist():
                x, y = cut[k], cut[k] + size[k]
                if most and size[k] > most:
                    yield _large(int(bucket[x]), int(size[k]))
                    continue
                a, b, thinned = _links_of(node[x:y], own[x:y], sketch[x:y], limit)
                yield _pairs(a, b, int(bucket[x]) if thinned else None)

        for b in batches:
            if not b.num_rows:
                continue
            if large:
                same = int(np.searchsorted(b.column(0).to_numpy(), large[0], "right"))
                large[1] += same
                b = b.slice(same)
                if not b.num_rows:
                    continue
                yield _large(*large)
                large.clear()
            held.append((*(b.column(c).to_numpy(zero_copy_only=False) for c in range(3)), _sketches(b)))
            if sum(len(x[0]) for x in held) >= 200_000:
                yield from links(False)
                if held and most and len(held[0][0]) > most:
                    large[:] = [int(held[0][0][0]), len(held[0][0])]
                    held.clear()
        if large:
            yield _large(*large)
        if held:
            yield from links(True)

    return mapper


def _pairs(a: np.ndarray, b: np.ndarray, thinned: int | None = None) -> pa.RecordBatch:
    of = pa.nulls(len(a), pa.int64()) if thinned is None else pa.array(np.full(len(a), thinned))
    return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), of], names=["a", "b", "thinned"])


def _large(bucket: int, rows: int) -> pa.RecordBatch:
    return pa.record_batch([pa.nulls(1, pa.int64()), pa.array([rows]), pa.array([bucket])], names=["a", "b", "thinned"])


def _probes(nodes: DataFrame, groups: list[tuple[list[int], int]]) -> DataFrame:
    """(bucket, own, node, s0, s1) of nodes (node, fp)."""
    return nodes.select("node", "fp").mapInArrow(_key_rows(groups), ", ".join(f"{c} {'boolean' if c == 'own' else 'long'}" for c in _PROBE))


def _dealt(rows: DataFrame, large: DataFrame) -> DataFrame:
    """The rows of the buckets in `large` (bucket, runs), in new buckets: one for each two runs of one, with negative numbers."""
    run = F.pmod(F.xxhash64("node"), F.col("runs"))
    own = rows.join(large, "bucket").withColumn("_run", run).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("runs") - 1))).where("_run <> _other")
    block = F.xxhash64("bucket", F.least("_run", "_other"), F.greatest("_run", "_other")).bitwiseOR(F.lit(-(1 << 63)))
    return own.withColumn("bucket", block).select(*_PROBE)


def meetings(nodes: DataFrame, groups: list[tuple[list[int], int]], share: float) -> tuple[DataFrame, DataFrame | None]:
    """(a, b, thinned) of nodes (node, fp) that meet in a bucket with near sketches, once a pair; `thinned` lists the
    buckets that told the pair and left others out (at most one a probe of a node). With it (bucket, runs) of the buckets that
    were dealt, none if no bucket was too large."""
    limit, kinds = _limit(share, 64 * SKETCH, DOUBT), "a long, b long, thinned long"
    order = lambda rows: rows.repartition("bucket").sortWithinPartitions("bucket", "s0", "node")
    rows = _probes(nodes, groups)
    told = order(rows).mapInArrow(_bucket_links(limit, RUN), kinds).checkpoint()
    large = told.where("a is null").select(F.col("thinned").alias("bucket"), F.ceil(F.col("b") * 2 / RUN).alias("runs")).checkpoint()
    if large.isEmpty():
        large = None
    else:
        told = told.where("a is not null").unionByName(order(_dealt(rows, large)).mapInArrow(_bucket_links(limit, None), kinds))
    return told.groupBy("a", "b").agg(F.collect_set("thinned").alias("thinned")), large


def compared(met: DataFrame, nodes: DataFrame, share: float) -> DataFrame:
    """(a, b, apart) of the pairs (a, b) of nodes (node, fp) whose whole fingerprints are near enough."""
    far = met.join(nodes.select(F.col("node").alias("a"), F.col("fp").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("fp").alias("y")), "b")

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in (2, 3))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(apart)], names=["a", "b", "apart"]).filter(pa.array(apart <= _limit(share, 64 * x.shape[1], DOUBT)))

    return far.select("a", "b", "x", "y").mapInArrow(mapper, "a long, b long, apart long")


def left_out(torn: DataFrame, roots: DataFrame, nodes: DataFrame, groups: list[tuple[list[int], int]], share: float, large: DataFrame | None = None) -> DataFrame:
    """(a, b, apart) of the members of the buckets in `torn` whose whole fingerprints are near enough and whose roots
    (node, root) differ. Few buckets are, so here the fingerprints go to the buckets."""
    limit = _limit(share, 64 * SKETCH, DOUBT)
    rows = _probes(nodes, groups)
    rows = rows if large is None else rows.unionByName(_dealt(rows, large))
    rows = rows.join(torn, "bucket", "left_semi").join(nodes.select("node", "fp"), "node").join(roots, "node", "left").select(*_PROBE, F.coalesce("root", "node").alias("root"), "fp")

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links() -> Iterator[pa.RecordBatch]:
            _, own, node, root, sketch, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            step = max(1, AT_ONCE // len(node))
            for i in range(0, len(node), step):
                rows = np.arange(i, min(i + step, len(node)))
                cols = np.arange(rows[-1])
                near = _apart(sketch[rows][:, None], sketch[cols][None, :]) <= limit
                x, y = np.nonzero(near & (cols[None, :] < rows[:, None]) & (own[rows][:, None] | own[cols][None, :]) & (root[rows][:, None] != root[cols][None, :]))
                x, y = rows[x], cols[y]
                apart = _apart(fp[x], fp[y])
                ok = apart <= _limit(share, 64 * fp.shape[1], DOUBT)
                found = _pairs(node[x[ok]], node[y[ok]])
                yield pa.record_batch([found.column(0), found.column(1), pa.array(apart[ok])], names=["a", "b", "apart"])

        for b in batches:
            if not b.num_rows:
                continue
            fps = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint64).reshape(b.num_rows, -1)
            columns = (*(b.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "own", "node", "root")), _sketches(b), fps)
            cut = [0, *(np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1).tolist(), b.num_rows]
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                if held and held[0][0][0] != columns[0][x]:
                    yield from links()
                    held.clear()
                held.append(tuple(c[x:y] for c in columns))
        if held:
            yield from links()

    return rows.repartition("bucket").sortWithinPartitions("bucket", "s0", "node").mapInArrow(mapper, "a long, b long, apart long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, size: int, share: float) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) have a Jaccard of `share` or more."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        return [x for i, j, prints, doc in shingle_sets(T.as_strings(column), size) for x in np.split(prints, np.cumsum(np.bincount(doc, minlength=j - i))[:-1])]

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x, y = sets(part.column(2)), sets(part.column(3))
                both = np.array([len(np.intersect1d(u, v, assume_unique=True)) for u, v in zip(x, y, strict=True)])
                every = np.array([len(u) + len(v) for u, v in zip(x, y, strict=True)]) - both
                yield part.select([0, 1]).filter(pa.array(both >= share * every - 1e-9))

    own, other = texts.select(F.col("node").alias("a"), F.col("text").alias("x")), texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(own, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(mapper, "a long, b long")


def _small(keys: DataFrame) -> DataFrame:
    """Broadcast if a count finds few rows."""
    return F.broadcast(keys) if keys.count() <= SMALL_ROWS else keys


def between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of pairs (a, b, …) whose ends are in different components (node, root)."""
    side = lambda x: comp.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    of = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return of.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).drop("ra", "rb")


def _confirmed(left: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, share: float) -> DataFrame:
    """The pairs (a, b) of `left` that the texts of the nodes confirm."""
    asked = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    wanted = nodes.join(asked, "node", "left_semi").select("node", F.col("best.row_key").alias("row_key")).checkpoint()
    read = texts.join(_small(wanted), "row_key").select("node", "text").dropDuplicates(["node"]).checkpoint()
    return verified(left, read, size, share)


def similar_texts(docs: DataFrame, size: int = 5, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, row_key, component_id, root): texts whose distinct shingles of `size` words have a Jaccard of `share` or
    more are linked; `component_id` is the smallest id reachable, `root` names the component even where it has none."""
    if not 0 < share <= 1:
        raise ValueError("share is above 0 and at most 1")
    checkpoint_dir(docs.sparkSession)
    texts = T.narrow(docs, (id_col, "doc_id", "bigint"), (text_col, "text", "string")).select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    made = wide_fingerprints(texts, size, blocks).checkpoint()
    nodes = made.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("best"))
    nodes = nodes.select("fp", "best", F.monotonically_increasing_id().alias("node")).checkpoint()
    n = nodes.count()
    labels = nodes.select("node", F.col("best.doc_id").alias("label"))
    named = labels.select("node", "label", F.col("node").alias("root"))
    if n > 1:
        some = T.sampled(nodes.select("fp", F.xxhash64("fp").alias("at")), "at", WIDE_SAMPLE).collect()
        bits = _bits(np.frombuffer(b"".join(r.fp for r in sorted(some, key=lambda r: (r["at"], bytes(r.fp)))), np.uint64).reshape(len(some), -1))
        groups = wide_plan(bits, n, share)
        del some, bits
        T.fresh()
        met, large = meetings(nodes, groups, share)
        met = met.checkpoint()
        near = compared(met.select("a", "b"), nodes, share).checkpoint()
        sure = F.col("apart") <= _limit(share, 64 * blocks, -DOUBT)
        comp = contracted(near.where(sure).select("a", "b"))
        # Links in doubt are verified by the texts, unless certain ones already join their ends.
        left = between(near.where(~sure).select("a", "b"), comp).checkpoint()
        if not left.isEmpty():
            comp = joined(comp, _confirmed(left, nodes, texts, size, share).checkpoint())
        # A bucket that told a tree lost no link as long as the tree's ends are together; where they are not, it tells all
        # links between the parts.
        torn = between(met.where(F.size("thinned") > 0), comp).select(F.explode("thinned").alias("bucket")).distinct().checkpoint()
        if not torn.isEmpty():
            again = left_out(torn, comp, nodes, groups, share, large).checkpoint()
            more = again.where(sure).select("a", "b").unionByName(_confirmed(again.where(~sure).select("a", "b"), nodes, texts, size, share)).checkpoint()
            if not more.isEmpty():
                comp = joined(comp, more)
        every = labels.join(comp, "node", "left").select("node", "label", F.coalesce("root", "node").alias("root")).checkpoint()
        named = every.groupBy("root").agg(F.min(F.struct(F.col("label").isNull().alias("none"), "label")).alias("best"))
        named = every.join(named, "root").select("node", F.col("best.label").alias("label"), "root")
    of = nodes.join(named, "node").select("fp", F.col("label").alias("component_id"), "root")
    return made.join(of, "fp").select("doc_id", "row_key", "component_id", "root")


def one_of_similar(docs: DataFrame, size: int = 5, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """The rows of docs, all columns, one of each group of similar texts: the row with the smallest id stays (rows without
    an id only where none has one; of rows that share the id, the one with the smallest hash)."""
    groups = similar_texts(docs, size, share, id_col, text_col, blocks)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("best"))
    # Most rows stay, so those that go are what is sent. Only rows that share id and text are dealt by key to keep one of
    # them; all others stay where they are.
    own_key = groups.groupBy("row_key", "root").agg(F.count("*").alias("times")).join(first.select("root", F.col("best.row_key").alias("kept")), "root")
    moved = own_key.where("row_key <> kept or times > 1").select(F.col("row_key").alias("_row_key"), (F.col("row_key") == F.col("kept")).alias("again")).checkpoint()
    own = docs.withColumn("_row_key", F.xxhash64(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`").cast("string")))
    once = own.join(_small(moved.select("_row_key")), "_row_key", "left_anti")
    repeated = own.join(_small(moved.where("again").select("_row_key")), "_row_key", "left_semi").dropDuplicates(["_row_key"])
    return once.unionByName(repeated).drop("_row_key")
