"""Toxicity by logistic regression over hashed word n-grams and skip-grams, learned with FTRL-proximal.

Features of a text are the presence of its words, the first bytes of its words (for word families), word pairs and
pairs with one or two words skipped, hashed to `1 << BITS` places. FTRL-proximal keeps a learning rate for every
coordinate and an L1 term that leaves most weights at exactly zero, so what is broadcast is the nonzero weights:
a list of at most `1 << BITS` places, in practice some thousands.

The model is fitted on at most `TRAIN_ROWS` labelled ids, chosen by a hash; all rows are scored. Results for odd input:
null or empty text: the score of a text without features. A very long text is scored as a whole, by one task. Rows
repeated with one id get a row each, and one of them (with the smallest text hash) is learned from; an id labelled both
ways counts as toxic; a score of exactly one half is toxic; null ids are never labelled nor held out. Without a labelled row no feature has
a weight and all scores are that of the first bias, below 0.5. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.llm import text as T

BITS = 20
#: The most labelled rows that a model is fitted on: the bound on what the driver holds.
TRAIN_ROWS = 6000
EPOCHS = 6
_SALT = [np.uint64(x) for x in np.random.default_rng(5).integers(1, 1 << 63, 8) * 2 + 1]


def _features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, place) arrays, one pair for each kind of feature."""
    w = T.words(texts, T.PLAIN)
    n, doc = len(w.start), w.doc()
    if not n:
        return
    one = T.spans(w.buf, w.start, w.end)
    place = lambda x: (T.mixed(x) >> np.uint64(64 - BITS)).astype(np.int32)
    yield doc, place(one)
    for k, size in enumerate((3, 4, 5)):
        long = np.flatnonzero(w.end - w.start > size)
        yield doc[long], place(T.spans(w.buf, w.start[long], w.start[long] + size) * _SALT[k])
    for k, gap in enumerate((1, 2, 3)):
        if n > gap:
            same = np.flatnonzero(doc[gap:] == doc[:-gap])
            yield doc[same], place(one[same] * _SALT[3 + k] + one[same + gap])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, text) to (label, places)."""
    for b in batches:
        texts = T.as_strings(b.column(1))
        for i, j in T.slices(texts):
            found = list(_features(texts.slice(i, j - i)))
            key = np.unique(np.concatenate([d.astype(np.int64) << BITS | p for d, p in found])) if found else np.zeros(0, np.int64)
            off = np.searchsorted(key >> BITS, np.arange(j - i + 1)).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(off), pa.array((key & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.record_batch([b.column(0).slice(i, j - i), places], names=["label", "places"])


@dataclass
class Weights:
    """Nonzero weights by place, and the bias."""

    place: np.ndarray
    weight: np.ndarray
    bias: float


def fit(rows: list[tuple[int, np.ndarray]], alpha: float = 1.0, beta: float = 1.0, l1: float = 2.5, l2: float = 0.0, epochs: int = EPOCHS) -> Weights:
    """FTRL-proximal over the rows in the order given, again and again."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = -1.0, 0.0
    for _ in range(epochs):
        for label, x in rows:
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2))
            g = 1.0 / (1.0 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - label
            more = nx + g * g
            z[x] = zx + g - (np.sqrt(more) - np.sqrt(nx)) / alpha * w
            n[x] = more
            bias_n += g * g
            bias -= alpha * g / (beta + np.sqrt(bias_n))
    at = np.flatnonzero(np.abs(z) > l1)
    w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
    return Weights(at.astype(np.int32), w.astype(np.float32), bias)


def score(texts: pa.Array, model: Weights) -> np.ndarray:
    table = np.zeros(1 << BITS, np.float32)
    table[model.place] = model.weight
    used = table != 0
    out = []
    for i, j in T.slices(texts):
        keys = [np.zeros(0, np.int64)]
        for doc, place in _features(texts.slice(i, j - i)):
            hit = np.flatnonzero(used[place])
            keys.append(doc[hit].astype(np.int64) << BITS | place[hit])
        key = np.unique(np.concatenate(keys))
        total = np.bincount(key >> BITS, table[key & ((1 << BITS) - 1)], minlength=j - i)
        out.append(1.0 / (1.0 + np.exp(-np.clip(total + model.bias, -35, 35))))
    return np.concatenate(out) if out else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    """Every fifth id by its crc32; never trained on."""
    return F.coalesce(F.pmod(T.crc_of(doc_id), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Weights:
    """A model of the labelled rows that are not held out, at most `rows` of them."""
    known = T.narrow(labels, (id_col, "doc_id", "bigint"), (label_col, "label", "int")).where("doc_id is not null and label is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = T.sampled(known.withColumn("at", F.xxhash64("doc_id")), "at", rows).select("doc_id", "label")  # at most `rows` of 16 bytes: broadcast below
    docs = T.narrow(docs, (id_col, "doc_id", "bigint"), (text_col, "text", "string"))
    found = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    made = found.select("label", "text").mapInArrow(_hashed, "label int, places array<int>").toArrow()
    own = [(int(y), x.values.to_numpy()) for y, x in zip(made.column("label").to_pylist(), made.column("places"), strict=True)]
    own.sort(key=lambda r: (zlib.crc32(r[1].tobytes()), r[0]))  # an order that no partitioning changes
    model = fit(own)
    del made, own
    T.fresh()
    return model


def score_toxicity(docs: DataFrame, model: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score(T.as_strings(b.column(2)), shared.value)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    docs = T.narrow(docs, (id_col, "doc_id", "bigint"), (text_col, "text", "string"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(mapper, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Weights, text_col: str = "text") -> DataFrame:
    """The rows, all columns, whose score is below one half."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return T.rows_kept(docs, text_col, lambda: lambda texts: score(texts, shared.value) < 0.5)
