"""Ranked lexical search: the best documents of each item, with posting lists blocked by document similarity.

A pass over the texts makes a forward index: of each document its number of terms and those that items ask for. Counts by
term and the totals come from it, then a second pass ranks. There each task cuts its documents into shards; in a shard every
posting list is clustered by the likeness of its documents (random pivots of the list, nearest by a sketch of the weighted
terms), and each block keeps the largest impact of any of its documents in each coordinate, of those that the queries that
read the list can ask for. A document's score is no larger than its block's summary gives, so a block is passed over only if
that bound is below the score that an item's tenth document has so far; lists whose terms together can't reach it are not
opened. Documents of the other blocks are scored in whole numbers. Each task gives at most ten rows an item, which meet in
two steps. First scores come from about `PROBED` documents, chosen by a hash: any documents give a lower bound, so they
change no result.

Items are taken `ITEMS` a pass, so what is sent to all tasks is bounded by that many items' terms, whatever their number.

Results for odd input: null and empty texts and texts without a term rank nowhere and count for nothing; items without a
term, or none of whose terms occurs, give no row. Rows of one item id are one item with the terms of all; a null id is an
item. Repeated document ids are documents of their own, each with its rank; equal scores go by ascending id, null ids last.
Empty tables give an empty result. Very long texts are indexed whole. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from fieldloom.llm import text as T
from fieldloom.operators.tables import numbered
from fieldloom.session import checkpoint_dir

#: Items of one pass over the documents.
ITEMS = 2_000
#: Documents that give the first bounds.
PROBED = 8_192
#: Cells (documents by terms) of a shard.
CELLS = 1 << 24
#: Documents of a block, about.
BLOCK = 16
SKETCH = 16

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, terms, at): each item's different terms, items numbered from 0."""
    d = T.narrow(items, (id_col, "item_id", dict(items.dtypes)[id_col]), (text_col, "text", "string"))
    terms = F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit(TERM), F.lit(0))
    per = d.select("item_id", F.explode(terms).alias("term")).distinct().groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    return numbered(per, ["item_id"], "at")


@dataclass
class Items:
    """Items of one pass: ids, the terms they ask for, and for each item which of them."""

    ids: list
    terms: list[str]
    asks: list[np.ndarray]

    @classmethod
    def of(cls, rows: list) -> Items:
        terms = sorted({t for r in rows for t in r.terms})
        place = {t: k for k, t in enumerate(terms)}
        return cls([r.item_id for r in rows], terms, [np.array([place[t] for t in r.terms], np.int64) for r in rows])


def forward(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts) of documents with a term: how many they have, and the places and counts of the asked ones."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.fresh()
        asked = pa.array([t.encode() for t in terms], pa.large_binary())
        for b in batches:
            texts = T.as_strings(b.column(1))
            for i, j in T.slices(texts):
                w = T.words(texts.slice(i, j - i), T.PLAIN)
                number, distinct = T.word_numbers(w)
                place = pc.fill_null(pc.index_in(distinct, value_set=asked), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                place = place[number]
                hit = place >= 0
                key, count = np.unique(w.doc()[hit] * len(terms) + place[hit], return_counts=True)
                own = np.flatnonzero(w.counts)
                ends = np.searchsorted(key, (np.arange(j - i) + 1) * len(terms))
                off = pa.array(np.append(0, ends[own]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32))) for x in (key % max(1, len(terms)), count)]
                yield pa.record_batch([b.column(0).slice(i, j - i).take(pa.array(own)), pa.array(w.counts[own].astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])

    docs = T.narrow(docs, (id_col, "doc_id", "bigint"), (text_col, "text", "string"))
    return docs.mapInArrow(mapper, "doc_id long, n long, terms array<int>, counts array<int>")


@dataclass
class Statistics:
    """Documents with a term, all their terms, and each asked term's weight."""

    documents: int
    length: int
    weights: np.ndarray

    @classmethod
    def of(cls, index: DataFrame, n_terms: int) -> Statistics:
        total = index.agg(F.count("*").alias("d"), F.sum("n").alias("l")).first()
        df = dict(index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect())  # the items' terms at most
        n = total.d
        return cls(n, total.l or 0, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) if t in df else 0 for t in range(n_terms)], np.int64))

    def impacts(self, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of terms that occur `counts` times in documents of n terms; the product of n and all documents may be large."""
        lengths, at = np.unique(n, return_inverse=True)
        norm = np.array([10 + 90 * int(x) * self.documents // self.length for x in lengths], np.int64)[at]
        return 1_000_000_000 * counts // (1000 * counts + 8 * norm)


class Best:
    """The best k documents of each item so far, and the score that another one needs."""

    def __init__(self, k: int, needs: np.ndarray):
        self.k, self.needs = k, needs.copy()
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(needs)

    def add(self, item: int, score: np.ndarray, none: np.ndarray, doc_id: np.ndarray) -> None:
        s, m, d = (np.concatenate(x) for x in zip(self.rows[item], (score, none, doc_id), strict=True))
        first = np.lexsort((d, m, -s))[: self.k]
        self.rows[item] = s[first], m[first], d[first]
        if len(first) == self.k:
            self.needs[item] = max(self.needs[item], s[first[-1]])


def blocks(sketch: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A posting list's documents ordered by block, and where blocks begin: each goes to the pivot that is most like it."""
    if len(members) <= BLOCK:
        return members, np.zeros(1, np.int64)
    nearest = (sketch[members] @ sketch[members[::BLOCK]].T).argmax(axis=1)
    order = np.argsort(nearest, kind="stable")
    nearest = nearest[order]
    return members[order], np.flatnonzero(np.append(True, nearest[1:] != nearest[:-1]))


def rank_shard(cells: np.ndarray, doc_id: np.ndarray, none: np.ndarray, items: Items, weights: np.ndarray, mix: np.ndarray, best: Best) -> None:
    """Adds a shard's documents to the best ones. cells: impacts by document and term."""
    top = cells.max(axis=0, initial=0).astype(np.float64) * weights
    readers: dict[int, list[int]] = {}
    for q, asks in enumerate(items.asks):
        order = asks[np.argsort(top[asks], kind="stable")]
        for t in order[np.cumsum(top[order]) >= best.needs[q]].tolist():  # the others can't reach it together
            readers.setdefault(t, []).append(q)
    sketch = cells @ mix
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
    found: dict[int, list[np.ndarray]] = {}
    for t, queries in readers.items():
        members = np.flatnonzero(cells[:, t])
        members, begin = blocks(sketch, members)
        columns = np.unique(np.concatenate([items.asks[q] for q in queries]))
        summary = np.maximum.reduceat(cells[np.ix_(members, columns)], begin, axis=0).astype(np.float64)
        want = np.zeros((len(columns), len(queries)))
        for k, q in enumerate(queries):
            at = np.searchsorted(columns, items.asks[q])
            want[at, k] = weights[items.asks[q]]
        opens = summary @ want * (1 + 1e-9) >= best.needs[queries]
        size = np.diff(np.append(begin, len(members)))
        for k in np.flatnonzero(opens.any(axis=0)).tolist():
            found.setdefault(queries[k], []).append(members[np.repeat(opens[:, k], size)])
    for q, lists in found.items():
        docs = np.unique(np.concatenate(lists))
        score = cells[np.ix_(docs, items.asks[q])].astype(np.int64) @ weights[items.asks[q]]
        fits = score >= best.needs[q]
        best.add(q, score[fits], none[docs[fits]], doc_id[docs[fits]])


def ranked(index: DataFrame, items: Items, stats: Statistics, k: int, needs: np.ndarray, id_kind: str) -> DataFrame:
    """(at, item_id, doc_id, score): each task's best k documents of each item."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.fresh()
        best = Best(k, needs)
        most = max(16, CELLS // max(1, len(items.terms)))
        mix = np.random.default_rng(11).standard_normal((len(items.terms), SKETCH)).astype(np.float32) * stats.weights[:, None].astype(np.float32)

        def shard(parts: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(parts).combine_chunks()
            ids, terms, counts = (t.column(c).combine_chunks() for c in ("doc_id", "terms", "counts"))
            size = pc.list_value_length(terms).to_numpy()
            doc = np.repeat(np.arange(len(ids)), size)
            cells = np.zeros((len(ids), len(items.terms)), np.float32)  # impacts are below 10^6
            cells[doc, terms.flatten().to_numpy()] = stats.impacts(t.column("n").to_numpy()[doc], counts.flatten().to_numpy().astype(np.int64))
            rank_shard(cells, pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), items, stats.weights, mix, best)

        waiting, n = [], 0
        for b in batches:
            for i in range(0, b.num_rows, most):
                part = b.slice(i, most)
                if n + part.num_rows > most:
                    shard(waiting)
                    waiting, n = [], 0
                waiting.append(part)
                n += part.num_rows
        if n:
            shard(waiting)
        at = np.repeat(np.arange(len(items.ids)), [len(r[0]) for r in best.rows])
        if len(at):
            score, none, doc = (np.concatenate([r[i] for r in best.rows]) for i in range(3))
            ids = pa.array([items.ids[x] for x in at.tolist()])
            yield pa.record_batch([pa.array(at.astype(np.int64)), ids if not pa.types.is_null(ids.type) else ids.cast(pa.int64()), pa.array(doc, mask=none), pa.array(score)], names=["at", "item_id", "doc_id", "score"])

    return index.mapInArrow(mapper, f"at long, item_id {id_kind}, doc_id long, score long")


def best_of(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, with their rank; first among those that share a part of the ids' hash, then of all."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("at", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 of each item."""
    checkpoint_dir(docs.sparkSession)
    kind = dict(items.dtypes)[item_col]
    asked = item_terms(items, item_col, item_text_col).checkpoint()
    out = None
    for first in range(0, max(1, asked.count()), ITEMS):
        own = Items.of(asked.where((F.col("at") >= first) & (F.col("at") < first + ITEMS)).orderBy("at").collect())
        index = forward(docs, own.terms, id_col, text_col).checkpoint()
        stats = Statistics.of(index, len(own.terms))
        index = index.where(F.size("terms") > 0)
        needs = np.ones(len(own.ids), np.int64)
        share = min(1.0, PROBED / max(1, stats.documents))
        probe = index.where(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(1 << 20)) < int(share * (1 << 20)))
        for r in best_of(ranked(probe, own, stats, k, needs, kind), k).where(F.col("rank") == k).select("at", "score").collect():  # one row an item at most
            needs[r["at"]] = r["score"]
        some = best_of(ranked(index, own, stats, k, needs, kind), k).select("item_id", "rank", "doc_id", "score")
        out = some if out is None else out.unionByName(some)
    return out
