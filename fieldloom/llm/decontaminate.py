"""Benchmark decontamination by greedy string tiling over shared-token seeds.

Runs of `least` tokens that a text and a test item share are seeds; seeds on one diagonal join to maximal matches, and
tiling takes the longest unmarked match again and again, marks its tokens on both sides, cuts what is left of the
matches it overlaps, and stops below `least` tokens. Seeds are found with rolling (Karp-Rabin) fingerprints of all
windows and confirmed token by token. Tiles may come in any order, so a passage whose sentences were shuffled is covered
as well as one in order. A text is contaminated by an item if tiles cover at least `coverage` of the item's tokens.

The items go to every task in blocks of at most `SHARED_BYTES` of text (usually there is one block), `BLOCKS_AT_ONCE` of
them in one pass over the texts, so no seed, however frequent, gathers texts anywhere. A text and an item are compared a
part of their pairs of places at a time (`PAIRS`), of which only maximal matches are kept, so repeated words do not
multiply. Tokens are lower-case runs of letters and digits (any character beyond ASCII counts as a letter).

Results for odd input: null or empty text: covered by nothing. A very long text is compared as a whole, by one task. Items
of fewer than `least` tokens are seeds of their own length; items without tokens or with null text match nothing; items
that share an id count apart and are reported once. Of matches of equal length the one further left in the text, then in
the item, is taken. Repeated rows get equal results. An empty table of texts gives an empty result, one of items leaves
all texts clean. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from fieldloom.llm import text as T
from fieldloom.session import checkpoint_dir

#: The most text of items that is sent to every task at once, and the blocks of items in one pass over the texts.
SHARED_BYTES = 32 << 20
BLOCKS_AT_ONCE = 4
#: Pairs of places that are looked at together.
PAIRS = 1 << 20
_FILTER_BITS = 22


@dataclass
class Seeds:
    """Windows of one length of the items that have it as their seed length, sorted by fingerprint."""

    size: int
    print_: np.ndarray
    item: np.ndarray
    at: np.ndarray
    seen: np.ndarray  # by the first bits of a fingerprint


@dataclass
class Items:
    """Test items: ids, token counts, their tokens' fingerprints, and their seeds by length."""

    ids: np.ndarray
    tokens: np.ndarray
    word: np.ndarray
    first: np.ndarray
    seeds: list[Seeds]


def _tokens(texts: pa.Array) -> tuple[T.Words, np.ndarray]:
    w = T.words(pc.utf8_lower(texts), T.PLAIN)
    return w, T.prints(w)


def items_of(ids: list[int], texts: pa.Array, least: int) -> Items:
    w, word = _tokens(texts)
    size, seeds = np.minimum(w.counts, least), []
    for k in np.unique(size[size > 0]).tolist():
        at = T.places(w, k)
        at = at[size[w.doc()[at]] == k]
        prints, doc = T.runs(word, (k,))[k][at], w.doc()[at]
        order = np.argsort(prints, kind="stable")
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[(prints >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        seeds.append(Seeds(k, prints[order], doc[order], (at - w.first[doc])[order], seen))
    return Items(np.array(ids, np.int64), w.counts, word, w.first, seeds)


def tile(matches: list[tuple[int, int, int]], n_here: int, n_there: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place here, place there, tokens) from maximal matches (tokens, place here, place there)."""
    heap = [(-n, i, j) for n, i, j in matches]
    heapq.heapify(heap)
    marked, other, tiles = np.zeros(n_here, bool), np.zeros(n_there, bool), []
    left = n_there  # unmarked tokens of the item
    while heap and left >= least:
        n, i, j = heapq.heappop(heap)
        taken = marked[i : i - n] | other[j : j - n]
        if not taken.any():
            tiles.append((i, j, -n))
            marked[i : i - n] = True
            other[j : j - n] = True
            left += n
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).view(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return tiles


def _matches(here: np.ndarray, which: np.ndarray, start: np.ndarray, n: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal matches of one text and one item: windows at `here` agree with the item's at which[start : start + n]."""
    ends, open_, out, k = np.cumsum(n), {}, [], 0
    while k < len(here):  # windows in order of place, so many at a time as have `PAIRS` pairs
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
        m = n[k:to]
        a = np.repeat(here[k:to], m)
        b = which[np.arange(m.sum()) + np.repeat(start[k:to] - (np.cumsum(m) - m), m)]
        order = np.lexsort((a, a - b))
        a, b = a[order], b[order]
        cut = np.append(0, np.flatnonzero((np.diff(a) != 1) | (np.diff(b) != 1)) + 1)
        last = here[to] - 1 if to < len(here) else -1  # runs up to here may go on
        going = {}
        for x, y in zip(cut.tolist(), np.append(cut[1:], len(a)).tolist(), strict=True):
            i, j, run = int(a[x]), int(b[x]), y - x
            before = open_.pop(i - j, None)
            if before and before[1] + before[0] == i:
                run, i, j = run + before[0], before[1], before[2]
            elif before:
                out.append((before[0] + size - 1, *before[1:]))
            if i + run - 1 == last:
                going[i - j] = (run, i, j)
            else:
                out.append((run + size - 1, i, j))
        out += [(r + size - 1, i, j) for r, i, j in open_.values()]
        open_, k = going, to
    return out + [(r + size - 1, i, j) for r, i, j in open_.values()]


def coverages(texts: pa.Array, items: Items) -> Iterator[tuple[int, int, float]]:
    """(text, item, share of the item's tokens under tiles) for all pairs that share a seed."""
    for i, j in T.slices(texts):
        w, word = _tokens(texts.slice(i, j - i))
        for s in items.seeds:
            at = T.places(w, s.size)
            prints = T.runs(word, (s.size,))[s.size][at] if len(at) else np.zeros(0, np.uint64)
            maybe = np.flatnonzero(s.seen[(prints >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            prints, at = prints[maybe], at[maybe]
            lo, hi = np.searchsorted(s.print_, prints), np.searchsorted(s.print_, prints, "right")
            # Confirmed by the tokens of one item's window: equal fingerprints there are of equal tokens.
            some = np.flatnonzero(hi > lo)
            place = items.first[s.item[lo[some]]] + s.at[lo[some]]
            same = np.ones(len(some), bool)
            for k in range(s.size):
                same &= items.word[place + k] == word[at[some] + k]
            some = some[same]
            at, lo, hi = at[some], lo[some], hi[some]
            doc = w.doc()[at]
            for x, y in _texts_of(doc):
                here, first = at[x:y] - w.first[doc[x]], lo[x:y]
                for item in np.unique(np.concatenate([s.item[a:b] for a, b in zip(first.tolist(), hi[x:y].tolist(), strict=True)])).tolist():
                    # A fingerprint's windows stand by item: those of this item are one range.
                    begin = np.array([a + np.searchsorted(s.item[a:b], item) for a, b in zip(first.tolist(), hi[x:y].tolist(), strict=True)])
                    n = np.array([np.searchsorted(s.item[a:b], item, "right") for a, b in zip(first.tolist(), hi[x:y].tolist(), strict=True)]) + first - begin
                    own = np.flatnonzero(n)
                    matches = _matches(here[own], s.at, begin[own], n[own], s.size)
                    tokens = int(items.tokens[item])
                    covered = sum(t[2] for t in tile(matches, int(w.counts[doc[x]]), tokens, s.size))
                    yield i + int(doc[x]), item, covered / tokens


def _texts_of(doc: np.ndarray) -> list[tuple[int, int]]:
    cut = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)]
    return list(zip(cut, cut[1:], strict=False)) if len(doc) else []


def _report(n: int, found: Iterator[tuple[int, int, float]], ids: np.ndarray, coverage: float) -> list[tuple[float, list[int]]]:
    best, hit = [0.0] * n, [set() for _ in range(n)]
    for doc, item, share in found:
        best[doc] = max(best[doc], share)
        if share >= coverage:
            hit[doc].add(int(ids[item]))
    return list(zip(best, map(sorted, hit), strict=True))


def _blocks(bench: DataFrame) -> list[list[tuple[int, str]]]:
    """The items in blocks of at most `SHARED_BYTES` of text (an item that is longer is a block of its own)."""
    out, held = [[]], 0
    for r in sorted(map(tuple, bench.collect())):
        size = len(r[1].encode())
        if out[-1] and held + size > SHARED_BYTES:
            out, held = [*out, []], 0
        out[-1].append(r)
        held += size
    return out


def _passes(rows: DataFrame, benchmark: DataFrame, least: int, coverage: float, item_col: str, text_col: str) -> DataFrame:
    """Rows (row, text, best, hits) with the largest coverage, and the ids of items at or over `coverage`, of all items."""
    bench = T.narrow(benchmark, (item_col, "item_id", "bigint"), (text_col, "text", "string")).where("text is not null and item_id is not null")
    spark = rows.sparkSession

    def passed(shared):
        def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            T.fresh()
            items = shared.value
            for b in batches:
                texts = T.as_strings(b.column(1))
                got = _report(len(texts), coverages(texts, items), items.ids, coverage)
                old, hits = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_pylist()
                best = np.maximum(old, [c for c, _ in got]) if got else old
                hits = [sorted({*x, *y}) for x, (_, y) in zip(hits, got, strict=True)]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(best, pa.float64()), pa.array(hits, pa.list_(pa.int64()))], names=["row", "text", "best", "hits"])

        return mapper

    out = rows.select("row", "text", F.lit(0.0).alias("best"), F.array().cast("array<long>").alias("hits"))
    for k, block in enumerate(_blocks(bench)):
        if k and k % BLOCKS_AT_ONCE == 0:
            checkpoint_dir(spark)
            out = out.checkpoint()
        shared = spark.sparkContext.broadcast(items_of([i for i, _ in block], T.as_strings(pa.array([t for _, t in block], pa.string())), least))
        out = out.mapInArrow(passed(shared), out.schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, max_coverage, n_items, item_ids, contaminated) of every text; item_ids are those at or over `coverage`."""
    docs = T.narrow(docs, (id_col, "doc_id", "bigint"), (text_col, "text", "string"))
    found = _passes(docs.select(F.col("doc_id").alias("row"), "text"), benchmark, least, coverage, item_col, item_text_col)
    return found.select(F.col("row").alias("doc_id"), F.col("best").alias("max_coverage"), F.size("hits").alias("n_items"), F.col("hits").alias("item_ids"), (F.size("hits") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, all columns, that no item contaminates."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = _passes(docs.select(rest.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text")), benchmark, least, coverage, item_col, item_text_col)
    return found.where(F.size("hits") == 0).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
