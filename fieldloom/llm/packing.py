"""Packing of token pieces into sequences by vector best fit.

A sequence has room for tokens, documents and attention cost: the tiles of `TILE` by `TILE` scores that a kernel works
off for its documents, each with itself only. Pieces go longest first; each looks at all open sequences of its group
that have room of every kind and takes the one with the smallest weighted norm of the rooms left (or the largest
weighted dot product of its needs and the rooms), and opens a new one only if none has room. By default a sequence
takes as many documents and tiles as tokens, which weigh in the choice but never cost a sequence; smaller rooms are a
parameter. Pieces are dealt at random to groups of a bounded number of tokens that are packed apart; a second
round packs the sequences that the first left partly empty once more, in fewer groups.

Results for odd input: null or empty text: one piece that is the end id alone. Texts of more than a sequence's tokens
are cut into full pieces and a rest. Repeated rows and null ids are pieces like others, dealt by their place and not by
their id, so no group grows with them. Ties go to the longer, then lower id, then lower piece; equal sequences to the
one opened first. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fieldloom.llm import text as T
from fieldloom.llm.token_ids import SLICE_BYTES, begin, encoder
from fieldloom.session import checkpoint_dir

#: Tokens of a group that is packed in one task.
GROUP_TOKENS = 4 << 20
#: A sequence that the first round filled less than this is packed again.
FILLED = 0.97
#: Side of an attention tile in tokens.
TILE = 128


@dataclass(frozen=True)
class Room:
    """What a sequence holds at most, and how much each kind weighs in the choice. Zero: by the number of tokens."""

    tokens: int = 4096
    documents: int = 0
    tiles: int = 0
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"  # or "dot"

    def __post_init__(self) -> None:
        full = -(-self.tokens // TILE)
        object.__setattr__(self, "documents", self.documents or self.tokens)
        object.__setattr__(self, "tiles", self.tiles or max(full * full, self.tokens))
        if self.rule not in ("norm", "dot"):
            raise ValueError(f"unknown rule {self.rule}")
        if self.tiles < full * full:
            raise ValueError("a piece of full length must fit the tiles")


def needs(lengths: np.ndarray) -> np.ndarray:
    """(tokens, documents, tiles) of each piece."""
    side = -(-lengths // TILE)
    return np.stack([lengths, np.ones_like(lengths), side * side], axis=1)


def pack(lengths: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; lengths in falling order. Every piece looks at all sequences.

    Needs, rooms and weights are whole numbers over a common denominator, so equal scores are equal and nothing rests on
    the last digit of a quotient.
    """
    most = (room.tokens, room.documents, room.tiles)
    whole = math.lcm(*most)
    exact = [Fraction(str(w)) for w in room.weights]
    parts = math.lcm(*[w.denominator for w in exact])
    kind = np.int64 if whole * whole * parts * 4 < 1 << 62 else object
    weights = np.array([int(w * parts) for w in exact], kind)[:, None]
    ask = needs(lengths).astype(kind) * np.array([whole // m for m in most], kind)
    left = np.full((3, 64), whole, kind)  # of each room, by sequence
    used = np.zeros(64, np.int64)
    n = 0
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, (want, size) in enumerate(zip(ask, lengths.tolist(), strict=True)):
        rest = left[:, :n] - want[:, None]
        fits = np.flatnonzero((rest >= 0).all(axis=0)) if size < room.tokens else np.zeros(0, np.int64)
        if len(fits):
            rest = rest[:, fits]
            score = (weights * rest * rest).sum(axis=0) if room.rule == "norm" else -(weights * want[:, None] * left[:, fits]).sum(axis=0)
            best = int(fits[np.argmin(score)])
        else:
            if n == left.shape[1]:
                left, used = np.concatenate([left, np.full_like(left, whole)], axis=1), np.concatenate([used, np.zeros_like(used)])
            best, n = n, n + 1
        where[k], offset[k] = best, used[best]
        left[:, best] -= want
        used[best] += size
    return where, offset


def pieces(docs: DataFrame, vocabulary: str, end_id: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, place): each text's ids with the end id, cut every `most` ids; `place`
    tells pieces of one run apart."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        before = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = T.as_strings(b.column(1))
            for i, j in T.slices(texts, SLICE_BYTES):
                ids, counts = encoder(vocabulary).encode(texts.slice(i, j - i))
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                total = counts + 1
                n = -(-total // most)
                doc = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * most
                length = np.minimum(most, total[doc] - start)
                at = (np.cumsum(total) - total)[doc] + start
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * x : 4 * (x + y)]) for x, y in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.record_batch([b.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(before + np.arange(len(doc)))], names=["doc_id", "piece", "start", "length", "ids_crc32", "place"])
                before += len(doc)

    docs = T.narrow(docs, (id_col, "doc_id", "bigint"), (text_col, "text", "string"))
    return docs.mapInArrow(mapper, "doc_id long, piece int, start long, length long, ids_crc32 long, place long")


_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, place long, sequence_id long, offset long, used long"


def _packed(cut: DataFrame, groups: int, room: Room, first: int) -> DataFrame:
    """Pieces with their sequence, its number from `first` on within 2^40 for a group, and its tokens."""

    def group(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("place", "ascending")])
        length = t.column("length").to_numpy()
        where, offset = pack(length, room)
        used = np.bincount(where, length, minlength=1).astype(np.int64)[where]
        t = t.select(["doc_id", "piece", "start", "length", "ids_crc32", "place"])
        for name, x in (("sequence_id", where + first + (key[0].as_py() << 40)), ("offset", offset), ("used", used)):
            t = t.append_column(name, pa.array(x, pa.int64()))
        return t

    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("place"), F.lit(groups)).cast("long"))
    return dealt.groupBy("grp").applyInArrow(group, _SCHEMA)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, room: Room | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all texts."""
    room = room or Room()
    checkpoint_dir(docs.sparkSession)
    cut = pieces(docs, vocabulary, end_id, room.tokens, id_col, text_col).checkpoint()
    total = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // GROUP_TOKENS))
    once = _packed(cut, groups, room, 0)
    if groups > 1:
        once = once.checkpoint()
        short = F.col("used") < FILLED * room.tokens
        again = once.where(short).select("doc_id", "piece", "start", "length", "ids_crc32", "place")
        left = again.agg(F.sum("length")).first()[0] or 0
        twice = _packed(again, max(1, -(-left // GROUP_TOKENS)), room, 1 << 39)
        once = once.where(~short).unionByName(twice)
    return once.drop("used", "place")
