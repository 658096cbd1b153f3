"""Vectorised text helpers that run inside Arrow tasks.

A batch of texts is cut into slices of a few MB and each slice is turned into one byte buffer with single spaces
between words, so no Python loop runs over words. Words have exact numbers (`numbers`: their place in the slice's
dictionary) and 64-bit fingerprints: XXH64 of a word, and for a window a tree of mixing steps over its words' values
that is no polynomial, so texts of a regular structure do not collide. Where a fingerprint decides a result, the
operators compare the words themselves.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.llm.xxh64 import xxh64

#: Bytes of text handled at once. A longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_ALL = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower case, and every ASCII character that is neither letter nor digit is a space.
PLAIN = LOWER.copy()
PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 0x20


#: What operators keep in a Python worker from task to task.
KEPT: list[dict] = []


def fresh(own: dict | None = None) -> None:
    """As a task begins, its worker lets go of what other operators keep in it, and gives free memory back."""
    for kept in KEPT:
        if kept is not own:
            kept.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


@dataclass
class Words:
    """Words of a slice of texts: `buf` holds them with one space in between, `start` and `end` their places."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray  # words of each text

    @property
    def first(self) -> np.ndarray:
        """Index of each text's first word, and the number of words at the end."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def as_strings(column: pa.Array | pa.ChunkedArray, kind: pa.DataType = pa.large_string()) -> pa.Array:
    """One array; null texts become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column.cast(kind).fill_null("")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string array and the offsets of its texts."""
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    if data is None or not len(off) or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `most` bytes together."""
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, min(to, len(texts))
        at = to


def words(texts: pa.Array, table: np.ndarray | None = None) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text; `table` maps bytes first."""
    data, off = raw(texts)
    if table is not None:
        data = table[data]
    n = len(data)
    if not n:
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64))
    solid = ~_SPACE[data]
    opens = np.zeros(n + 1, bool)
    opens[off] = True
    before = np.empty(n, bool)  # the byte before belongs to the same text and is solid
    before[0] = False
    before[1:] = solid[:-1]
    before &= ~opens[:n]
    keep = solid | before
    place = np.cumsum(keep)
    start = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(before & ~solid)
    shut = off[1:][off[1:] > off[:-1]]
    shut = shut[solid[shut - 1]]  # texts that end inside a word
    end = np.sort(np.concatenate([ends, shut]))
    counts = np.searchsorted(start, off[1:]) - np.searchsorted(start, off[:-1])
    buf = np.where(solid, data, np.uint8(0x20))[keep]
    return Words(buf, place[start] - 1, np.where(end > 0, place[np.maximum(end - 1, 0)], 0), counts)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads fingerprints over all 64 bits."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def joined(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """The fingerprint of two parts in this order."""
    return mixed(mixed(a + np.uint64((2 * salt + 1) * 0x9E3779B97F4A7C15 & _ALL)) + b)


def spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of buf[start:end]; equal bytes give equal ones in any slice."""
    return xxh64(buf, start, end)


def prints(w: Words) -> np.ndarray:
    """The fingerprint of each word."""
    return spans(w.buf, w.start, w.end)


def runs(values: np.ndarray, depths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each depth the fingerprints of so many consecutive values, from each place that has them to its right.

    Depths double: 2 from two of 1, 4 from two of 2; any other is its largest power of two followed by the rest.
    """
    made: dict[int, np.ndarray] = {1: values}

    def of(k: int) -> np.ndarray:
        if k not in made:
            half = 1 << (k.bit_length() - 1)
            half = half // 2 if half == k else half
            a, b = of(half), of(k - half)
            n = max(0, len(values) - k + 1)
            made[k] = joined(a[:n], b[half : half + n], k)
        return made[k]

    return {d: of(d) for d in depths}


def places(w: Words, k: int) -> np.ndarray:
    """Indices of the words that open a window of k words inside one text."""
    n = len(w.start)
    if n < k:
        return np.zeros(0, np.int64)
    left = np.repeat(w.first[1:], w.counts) - np.arange(n)  # words from here to the end of the text
    return np.flatnonzero(left >= k)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words that open a window of k words inside one text, and the windows' fingerprints."""
    at = places(w, k)
    return at, runs(prints(w), (k,))[k][at] if len(at) else np.zeros(0, np.uint64)


def as_array(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """buf[start:end] as binary values."""
    size = end - start
    off = np.append(0, np.cumsum(size)).astype(np.int64)
    data = buf[np.arange(off[-1]) + np.repeat(start - off[:-1], size)]
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def numbers(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each value among the distinct ones, and these."""
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def word_numbers(w: Words) -> tuple[np.ndarray, pa.Array]:
    """The number of each word among the slice's distinct words, and these."""
    data = w.buf[w.buf != 0x20]
    off = np.append(0, np.cumsum(w.end - w.start)).astype(np.int64)
    return numbers(pa.Array.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))]))


def sampled(rows: DataFrame, key: str, n: int, where: Column | None = None, among: int = 8) -> DataFrame:
    """At most n of the rows that `where` holds for, with different `key` (a column of hashes): those with the smallest.

    Rows are counted first, so that a filter on the key leaves about `among` times n of them in all tasks together,
    whatever the table's size; `where` is asked for these only, and finds n among them unless it holds for less than one
    row in `among`. Then only keys are sorted, and the rows of the chosen keys are read once more.
    """
    share = 2.0**64 * min(1.0, among * n / max(1, rows.count())) - 2.0**63
    some = rows if share >= 2.0**63 else rows.where(F.col(key) < F.lit(int(share)))
    some = some if where is None else some.where(where)
    last = [r[0] for r in some.select(key).distinct().orderBy(key).limit(n).collect()][-1:]
    return some.where(F.col(key) <= F.lit(last[0]) if last else F.lit(False)).dropDuplicates([key])


def crc_of(doc_id: Column) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))


def narrow(docs: DataFrame, *columns: tuple[str, str, str]) -> DataFrame:
    """Only the named columns, as (input, output, type); other columns cannot clash with results."""
    return docs.select(*[F.col(f"`{a}`").cast(kind).alias(b) for a, b, kind in columns])


def rows_kept(docs: DataFrame, text_col: str, keeps) -> DataFrame:
    """The rows, all columns, whose text passes; `keeps` makes, in a task, a function of texts that gives booleans.

    A row goes to the task once, as a struct that holds its text too.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = docs.columns.index(text_col)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        passes = keeps()
        for b in batches:
            rows = b.column(0)
            for i in range(0, len(rows), 2000):
                part = rows.slice(i, 2000)
                yield pa.record_batch([part.filter(pa.array(passes(as_strings(part.field(at)))))], names=["row"])

    made = own.mapInArrow(mapper, own.schema)
    return made.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
