"""Token ids of whole texts by the tokenizers library, each distinct chunk of a batch encoded once.

A text is cut into chunks at places where the vocabulary's pre-tokenizer always starts a new piece, whatever stands
around them, so the ids of a text are those of its chunks in order. Chunks of a batch are made distinct by their bytes
in Arrow, only new ones go through the library, and ids are gathered back with numpy.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa

from fieldloom.llm import text as T

#: Bytes of text handled at once.
SLICE_BYTES = 2 << 20
#: Chunks that go through the library at once.
AT_ONCE = 20_000


class Known:
    """Chunks that a worker remembers, found by fingerprint and confirmed by their bytes; numbered in the order they came."""

    def __init__(self, bits: int = 21):
        self.bits, self.most = bits, (1 << bits) * 6 // 10
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.number = np.full(1 << self.bits, -1, np.int32)
        self.off = np.zeros(self.most + 1, np.int64)
        self.data = np.zeros(1 << 16, np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The number of each chunk, or -1; chunk k is data[off[k]:off[k + 1]]."""
        slot, out, left = self._slot(key), np.full(len(key), -1, np.int32), np.arange(len(key))
        while len(left):
            at = slot[left]
            number = self.number[at]
            hit = (self.keys[at] == key[left]) & (number >= 0)
            out[left[hit]] = number[hit]
            left = left[~hit & (number >= 0)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        got = np.flatnonzero(out >= 0)
        number = out[got]
        size = off[got + 1] - off[got]
        same = self.off[number + 1] - self.off[number] == size
        got, number, size = got[same], number[same], size[same]
        ends = np.cumsum(size)
        step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        wrong = self.data[np.repeat(self.off[number], size) + step] != data[np.repeat(off[got], size) + step]
        seen = np.append(0, np.cumsum(wrong))
        fine = got[seen[ends] == seen[ends - size]]
        sure = np.full(len(key), -1, np.int32)
        sure[fine] = out[fine]
        return sure

    def add(self, key: np.ndarray, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of new, distinct chunks, whose bytes are `data` one after the other."""
        new = np.arange(self.n, self.n + len(key), dtype=np.int32)
        used = int(self.off[self.n])
        while used + len(data) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[used : used + len(data)] = data
        self.off[self.n + 1 : self.n + 1 + len(key)] = used + np.cumsum(size)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            at = slot[left]
            _, one = np.unique(at, return_index=True)
            put = one[self.number[at[one]] < 0]
            i = left[put]
            self.keys[slot[i]], self.number[slot[i]] = key[i], new[i]
            left = np.delete(left, put)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        self.n += len(key)
        return new


def white_chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words without the white space around them, for vocabularies that drop white space. Chunks and their count by text."""
    w = T.words(texts)
    data = w.buf[w.buf != 0x20]
    off = np.append(0, np.cumsum(w.end - w.start)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(w.start), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))]), w.counts


def space_chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A run of white space with the word after it, for byte-level vocabularies, whose pieces never have white space
    after a character that is none. No cut comes after a white-space character beyond ASCII: both make one run."""
    data, off = T.raw(texts)
    n = len(data)
    if not n:
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    space = T._SPACE[data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    at = np.flatnonzero(cut)
    at = at[at > 2]
    a, b, c = data[at - 3], data[at - 2], data[at - 1]
    wide = (b == 0xC2) & np.isin(c, (0x85, 0xA0)) | np.isin(a, (0xE1, 0xE2, 0xE3)) & (c >= 0x80)
    cut[:3] = False
    cut[at[wide]] = False
    cut[off[:-1][off[:-1] < n]] = True
    start = np.flatnonzero(cut)
    counts = np.searchsorted(start, off[1:]) - np.searchsorted(start, off[:-1])
    ends = np.append(start, n).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]), counts


class Encoder:
    """Ids by a vocabulary file; lives in a Python worker from task to task and remembers chunks by their text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.chunks = white_chunks if '"end_of_word_suffix":"</w>"' in self.library.to_str() else space_chunks
        self.known = Known()
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        self.off = np.zeros(self.known.most + 1, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks one after the other, and how many each has."""
        flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(chunks), AT_ONCE):
            ids = [e.ids for e in self.library.encode_batch(chunks[i : i + AT_ONCE], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths[-1].sum())))
        return np.concatenate(flat), np.concatenate(lengths)

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each of the distinct chunks where its ids begin in them and how many they are."""
        if len(chunks) > self.known.most:
            flat, size = self._ids(chunks.to_pylist())
            return flat, np.cumsum(size) - size, size
        data, off = T.raw(chunks)
        key = T.spans(data, off[:-1], off[1:])
        which = self.known.find(key, data, off)
        new = np.flatnonzero(which < 0)
        if self.known.n + len(new) > self.known.most:  # more than a worker remembers: start anew
            self._clear()
            new = np.arange(len(chunks))
        if len(new):
            fresh = chunks.take(pa.array(new))
            ids, lengths = self._ids(fresh.to_pylist())
            n, used = self.known.n, int(self.off[self.known.n])
            while used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[used : used + len(ids)] = ids
            self.off[n + 1 : n + 1 + len(new)] = used + np.cumsum(lengths)
            own, ends = T.raw(fresh)
            which[new] = self.known.add(key[new], own, np.diff(ends))
        return self.flat, self.off[which], self.off[which + 1] - self.off[which]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        chunks, counts = self.chunks(texts)
        if not len(chunks):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        which, distinct = T.numbers(chunks)
        flat, start, size = self._distinct(distinct)
        size = size[which]
        ends = np.cumsum(size)
        ids = flat[np.arange(ends[-1]) + np.repeat(start[which] - (ends - size), size)]
        upto = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        return ids, np.diff(upto)


_encoders: dict[str, Encoder] = {}
T.KEPT.append(_encoders)


def begin() -> None:
    """As a task that encodes begins."""
    T.fresh(_encoders)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
