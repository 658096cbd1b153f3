"""Token counts by rank-synchronous merging of pre-tokens held as ragged arrays.

The distinct pre-tokens of a batch are one array of symbols with an owner for each. In every round each pre-token
finds its lowest-rank pair and all occurrences of it merge at once, in all pre-tokens together; a pre-token without a
pair that the vocabulary knows is done, and its surviving symbols are its tokens. Rounds are as many as the most
different merges of one pre-token, not of the text. Splitting into pre-tokens, Unicode normalisation and special
strings follow the vocabulary file, so counts are those of its library.

Results for odd input: null or empty text: 0 bytes, 0 tokens. A very long text is counted as a whole, by one task. Of
equally low pairs of a pre-token all merge at once, overlapping ones from the left. Repeated rows and null ids give a row
each; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldloom.llm import text as T
from fieldloom.llm.token_ids import white_chunks

#: Chunks that a worker remembers; beyond that it starts anew.
KNOWN = 400_000
_NEVER = np.int64(1) << np.int64(62)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    out = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class RankMerger:
    """A byte-pair vocabulary as arrays: symbols of bytes, and ranks of pairs."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str | None):
        self.base = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.last = np.array([vocab[c + suffix] for c in byte_symbols()], np.int64) if suffix else self.base
        self.size = max(vocab.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        #: With one merge for each symbol, no merge can make a pair of a lower rank than its own.
        self.all_at_once = len(set(made.tolist())) == len(made)
        rank = np.arange(len(key))
        bits = 19
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, _NEVER, np.int64)
        self.probes = 0
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):  # open addressing, all keys a step at a time
            free = self.keys[slot[left]] < 0
            _, one = np.unique(slot[left], return_index=True)
            take = np.zeros(len(left), bool)
            take[one] = True
            put = left[take & free]
            self.keys[slot[put]], self.ranks[slot[put]] = key[put], rank[put]
            left = left[~(take & free)]
            slot[left] = (slot[left] + 1) & self.mask
            self.probes += 1
        self.made = made

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64) & self.mask

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.ranks[slot], _NEVER)
        left = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            at = self.keys[slot[left]]
            hit = at == key[left]
            out[left[hit]] = self.ranks[slot[left[hit]]]
            left = left[~hit & (at >= 0)]
        return out

    def merge(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens one after the other, and how many each has; bytes `data`, `length` of each pre-token."""
        keep = length > 0
        count = np.zeros(len(length), np.int64)
        if not keep.any():
            return np.zeros(0, np.int64), count
        owner = np.repeat(np.arange(len(length)), length)
        sym = self.base[data]
        ends = np.cumsum(length)[keep] - 1
        sym[ends] = self.last[data[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), _NEVER, np.int64)  # of a symbol and the next
        if len(sym) > 1:
            rank[:-1] = np.where(owner[1:] == owner[:-1], self.rank(sym[:-1], sym[1:]), _NEVER)
        while len(sym):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            size = np.diff(np.append(first, len(sym)))
            low = np.minimum.reduceat(rank, first)
            over = low == _NEVER
            if over.any():
                gone = np.repeat(over, size)
                done.append((owner[gone], sym[gone]))
                stay = ~gone
                owner, sym, rank = owner[stay], sym[stay], rank[stay]
                first, size, low = first[~over], size[~over], low[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            if len(at) > 1:
                chain = np.append(False, (np.diff(at) == 1) & (owner[at[1:]] == owner[at[:-1]]))
                if not self.all_at_once:
                    at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]
                elif chain.any():  # of overlapping occurrences every other one, from the left
                    opens = np.maximum.accumulate(np.where(chain, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - opens) % 2 == 0]
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            owner, sym, rank = owner[stay], sym[stay], rank[stay]
            new = place[at]
            for x in (new, new[new > 0] - 1):
                nxt = np.minimum(x + 1, len(sym) - 1)
                rank[x] = np.where((x + 1 < len(sym)) & (owner[nxt] == owner[x]), self.rank(sym[x], sym[nxt]), _NEVER)
        who, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(who, kind="stable")
        return ids[order], count + np.bincount(who, minlength=len(count))


class Counter:
    """Counts of a vocabulary file that drops white space; lives in a Python worker from task to task."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)  # for Unicode normalisation and pre-tokens beyond ASCII
        spec = json.loads(self.library.to_str())
        model = spec["model"]
        self.merger = RankMerger(model["vocab"], model["merges"], model.get("end_of_word_suffix"))
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in spec["added_tokens"]) + ")")
        self.marks = {t["content"] for t in spec["added_tokens"]}
        # Fixed value: the vocabulary's pre-token pattern, for lower-case ASCII.
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\x0b\x0ca-z0-9]+")
        self.byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.known: dict[str, int] = {}

    def _pieces(self, chunk: str) -> tuple[int, list[bytes]]:
        """Special tokens of a chunk, and its pre-tokens."""
        if "<" in chunk and self.special.search(chunk):
            n, out = 0, []
            for part in self.special.split(chunk):
                if part in self.marks:
                    n += 1
                elif part:
                    out += self._pieces(part)[1]
            return n, out
        if chunk.isascii():
            return 0, [p.encode() for p in self.ascii.findall(chunk.lower())]
        plain = self.library.normalizer.normalize_str(chunk)
        return 0, [bytes(self.byte_of[c] for c in p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def distinct(self, chunks: list[str]) -> np.ndarray:
        """Tokens of each chunk."""
        if len(self.known) + len(chunks) > KNOWN:
            self.known = {}
        out = np.fromiter((self.known.get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(out < 0)
        if len(new):
            pieces: dict[bytes, int] = {}
            owner, which, extra = [], [], np.zeros(len(new), np.int64)
            for k, i in enumerate(new):
                n, parts = self._pieces(chunks[i])
                extra[k] = n
                for p in parts:
                    owner.append(k)
                    which.append(pieces.setdefault(p, len(pieces)))
            data = np.frombuffer(b"".join(pieces), np.uint8)
            _, count = self.merger.merge(data, np.fromiter(map(len, pieces), np.int64, len(pieces)))
            got = extra + np.bincount(np.array(owner, np.int64), count[np.array(which, np.int64)], len(new)).astype(np.int64)
            out[new] = got
            if len(self.known) + len(new) <= KNOWN:
                self.known.update(zip((chunks[i] for i in new), got.tolist(), strict=True))
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        chunks, counts = white_chunks(texts)
        d = chunks.dictionary_encode()
        n = self.distinct(d.dictionary.to_pylist())[d.indices.to_numpy(zero_copy_only=False)] if len(chunks) else np.zeros(0, np.int64)
        upto = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(counts))]
        return np.diff(upto)


_counters: dict[str, Counter] = {}
T.KEPT.append(_counters)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of whole texts; `vocabulary` is a file that every worker can open."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.fresh(_counters)
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(vocabulary)
        for b in batches:
            texts = T.as_strings(b.column(1))
            n = [_counters[vocabulary].count(texts.slice(i, j - i)) for i, j in T.slices(texts, 2 << 20)]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            size = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)) if len(texts) else n
            yield pa.record_batch([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    docs = T.narrow(docs, (id_col, "doc_id", "bigint"), (text_col, "text", "string"))
    return docs.mapInArrow(mapper, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
