"""Removal of word passages that occur earlier in the corpus, by prefix-partitioned suffix trees.

Every word position with `width` words to its right is a suffix, and the trees are cut at that depth: the leaves below
an internal node of depth `width` or more are the suffixes of one repeated window, and consecutive ones of a text are
one maximal repeat. All leaves of such a node but the earliest are repeats.

1. `heavy_prefixes` counts prefixes of 1, 2, 4, ... words over all suffixes. A suffix goes to the group of its shortest
   prefix that has at most `GROUP` suffixes, so prefixes have as many words as it takes for a group to fit in memory;
   light prefixes share groups. Only the heavy prefixes (at most one for each `GROUP` / 2 suffixes of a length) are sent
   to the tasks.
2. `announce` and `shared`: leaves without a sibling at the full depth are pruned before any words are sent. Each block
   of documents tells each group 32 bits of the fingerprint of every node it has (sorted, about 3 bytes each), and
   learns which ones other blocks have too. This only prunes: a fingerprint that agrees by chance costs a suffix that
   is sent for nothing.
3. `send`: for the nodes left, each block sends its earliest leaf to the node's group with the path to it: `SYMBOLS`
   symbols of 32 bits, each the fingerprint of the next words. (The other leaves of the block are repeats already,
   confirmed by their words, so a hot passage sends one suffix for each block, never one for each copy. The words
   themselves are three times as long as their symbols; README has figures.)
4. `repeats`: a group sorts its suffixes by their paths, takes the common-prefix lengths of neighbours, and all leaves
   below a node at full depth but the earliest are repeats. A path has 128 bits, so two different ones agree about once
   in 10^38 pairs.
5. `keep_words`: repeats meet their texts again and the covered words are cut out.

Results for odd input: null or empty text: no words, nothing removed. Texts shorter than `width` lose nothing. A very
long text is held with its words by one task at a time. A document is an id with its text: rows repeated with the same
id and text are one and get equal results; rows of one id with different texts are different documents, the one with
the smaller hash of id and text counting as the earlier. Null ids come before all others. An empty table gives an empty
result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from fieldloom.llm import text as T

#: Suffixes of a prefix that makes a group of its own, and those that a group of light prefixes holds on average.
GROUP = 2_000_000
#: Bytes of text in a block of documents.
BLOCK_BYTES = 3 << 20
#: Symbols of a path to the full depth.
SYMBOLS = 4
_LOW = np.uint64(0xFFFFFFFF)


def depths(width: int) -> list[int]:
    """Lengths of prefixes that are counted, and the full depth."""
    return [*(1 << k for k in range(width.bit_length()) if 1 << k < width), width]


def symbols(width: int) -> list[tuple[int, int]]:
    """(first word, words) of each symbol of a path."""
    cut = [width * k // SYMBOLS for k in range(SYMBOLS + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays, byte plane by byte plane: sorted and small numbers shrink to a few bytes each."""
    head = np.array([len(arrays), *[len(a) * a.itemsize for a in arrays]], "<i8").tobytes()
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"" for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *planes]))


def _unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(data, "<i8", n, 8), 8 * (n + 1), []
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        item = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at).reshape(item, -1).T).view(kind).ravel())
        at += size
    return out


def _ranges(values: np.ndarray) -> list[tuple[int, int]]:
    """[i, j) of each run of equal values."""
    cut = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cut, cut[1:], strict=False)) if len(values) else []


class Block:
    """Documents of a block in order of id and key (equal rows are one), their words and their suffixes."""

    def __init__(self, docs: pa.Table, width: int):
        order = docs.append_column("place", pa.array(np.arange(docs.num_rows))).sort_by([("null", "descending"), ("doc_id", "ascending"), ("row_key", "ascending"), ("text", "ascending")])
        texts = T.as_strings(order.column("text"))
        id_, null, key = (order.column(c).combine_chunks() for c in ("doc_id", "null", "row_key"))
        self.id, self.key = id_.fill_null(0).to_numpy(zero_copy_only=False), key.to_numpy(zero_copy_only=False)
        self.null = null.to_numpy(zero_copy_only=False)
        new = np.ones(len(texts), bool)
        same = (self.id[1:] == self.id[:-1]) & (self.null[1:] == self.null[:-1]) & (self.key[1:] == self.key[:-1])
        for k in np.flatnonzero(same):
            new[k + 1] = texts[int(k)] != texts[int(k) + 1]
        #: The document of each row of the table.
        self.row = np.empty(len(texts), np.int64)
        self.row[order.column("place").to_numpy()] = np.cumsum(new) - 1
        self.id, self.key, self.null = self.id[new], self.key[new], self.null[new]
        self.texts = texts.filter(pa.array(new))
        self.width = width
        self.words = T.words(self.texts)

    def suffixes(self, heavy: dict[int, np.ndarray], groups: int) -> None:
        """Sorts suffixes by group and node: `place` (index of the first word), `group`, `node` (fingerprints)."""
        at = T.places(self.words, self.width)
        word = T.prints(self.words)
        prints = T.runs(word, tuple(depths(self.width)))
        node = prints[self.width][at]
        self.parts = T.runs(word, tuple({size for _, size in symbols(self.width)}))
        group = (_prefix(prints, at, heavy, self.width) % np.uint64(groups)).astype(np.int32)
        order = np.argsort(node, kind="stable")  # equal nodes stay in order of document and place
        order = order[np.argsort(group[order].astype(np.uint16) if groups <= 1 << 16 else group[order], kind="stable")]
        self.place, self.group, self.node = at[order], group[order], node[order]
        self.doc = self.words.doc()[self.place]
        change = (self.group[1:] != self.group[:-1]) | (self.node[1:] != self.node[:-1])
        self.first = np.flatnonzero(np.append(True, change)) if len(at) else np.zeros(0, np.int64)

    def paths(self, place: np.ndarray) -> np.ndarray:
        """A row of symbols for each suffix."""
        return np.stack([(self.parts[size][place + at] >> np.uint64(32)).astype(np.uint32) for at, size in symbols(self.width)], axis=1)

    def told(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(group, 32 bits of its nodes in order, index of the nodes): each value once."""
        out = []
        group = self.group[self.first]
        for i, j in _ranges(group):
            value, which = np.unique((self.node[self.first[i:j]] & _LOW).astype(np.uint32), return_inverse=True)
            out.append((int(group[i]), value, which))
        return out


def _prefix(prints: dict[int, np.ndarray], at: np.ndarray, heavy: dict[int, np.ndarray], width: int) -> np.ndarray:
    """The shortest prefix of each suffix that is not heavy."""
    steps = depths(width)
    key, left = prints[steps[0]][at], np.arange(len(at))
    for d, then in zip(steps, steps[1:], strict=False):
        known = heavy.get(d)
        if known is None or not len(left):
            break
        left = left[known[np.minimum(np.searchsorted(known, key[left]), len(known) - 1)] == key[left]]
        key[left] = prints[then][at[left]]
    return key


def heavy_prefixes(docs: DataFrame, width: int, n_bytes: int) -> dict[int, np.ndarray]:
    """Fingerprints of the prefixes, by length, that more than `GROUP` suffixes may have.

    A slice tells only the prefixes that have more than their share, GROUP / 2 of all, of its suffixes; what is left
    untold sums to GROUP / 2 at most, so every prefix with over GROUP suffixes is told more than GROUP / 2 times.
    """
    most = max(1.0, n_bytes / 2)  # suffixes: a word and a space have two bytes at least
    heavy: dict[int, np.ndarray] = {}
    if most <= GROUP:
        return heavy
    for d, then in zip([0, *depths(width)], depths(width)[:-1], strict=False):
        if d and not len(heavy.get(d, [])):
            break

        def count(batches: Iterator[pa.RecordBatch], then: int = then, d: int = d) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = T.as_strings(b.column(0))
                for i, j in T.slices(texts):
                    w = T.words(texts.slice(i, j - i))
                    at = T.places(w, width)
                    prints = T.runs(T.prints(w), tuple(depths(width)[: depths(width).index(then) + 1]))
                    if d:
                        last = prints[d][at]
                        at = at[heavy[d][np.minimum(np.searchsorted(heavy[d], last), len(heavy[d]) - 1)] == last]
                    key, n = np.unique(prints[then][at], return_counts=True)
                    told = n > len(w.start) * GROUP / (2 * most)
                    yield pa.record_batch([pa.array(key[told].view(np.int64)), pa.array(n[told])], names=["key", "n"])

        found = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > GROUP // 2)
        heavy[then] = np.sort(np.array([r.key for r in found.select("key").collect()], np.int64).view(np.uint64))
    return {d: x for d, x in heavy.items() if len(x)}


def announce(width: int, heavy, groups: int):
    """Arrow function of a block: (grp, block, payload) with the nodes that each group has here."""

    def tell(key: tuple, docs: pa.Table) -> pa.Table:
        block = Block(docs, width)
        block.suffixes(heavy.value, groups)
        out = [(g, _packed(np.diff(v, prepend=np.uint32(0)))) for g, v, _ in block.told()]
        return pa.table({"grp": pa.array([g for g, _ in out], pa.int64()), "block": pa.array([key[0].as_py()] * len(out), pa.int64()), "payload": pa.array([p for _, p in out], pa.binary())})

    return tell


def shared(key: tuple, rows: pa.Table) -> pa.Table:
    """Arrow function of a group: for each block a bit for each of its nodes, set if another block has it too."""
    told = [np.cumsum(_unpacked(p.as_py(), np.uint32)[0], dtype=np.uint32) for p in rows.column("payload")]
    value = np.sort(np.concatenate(told)) if told else np.zeros(0, np.uint32)
    twice = np.unique(value[1:][value[1:] == value[:-1]])
    out = []
    for block, own in zip(rows.column("block").to_pylist(), told, strict=True):
        bits = twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own if len(twice) else np.zeros(len(own), bool)
        if bits.any():
            out.append((block, _packed(np.packbits(bits))))
    return pa.table({"block": pa.array([b for b, _ in out], pa.int64()), "grp": pa.array([key[0].as_py()] * len(out), pa.int64()), "payload": pa.array([p for _, p in out], pa.binary())})


def _delta(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def send(width: int, heavy, groups: int, keys: bool):
    """Arrow function of a block and what it learned: (kind, grp, block, payload). Kind 0: suffixes for a group, as their
    places in the block in order, their documents' ids (and keys, if ids repeat at all), and their paths. Kind 1: places
    of repeats of the block itself."""

    def tell(key: tuple, docs: pa.Table, bits: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, bytes]] = []
        if docs.num_rows:
            own = key[0].as_py()
            block = Block(docs, width)
            block.suffixes(heavy.value, groups)
            w = block.words
            number = np.repeat(np.arange(len(block.first)), np.diff(np.append(block.first, len(block.place))))
            again = np.ones(len(block.place), bool)
            again[block.first] = False
            # Nodes of several suffixes of the block: confirmed by words, or else left to the group one by one.
            word, _ = T.word_numbers(w)
            more = np.flatnonzero(again)
            head = block.place[block.first[number[more]]]
            equal = np.ones(len(more), bool)
            for k in range(width):
                equal &= word[block.place[more] + k] == word[head + k]
            odd = np.unique(number[more[~equal]])
            again[np.isin(number, odd)] = False
            wanted = np.zeros(len(block.first), bool)
            wanted[odd] = True
            learned = dict(zip(bits.column("grp").to_pylist(), bits.column("payload"), strict=True))
            at = 0
            for g, value, which in block.told():
                if g in learned:
                    flags = np.unpackbits(_unpacked(learned[g].as_py(), np.uint8)[0], count=len(value)).astype(bool)
                    wanted[at : at + len(which)] |= flags[which]
                at += len(which)
            go = np.flatnonzero(wanted[number] & ~again)
            go = go[np.lexsort((block.place[go], block.group[go]))]
            for i, j in _ranges(block.group[go]):
                some = go[i:j]
                place, doc = block.place[some], block.doc[some]
                who, which = np.unique(doc, return_inverse=True)
                path = block.paths(place)
                out.append((0, int(block.group[some[0]]), own, _packed(_delta(place.astype(np.int32)), _delta(which.astype(np.int32)), _delta(block.id[who]), block.null[who].astype(np.uint8), block.key[who] if keys else block.key[:0], path.ravel())))
            local = np.flatnonzero(again)
            if len(local):
                out.append((1, own, own, _packed(_delta(np.sort(block.place[local]).astype(np.int32)))))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=["kind", "grp", "block", "payload"])

    return tell


def leaves(path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes (a row of symbols each), and the common-prefix length of each with the one before it."""
    n, depth = path.shape
    order = np.lexsort(path.T[::-1])
    differ = path[order[1:]] != path[order[:-1]]
    return order, np.append(0, np.where(differ.any(axis=1), differ.argmax(axis=1), depth))[:n]


def repeats(width: int):
    """Arrow function of a group: its subtree's repeats as (block, payload); what a block knew passes on."""

    def group(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() == 1:
            return rows.select(["block", "payload"])
        parts, paths, depth = [], [], len(symbols(width))
        for block, p in zip(rows.column("block").to_pylist(), rows.column("payload"), strict=True):
            place, which, id_, null, row_key, path = _unpacked(p.as_py(), np.int32, np.int32, np.int64, np.uint8, np.int64, np.uint32)
            which = np.cumsum(which)
            row_key = row_key if len(row_key) else np.zeros(len(id_), np.int64)
            parts.append((np.full(len(place), block, np.int64), np.cumsum(place, dtype=np.int32), np.cumsum(id_)[which], null[which], row_key[which]))
            paths.append(path.reshape(-1, depth))
        block, place, id_, null, row_key = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, common = leaves(np.concatenate(paths))
        node = np.cumsum(common < depth) - 1  # suffixes below one node at full depth
        size = np.bincount(node)
        many = size[node] > 1
        order, node = order[many], node[many]
        order = order[np.lexsort((place[order], row_key[order], id_[order], 1 - null[order].astype(np.int8), node))]
        node = np.sort(node)
        later = order[np.append(False, node[1:] == node[:-1])]
        later = later[np.lexsort((place[later], block[later]))]
        out = [(int(block[later[i]]), _packed(_delta(place[later[i:j]]))) for i, j in _ranges(block[later])]
        return pa.table({"block": pa.array([b for b, _ in out], pa.int64()), "payload": pa.array([x for _, x in out], pa.binary())})

    return group


def keep_words(width: int, with_text: bool):
    """Arrow function of a block: its documents without the words below repeats."""

    def cut(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        n_words, n_removed, sha, kept, spans = [], [], [], [], []
        row = np.zeros(0, np.int64)
        if docs.num_rows:
            block = Block(docs, width)
            row, w = block.row, block.words
            first = w.first
            marks = np.zeros(len(w.start) + 1, np.int32)
            for p in found.column("payload"):
                place = np.cumsum(_unpacked(p.as_py(), np.int32)[0])
                np.add.at(marks, place, 1)
                np.add.at(marks, place + width, -1)
            gone = np.cumsum(marks[:-1]) > 0
            lost = np.append(0, np.cumsum(gone))
            for k in range(len(block.texts)):
                a, b = int(first[k]), int(first[k + 1])
                n_words.append(b - a)
                n_removed.append(int(lost[b] - lost[a]))
                edge = np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]])) if n_removed[-1] else np.zeros(1, np.int8)
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True)] if with_text else None)
                if b == a:
                    kept.append(b"")
                elif not n_removed[-1]:
                    kept.append(w.buf[w.start[a] : w.end[b - 1]].tobytes())
                else:
                    stay = np.flatnonzero(~gone[a:b]) + a
                    jump = np.flatnonzero(np.diff(stay) > 1) + 1
                    runs = np.append(0, jump)[: len(stay)]
                    last = np.append(jump, len(stay))[: len(stay)] - 1
                    kept.append(b" ".join(w.buf[w.start[stay[x]] : w.end[stay[y]]].tobytes() for x, y in zip(runs, last, strict=True)))
                sha.append(hashlib.sha256(kept[-1]).hexdigest())
                kept[-1] = kept[-1] if with_text else None
        made = pa.table({"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})
        made = made.take(pa.array(row))
        return made.add_column(0, "doc_id", docs.column("doc_id"))

    return cut


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def remove_repeated_passages(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text, removed]): each text without the words of `width`-word
    windows that start earlier in the corpus (smaller id, or the same text further left); `removed` has the maximal
    runs of removed words as [start, end) in words."""
    docs = T.narrow(docs, (id_col, "doc_id", "bigint"), (text_col, "text", "string"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups, blocks = max(2 * parts, math.ceil(n_bytes / 4 / GROUP)), _prime(max(parts * 2, math.ceil(n_bytes / BLOCK_BYTES)))
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_prefixes(docs, width, n_bytes))
    keys = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    key = F.xxhash64("doc_id", "text")
    placed = docs.select("doc_id", F.col("doc_id").isNull().alias("null"), key.alias("row_key"), "text", F.pmod(key, F.lit(blocks)).alias("block"))
    told = placed.groupBy("block").applyInArrow(announce(width, heavy, groups), "grp long, block long, payload binary")
    learned = told.groupBy("grp").applyInArrow(shared, "block long, grp long, payload binary")
    sent = placed.groupBy("block").cogroup(learned.groupBy("block")).applyInArrow(send(width, heavy, groups, keys), "kind int, grp long, block long, payload binary")
    known = sent.groupBy("kind", "grp").applyInArrow(repeats(width), "block long, payload binary")
    cut = placed.groupBy("block").cogroup(known.groupBy("block"))
    out = cut.applyInArrow(keep_words(width, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<start: long, end: long>>")
    return out if with_text else out.drop("kept_text", "removed")
