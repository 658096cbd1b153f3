"""Quality rules with an isolation forest over rule statistics.

Each text gets counts (words, characters, symbols, repeated lines, words in repeated windows and more). Rules with
fixed limits fail the plainest cases. For the rest an isolation forest, grown on a bounded sample of labelled good
texts, measures how few random splits of the statistics isolate a text; splits are drawn from the whole range that the
labelled rows span, so a text far from all good ones falls into an empty cell after a few of them. The path-length
score above which a text is dropped is calibrated on labelled rows: of the limits that lose at most `LOSS` of the good
rows it takes the one that best parts good from bad.

Results for odd input: null or empty text: no words, so the rules fail it. A very long text is counted as a whole, by one
task. Repeated rows get equal results, and one of them is trained on; an id labelled both ways counts as bad; null ids
are never labelled. A score at the limit is kept. With fewer than `LEAST` labelled rows of either kind
only the rules decide. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldloom.llm import text as T

#: The most labelled rows that the forest and its limit come from: the bound on what the driver holds.
TRAIN_ROWS = 6000
LEAST = 20
TREES, TREE_ROWS, DEPTH = 150, 256, 10
LOSS = 0.005

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _DIGIT[48:58] = True
_MARK[[ord(c) for c in "!?;:{}[]()=+_~^@/\\"]] = True
_SPACE = T._SPACE


def _within(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags each range between offsets has."""
    sums = np.append(0, np.cumsum(flags))
    return sums[off[1:]] - sums[off[:-1]]


def _again(owner: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one with the same owner at all, and before them."""
    both = owner.astype(np.int64) * (int(number.max(initial=0)) + 1) + number
    order = np.argsort(both, kind="stable")
    same = np.append(False, both[order][1:] == both[order][:-1])
    any_, earlier = np.zeros(len(both), bool), np.zeros(len(both), bool)
    earlier[order] = same[: len(both)]
    any_[order] = (same | np.append(same[1:], False))[: len(both)]
    return any_, earlier


def _triples(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each three words in a row: equal numbers, equal words."""
    if not len(at):
        return at
    size = int(word.max()) + 1
    pair = word[at] * size + word[at + 1]
    if size >= 1 << 20:  # so many different words that three would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    return pair * size + word[at + 2] if size < 1 << 20 else np.unique(np.stack([pair, word[at + 2]]), axis=1, return_inverse=True)[1].ravel()


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of COUNTS for each text."""
    out = []
    for i, j in T.slices(texts):
        part = texts.slice(i, j - i)
        data, off = T.raw(part)
        w = T.words(part)
        first, doc = w.first, w.doc()
        lead = (data & 0xC0) != 0x80  # first bytes of characters
        chars = _within(lead & ~_SPACE[data], off)
        # Lines: from a text's start or a line feed to the next; a line's words are the solid bytes in it.
        opens = np.zeros(len(data) + 1, bool)
        opens[off[:-1]] = True
        opens[1:] |= np.append(data, 0)[:-1] == 0x0A if len(data) else False
        at = np.flatnonzero(opens[: len(data)])
        to = np.append(at[1:], len(data))
        line_doc = np.searchsorted(off, at, "right") - 1
        to = np.minimum(to, off[line_doc + 1])
        to = to - ((to > at) & (data[np.maximum(to - 1, 0)] == 0x0A)) if len(at) else to
        solid = np.append(0, np.cumsum(~_SPACE[data]))
        full = solid[to] > solid[at]
        at, to, line_doc = at[full], to[full], line_doc[full]
        _, dup = _again(line_doc, T.numbers(T.as_array(data, at, to))[0])
        n_lines = np.bincount(line_doc, minlength=j - i)
        n_dup = np.bincount(line_doc[dup], minlength=j - i)
        # Words in three-word windows found twice or more.
        word, win = T.word_numbers(w)[0], T.places(w, 3)
        triple = _triples(word, win)
        twice, _ = _again(doc[win], np.unique(triple, return_inverse=True)[1])
        marks = np.zeros(len(w.start) + 1, np.int32)
        np.add.at(marks, win[twice], 1)
        np.add.at(marks, win[twice] + 3, -1)
        repeat = _within(np.cumsum(marks[:-1]) > 0, first)
        _, seen = _again(doc, word)
        out.append(np.stack([w.counts, chars, _within(_SYMBOL[data], off), n_dup, repeat, n_lines, _within(_UPPER[data], off), _within(_DIGIT[data], off), _within(_MARK[data], off), w.counts - _within(seen, first)], axis=1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros((0, len(COUNTS)), np.int64)


def base_failed(counts: np.ndarray) -> np.ndarray:
    n, repeat = counts[:, 0], counts[:, 4]
    return (n < 50) | (100 * repeat > 50 * n)


def traits(counts: np.ndarray) -> np.ndarray:
    """What the forest splits, one trait for each statistic beside the number of words: shares, on a scale that spreads
    small ones, and lengths of words and lines."""
    n, chars, symbols, dup, repeat, lines, upper, digits, marks, distinct = (counts[:, k].astype(float) for k in range(len(COUNTS)))
    words, chars, rows = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    shares = np.sqrt([symbols / chars, dup / rows, repeat / words, upper / chars, digits / chars, marks / chars])
    return np.stack([*shares, np.log(chars / words), np.log1p(words / rows), np.log(np.maximum(distinct, 1)) / np.log(words + 1)], axis=1)


@dataclass
class Forest:
    """Complete arrays of `trees` trees: feature (-1 for a leaf), split, children, and path length at a leaf."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    path: np.ndarray
    norm: float
    limit: float  # scores above are anomalous
    roots: np.ndarray | None = None


def _average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(good: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 7) -> Forest:
    """Trees on samples of `good`; a node splits a random trait at a random place of its cell of [low, high]."""
    rng = np.random.default_rng(seed)
    feature, split, left, path = [], [], [], []
    usable = np.flatnonzero(high > low)
    size = min(TREE_ROWS, len(good))
    roots = []
    for _ in range(TREES):
        rows = good[rng.choice(len(good), size, replace=False)]
        todo = [(len(feature), rows, low.copy(), high.copy(), 0)]
        roots.append(len(feature))
        for x, v in zip((feature, split, left, path), (-1, 0.0, 0, 0.0), strict=True):
            x.append(v)
        while todo:
            at, own, lo, hi, depth = todo.pop()
            if len(own) <= 1 or depth >= DEPTH or not len(usable):
                path[at] = depth + _average_path(len(own))
                continue
            f = int(rng.choice(usable))
            s = rng.uniform(lo[f], hi[f])
            feature[at], split[at], left[at] = f, s, len(feature)
            below = own[:, f] < s
            for part, a, b in ((own[below], lo, np.where(np.arange(len(hi)) == f, s, hi)), (own[~below], np.where(np.arange(len(lo)) == f, s, lo), hi)):
                todo.append((len(feature), part, a, b, depth + 1))
                for x, v in zip((feature, split, left, path), (-1, 0.0, 0, 0.0), strict=True):
                    x.append(v)
    return Forest(np.array(feature), np.array(split), np.array(left), np.array(path), _average_path(size), np.inf, np.array(roots))


def anomaly(forest: Forest, x: np.ndarray) -> np.ndarray:
    """2^(-mean path / usual path): near 1 for rows that few splits isolate."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for root in forest.roots:
        node = np.full(len(x), root)
        for _ in range(DEPTH + 1):
            f = forest.feature[node]
            inner = f >= 0
            if not inner.any():
                break
            right = x[rows, np.maximum(f, 0)] >= forest.split[node]
            node = np.where(inner, forest.left[node] + right, node)
        total += forest.path[node]
    return 2.0 ** (-total / len(forest.roots) / max(forest.norm, 1e-9))


def fit(counts: np.ndarray, good: np.ndarray) -> Forest | None:
    """A forest and its limit from labelled rows; None if there are too few."""
    left = ~base_failed(counts)
    x, good = traits(counts[left]), good[left]
    if good.sum() < LEAST or (~good).sum() < LEAST:
        return None
    forest = grow(x[good], x.min(axis=0), x.max(axis=0))
    s = anomaly(forest, x)
    fine = np.sort(s[good])
    least = fine[int(np.ceil((1 - LOSS) * len(fine))) - 1]
    cuts = np.unique(s[s >= least])
    middle = np.append((cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1e-9)
    gain = [(s[~good] > c).mean() - (s[good] > c).mean() for c in middle]
    best = np.flatnonzero(np.isclose(gain, np.max(gain)))
    forest.limit = float(middle[best[len(best) // 2]])
    return forest


def _mapper(forest: Forest | None):
    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = statistics(T.as_strings(b.column(1)))
            failed = base_failed(counts)
            score = np.full(len(counts), np.nan)
            kept = ~failed
            if forest is not None and kept.any():
                score[kept] = anomaly(forest, traits(counts[kept]))
                kept = kept & ~(score > forest.limit)
            columns = [b.column(0), *[pa.array(counts[:, k]) for k in range(len(COUNTS))], pa.array(failed), pa.array(kept), pa.array(score, mask=np.isnan(score))]
            yield pa.record_batch(columns, names=["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    return mapper


_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double"


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Forest | None:
    """A forest of at most `rows` labelled ids, chosen by a hash; of rows that share an id the one with the smallest text hash."""
    known = T.narrow(labels, (id_col, "doc_id", "bigint"), (label_col, "label", "int")).where("doc_id is not null and label is not null")
    known = T.sampled(known.groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("at", F.xxhash64("doc_id")), "at", rows)
    docs = T.narrow(docs, (id_col, "doc_id", "bigint"), (text_col, "text", "string"))
    found = docs.join(F.broadcast(known.select("doc_id", "label")), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    made = found.select((F.col("label") * 1).cast("long").alias("doc_id"), "text").mapInArrow(_mapper(None), _SCHEMA).select("doc_id", *COUNTS).toPandas().sort_values(["doc_id", *COUNTS])
    return fit(made[list(COUNTS)].to_numpy(np.int64).reshape(-1, len(COUNTS)), made["doc_id"].to_numpy() == 1)


def judge(docs: DataFrame, forest: Forest | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept, anomaly) of every row."""
    docs = T.narrow(docs, (id_col, "doc_id", "bigint"), (text_col, "text", "string"))
    return docs.mapInArrow(_mapper(forest), _SCHEMA)
