"""Ranked lexical search against brute force, and every odd input."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from fieldloom.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _reference(docs, items, k=10):
    docs = [(d, Counter(_terms(t))) for d, t in docs]
    docs = [(d, c) for d, c in docs if c]
    n_docs, length = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(_terms(text))
    for item, terms in asked.items():
        scored = []
        for d, c in docs:
            m = 10 + 90 * c.total() * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s:
                scored.append((-s, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda r: r[:3])[:k], 1):
            yield item, rank, d, -s


def _compare(spark, docs, items, k=10):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, rank int, terms string")
    q = spark.createDataFrame([(*r, 2.0) for r in items], "item_id long, text string, score double")
    got = sorted((tuple(r) for r in lexical.search(d, q, k).collect()), key=repr)
    assert got == sorted(_reference(docs, items, k), key=repr)
    return got


@pytest.mark.parametrize("cells, block, passes", [(1 << 24, 16, 2000), (40 * 30, 3, 2)])
def test_against_all_scores(spark, monkeypatch, cells, block, passes):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "ITEMS", passes)
    monkeypatch.setattr(lexical, "PROBED", 40)
    rng = random.Random(3)
    common, rare = [f"c{k}" for k in range(8)], [f"R{k}é" for k in range(60)]
    text = lambda n: " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(n))
    docs = [(k, text(rng.randint(1, 40))) for k in range(400)]
    docs += [(1000 + k, docs[k % 5][1]) for k in range(60)]
    _compare(spark, docs, [(k, text(12)) for k in range(5)])


def test_odd(spark):
    docs = [(1, None), (2, ""), (3, "A b-C 7"), (3, "a B_c 7"), (None, "a b"), (None, "a"), (4, "é É x" * 3000), (5, " .,!"), (6, "a"), (7, "a")]
    items = [(1, "a b c 7"), (1, "é"), (None, "A"), (2, None), (3, "..."), (4, "unknown"), (5, "É a a")]
    _compare(spark, docs, items, 3)
    assert _compare(spark, docs, []) == []
    assert _compare(spark, [], items) == []


def test_table(spark, sf):
    got = sorted(tuple(r) for r in queries.op11_lexical_search(spark, sf).collect())
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert got == sorted(c.execute(queries.oracle_sql()["op11_lexical_search"]).fetchall())


def test_bounds_pass_blocks_over(spark, monkeypatch):
    """Where one document holds an item, most blocks of the other lists stay shut."""
    import numpy as np

    rng = np.random.default_rng(5)
    cells = (rng.integers(1, 300, (600, 50)) * (rng.random((600, 50)) < 0.2)).astype(np.float32) * 1000
    items = lexical.Items([1], [f"t{k}" for k in range(50)], [np.arange(12)])
    cells[17, :12] = 900_000
    weights, mix = np.arange(1, 51, dtype=np.int64), rng.standard_normal((50, lexical.SKETCH)).astype(np.float32)
    scored = []
    monkeypatch.setattr(lexical.Best, "add", lambda self, item, score, none, doc_id: scored.extend(doc_id.tolist()))
    whole = cells[:, :12].astype(np.int64) @ weights[:12]
    need = np.sort(whole)[-3:-2]
    lexical.rank_shard(cells, np.arange(600), np.zeros(600, bool), items, weights, mix, lexical.Best(1, need))
    assert sorted(scored) == np.flatnonzero(whole >= need[0]).tolist()
