"""Mixing and conversation repair against brute force, and every odd input."""

import hashlib
import re
import zlib
from functools import lru_cache

import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fieldloom.llm import conversations, mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 12: mixing.


def _targets(sizes, weights=(3, 1, 2)):
    """Rounds of sharing out as the contract has them."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), dict(weight), {}
    while free:
        share = {s: w * left / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            del free[s]
    return out


def _mix_checked(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert all(r.source_size == sizes[r.source] for r in got)
    want = _targets(sizes) if sizes else {}
    for s, t in target.items():
        assert t == pytest.approx(want[s], rel=1e-12)
        assert taken[s] == int(t)
    return got


def test_mixing_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = _mix_checked(docs)
    words = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r.size for r in got} == words
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    again = mixing.mix(docs.repartition(5)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(c.execute(queries.oracle_sql()["op12_mixing"]).fetchall())
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == want


def test_mixing_odd(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (None, "a b", None), (None, "a b", None), (None, "a b", None), (4, "w " * 5000, "é"), (5, "one", "Z"), (5, "one", "Z"), (5, "two", "Z"), (6, " \n\t", "empty")]
    odd = spark.createDataFrame([(a, b, s, 1, 2.0, "k") for a, b, s in rows], "doc_id long, text string, source string, size int, target double, part string")
    got = _mix_checked(odd)
    assert {r.source: r.target for r in got}["empty"] == 0.0
    assert mixing.mix(odd.where("false")).collect() == []
    none = mixing.mix(odd.where("source = 'empty'")).collect()
    assert [(r.doc_id, r.size, r.target, r.taken) for r in none] == [(6, 0, 0.0, 0)]
    each = mixing.epochs_of(mixing.mix(odd))
    assert each.agg(F.sum("words")).first()[0] == sum(r.taken for r in got)
    assert each.agg(F.max("epoch")).first()[0] <= 1


def test_mixing_hot_id(spark):
    """One id and source with most rows: they are cut at the budget, over more than one partition."""
    hot = spark.range(4000).select(F.when(F.col("id") % 4 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("two words").alias("text"), F.lit("s").alias("source"))
    others = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), F.concat(F.lit("t"), (F.col("id") % 2).cast("string")).alias("source"))
    got = _mix_checked(hot.unionByName(others))
    assert len({r.taken for r in got if r.doc_id == 7 and r.source == "s"}) <= 3


# 13: conversations.

codes_of = st.text(alphabet="suaxSUAXbd", max_size=9)


@lru_cache(None)
def _best(codes, role, inserted):
    """(cost, letters) by plain recursion: the cheapest, then the least letters."""
    out = [(0, "")] if not codes and role in "0a" else []
    follows = {"0": "u", "s": "u", "u": "a", "a": "u"}[role]
    if inserted < 2:
        c, t = _best(codes, follows, inserted + 1)
        out.append((c + 5, "I" + t))
    if codes:
        c, t = _best(codes[1:], role, 0)
        out.append((c + 2, "D" + t))
        if codes[0] not in "bd":
            extra = 5 if codes[0].isupper() else 0
            own = codes[0].lower()
            if own == follows or own == "s" and role == "0":
                c, t = _best(codes[1:], own, 0)
                out.append((c + extra, "K" + t))
            c, t = _best(codes[1:], follows, 0)
            out.append((c + extra + 1, "R" + t))
    return min(out, default=(10**6, ""))


@settings(max_examples=400, deadline=None)
@given(codes_of)
def test_search(codes):
    assert conversations.search(codes.encode(), conversations.NONE, conversations.ENDS, True) == _best(codes, "0", 0)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="suaxSUAbd", min_size=5, max_size=14))
def test_chunks_change_nothing(codes):
    was, conversations.CHUNK = conversations.CHUNK, 4
    try:
        assert conversations.repair(codes.encode()) == _best(codes, "0", 0)
    finally:
        conversations.CHUNK = was


def test_long_conversations():
    cost, audit = conversations.repair(b"uau" * 3000 + b"b" * 500 + b"xxUA" * 100)
    assert len(audit) - audit.count("I") == 9900
    assert cost == 2 * audit.count("D") + audit.count("R") + 5 * audit.count("I")


def _reference(rows):
    """The contract in plain Python."""
    space = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        codes, seen = "", set()
        for _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            i = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "b" if not solid else "d" if (role, text) in seen else i if solid[-1] in ".!?" else i.upper()
            seen.add((role, text))
        cost, audit = _best(codes, "0", 0)
        turns = {t for t, _, _ in own if t is not None}
        out, at, role = [], iter(own), "0"
        for x in audit:
            row = None if x == "I" else next(at)
            if x == "D":
                continue
            role = row[1][:1] if x == "K" else {"0": "u", "s": "u", "u": "a", "a": "u"}[role]
            out.append((row[1] if x == "K" else {"u": "user", "a": "assistant"}[role]) + ":" + (row[2] if row else ""))
        pairs = [(a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False)]
        yield conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, codes.count("b"), codes.count("d"), sum(c.isupper() for c in codes), sum(pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def _compare(df):
    got = sorted((tuple(r) for r in conversations.repaired(df).collect()), key=repr)
    assert got == sorted(_reference([(r.conv_id, r.turn, r.role, r.text) for r in df.select("conv_id", "turn", "role", "text").collect()]), key=repr)
    return got


def test_conversations_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    got = _compare(df)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    assert got == sorted((tuple(r) for r in conversations.repaired(df.repartition(7)).collect()), key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_conversations_odd(spark):
    long = "word " * 40_000 + "."
    rows = [(None, None, None, None), (None, 1, "user", "a."), (None, 1, "user", "a."), (1, None, "system", "x!"), (1, 3, "user", ""), (1, 3, "assistant", " \t\n"), (1, 9, "assistant", long), (2, 5, "", "z?"), (2, -4, "tool", "é."), (3, 0, "user", "漢字")]
    dropped = next(k for k in range(100, 400) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "all gone."), *[(5, k // 2, ("user", "assistant")[k % 2], f"text {k % 5}.") for k in range(12)]]
    df = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], "conv_id long, turn long, role string, text string, cost int, code int, digest string")
    got = {r[0]: r for r in _compare(df)}
    assert got[dropped][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repaired(df.where("false")).collect() == []
    names = df.withColumn("conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    assert conversations.repaired(names).count() == len(got)


def test_one_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    df = spark.range(300).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(".")).alias("text"))
    other = spark.range(40).select((F.col("id") % 9 + 2).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("same.").alias("text"))
    got = {r.conv_id: r for r in conversations.repaired(df.unionByName(other)).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = {r.conv_id: r for r in conversations.repaired(df.unionByName(other)).collect()}
    assert got == whole and len(got) == 10
