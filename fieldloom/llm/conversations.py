"""Structure repair of conversations by iterative-deepening A*.

A conversation's rows are consumed in order by edits: keep (K, free, if the role fits), rerole to user or assistant (R, 1),
delete (D, 2), insert an empty turn (I, 5); a truncated row that stays costs 5 more, blank and duplicate rows must go. The
roles left must read `(s?(ua)+)?`. A state is the number of rows consumed and the last role. Depth-first search in ASCII
order of the edits goes as far as a bound on the cost allows, which then rises to the least cost that was cut off; a table
holds for each failed state the cost that it needs at least, so no state is searched again with less. The first accepting
path under a bound that no cheaper path meets is the cheapest one, and of equally cheap ones the least in ASCII. The search
starts from what rows cost by themselves (2 for a blank, duplicate or truncated one, 1 for a role of another kind) and 1 for
each disjoint pair of clean neighbours that can't follow each other, which is never too much.

A conversation of more than `CHUNK` rows is searched chunk by chunk, for each role that a chunk can begin and end with, and
the cheapest costs are added up backwards; the least edits are then read off forwards. Time is in proportion to the rows.

Conversations are dealt by id and their rows sorted, so that one comes to a task row by row: its codes and edits take a byte
a row, its texts are hashed as they pass and never held. Texts are sent once; faults come from their lengths and hashes.

Results for odd input: a null id is a conversation of its own; null roles and texts are one space, so such a text is
blank, such a role of another kind. Null turns come first and count for no gap. Rows of equal turn are in the order of
role and SHA-256 of the text, so repeats are neighbours. A conversation whose rows all were dropped has zeros, no edits
and the hash of an empty string. An empty table gives an empty result. Other columns are not looked at, whatever their
names; very long texts count like others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.llm import text as T

#: Rows that are searched at once.
CHUNK = 32
#: Repaired conversations of one chunk that a task remembers.
REMEMBERED = 50_000

NEVER = 1 << 40
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The role after a kept row, by the role before it.
_KEEPS = {b"s"[0]: {NONE: SYSTEM}, b"u"[0]: {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, b"a"[0]: {USER: ASSISTANT}, b"x"[0]: {}}
#: The role that follows another; it is that of an inserted or reroled row.
_NEXT = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: b"user", ASSISTANT: b"assistant"}
_FORCED = b"bd"
ENDS = frozenset((NONE, ASSISTANT))

SPACE = " \t\n\x0b\x0c\r"


def least_costs(codes: bytes) -> list[int]:
    """For each place what the rows from there on cost at least. Codes are s, u, a, x (another role) for a clean row, their
    capitals for a truncated one, b for a blank and d for a duplicate."""
    out, waiting = [0] * (len(codes) + 1), None
    for i in range(len(codes) - 1, -1, -1):
        c = codes[i]
        out[i] = out[i + 1]
        if c in _FORCED:
            out[i] += 2
        elif c < 97 or c == 120:
            out[i] += 2 if c < 97 else 1
            waiting = None
        elif waiting is not None and bytes((c, waiting)) not in (b"su", b"ua", b"au"):
            out[i] += 1
            waiting = None
        else:
            waiting = c
    return out


def search(codes: bytes, begin: int, ends: frozenset[int], inserts_last: bool) -> tuple[int, str] | None:
    """The cheapest edits, and their cost, that consume all codes from the role `begin` and leave a role of `ends`; rows may
    be inserted behind the last code only if asked for. None if there are none."""
    n = len(codes)
    least = least_costs(codes)
    last_system = max(codes.rfind(b"s"), codes.rfind(b"S"))
    needs: dict[int, int] = {}  # of failed states
    path: list[str] = []

    def moves(i: int, role: int) -> Iterator[tuple[str, int, int, int]]:
        follows = _NEXT[role]
        if i < n:
            yield "D", 2, i + 1, role
        if i < n or inserts_last:
            yield "I", 5, i, follows
        if i < n and (c := codes[i]) not in _FORCED:
            extra = 5 if c < 97 else 0
            kept = _KEEPS[c | 32].get(role)
            if kept is not None:
                yield "K", extra, i + 1, kept
            yield "R", extra + 1, i + 1, follows

    def at_least(i: int, role: int) -> int:
        """What a state costs as far as is known. Nothing leads back to no role or to the system's."""
        if (known := needs.get(4 * i + role)) is not None:
            return known
        if role in ends:
            return least[i]
        if i == n:
            return 5 if inserts_last else NEVER
        return least[i] if ends & {USER, ASSISTANT} or SYSTEM in ends and role == NONE and i <= last_system else NEVER

    def fails(i: int, role: int, budget: int) -> int:
        """0 if an accepting path was found, else the cost above the budget that one from here takes at least."""
        if i == n and role in ends:
            return 0
        best = NEVER
        for letter, cost, j, then in moves(i, role):
            need = cost + at_least(j, then)
            if need <= budget:
                path.append(letter)
                over = fails(j, then, budget - cost)
                if not over:
                    return 0
                path.pop()
                need = cost + over
            best = min(best, need)
        needs[4 * i + role] = best
        return best

    bound = at_least(0, begin)
    while bound < NEVER:
        over = fails(0, begin, bound)
        if not over:
            return bound, "".join(path)
        bound = over
    return None


def repair(codes: bytes) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of a conversation."""
    if len(codes) <= CHUNK:
        return search(codes, NONE, ENDS, True)
    parts = [codes[i : i + CHUNK] for i in range(0, len(codes), CHUNK)]
    known: dict[tuple[bytes, int, int], int] = {}

    def through(part: bytes, a: int, b: int) -> int:
        if (part, a, b) not in known:
            if len(known) > REMEMBERED:
                known.clear()
            found = search(part, a, frozenset((b,)), False)
            known[part, a, b] = found[0] if found else NEVER
        return known[part, a, b]

    ahead = np.full((len(parts) + 1, 4), NEVER, np.int64)  # cheapest from each part and role to the end
    ahead[-2] = [search(parts[-1], a, ENDS, True)[0] for a in range(4)]
    for k in range(len(parts) - 2, -1, -1):
        for a in range(4):
            ahead[k, a] = min(through(parts[k], a, b) + int(ahead[k + 1, b]) for b in range(4))
    role, out = NONE, []
    for k, part in enumerate(parts[:-1]):
        fits = [b for b in range(4) if through(part, role, b) + ahead[k + 1, b] == ahead[k, role]]
        edits, then = min((search(part, role, frozenset((b,)), False)[1], b) for b in fits)
        out.append(edits)
        role = then
    out.append(search(parts[-1], role, ENDS, True)[1])
    return int(ahead[0, NONE]), "".join(out)


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone): rows with the damage that crc32 of `id:turn`, modulo 20, asks for; a dropped row is
    still there, marked as gone, so that its conversation is not lost."""
    d = T.narrow(conversations, (id_col, "conv_id", dict(conversations.dtypes)[id_col]), (turn_col, "turn", "bigint"), (role_col, "role", "string"), (text_col, "text", "string"))
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    d = d.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), kind.alias("kind"))
    return d.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "kind")


def _order(*first: str | Column) -> list[str | Column]:
    return ["conv_id", *first, F.col("turn").asc_nulls_first(), "role", "digest"]


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, gone, code, illegal, turn_again) of damaged rows, conversations in one partition each and in order."""
    bare = F.rtrim("text", F.lit(SPACE))
    r = rows.select("conv_id", "turn", "gone", "role", F.sha2("text", 256).alias("digest"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    r = r.repartition("conv_id")
    turn = F.col("turn").asc_nulls_first()
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "digest").orderBy(turn)) > 1
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    row = Window.partitionBy("conv_id").orderBy("gone", turn, "role", "digest")
    code = F.when(F.col("gone"), "-").when(F.col("blank"), "b").when(seen, "d").when(F.col("truncated"), F.upper(initial)).otherwise(initial)
    before = F.lag(initial).over(row)
    illegal = ~F.col("gone") & before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au")
    again = F.col("gone") | F.col("turn").isNull() | F.coalesce(F.lag("turn").over(row) == F.col("turn"), F.lit(False))
    out = r.select("conv_id", "turn", "gone", "role", "digest", F.ascii(code).alias("code"), illegal.alias("illegal"), again.alias("turn_again"))
    return out.sortWithinPartitions(*_order("gone")).select("conv_id", "turn", "gone", "code", "illegal", "turn_again")


def _runs(ids: pa.Array, last: list) -> list[tuple[int, int, bool]]:
    """Ranges of equal ids, and whether each goes on with the id before; `last` holds that one."""
    if not len(ids):
        return []
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    differs = pc.fill_null(pc.not_equal(a, b), pa.scalar(False))
    cuts = np.flatnonzero(differs.to_numpy(zero_copy_only=False) | (a.is_valid().to_numpy(zero_copy_only=False) != b.is_valid().to_numpy(zero_copy_only=False))) + 1
    at = [0, *cuts.tolist(), len(ids)]
    goes_on = bool(last) and last[0] == ids[0].as_py()
    last[:] = [ids[len(ids) - 1].as_py()]
    return [(i, j, goes_on and i == 0) for i, j in zip(at, at[1:], strict=False)]


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audited(rows: DataFrame) -> DataFrame:
    """(conv_id, counts, cost, audit) of each conversation of damaged rows."""
    kind = dict(rows.dtypes)["conv_id"]

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.fresh()
        known: dict[bytes, tuple[int, str]] = {}
        last: list = []
        codes, illegal, turns, low, high = bytearray(), 0, 0, None, None
        done: list[tuple] = []

        def finished(conv: object) -> None:
            found = known.get(bytes(codes)) or repair(bytes(codes))
            if len(codes) <= CHUNK:
                if len(known) > REMEMBERED:
                    known.clear()
                known[bytes(codes)] = found
            count = lambda letters: sum(codes.count(x) for x in letters)
            done.append((conv, high - low + 1 - turns if turns else 0, count(b"b"), count(b"d"), count(b"SUAX"), illegal, *found))

        def out() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [()] * 8
            done.clear()
            return pa.record_batch([pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:7]], pa.array(cols[7], pa.string())], names=["conv_id", *_COUNTS, "audit"])

        conv, id_type = None, None
        for b in batches:
            id_type = b.schema.field(0).type
            here, wrong, again = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5))
            there = here != ord("-")
            turn = pc.fill_null(b.column(1), 0).to_numpy(zero_copy_only=False)
            was = last[:]
            for i, j, goes_on in _runs(b.column(0), last):
                if not goes_on:
                    if i or was:
                        finished(conv)
                    codes, illegal, turns, low, high = bytearray(), 0, 0, None, None
                    conv = b.column(0)[i].as_py()
                codes += here[i:j][there[i:j]].astype(np.uint8).tobytes()
                illegal += int(wrong[i:j].sum())
                new = turn[i:j][~again[i:j].astype(bool)]
                if len(new):
                    turns += len(new)
                    low, high = min(int(new.min()), int(new.min()) if low is None else low), max(int(new.max()), int(new.max()) if high is None else high)
            if len(done) >= 1000:
                yield out()
        if last:
            finished(conv)
            yield out()

    return coded(rows).mapInArrow(mapper, f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string")


class _Repaired:
    """The hash of a conversation's repaired rows, which come one by one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.role, self.lines, self.sha = audit, 0, NONE, 0, hashlib.sha256()

    def _line(self, role: bytes, text: bytes) -> None:
        self.sha.update((b"\n" if self.lines else b"") + role + b":")
        self.sha.update(text)
        self.lines += 1

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.role = _NEXT[self.role]
            self._line(_NAMES[self.role], b"")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.role = _NEXT[self.role]
            self._line(_NAMES[self.role], text.encode())
        elif edit == "K":
            self.role = _KEEPS[ord(role[0])][self.role]
            self._line(role.encode(), text.encode())

    def hexdigest(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


def repaired(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation after damage."""
    rows = damaged(conversations, id_col, turn_col, role_col, text_col)
    audits = audited(rows)
    kind = dict(rows.dtypes)["conv_id"]
    counts = [c for c in audits.columns if c != "conv_id"]
    texts = rows.where(~F.col("gone")).select("conv_id", F.lit(1).alias("at"), "turn", F.sha2("text", 256).alias("digest"), "role", "text", *[F.lit(None).cast(t).alias(c) for c, t in audits.dtypes if c != "conv_id"])
    nothing = F.lit(None)
    heads = audits.select("conv_id", F.lit(0).alias("at"), nothing.cast("bigint").alias("turn"), nothing.cast("string").alias("digest"), nothing.cast("string").alias("role"), nothing.cast("string").alias("text"), *counts)
    ordered = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions(*_order("at")).select("conv_id", "at", "role", "text", *counts)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.fresh()
        head, own = None, None
        for b in batches:
            made, hashes = [], []
            at, roles, texts = b.column(1).to_numpy(zero_copy_only=False), b.column(2), b.column(3)
            for k in range(b.num_rows):
                if at[k]:
                    own.row(roles[k].as_py(), texts[k].as_py())
                    continue
                if head is not None:
                    made.append(head)
                    hashes.append(own.hexdigest())
                head = b.slice(k, 1).select(["conv_id", *counts])
                own = _Repaired(head.column("audit")[0].as_py())
            if head is not None:  # not a view that keeps the batch
                head = pa.RecordBatch.from_pylist(head.to_pylist(), schema=head.schema)
            if made:
                yield _with_hashes(made, hashes)
        if head is not None:
            yield _with_hashes([head], [own.hexdigest()])

    return ordered.mapInArrow(mapper, f"conv_id {kind}, {', '.join(f'{c} {t}' for c, t in audits.dtypes if c != 'conv_id')}, repaired_sha256 string")


def _with_hashes(heads: list[pa.RecordBatch], hashes: list[str]) -> pa.RecordBatch:
    t = pa.Table.from_batches(heads).append_column("repaired_sha256", pa.array(hashes, pa.string())).combine_chunks()
    return t.to_batches()[0]
