"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The patterns find e-mail addresses, IPv4 addresses, payment cards (Luhn) and international phone numbers. The field's
variables are a text's candidate tokens (words with a digit or an at sign); neighbours in the text form a chain, and
tokens that repeat or resemble each other (equal text, or equal last seven digits) are joined by skip edges from each
occurrence to the next, so edges grow with the text and not with the square of a repetition. Node weights sit on hashed
shape and context features, edge weights on label pairs of either kind of edge. They are fitted by pseudo-likelihood
on a bounded sample of texts labelled by the patterns, with copies of it in which entities are written in ways that the
patterns do not know (no plus sign, dots in cards, an address with a port). Labels come from loopy belief propagation,
all texts of a batch at once. Spans of the patterns always stay; the field only adds spans beside them.

Results for odd input: null or empty text: no spans. A very long text is searched as a whole, by one task. Repeated rows
and null ids get a row each; of overlapping spans of several kinds all are told, by start and then kind. Digits beyond
ASCII are no digits. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldloom.llm import text as T

KINDS = ("email", "ip", "card", "phone")
#: The most texts that weights are fitted on: the bound on what the driver holds (whole texts are not kept).
TRAIN_TEXTS = 1500
#: Longer texts are not among them.
TRAIN_CHARS = 200_000
#: The most rounds of messages, for texts whose messages do not settle; and the move of a message that counts as settled.
ROUNDS = 200
SETTLED = 1e-7
#: Belief that an added span needs.
SURE = 0.9
_BITS = 15

# The patterns of the contract.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by start and kind, in code points."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:  # the local part is the run before the sign, so each sign is looked at once
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    for m in _IP.finditer(text):
        if all(map(_is_byte, m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


# The field.


def _shape(word: str) -> str:
    runs = re.sub(r"[a-zß-ÿ]+", "a", re.sub(r"[A-Z]+", "A", word))
    return re.sub(r"[0-9]+", lambda m: "9" * min(len(m.group()), 5), runs)


def _is_byte(part: str) -> bool:
    """Whether ASCII digits write a number up to 255."""
    return bool(_DIGITS.fullmatch(part)) and len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def _features(words: list[str], k: int) -> list[int]:
    word = words[k]
    core = word.strip(".,;:!?\"'")
    digits = re.sub(r"[^0-9]", "", core)
    shape = _shape(core)
    before, after = (words[k - 1] if k else "<"), (words[k + 1] if k + 1 < len(words) else ">")
    parts = core.split(".")
    own = [
        "shape " + shape, "classes " + re.sub(r"(.)\1+", r"\1", shape), f"digits {min(len(digits), 20)}", f"signs {min(core.count('@'), 2)}", f"dots {min(core.count('.'), 5)}",
        f"plus {core[:1] == '+'}", f"open {core[:1] == '('}", f"luhn {12 <= len(digits) <= 19 and luhn(digits)} {core == digits}", f"ip {len(parts) == 4 and all(map(_is_byte, parts))}",
        f"mail {bool(re.search(r'[^@]@[^@]+[.][^@]', core))}", "before " + _shape(before), "after " + _shape(after), f"both {_shape(before)} {shape} {_shape(after)}", "bias",
    ]
    return [zlib.crc32(f.encode()) & ((1 << _BITS) - 1) for f in own]


@dataclass
class Graph:
    """Candidate tokens of some texts with their edges."""

    text: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)

    def add(self, number: int, text: str) -> None:
        spans = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        words = [text[a:b] for a, b in spans]
        last, seen = -9, {}
        for k, word in enumerate(words):
            if not any(c.isdigit() and c.isascii() or c == "@" for c in word):
                continue
            core = word.strip(".,;:!?\"'")
            lead = len(word) - len(word.lstrip(".,;:!?\"'"))
            at = len(self.text)
            self.text.append(number)
            self.start.append(spans[k][0] + lead)
            self.end.append(spans[k][0] + lead + len(core))
            self.features.append(_features(words, k))
            chained = last == k - 1
            if chained:
                self.chain.append((at - 1, at))
            last = k
            digits = re.sub(r"[^0-9]", "", core)
            for key in {core.lower(), digits[-7:] if len(digits) >= 7 else core.lower()}:
                if key in seen and not (chained and seen[key] == at - 1):
                    self.skip.append((seen[key], at))
                seen[key] = at


_L = len(KINDS) + 1  # label 0 is none


@dataclass
class Field:
    node: np.ndarray  # features by labels
    chain: np.ndarray  # label by next label
    skip: np.ndarray  # symmetric


def _labels(graph: Graph, spans: dict[int, list[Span]]) -> np.ndarray:
    out = np.zeros(len(graph.text), np.int64)
    for i, (n, a, b) in enumerate(zip(graph.text, graph.start, graph.end, strict=True)):
        for s, kind, e in spans.get(n, []):
            if s < b and a < e:
                out[i] = kind + 1
                break
    return out


def fit(graph: Graph, label: np.ndarray, rounds: int = 150, rate: float = 0.5, l2: float = 1e-4) -> Field:
    """Pseudo-likelihood: each label given its neighbours', by AdaGrad on all tokens."""
    n = len(label)
    model = Field(np.zeros((1 << _BITS, _L)), np.zeros((_L, _L)), np.zeros((_L, _L)))
    if not n:
        model.node[zlib.crc32(b"bias") & ((1 << _BITS) - 1), 0] = 9.0
        return model
    x = np.array(graph.features)
    chain = np.array(graph.chain, np.int64).reshape(-1, 2)
    skip = np.array(graph.skip, np.int64).reshape(-1, 2)
    one = np.eye(_L)[label]
    before, after, like = np.zeros((n, _L)), np.zeros((n, _L)), np.zeros((n, _L))
    before[chain[:, 1]] = one[chain[:, 0]]
    after[chain[:, 0]] = one[chain[:, 1]]
    np.add.at(like, skip[:, 0], one[skip[:, 1]])
    np.add.at(like, skip[:, 1], one[skip[:, 0]])
    seen = [np.full_like(w, 1e-8) for w in (model.node, model.chain, model.skip)]
    for _ in range(rounds):
        s = model.node[x].sum(axis=1) + before @ model.chain + after @ model.chain.T + like @ model.skip
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - one) / n
        node = l2 * model.node
        for c in range(_L):
            node[:, c] += np.bincount(x.ravel(), np.repeat(g[:, c], x.shape[1]), 1 << _BITS)
        both = like.T @ g
        grads = (node, before.T @ g + (after.T @ g).T + l2 * model.chain, (both + both.T) / 2 + l2 * model.skip)
        for w, d, q in zip((model.node, model.chain, model.skip), grads, seen, strict=True):
            q += d * d
            w -= rate * d / np.sqrt(q)
    return model


def beliefs(graph: Graph, model: Field, rounds: int = ROUNDS) -> np.ndarray:
    """Marginals of all tokens by loopy belief propagation, messages of all edges at once until those of a text settle."""
    n = len(graph.text)
    own = model.node[np.array(graph.features, np.int64).reshape(n, -1)].sum(axis=1)
    chain = np.array(graph.chain, np.int64).reshape(-1, 2)
    skip = np.array(graph.skip, np.int64).reshape(-1, 2)
    src = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
    dst = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
    c, k = len(chain), len(skip)
    back = np.concatenate([np.arange(c) + c, np.arange(c), np.arange(k) + 2 * c + k, np.arange(k) + 2 * c])
    weight = np.concatenate([np.broadcast_to(w, (m, _L, _L)) for w, m in ((model.chain, c), (model.chain.T, c), (model.skip, k), (model.skip, k))])
    message = np.zeros((len(src), _L))

    def gathered() -> np.ndarray:
        total = own.copy()
        for x in range(_L):
            total[:, x] += np.bincount(dst, message[:, x], n)
        return total

    text = np.array(graph.text, np.int64)[dst]
    live = np.arange(len(src))
    for _ in range(rounds):
        if not len(live):
            break
        sent = gathered()[src[live]] - message[back[live]]
        new = sent[:, :, None] + weight[live]
        top = new.max(axis=1)
        new = top + np.log(np.exp(new - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        new = 0.5 * message[live] + 0.5 * new
        moves = np.zeros(int(text.max()) + 1, bool)
        moves[text[live[np.abs(new - message[live]).max(axis=1) > SETTLED]]] = True
        message[live] = new
        live = live[moves[text[live]]]
    total = gathered()
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _varied(text: str, spans: list[Span], turn: int) -> tuple[str, list[Span]]:
    """The text with its entities in other spellings, and where they are then."""
    out, marks, at = [], [], 0
    for a, kind, b in spans:
        if a < at:
            continue
        new = text[a:b]
        if kind == 3:
            new = (re.sub(r"^\+[0-9]{1,3}\x20?", "", new), "00" + new[1:], new[1:])[turn % 3]
        elif kind == 2:
            digits = re.sub(r"[^0-9]", "", new)
            new = ".".join(digits[i : i + 4] for i in range(0, len(digits), 4)) if turn % 2 else "/".join(digits[i : i + 4] for i in range(0, len(digits), 4))
        elif kind == 1:
            new = new + ":8080" if turn % 2 else new + "/24"
        out += [text[at:a], new]
        start = sum(map(len, out)) - len(new)
        marks.append((start, kind, start + len(new)))
        at = b
    return "".join(out) + text[at:], marks


def added_spans(graph: Graph, belief: np.ndarray, base: dict[int, list[Span]]) -> dict[int, list[Span]]:
    """Tokens that the field is sure of, neighbours of one kind joined, unless they touch a span of the patterns."""
    label = np.where(belief.max(axis=1) >= SURE, belief.argmax(axis=1), 0)
    follows = {b: a for a, b in graph.chain}
    out: dict[int, list[Span]] = {}
    for i in np.flatnonzero(label):
        n, kind = graph.text[i], int(label[i]) - 1
        own = out.setdefault(n, [])
        if own and follows.get(i) is not None and own[-1][1] == kind and own[-1][2] == graph.end[follows[i]]:
            own[-1] = (own[-1][0], kind, graph.end[i])
        else:
            own.append((graph.start[i], kind, graph.end[i]))
    return {n: [s for s in own if not any(a < s[2] and s[0] < b for a, _, b in base.get(n, []))] for n, own in out.items()}


def find(texts: list[str], model: Field | None) -> tuple[list[list[Span]], list[list[Span]]]:
    """Spans of the patterns, and all spans, of each text."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return base, base
    graph = Graph()
    for n, t in enumerate(texts):
        graph.add(n, t)
    if not graph.text:
        return base, base
    more = added_spans(graph, beliefs(graph, model), dict(enumerate(base)))
    return base, [sorted(b + more.get(n, [])) for n, b in enumerate(base)]


_DIGIT_OR_SIGN = np.zeros(256, bool)
_DIGIT_OR_SIGN[48:58] = True
_DIGIT_OR_SIGN[64] = True


def candidates(texts: pa.Array) -> np.ndarray:
    """Texts with a digit or an at sign; all others are without spans of any kind."""
    data, off = T.raw(texts)
    sums = np.append(0, np.cumsum(_DIGIT_OR_SIGN[data]))
    return np.flatnonzero(sums[off[1:]] > sums[off[:-1]])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: int = TRAIN_TEXTS) -> Field:
    """Weights from at most `texts` texts with a digit or an at sign, of at most `TRAIN_CHARS` characters, with different
    ids, chosen by a hash of the id."""
    docs = T.narrow(docs, (id_col, "doc_id", "bigint"), (text_col, "text", "string"))
    fit_for = F.col("text").rlike("[0-9@]") & (F.length("text") <= TRAIN_CHARS)
    some = T.sampled(docs.select(F.xxhash64("doc_id").alias("at"), "text"), "at", texts, fit_for)
    # Only surroundings of candidates leave the executors: 200 characters on either side.
    cut = some.select("at", F.expr(r"array_join(regexp_extract_all(text, '(?s)(.{0,200}[0-9@].{0,200})', 1), '\n')").alias("text"))
    rows = [r.text for r in sorted(cut.collect())]
    graph, spans = Graph(), {}
    for n, t in enumerate(rows):
        found = base_spans(t)
        for x, (u, s) in enumerate([(t, found), _varied(t, found, n)] if found else [(t, found)]):
            graph.add(2 * n + x, u)
            spans[2 * n + x] = s
    model = fit(graph, _labels(graph, spans))
    del graph, rows
    T.fresh()
    return model


def _each(docs: DataFrame, model: Field, schema: str, row) -> DataFrame:
    """Rows made of a text's (own columns, base spans, all spans)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [x.strip().split()[0] for x in schema.split(",")]

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.fresh()
        for b in batches:
            texts = T.as_strings(b.column("text"))
            for i, j in T.slices(texts):
                part = texts.slice(i, j - i)
                some = candidates(part)
                base, spans = find(part.take(pa.array(some)).to_pylist(), shared.value)
                place = {int(n): k for k, n in enumerate(some)}
                yield row(b.slice(i, j - i), place, base, spans, names)

    return docs.mapInArrow(mapper, schema)


def find_personal_data(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts and digest of the patterns' spans, and all spans."""
    nothing = hashlib.sha256(b"").hexdigest()

    def row(b: pa.RecordBatch, place: dict, base: list, spans: list, names: list[str]) -> pa.RecordBatch:
        n = b.num_rows
        counts = np.zeros((len(KINDS), n), np.int64)
        sha, text, added = [nothing] * n, [""] * n, np.zeros(n, np.int64)
        for i, k in place.items():
            for _, kind, _ in base[k]:
                counts[kind, i] += 1
            if spans[k]:
                sha[i], text[i] = hashlib.sha256(joined(base[k]).encode()).hexdigest(), joined(spans[k])
                added[i] = len(spans[k]) - len(base[k])
        return pa.record_batch([b.column("doc_id"), *[pa.array(c) for c in counts], pa.array(sha), pa.array(text), pa.array(added)], names=names)

    docs = T.narrow(docs, (id_col, "doc_id", "bigint"), (text_col, "text", "string"))
    return _each(docs, model, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", row)


def redact(docs: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span replaced by its kind, as <email>; null texts stay null."""
    kept = [c for c in docs.columns if c != text_col]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("rest"), F.col(f"`{text_col}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.fresh()
        for b in batches:
            texts = T.as_strings(b.column(1))
            for i, j in T.slices(texts):
                part = texts.slice(i, j - i)
                out = part.to_pylist()
                some = candidates(part)
                _, spans = find([out[k] for k in some], shared.value)
                for k, own_spans in zip(some, spans, strict=True):
                    if own_spans:
                        out[k] = _masked(out[k], own_spans)
                nulls = b.column(1).slice(i, j - i).is_null().to_numpy(zero_copy_only=False)
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(out, pa.string(), mask=nulls)], names=["rest", "text"])

    made = own.mapInArrow(mapper, own.schema)
    return made.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def _masked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for a, kind, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        at = b
    return "".join(out) + text[at:]
