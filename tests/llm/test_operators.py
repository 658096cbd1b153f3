"""Operators against brute force, and every odd input: nulls, empty and long texts, repeats, empty tables, clashing columns."""

import hashlib
import html
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm.components import smallest_reachable
from fieldloom.llm import decontaminate, html_crf, packing, pii_crf, quality_forest, simhash_gph, substring_dedup, text as T, token_counts, token_ids, token_store, toxicity_ftrl
from fieldloom.llm.xxh64 import xxh64

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix potions in a quiet hall and nobody asks them why it has to be done before dawn on the last day"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with everything odd, and extra columns that clash with results."""
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    rows = [(1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (None, PROSE), (None, None), (5, "  \n\t "), (6, long), (7, "x"), (8, PROSE.upper() + " é 漢字   z"), (9, long), (9, "other text of the same id")]
    df = spark.createDataFrame([(a, b, "en", None, 1, 0.5, "k", True, 7) for a, b in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, kept boolean, grp int")
    return df


def _empty(df):
    return df.where("false")


def _texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


# Word helpers.

letters = st.text(alphabet="ab é\n\t\x0b漢", max_size=14)


@settings(max_examples=150, deadline=None)
@given(st.lists(letters, max_size=6))
def test_words_and_windows(texts):
    w = T.words(T.as_strings(pa.array([*texts, None], pa.string())))
    want = [WORD.findall(t) for t in [*texts, ""]]
    first = w.first
    got = [[w.buf[w.start[j] : w.end[j]].tobytes().decode() for j in range(first[i], first[i + 1])] for i in range(len(want))]
    assert got == want
    _, prints = T.windows(w, 2)
    pairs = [tuple(x[j : j + 2]) for x in want for j in range(len(x) - 1)]
    assert [a == b for a in pairs for b in pairs] == [bool(a == b) for a in prints for b in prints]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 40))
def test_xxh64(data, start):
    buf = np.frombuffer(data, np.uint8)
    a = np.array([min(start, len(buf)), 0])
    b = np.array([len(buf), len(buf)])
    assert [int(x) for x in xxh64(buf, a, b)] == [xxhash.xxh64_intdigest(data[i:j], seed=42) for i, j in zip(a, b)]


# 1: main text.


def test_html_layouts_and_odd_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    model = html_crf.train(pages)
    got = {r.page_id: r.text for r in html_crf.extract_text(pages, model).collect()}
    for r in pages.collect():
        body = r.html[r.html.find("<article>") + 9 :].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)
    odd = spark.createDataFrame([(1, None, None, 5), (2, "u", "", 5), (None, "u", "<p", 5), (3, "u", "<<<>>&amp;<script>x", 5), (3, "u", "<div>" * 3000 + "deep", 5), (4, "u", "<!-- open", 5)], "page_id long, url string, html string, n_chars int")
    out = html_crf.extract_text(odd, model).collect()
    assert len(out) == 6 and all(r.n_chars == len(r.text) for r in out)
    assert html_crf.extract_text(_empty(odd), model).count() == 0
    html_crf.extract_text(odd, html_crf.train(_empty(odd))).collect()
    page = '<body><nav><a href=x>Home</a></nav><div class="content"><p>A first paragraph, with enough words to be one.</p><p>And a second paragraph &amp; more words.</p></div><div class="comments"><p>I liked it a lot, thanks for this.</p></div><div class="footer">(c) someone</div></body>'
    assert html_crf.Extractor(model)(page).split("\n\n") == ["A first paragraph, with enough words to be one.", "And a second paragraph & more words."]


def test_text_inside_articles_is_kept(spark, sf):
    model = html_crf.train(spark.read.parquet(f"{sf}/pages.parquet"))
    extract = html_crf.Extractor(model)
    lead, end = "A first paragraph, with enough words to be one.", "And a second paragraph with quite some words, too."
    page = lambda x: f"<body><article><p>{lead}</p>{x}<p>{end}</p></article></body>"
    want = lambda *x: "\n\n".join([lead, *x, end])
    assert extract(page("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>E=mc^2</annotation></math> always, in all of these cases.</p>")) == want("Energy is E=mc2 always, in all of these cases.")
    assert extract(page("<p>One block that a script <script>var a = '<p>';</script> stands in, and a style <STYLE>p {}</Style>, as well.</p>")) == want("One block that a script stands in, and a style , as well.")
    assert extract(page("<p>" + "İ" * 40 + " are long when in lower case, aren't they?</p><script>x</script>")) == want("İ" * 40 + " are long when in lower case, aren't they?")
    assert extract(page("<div>" * 500 + "<p>However deep a paragraph lies, it is still a paragraph.</p>" + "</div>" * 500)) == want("However deep a paragraph lies, it is still a paragraph.")
    talk = html_crf.blocks('<article><p>a</p><article class="comment"><p>b</p></article><section id="comments"><p>c</p></section><footer>d</footer></article><p>e</p>')
    assert [b.marked for b in talk] == [True, False, False, False, False]


def test_layouts_with_names_that_were_not_seen(spark):
    """Weights of layouts from one half of all names, held against layouts from the other half."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").limit(120).collect()]
    model = html_crf.fit(html_crf.labelled(pages[:60], slice(0, None, 2)))
    right = found = true = 0
    for p in html_crf.labelled(pages[60:], slice(1, None, 2)):
        score = [float(model.node[html_crf.path_features(b) + html_crf.text_features(b)].sum()) for b in p]
        on = html_crf.viterbi(score, model)
        right += sum(a and b.gold for a, b in zip(on, p))
        found, true = found + sum(on), true + sum(b.gold for b in p)
    assert right / found > 0.9 and right / true > 0.8, (right / found, right / true)


def test_gradient_of_the_chain():
    """Fitting climbs the likelihood that brute force gives."""
    mark = lambda k, gold: html_crf.Block(f"text {k}.", ("p", f"w{k}"), "div", frozenset(["in div", f"word w{k}"]), 0, gold, False)
    pages = [[mark(0, True), mark(1, False), mark(2, True)], [mark(1, False), mark(0, True)], [mark(2, False)]]

    def likelihood(model):
        total = 0.0
        for p in pages:
            score = [model.node[html_crf.path_features(b) + html_crf.text_features(b)].sum() for b in p]
            value = lambda y: model.first[y[0]] + sum(s * a for s, a in zip(score, y)) + sum(model.step[a, b] for a, b in zip(y, y[1:]))
            total += value([int(b.gold) for b in p]) - np.logaddexp.reduce([value(y) for y in np.ndindex(*[2] * len(p))])
        return total

    # One small step of the rounds goes along the gradient: sign by sign, as finite differences have it.
    model = html_crf.fit(pages, rounds=1, rate=1e-3, l2=0.0)
    zero = html_crf.Chain(np.zeros_like(model.node), np.zeros((2, 2)), np.zeros(2))
    base = likelihood(zero)
    for name in ("node", "step", "first"):
        moved = getattr(model, name)
        for at in list(zip(*np.nonzero(moved)))[:12]:
            probe = html_crf.Chain(zero.node.copy(), zero.step.copy(), zero.first.copy())
            getattr(probe, name)[at] = 1e-5
            slope = (likelihood(probe) - base) / 1e-5
            assert np.sign(slope) == np.sign(moved[at]) or abs(slope) < 1e-4, (name, at, slope)
    assert likelihood(html_crf.fit(pages, rounds=200, l2=0.0)) > likelihood(html_crf.fit(pages, rounds=5, l2=0.0)) > base


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 7))
        score, model = rng.normal(size=n), html_crf.Chain(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))

        def value(path):
            return model.first[path[0]] + sum(score[k] * path[k] for k in range(n)) + sum(model.step[path[k], path[k + 1]] for k in range(n - 1))

        best = max(([int(b) for b in np.binary_repr(k, n)] for k in range(1 << n)), key=value)
        assert html_crf.viterbi(score.tolist(), model) == [bool(b) for b in best]


# 2: repeated passages.


def _removed(rows, width=20):
    seen, out = {}, []
    for doc, text in rows:
        w = WORD.findall(text or "")
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            seen[key] = min(seen.get(key, (doc, s)), (doc, s))
    for doc, text in rows:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if seen[tuple(w[s : s + width])] < (doc, s):
                gone[s : s + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        runs = [(k, next((j for j in range(k, len(w)) if not gone[j]), len(w))) for k in range(len(w)) if gone[k] and not (k and gone[k - 1])]
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept, runs))
    return sorted(out)


@pytest.mark.parametrize("group", [2_000_000, 300])
def test_repeats_against_brute_force(spark, sf, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)  # few: prefixes of many words
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 20_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    if group == 300:
        heavy = substring_dedup.heavy_prefixes(docs, 20, sum(len(t.encode()) for _, t in rows))
        assert 1 in heavy and 2 in heavy
    got = sorted((*tuple(r)[:5], [tuple(x) for x in r.removed]) for r in substring_dedup.remove_repeated_passages(docs).collect())
    assert got == _removed(rows)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=60), min_size=1, max_size=6))
def test_repeats_of_few_words(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted((*tuple(r)[:5], [tuple(x) for x in r.removed]) for r in substring_dedup.remove_repeated_passages(docs, width=3).collect())
    assert got == _removed(list(enumerate(texts)), 3)


def test_repeats_of_structured_words(spark):
    """Words that a polynomial hash modulo a power of two takes for each other."""
    x, y = thue_morse()
    other = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{x} {other}"), (2, f"{y} {other}"), (3, f"{x} {other}"), (4, " ".join(x)), (5, " ".join(y))]
    got = sorted((*tuple(r)[:5], [tuple(x) for x in r.removed]) for r in substring_dedup.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == _removed(rows) and [r[2] for r in got[:3]] == [0, 0, 20]


def test_chance_only_costs_suffixes():
    """With fingerprints of one bit for pruning nearly all suffixes are sent; the result stays."""
    docs = pa.table({"doc_id": [1, 2, 3], "null": [False] * 3, "row_key": [5, 6, 7], "text": ["a b c d a b c d", "x a b c y", "q r s t"], "block": [0, 0, 0]})
    heavy = type("Shared", (), {"value": {}})
    blocks = [docs.slice(0, 1), docs.slice(1, 2)]
    key = lambda k: (pa.scalar(k),)
    for low in (0xFFFFFFFF, 1):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(substring_dedup, "_LOW", np.uint64(low))
            learned = substring_dedup.shared(key(0), pa.concat_tables([substring_dedup.announce(3, heavy, 1)(key(k), t) for k, t in enumerate(blocks)]))
            own = lambda k: learned.filter(pa.array([b == k for b in learned.column("block").to_pylist()]))
            rows = pa.concat_tables([substring_dedup.send(3, heavy, 1, False)(key(k), t, own(k)) for k, t in enumerate(blocks)])
        by = lambda t, c, v: t.filter(pa.array([x == v for x in t.column(c).to_pylist()]))
        found = pa.concat_tables([substring_dedup.repeats(3)(key(0), by(rows, "kind", 0)), by(rows, "kind", 1).select(["block", "payload"])])
        for k, want in enumerate(([4], [3, 0])):
            assert substring_dedup.keep_words(3, True)(key(k), blocks[k], by(found, "block", k)).column("n_removed").to_pylist() == want


def test_common_prefix_lengths():
    rng = np.random.default_rng(4)
    for width in (1, 4, 5):
        m = rng.integers(0, 3, (60, width)).astype(np.int32)
        order, common = substring_dedup.leaves(m)
        s = [tuple(x) for x in m[order].tolist()]
        assert s == sorted(s) and common[0] == 0
        assert all(n == next((k for k in range(width) if a[k] != b[k]), width) for a, b, n in zip(s, s[1:], common[1:].tolist()))


def test_repeats_odd_input(spark, odd):
    out = substring_dedup.remove_repeated_passages(odd)
    got = [(r.doc_id, r.n_words, r.n_removed) for r in out.collect()]
    n = len(PROSE.split())
    assert len(got) == odd.count()
    assert got.count((2, n, n)) == 2 and (1, n, n) in got and (None, n, 0) in got  # null ids come first
    assert substring_dedup.remove_repeated_passages(_empty(odd)).count() == 0
    # Rows of one id, or of none, with different texts are documents of their own: unique text stays, a copied passage goes once.
    lead = [" ".join(f"own{k}w{j}" for j in range(25)) for k in range(4)]
    rows = [(i, f"{lead[k]} {PROSE}") for i in (None, 7) for k in range(2)] + [(None, lead[2]), (7, lead[3])]
    kept = substring_dedup.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), width=20).collect()
    assert sorted(r.n_removed for r in kept) == [0, 0, 0, n, 25 + n, 25 + n] and all(r.n_removed == 0 for r in kept if r.n_words == 25)


# 3: quality.


def test_statistics_against_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["", "a\na\n\na b\n", "x y z x y z", " \n \n", "é" * 5 + "\n" + "é" * 5]

    def one(t):
        w = WORD.findall(t)
        lines, dup = [x for x in t.split("\n") if WORD.search(x)], 0
        for k, x in enumerate(lines):
            dup += x in lines[:k]
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 400 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
        marked = {k + j for k, g in enumerate(grams) if g in twice for j in range(3)}
        return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked), len(lines)]

    got = quality_forest.statistics(T.as_strings(pa.array(texts, pa.string())))
    assert got[:, :6].tolist() == [one(t) for t in texts]


def test_forest_against_brute_force():
    rng = np.random.default_rng(8)
    good, low, high = rng.normal(size=(300, 3)), np.full(3, -6.0), np.array([6.0, 6.0, -6.0])
    forest = quality_forest.grow(good, low, high)
    assert not (forest.feature == 2).any()  # a trait without a range is never split

    def path(x, at, depth=0):
        f = forest.feature[at]
        return forest.path[at] if f < 0 else path(x, forest.left[at] + (x[f] >= forest.split[at]), depth + 1)

    x = np.concatenate([rng.normal(size=(20, 3)), np.full((1, 3), 5.5)])
    want = [2.0 ** (-np.mean([path(r, root) for root in forest.roots]) / quality_forest._average_path(256)) for r in x]
    got = quality_forest.anomaly(forest, x)
    assert np.allclose(got, want) and got.argmax() == 20
    # Leaves: the depth, and what a search among the rows that a leaf keeps would still take.
    for root in forest.roots[:5]:
        todo = [(root, 0)]
        while todo:
            at, depth = todo.pop()
            if forest.feature[at] < 0:
                assert depth <= quality_forest.DEPTH and forest.path[at] >= depth
            else:
                todo += [(forest.left[at], depth + 1), (forest.left[at] + 1, depth + 1)]


def test_all_statistics_count():
    texts = ["one two three four. " * 5 + "\n", "a line\n" * 60, " ".join(f"w{k}" for k in range(90)), " ".join(f"{k}" for k in range(90))]
    x = quality_forest.traits(quality_forest.statistics(T.as_strings(pa.array(texts))))
    base = quality_forest.statistics(T.as_strings(pa.array(["some plain text of words"])))
    for k, name in enumerate(quality_forest.COUNTS):
        more = base.copy()
        more[0, k] += 3
        assert (quality_forest.traits(more) != quality_forest.traits(base)).any(), name
    assert np.isfinite(x).all()


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    test = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    forest = quality_forest.train(docs, labels.where(~test))
    out = quality_forest.judge(docs, forest).join(labels.where(test), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg(F.col("base_failed").cast("int")).alias("failed")).collect()
    by = {r.quality: r for r in out}
    assert by[0].kept < 0.05
    assert by[1].kept > 0.98 * (1 - by[1].failed)


def test_quality_odd_input(spark, odd, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert quality_forest.train(_empty(odd), labels) is None
    out = quality_forest.judge(odd, None).collect()
    assert len(out) == odd.count() and all(r.base_failed for r in out if r.n_words < 50)
    assert quality_forest.judge(_empty(odd), None).count() == 0


# 4: personal data.


def _plain(text):
    out = []
    for k, p in enumerate([re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), pii_crf._IP, pii_crf._CARD, pii_crf._PHONE]):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(digits) <= 19 and pii_crf.luhn(digits), 9 <= len(digits) <= 15)[k]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b@", "@", ".", "-", "+", "1", "23", "4", " ", "(", ")", "com", "%", "é", "4111111111111111", "255", "0", "\n", "+1 (988) 555-2485", "٣", "²", "①"]), max_size=18).map("".join))
def test_patterns(text):
    assert pii_crf.base_spans(text) == _plain(text)


def test_personal_data(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pii_crf.train(docs)
    text = "Call (988) 555-2485 or +1 (988) 555-2485 about 4111.1111.1111.1111, version 4.0 of 1998; write to me@x.org."
    base, spans = pii_crf.find([text], model)
    assert set(base[0]) <= set(spans[0]) and base[0] == _plain(text)
    assert {text[a:b] for a, _, b in spans[0]} == {"(988) 555-2485", "+1 (988) 555-2485", "4111.1111.1111.1111", "me@x.org"}
    out = pii_crf.find_personal_data(docs, model)
    rows = out.where("n_added > 0 or n_email + n_ip + n_card + n_phone > 0").join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        want = _plain(r.text)
        assert r.base_sha256 == hashlib.sha256(pii_crf.joined(want).encode()).hexdigest()
        assert set(pii_crf.joined(want).split(",")) - {""} <= set(r.spans.split(","))
    assert sum(r.n_added for r in rows) < 0.02 * len(rows)  # clean numbers are left alone
    assert pii_crf.find_personal_data(odd, model).count() == odd.count()
    assert pii_crf.find_personal_data(_empty(odd), pii_crf.train(_empty(odd))).count() == 0
    assert sorted(pii_crf.redact(odd, model).columns) == sorted(odd.columns)
    assert _texts(pii_crf.redact(odd.select("doc_id", "text"), model)) == _texts(odd)


def test_digits_beyond_ascii(spark):
    texts = ["foot 1.2.3.² and", "10.0.0.① 1.2.3.٣", "٣٣٣٣ 4111-1111-1111-111١ ②@x.org", "9" * 4000 + ".1.1.1"]
    model = pii_crf.train(spark.createDataFrame([(k, t + f" call +1 (988) 555-248{k} or mail a{k}@b.org") for k, t in enumerate(texts)], "doc_id long, text string"))
    base, spans = pii_crf.find(texts, model)
    assert [pii_crf.joined(b) for b in base] == [pii_crf.joined(_plain(t)) for t in texts]
    assert all(set(b) <= set(s) for b, s in zip(base, spans))


def test_distant_repeats_are_linked():
    g = pii_crf.Graph()
    g.add(0, "call 5551234567 or later and once more 5551234567 then 5551234567 5551234567")
    assert g.chain == [(2, 3)] and set(g.skip) == {(0, 1), (1, 2)}


def test_messages_settle():
    n, L = 40, pii_crf._L
    g = pii_crf.Graph(text=[0] * n + [3] * 2, start=[0] * (n + 2), end=[1] * (n + 2), features=[[0]] + [[1]] * (n + 1), chain=[(k, k + 1) for k in range(n - 1)] + [(n, n + 1)])
    node = np.zeros((1 << pii_crf._BITS, L))
    node[0, 2] = 9
    model = pii_crf.Field(node, 5 * np.eye(L), np.zeros((L, L)))
    got = pii_crf.beliefs(g, model)
    step = np.exp(5 * np.eye(L))
    want = np.exp(node[0]) @ np.linalg.matrix_power(step / step.sum(axis=1), n - 1)
    assert np.allclose(got[n - 1], want / want.sum(), atol=1e-4) and np.allclose(got[n:], 1 / L)


def test_belief_propagation_is_exact_on_trees():
    rng = np.random.default_rng(1)
    g = pii_crf.Graph(text=[0] * 4, start=[0] * 4, end=[1] * 4, features=[[0], [1], [2], [3]], chain=[(0, 1), (1, 2)], skip=[(1, 3)])
    L = pii_crf._L
    node = np.zeros((1 << pii_crf._BITS, L))
    node[:4] = rng.normal(size=(4, L))
    skip = rng.normal(size=(L, L))
    model = pii_crf.Field(node, rng.normal(size=(L, L)), (skip + skip.T) / 2)
    got = pii_crf.beliefs(g, model, rounds=60)
    want = np.zeros((4, L))
    for y in np.ndindex(L, L, L, L):
        p = np.exp(sum(node[k, y[k]] for k in range(4)) + model.chain[y[0], y[1]] + model.chain[y[1], y[2]] + model.skip[y[1], y[3]])
        for k in range(4):
            want[k, y[k]] += p
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-6)


# 5: toxicity.


def test_ftrl_against_brute_force():
    rng = np.random.default_rng(6)
    rows = [(int(rng.random() < 0.4), np.unique(rng.integers(0, 30, 6)).astype(np.int32)) for _ in range(80)]
    alpha, beta, l1, l2 = 0.7, 1.5, 0.3, 0.2
    got = toxicity_ftrl.fit(rows, alpha, beta, l1, l2, epochs=3)
    z, n, bias, bias_n = [0.0] * 30, [0.0] * 30, -1.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for y, x in rows:
            w = {i: weight(i) for i in x.tolist()}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - y
            for i in w:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
            bias_n += g * g
            bias -= alpha * g / (beta + math.sqrt(bias_n))
    want = {i: weight(i) for i in range(30) if weight(i)}
    assert dict(zip(got.place.tolist(), got.weight.tolist())) == pytest.approx(want, rel=1e-5) and math.isclose(got.bias, bias)


def test_features_and_scores_against_brute_force():
    texts = ["The cat's PAWS, and the\tdog", "", "ünïcode wörds únder test", "one"]
    place = lambda x: int(T.mixed(np.array([x], np.uint64))[0] >> np.uint64(64 - toxicity_ftrl.BITS))
    h = lambda b: xxhash.xxh64_intdigest(b, seed=42)
    salt, full = [int(x) for x in toxicity_ftrl._SALT], (1 << 64) - 1
    want = []
    for t in texts:
        w = re.findall(rb"[0-9a-z\x80-\xff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode())
        own = {place(h(x)) for x in w}
        own |= {place(h(x[:k]) * salt[i] & full) for x in w for i, k in enumerate((3, 4, 5)) if len(x) > k}
        own |= {place((h(a) * salt[3 + i] + h(b)) & full) for i, gap in enumerate((1, 2, 3)) for a, b in zip(w, w[gap:])}
        want.append(own)
    a = T.as_strings(pa.array(texts))
    got = [set() for _ in texts]
    for doc, at in toxicity_ftrl._features(a):
        for d, p in zip(doc.tolist(), at.tolist()):
            got[d].add(p)
    assert got == want
    model = toxicity_ftrl.Weights(np.array(sorted(want[0])[:9], np.int32), np.linspace(-1, 1, 9).astype(np.float32), 0.25)
    table = dict(zip(model.place.tolist(), model.weight.tolist()))
    assert np.allclose(toxicity_ftrl.score(a, model), [1 / (1 + math.exp(-(0.25 + sum(table.get(p, 0.0) for p in own)))) for own in want])


def test_toxicity_held_out(spark, odd):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity_ftrl.train(docs, labels)
    assert len(model.place) < 20_000
    out = toxicity_ftrl.score_toxicity(docs, model)
    rows = out.where("held_out").join(labels, "doc_id").select("doc_id", "score", "predicted", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good, bad = [r.score for r in rows if not r.toxic], [r.score for r in rows if r.toxic]
    auc = np.mean([[(b > g) + 0.5 * (b == g) for g in good] for b in bad])
    assert auc > 0.97
    assert np.mean([r.predicted for r in rows if not r.toxic]) < 0.005
    res = toxicity_ftrl.score_toxicity(odd, model).collect()
    assert len(res) == odd.count() and all(0 <= r.score <= 1 for r in res)
    assert toxicity_ftrl.score_toxicity(_empty(odd), toxicity_ftrl.train(_empty(odd), labels)).count() == 0


# 6: benchmark passages.


def _cover(doc, item, least=3):
    items = decontaminate.items_of([0], T.as_strings(pa.array([item])), least)
    return max((c for _, _, c in decontaminate.coverages(T.as_strings(pa.array([doc])), items)), default=0.0)


def _greedy(doc, item, least):
    """Greedy string tiling token by token."""
    a, b = re.findall(r"[^\W_]+", doc.lower()), re.findall(r"[^\W_]+", item.lower())
    used, done, covered = set(), set(), 0
    least = min(least, len(b))
    while least:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used and j + n not in done:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            break
        used |= set(range(i, i + n))
        done |= set(range(j, j + n))
        covered += n
    return covered / max(1, len(b))


def test_tiling():
    item = "a b c d e f g h i j"
    assert _cover("x a b c d e f g h i j y", item) == 1.0
    assert _cover("f g h i j x x a b c d e", item) == 1.0  # in another order
    assert _cover("a b c d x x x a b c d", item) == 0.4  # a tile is marked once
    assert _cover("a b x c d x e f", item) == 0.0
    assert _cover("so it is yes no or", "yes no", 5) == 1.0 and _cover("no yes", "yes no", 5) == 0.0  # short items are seeds of their own length
    assert sorted(n for _, _, n in decontaminate.tile([(4, 0, 0), (2, 10, 1)], 12, 6, 2)) == [4]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=12), st.integers(1, 4))
def test_tiling_against_brute_force(doc, item, least):
    assert _cover(" ".join(doc), " ".join(item), least) == pytest.approx(_greedy(" ".join(doc), " ".join(item), least))


def test_tiling_of_repeated_words(monkeypatch):
    monkeypatch.setattr(decontaminate, "PAIRS", 1000)  # matches that go on from one part of the pairs to the next
    assert _cover("a " * 5000, "a " * 200, 5) == 1.0
    assert _cover("a " * 50 + "b", "a " * 200, 5) == 0.25
    assert _cover("x y a b c d e f " * 30, "a b c d e f g h " * 3, 5) == pytest.approx(_greedy("x y a b c d e f " * 30, "a b c d e f g h " * 3, 5))


def test_contamination(spark, sf, odd, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    planted = bench.limit(3).select((F.col("item_id") + 900_000).alias("doc_id"), F.concat(F.lit("Some words before. "), F.upper("text"), F.lit(" and some after")).alias("text"))
    both = docs.select("doc_id", "text").unionByName(planted)
    got = sorted(map(tuple, decontaminate.contamination(both, bench).collect()), key=lambda r: r[0])
    hit = {r[0]: r[3] for r in got if r[4]}
    assert {r.doc_id for r in planted.collect()} <= set(hit)
    for r in docs.collect():
        w = re.findall(r"[^\W_]+", r.text.lower())
        inside = [b.item_id for b in bench.collect() if re.findall(r"[^\W_]+", b.text.lower()) == w or f" {' '.join(re.findall(r'[^\W_]+', b.text.lower()))} " in f" {' '.join(w)} "]
        assert set(inside) <= set(hit.get(r.doc_id, []))
    kept = decontaminate.without_contaminated(both, bench)
    assert kept.columns == both.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in got if not r[4]}
    monkeypatch.setattr(decontaminate, "SHARED_BYTES", 2000)  # the same in blocks of items
    assert len(decontaminate._blocks(bench.select("item_id", "text"))) > decontaminate.BLOCKS_AT_ONCE
    again = sorted(map(tuple, decontaminate.contamination(both, bench).collect()), key=lambda r: r[0])
    assert again == got
    assert {r.doc_id for r in decontaminate.without_contaminated(both, bench).collect()} == {r[0] for r in got if not r[4]}
    monkeypatch.undo()
    assert decontaminate.contamination(odd, bench).count() == odd.count()
    assert decontaminate.contamination(_empty(odd), bench).count() == 0
    assert not decontaminate.contamination(odd, _empty(bench)).where("contaminated").count()


# 7, 9, 10: tokens.

TOKENS = st.lists(st.sampled_from(["a", "b", "the", " ", "  ", "\n", " ", "　", " ", "é", "é", "漢", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "1", "23", ".", "###", "\x0b", "\x1c", "\u0085", "Σ", "İ", "ΑΣ ", "\U0001f600", "\r\n", "\t", "ing", "aaaa"]), max_size=16).map("".join)


@pytest.fixture(scope="module")
def libraries():
    return {n: (vocabularies.path(n), tokenizers.Tokenizer.from_file(vocabularies.path(n))) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


@settings(max_examples=200, deadline=None)
@given(st.lists(TOKENS, min_size=1, max_size=4))
def test_counts_and_ids_are_the_librarys(libraries, texts):
    a = T.as_strings(pa.array(texts, pa.string()))
    for name, (path, library) in libraries.items():
        ids, n = token_ids.encoder(path).encode(a)
        ends = np.append(0, np.cumsum(n))
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [ids[x:y].tolist() for x, y in zip(ends[:-1], ends[1:])] == want
        if name.startswith("word"):
            if path not in token_counts._counters:
                token_counts._counters[path] = token_counts.Counter(path)
            assert token_counts._counters[path].count(a).tolist() == [len(x) for x in want]


def test_known_starts_anew(libraries):
    path, library = libraries["word_bpe_49k.json"]
    e = token_ids.Encoder(path)
    e.known = token_ids.Known(bits=4)
    e._clear()
    for k in range(30):
        texts = [f"alpha{k} beta{k * 7} gamma{k % 5}", "one two three four five six seven eight nine ten eleven twelve"]
        ids, n = e.encode(T.as_strings(pa.array(texts)))
        assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]


def test_equal_fingerprints_are_told_apart(libraries, monkeypatch):
    path, library = libraries["word_bpe_49k.json"]
    monkeypatch.setattr(T, "xxh64", lambda buf, start, end: np.full(len(start), 7, np.uint64))
    e = token_ids.Encoder(path)
    for texts in (["alpha beta gamma delt"], ["beta alpha nine alphx"], ["delt gamma zeta alpha"]):
        assert e.encode(T.as_strings(pa.array(texts)))[0].tolist() == library.encode(texts[0], add_special_tokens=False).ids


def thue_morse(n=1024):
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_structured_words_do_not_collide(libraries):
    x, y = thue_morse()
    w = T.words(T.as_strings(pa.array([x, y])))
    assert len(set(T.prints(w).tolist())) == 2
    for path, library in libraries.values():
        e = token_ids.Encoder(path)
        for t in (x, y):
            assert e.encode(T.as_strings(pa.array([t])))[0].tolist() == library.encode(t, add_special_tokens=False).ids
    a, b = " ".join(x), " ".join(y)
    assert len(set(T.windows(T.words(T.as_strings(pa.array([a, b]))), 1024)[1].tolist())) == 2


def test_token_counts_odd_input(spark, odd, libraries):
    path, library = libraries["word_bpe_49k.json"]
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd, path).collect())
    want = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids), len(library.encode(t or "", add_special_tokens=False).ids) > 2048) for _, t in _texts(odd))
    assert got == want
    assert token_counts.count_tokens(_empty(odd), path).count() == 0


@pytest.mark.parametrize("room", [packing.Room(), packing.Room(documents=3), packing.Room(rule="dot"), packing.Room(tokens=1000, documents=90, tiles=70), packing.Room(documents=1024, tiles=1024)])
def test_pack_keeps_every_constraint(room):
    rng = np.random.default_rng(3)
    lengths = np.sort(np.append(rng.integers(1, room.tokens + 1, 300), rng.integers(1, 20, 300)))[::-1]
    where, offset = packing.pack(lengths, room)
    left, best = [], []  # plain best fit: all sequences, every room
    for n in lengths.tolist():
        want = [Fraction(n, room.tokens), Fraction(1, room.documents), Fraction((-(-n // 128)) ** 2, room.tiles)]
        weights = [Fraction(str(w)) for w in room.weights]
        found = [(sum(w * (x - y) ** 2 if room.rule == "norm" else -w * x * y for w, x, y in zip(weights, rest, want, strict=True)), k) for k, rest in enumerate(left) if all(x >= y for x, y in zip(rest, want, strict=True))]
        k = min(found)[1] if found and n < room.tokens else len(left)
        left += [[Fraction(1)] * 3] if k == len(left) else []
        left[k] = [x - y for x, y in zip(left[k], want, strict=True)]
        best.append(k)
    assert best == where.tolist()
    for s in np.unique(where):
        own = lengths[where == s]
        assert own.sum() <= room.tokens and len(own) <= room.documents and ((-(-own // 128)) ** 2).sum() <= room.tiles
        assert offset[where == s].tolist() == (np.cumsum(own) - own).tolist()


def _check_packed(rows, ids, most=4096):
    want = {}
    for d, x in ids.items():
        for p in range(-(-len(x) // most)):
            cut = x[p * most : (p + 1) * most]
            want[d, p] = (p * most, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= most
    return len(by), sum(n for _, n, _ in want.values())


def test_packing(spark, sf, odd, libraries, monkeypatch):
    path, library = libraries["word_bpe_49k.json"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
    n, total = _check_packed(packing.pack_documents(docs, path).collect(), ids)
    assert n <= -(-total // 4096) + 1
    monkeypatch.setattr(packing, "GROUP_TOKENS", 20_000)  # many groups, and a second round
    n, total = _check_packed(packing.pack_documents(docs, path).collect(), ids)
    assert n <= 1.03 * total / 4096 + 2
    empty = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    monkeypatch.undo()
    assert packing.pack_documents(empty, path).select("sequence_id").distinct().count() == 3
    rows = packing.pack_documents(odd, path).collect()
    assert sum(r.piece == 0 for r in rows) == odd.count()
    assert packing.pack_documents(_empty(odd), path).count() == 0


def test_store(spark, sf, odd, libraries, tmp_path, monkeypatch):
    path, library = libraries["byte_bpe_50k.json"]
    monkeypatch.setattr(token_store, "SHARD_IDS", 3000)
    monkeypatch.setattr(token_store, "BUCKET_KEYS", 16)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    token_store.write_store(docs, f"file://{tmp_path}/a", path)
    at, full = 0, {}
    got = {r.doc_id: r for r in token_store.read_store(spark, f"file://{tmp_path}/a").collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 2]
        full[r.doc_id] = ids
        g = got.pop(r.doc_id)
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got
    by_key = token_store.documents_of(docs, f"file://{tmp_path}/a")
    assert sorted(map(tuple, by_key.collect())) == sorted(map(tuple, token_store.read_store(spark, f"file://{tmp_path}/a").collect()))
    found = {r.doc_id: r.ids for r in token_store.lookup(spark.range(-50, 5000).toDF("doc_id"), f"file://{tmp_path}/a").collect()}
    assert found == {k: v for k, v in full.items() if -50 <= k < 5000}
    token_store.write_store(odd, f"file://{tmp_path}/b", path)
    assert token_store.read_store(spark, f"file://{tmp_path}/b").count() == odd.count()
    twice = token_store.lookup(spark.createDataFrame([(2,), (9,), (77,), (None,)], "doc_id long"), f"file://{tmp_path}/b").collect()
    assert sorted(r.doc_id for r in twice) == [2, 2, 9, 9]
    nulls = token_store.read_store(spark, f"file://{tmp_path}/b", nulls_only=True)
    every = token_store.documents_of(odd, f"file://{tmp_path}/b").unionByName(nulls)
    plain = lambda df: sorted(map(tuple, df.collect()), key=lambda r: (r[1], r[2]))
    assert plain(every) == plain(token_store.read_store(spark, f"file://{tmp_path}/b")) and nulls.count() == 2
    monkeypatch.setattr(token_store, "SHARD_IDS", 1)  # rows of one id in many shards and parts
    monkeypatch.setattr(token_store, "SLICE_BYTES", 1)
    hot = spark.createDataFrame([(7, f"text {k} " + "x " * k) for k in range(60)] + [(8, "y")], "doc_id long, text string")
    token_store.write_store(hot, f"file://{tmp_path}/d", path)
    assert token_store.lookup(spark.createDataFrame([(7,), (9,)], "doc_id long"), f"file://{tmp_path}/d").count() == 60
    assert plain(token_store.documents_of(hot, f"file://{tmp_path}/d")) == plain(token_store.read_store(spark, f"file://{tmp_path}/d"))
    token_store.write_store(_empty(odd), f"file://{tmp_path}/c", path)
    assert token_store.read_store(spark, f"file://{tmp_path}/c").count() == 0
    assert token_store.lookup(spark.range(3).toDF("doc_id"), f"file://{tmp_path}/c").count() == 0
    assert token_store.documents_of(spark.range(3).toDF("doc_id"), f"file://{tmp_path}/c").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 500, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 50, n, replace=False).astype(np.int64)
    seeds, slots = token_store.perfect_hash(keys)
    assert sorted(slots) == list(range(n))
    assert (token_store.slot_of(keys, seeds, n) == slots).all()


# 8: near-duplicates.


def _groups(rows):
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    prints = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(s)))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                up[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        r = root(k)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or 0)
    return sorted(((d, f"{prints[k]:016x}", least[root(k)]) for k, (d, _) in enumerate(rows)), key=key), key


@pytest.mark.parametrize("bucket, groups", [(32, None), (1, None), (32, [(0xFFFFFFFF, 1), (0xFFFFFFFF << 32, 0)]), (1, [(0xFFFFFFFF, 1), (0xFFFFFFFF << 32, 0)])])
def test_near_duplicates(spark, sf, odd, monkeypatch, bucket, groups):
    monkeypatch.setattr(simhash_gph, "BUCKET", bucket)
    if groups:
        monkeypatch.setattr(simhash_gph, "plan", lambda *_: groups)
    near = [(1000 + k, PROSE + " " + " ".join(f"tail{j + (k > 5)}" for j in range(300)) + f" end{k}") for k in range(12)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    for df in (docs, odd):
        want, key = _groups([(r.doc_id, r.text) for r in df.collect()])
        got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_gph.near_duplicates(df).collect()), key=key)
        assert got == want
    assert simhash_gph.near_duplicates(_empty(odd)).count() == 0


def test_thresholds_cover_the_radius():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for m in (1, 2, 3, 4):
        masks = simhash_gph.bit_groups(fps, m)
        assert sum(masks) == (1 << 64) - 1
        _, t = simhash_gph.thresholds(fps, masks, 2, 10_000)
        assert sum(t) == 2 - m + 1


def _sets(rows):
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    words = [WORD.findall((t or "").translate(lower)) for _, t in rows]
    return [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]


def _similar_pairs(sets):
    """All pairs with a Jaccard of 0.8 or more, by shingles that they share."""
    at, out = {}, {(i, j) for i in range(len(sets)) for j in range(i) if not sets[i] and not sets[j]}
    for k, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(k)
    near = {(i, j) for own in at.values() for i in own for j in own if j < i}
    return out | {(i, j) for i, j in near if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}


def _varied():
    rng = np.random.default_rng(5)
    rows = []
    for g in range(60):  # groups around a text, some words changed: on either side of 0.8, and in chains
        n = int(rng.integers(40, 400))
        base = [f"g{g}w{k}" for k in rng.integers(0, 500, n)]
        for _ in range(4):
            w = base[:]
            for x in rng.integers(0, n, 1 + int(rng.integers(0, max(1, n // 18)))):
                w[x] = f"new{rng.integers(0, 10_000)}"
            rows.append((1000 + len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("few, at_once, run", [(8, 1 << 18, 20_000), (2, 600, 60)])
def test_similar_texts_against_brute_force(spark, sf, odd, monkeypatch, few, at_once, run):
    monkeypatch.setattr(simhash_gph, "FEW", few)
    monkeypatch.setattr(simhash_gph, "LINKS", few // 2)
    monkeypatch.setattr(simhash_gph, "AT_ONCE", at_once)
    monkeypatch.setattr(simhash_gph, "RUN", run)
    made = spark.createDataFrame(_varied(), "doc_id long, text string")
    df = made.unionByName(odd.select("doc_id", "text")).unionByName(spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text")).cache()
    found = simhash_gph.similar_texts(df).join(df.withColumn("row_key", F.xxhash64("doc_id", "text")).select("row_key", "text").distinct(), "row_key").collect()
    rows = [(r.doc_id, r.text) for r in found]
    assert len(rows) == df.count()
    pairs = _similar_pairs(_sets(rows))
    together = np.mean([found[i].root == found[j].root for i, j in pairs])
    assert together >= 0.98, together
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in pairs:
        up[root(i)] = root(j)
    groups = {}
    for k, r in enumerate(found):
        groups.setdefault(r.root, set()).add(root(k))
    assert sum(len(g) > 1 for g in groups.values()) <= 1  # no component joins what brute force keeps apart, but for a distance beyond all doubt
    for k, r in enumerate(found):
        ids = [x.doc_id for x in found if x.root == r.root and x.doc_id is not None]
        assert r.component_id == min(ids, default=None)
    kept = simhash_gph.one_of_similar(df.withColumn("fp", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(min((r.doc_id is None, r.doc_id or 0) for r in found if r.root == g) for g in groups)
    assert simhash_gph.one_of_similar(_empty(odd)).count() == 0


def test_trees_of_buckets_against_brute_force():
    """A tree connects what all near pairs connect, by links of the least total length, whatever the members' order."""
    rng = np.random.default_rng(5)
    for m, groups in ((1, 1), (2, 1), (60, 1), (300, 7), (200, 60)):
        base = rng.integers(0, 1 << 63, (groups, simhash_gph.SKETCH), dtype=np.uint64)
        sketch = base[rng.integers(0, groups, m)] ^ (np.uint64(1) << rng.integers(0, 64, (m, simhash_gph.SKETCH), dtype=np.uint64))
        own, node = rng.random(m) < 0.8, rng.permutation(m * 3)[:m]
        x, y = np.triu_indices(m, 1)
        apart = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1)
        ok = (apart <= 4) & (own[x] | own[y])
        x, y, apart = x[ok], y[ok], apart[ok]

        def forest(a, b, d):
            up, total = list(range(m)), 0
            for k in np.argsort(d, kind="stable").tolist():
                i, j = int(a[k]), int(b[k])
                while up[i] != i:
                    i = up[i]
                while up[j] != j:
                    j = up[j]
                if i != j:
                    up[max(i, j)] = min(i, j)
                    total += int(d[k])

            def top(i):
                while up[i] != i:
                    i = up[i]
                return i

            return [top(i) for i in range(m)], total

        a, b = simhash_gph._tree(node, own, sketch, 4)
        assert forest(x, y, apart) == forest(a, b, np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1))
        assert len(a) == m - len(set(forest(x, y, apart)[0]))
        turned = rng.permutation(m)
        c, d = simhash_gph._tree(node[turned], own[turned], sketch[turned], 4)
        assert {frozenset(z) for z in zip(node[a].tolist(), node[b].tolist())} == {frozenset(z) for z in zip(node[turned][c].tolist(), node[turned][d].tolist())}


@pytest.mark.parametrize("links", [0, 4])
def test_large_buckets_lose_no_link_between_runs(spark, monkeypatch, links):
    """One bucket of many runs; most clusters have no member among its first rows."""
    monkeypatch.setattr(simhash_gph, "RUN", 40)
    monkeypatch.setattr(simhash_gph, "LINKS", links)
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 1 << 63, (150, 16), dtype=np.uint64)[rng.integers(0, 150, 600)] ^ (np.uint64(1) << rng.integers(20, 60, (600, 16), dtype=np.uint64))
    fps[:, 0] &= ~np.uint64(0xFF)
    nodes = spark.createDataFrame([(k, fp.tobytes()) for k, fp in enumerate(fps)], "node long, fp binary").repartition(3)
    met, large = simhash_gph.meetings(nodes, [(list(range(8)), 0)], 0.8)
    limit = simhash_gph._limit(0.8, 64 * simhash_gph.SKETCH, simhash_gph.DOUBT)
    x, y = np.triu_indices(600, 1)
    near = np.bitwise_count(fps[x, -2:] ^ fps[y, -2:]).sum(axis=1) <= limit
    want = spark.createDataFrame(list(zip(x[near].tolist(), y[near].tolist())), "a long, b long")
    roots = lambda e: {r.node: r.root for r in simhash_gph.contracted(e).collect()}
    assert large.count() == 1 and roots(met.select("a", "b")) == roots(want)
    again = simhash_gph.left_out(met.select(F.explode("thinned").alias("bucket")).distinct(), nodes.select("node", F.col("node").alias("root")), nodes, [(list(range(8)), 0)], 0.8, large)
    every = met.where(F.size("thinned") == 0).select("a", "b").union(again.select("a", "b"))
    assert roots(every) == roots(want)


def test_components_of_chains(spark):
    """The smallest label of long chains, stars and rings, in any order of the nodes."""
    rng = np.random.default_rng(4)
    name = rng.permutation(400).tolist()
    edges = [(name[k], name[k + 1]) for k in range(0, 99)] + [(k, k + 1) for k in range(1000, 1200)] + [(name[200], name[k]) for k in range(201, 260)] + [(name[300 + k], name[300 + (k + 1) % 50]) for k in range(50)] + [(5000, 5000)]
    nodes = {x for e in edges for x in e}
    label = {x: None if x % 7 == 0 else -x for x in nodes}
    got = smallest_reachable(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame(list(label.items()), "node long, label long")).collect()
    up = {x: x for x in nodes}
    for _ in range(len(nodes)):
        new = dict(up)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == up:
            break
        up = new
    best = {}
    for x in nodes:
        best[up[x]] = min(best.get(up[x], (True, 0, 0)), (label[x] is None, label[x] or 0, x))
    assert {r.node: (r.label, r.root) for r in got} == {x: (None if best[up[x]][0] else best[up[x]][1], best[up[x]][2]) for x in nodes if x != 5000}


def test_planned_sizes_stay_small_over_rounds(spark):
    """A path takes ten pointer jumps; planned as products of both sides, the size of its table had 2**10 times the digits."""
    from fieldloom.llm.components import contracted
    from fieldloom.operators import spatial

    path = spark.createDataFrame([(k, k + 1) for k in range(600)], "a long, b long")
    of = contracted(path).checkpoint()
    assert of.count() == 601 and of.agg({"root": "max"}).first()[0] == 0
    parts = spatial.components(path, spark.range(601).withColumnRenamed("id", "node")).checkpoint()
    assert parts.agg({"label": "max"}).first()[0] == 0
    for made in (of, parts):
        assert int(made._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 500


def test_rejected_links_of_a_bucket_lose_no_other(spark, monkeypatch):
    """A large bucket tells a tree; here every link of it that is not certain is rejected at first, and the links that the
    tree left out are still told, verified and joined."""
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(400)]
    base = [words[k] for k in rng.integers(0, 400, 240)]
    rows = []
    for i in range(60):
        text = list(base)
        for at in rng.choice(240, 2, replace=False):
            text[at] = f"x{i}y{at}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found, calls, plain = [], [], simhash_gph._confirmed

    def refuse(left, *args):
        calls.append(left.count())
        return plain(left, *args) if len(calls) > 1 else left.select("a", "b").limit(0)

    monkeypatch.setattr(simhash_gph, "_confirmed", refuse)
    found = simhash_gph.similar_texts(df).collect()
    rows = [(r.doc_id, r.text) for r in df.collect()]
    of = {r.doc_id: r.root for r in found}
    pairs = _similar_pairs(_sets(rows))
    together = [of[rows[i][0]] == of[rows[j][0]] for i, j in pairs]
    assert len(calls) == 2 and pairs and np.mean(together) >= 0.98, (calls, len(pairs), np.mean(together))


def test_wide_plan_reaches_the_recall():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (300, 1024)).astype(np.uint8)
    p = simhash_gph.differing(0.8)
    width = {}
    for n in (1_000, 100_000, 100_000_000):
        plan = simhash_gph.wide_plan(bits, n, 0.8)
        used = [b for g, _ in plan for b in g]
        assert len(used) == len(set(used))
        miss = np.prod([1 - (1 - p) ** len(g) - t * len(g) * p * (1 - p) ** (len(g) - 1) for g, t in plan])
        assert 1 - miss >= 0.99
        width[n] = max(len(g) for g, _ in plan)
    assert width[1_000] < width[100_000_000]  # more texts, narrower buckets


def test_shingle_sets_against_brute_force(sf):
    texts = ["", "One two", "one TWO three four five six one two three four five", "x " * 30, PROSE]
    sets = _sets(list(enumerate(texts)))
    got = [set() for _ in texts]
    for i, j, prints, doc in simhash_gph.shingle_sets(T.as_strings(pa.array(texts)), 5):
        for d, x in zip(doc.tolist(), prints.tolist()):
            got[i + d].add(x)
    assert [len(g) for g in got] == [len(s) for s in sets]
    assert len(got[2] & got[4]) == len(sets[2] & sets[4]) == 0


def test_one_of_each(spark, odd):
    kept = simhash_gph.one_of_each(odd)
    assert sorted(kept.columns) == sorted(odd.columns)
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and None not in ids and ids.count(3) == 1


# The pipeline.


def test_near_duplicates_in_the_pipeline(spark, sf):
    rows = _varied()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    pairs = _similar_pairs(_sets(rows))
    assert sum(rows[i][0] in kept and rows[j][0] in kept for i, j in pairs) <= 0.02 * len(pairs)
    alone = {k for k in range(len(rows))} - {k for p in pairs for k in p}
    assert alone and all(rows[k][0] in kept for k in alone)


def test_stages(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    strange = odd.select(*docs.columns)
    for start in (docs, strange, _empty(docs)):
        now = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, sf).checkpoint()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == docs.columns
    out = corpus_pipeline.run(spark, sf)
    left = {r.doc_id for r in out.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    assert left and len(left & toxic) <= len(toxic) / 2


def test_stages_keep_clean_documents(spark, sf):
    clean = spark.createDataFrame([(k, " ".join(f"clean{(k * 7919 + j * j * 31 + k * j * 13) % 5003}" for j in range(80)), "en", "s", 500) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    now = clean
    for name, stage in corpus_pipeline.STAGES[1:4]:
        now = stage(spark, now, sf).checkpoint()
        assert now.count() == 40, name
