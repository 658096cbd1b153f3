"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between the starts and ends of block elements, with their ancestors'
tags and class names. Each block is content or not; features are the ancestors (tags, words of class and id), the
block's own tag, and its text (length, links, punctuation). The chain's weights are fitted by conditional likelihood
on labelled pages and blocks are decoded by Viterbi; content blocks are joined in page order by an empty line.

Labelled pages come from a bounded sample of the table: pages that mark their article (<article> or <main>) label
themselves, and the texts of the sample are set once more into a range of page layouts (other containers, side bars,
notices, forms, comments), where every block's label is known.

Character references are decoded; white space inside a block, line breaks included, becomes one space. Results for odd
input: null or empty html: empty text. Pages without any content block have empty text; broken or cut-off markup is
read as far as it goes. Very long and very deep pages are read whole, by one task. Of equally likely labellings the one
with less content is taken. Repeated rows and null ids get a row each; an empty table gives an empty result. Other
columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldloom.llm import text as T

#: The most pages that weights are fitted on, and how many layouts each of them is set into.
TRAIN_PAGES = 100
LAYOUTS = 5
_BITS = 14
_MASK = (1 << _BITS) - 1
#: Of a training page: the most characters (longer pages are not taken), blocks, and paragraphs that other layouts repeat.
TRAIN_CHARS = 200_000
TRAIN_BLOCKS = 120
TRAIN_PARAGRAPHS = 25

# HTML element names by their role in reading.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter nobr picture progress q ruby rp rt s samp small source span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mpadded mphantom mspace mstyle semantics".split())
#: Elements whose content is no text of the page: code, drawings, other spellings of a formula, form controls, what is never shown.
_RAW = frozenset("script style template textarea select button iframe svg annotation annotation-xml title".split())
_ENDS_OF = {t: re.compile(f"</{t}(?![a-z0-9:-])", re.I | re.A) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WALLS = frozenset("ul ol dl table body html div section article main aside nav footer header form blockquote td th".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>?")
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|style|data-gold)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Block:
    text: str
    own: tuple[str, ...]  # tag and class words of the element that holds it
    above: str  # tag of the element around that
    inside: frozenset[str]  # tags ("in t") and class words ("word w") of all elements around it
    linked: int  # characters inside links
    gold: bool
    marked: bool  # lies in the page's own <article> or <main>, not in a part of it that is another's text


@dataclass(slots=True)
class _Open:
    """An open element; what lies inside knows the names of all elements around it as one set, however deep it is."""

    own: tuple[str, ...]
    above: str
    inside: frozenset[str]
    gold: bool
    marked: bool


_TOP = _Open(("none",), "", frozenset(), False, False)


def _element(tag: str, attrs: str, around: _Open) -> _Open:
    words, gold = [], False
    for name, value in _ATTR.findall(attrs) if attrs and not attrs.isspace() else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "data-gold":
            gold = True
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            words.append("hidden")
        elif name in ("class", "id", "role"):
            words += _NAME.findall(value)
    own = (tag, *dict.fromkeys(words))
    names = {f"in {tag}", *(f"word {w}" for w in own[1:])}
    opens = tag in ("article", "main")
    marked = around.marked and not (tag in _OTHERS or tag == "article" and "in article" in around.inside or _OTHERS_NAMES & set(own[1:])) or opens and not around.inside & _MAIN
    return _Open(own, around.own[0] if around is not _TOP else "", around.inside if names <= around.inside else around.inside | names, gold or around.gold, marked)


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in page order."""
    out: list[Block] = []
    stack: list[_Open] = []
    there: Counter[str] = Counter()  # open elements by tag
    pieces: list[str] = []
    links = linked = at = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                e = stack[-1] if stack else _TOP
                out.append(Block(text, e.own, e.above, e.inside, min(linked, len(text)), e.gold, e.marked))
            pieces.clear()
        linked = 0

    def pop(to: int) -> None:
        for e in stack[to:]:
            there[e.own[0]] -= 1
        del stack[to:]

    n = len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            pieces.append(page[at:lt])
            linked += (lt - at) if links else 0
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            pieces.append("<")
            at = lt + 1
            continue
        at = max(m.end(), lt + 1)
        close, tag, attrs = m.group(1), m.group(2).lower(), m.group(3)
        if tag in _RAW:  # its content is skipped, the block around it goes on
            if not close and not attrs.endswith("/"):
                end = _ENDS_OF[tag].search(page, at)
                gt = page.find(">", end.end()) if end else -1
                at = n if gt < 0 else gt + 1
            continue
        if tag in _INLINE:
            if tag == "a":
                links = 0 if close else 1
            elif tag in ("br", "wbr", "img", "input"):
                pieces.append(" " if tag != "wbr" else "")
            continue
        flush()
        links = 0
        if close:
            if there[tag]:
                k = len(stack) - 1
                while stack[k].own[0] != tag:
                    k -= 1
                pop(k)
            continue
        if stack and stack[-1].own[0] == "p":
            pop(len(stack) - 1)
        for k in range(len(stack) - 1, -1, -1) if tag in _CLOSES else ():
            top = stack[k].own[0]
            if top in _CLOSES[tag]:
                pop(k)
                break
            if top in _WALLS and not (tag in ("td", "th", "tr") and top in ("td", "th")):
                break
        if tag not in _VOID and not attrs.endswith("/"):
            stack.append(_element(tag, attrs, stack[-1] if stack else _TOP))
            there[tag] += 1
    flush()
    return [b for b in out if "in head" not in b.inside]


def _hash(f: str) -> int:
    return zlib.crc32(f.encode()) & _MASK


def path_features(b: Block) -> list[int]:
    out = {f"own {b.own[0]}", "bias"} | b.inside | {f"own word {w}" for w in b.own[1:]}
    if b.above:
        out.add(f"pair {b.above} {b.own[0]}")
    return [_hash(f) for f in sorted(out)]


def text_features(b: Block) -> list[int]:
    n, share = len(b.text), b.linked / max(1, len(b.text))
    words = b.text.count(" ") + 1
    length = min(int(np.log2(n + 1)), 12)
    link = 0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3
    out = [f"length {length}", f"link {link}", f"link {link} length {length // 3}", f"stop {b.text[-1] in '.!?…:;' or b.text[-1] == '”'}", f"commas {min(b.text.count(','), 3)}", f"words {min(words, 6)}", f"mark {'©' in b.text} {'|' in b.text}"]
    return [_hash(f) for f in out]


@dataclass
class Chain:
    node: np.ndarray  # score of content against not, by feature
    step: np.ndarray  # label by next label
    first: np.ndarray


def fit(pages: list[list[Block]], rounds: int = 100, rate: float = 0.5, l2: float = 1e-5) -> Chain:
    """Conditional likelihood by AdaGrad; forward and backward sums of all pages at once, a step of the chain at a time."""
    pages = [p for p in pages if p]
    model = Chain(np.zeros(1 << _BITS), np.zeros((2, 2)), np.zeros(2))
    if not pages:
        return model
    long = max(map(len, pages))
    n = len(pages)
    rows = [(i, t, path_features(b) + text_features(b), b.gold) for i, p in enumerate(pages) for t, b in enumerate(p)]
    who = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    feat = np.array([f for r in rows for f in r[2]])
    at = (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    gold = np.array([r[3] for r in rows], np.int64)
    size = np.array([len(p) for p in pages])
    label = np.zeros((n, long), np.int64)
    label[at] = gold
    real = np.arange(long)[None, :] < size[:, None]
    seen = [np.full_like(w, 1e-8) for w in (model.node, model.step, model.first)]
    for _ in range(rounds):
        score = np.zeros((n, long, 2))
        score[at[0], at[1], 1] = np.bincount(who, model.node[feat], len(rows))
        fwd, bwd = np.zeros((n, long, 2)), np.zeros((n, long, 2))
        fwd[:, 0] = score[:, 0] + model.first
        for t in range(1, long):
            step = np.logaddexp.reduce(fwd[:, t - 1, :, None] + model.step, axis=1) + score[:, t]
            fwd[:, t] = np.where(real[:, t, None], step, fwd[:, t - 1])
        for t in range(long - 2, -1, -1):
            step = np.logaddexp.reduce(model.step + (score[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
            bwd[:, t] = np.where(real[:, t + 1, None], step, 0.0)
        total = np.logaddexp.reduce(fwd[:, -1], axis=1)
        p = np.exp(fwd + bwd - total[:, None, None])
        both = np.exp(fwd[:, :-1, :, None] + model.step + (score + bwd)[:, 1:, None, :] - total[:, None, None, None]) * real[:, 1:, None, None]
        truth = np.zeros((n, long - 1, 2, 2))
        np.put_along_axis(truth.reshape(n, long - 1, 4), (label[:, :-1] * 2 + label[:, 1:])[..., None], 1.0, axis=2)
        truth *= real[:, 1:, None, None]
        g = (p[at[0], at[1], 1] - gold) / len(rows)
        grads = (np.bincount(feat, g[who], 1 << _BITS) + l2 * model.node, (both - truth).sum(axis=(0, 1)) / len(rows), (p[:, 0] - np.eye(2)[label[:, 0]]).sum(axis=0) / len(rows))
        for w, d, q in zip((model.node, model.step, model.first), grads, seen, strict=True):
            q += d * d
            w -= rate * d / np.sqrt(q)
    return model


def viterbi(score: list[float], model: Chain) -> list[bool]:
    """The likeliest labels; score is content against not. Of equal paths the one with less content."""
    if not score:
        return []
    (aa, ab), (ba, bb) = model.step.tolist()
    a, b = model.first.tolist()
    b += score[0]
    came: list[tuple[bool, bool]] = []
    for s in score[1:]:
        fa, fb = b + ba > a + aa, b + bb > a + ab
        came.append((fa, fb))
        a, b = (b + ba if fa else a + aa), (b + bb if fb else a + ab) + s
    on = b > a
    out = [on]
    for fa, fb in reversed(came):
        on = fb if on else fa
        out.append(on)
    return out[::-1]


class Extractor:
    def __init__(self, model: Chain):
        self.model = model
        self.node = model.node.tolist()
        self.paths: dict[tuple, float] = {}

    def __call__(self, page: str) -> str:
        found = blocks(page)
        score = []
        for b in found:
            path = (b.own, b.above, b.inside)
            s = self.paths.get(path)
            if s is None:
                if len(self.paths) > 50_000:
                    self.paths.clear()
                s = self.paths[path] = sum(self.node[f] for f in path_features(b))
            score.append(s + sum(self.node[f] for f in text_features(b)))
        return "\n\n".join(b.text for b, on in zip(found, viterbi(score, self.model), strict=True) if on)


# Labelled pages.

# Names that page layouts commonly give to their parts.
_MAIN = frozenset(("in article", "in main"))
_OTHERS = frozenset("nav aside footer form header".split())
_OTHERS_NAMES = frozenset("comment comments commentlist disqus discussion reply replies respond sidebar related share social newsletter advert breadcrumb pagination".split())
_CONTENT = ["<article>", "<main>", '<div class="content">', '<div id="main-content">', '<div class="post-body entry-content">', '<section class="article-body">', '<div class="story">', '<main><article class="post">', '<div id="content"><div class="entry">', '<div role="main">']
_SIDES = ['<aside class="sidebar">', '<div class="sidebar widget">', '<div id="related" class="related">', '<div class="promo ad">', '<div class="ad">', '<div class="advert banner">', '<div class="cookie-notice">', '<div class="notice" role="alert">', '<section class="newsletter">', '<div class="share social">', '<div class="breadcrumb">', '<div class="pagination">', '<ul class="tags">', '<div class="author bio">']
_TALK = ['<div class="comments">', '<section id="comments">', '<ol class="commentlist">', '<div class="comment-thread">', '<div id="disqus_thread" class="discussion">', '<div class="user-comments reply">']
_TOPS = ['<header class="site-header">', '<div id="header">', '<div class="masthead">', "<header>"]
_ENDS = ['<footer class="site-footer">', '<div id="footer">', '<div class="copyright">', "<footer>"]
_MENUS = ["<nav>", '<div class="nav menu">', '<ul class="menu">', '<div id="navigation">']


def _closed(opening: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z]+)", opening)))


def _inside(opening: str, inner: str) -> str:
    return opening + inner + _closed(opening)


def _gold(opening: str) -> str:
    k = opening.rfind(">")
    return f"{opening[:k]} data-gold{opening[k:]}"


def _layout(rng: np.random.Generator, paragraphs: list[str], pool: list[str], part: slice = slice(None)) -> str:
    """A page in a layout of its own around the paragraphs; content sits below an element marked as gold."""
    esc = entities.escape
    pick = lambda x: x[int(rng.integers(len(x)))]
    words = lambda a, b: " ".join(pick(pool).split()[: int(rng.integers(a, b))])
    para = lambda: f"<p>{esc(pick(pool)[: int(rng.integers(30, 400))])}</p>"
    menu = lambda: "<ul>" + "".join(f'<li><a href="/{k}">{esc(words(1, 4))}</a></li>' for k in range(int(rng.integers(3, 9)))) + "</ul>"
    side = lambda: _inside(pick(_SIDES[part]), pick([menu, para, lambda: f"<h3>{esc(words(1, 5))}</h3>" + para(), lambda: f'<a href="/x">{esc(words(2, 9))}</a>', lambda: esc(words(3, 14))])()) if rng.random() > 0.05 else f"<noscript>{para()}</noscript>"
    body = [f"<h1>{esc(words(3, 10))}</h1>"] if rng.random() < 0.7 else []
    for p in paragraphs:
        kind = rng.random()
        body.append(f"<h2>{esc(words(2, 8))}</h2>" if kind < 0.06 else f"<ul><li>{esc(p)}</li><li>{esc(words(3, 12))}</li></ul>" if kind < 0.11 else f"<blockquote><p>{esc(p)}</p></blockquote>" if kind < 0.15 else f"<div>{esc(p)}</div>" if kind < 0.2 else f'<p>{esc(p)} <a href="#">{esc(words(1, 4))}</a>.</p>' if kind < 0.3 else f"<p>{esc(p)}</p>")
    opening = pick(_CONTENT[part])
    parts, run = [], []
    for piece in body:  # some layouts set notices and adverts between paragraphs
        run.append(piece)
        if rng.random() < 0.12:
            parts += [f"<div data-gold>{''.join(run)}</div>" if rng.random() < 0.3 else "".join(run).replace("<p>", "<p data-gold>").replace("<h1>", "<h1 data-gold>").replace("<h2>", "<h2 data-gold>").replace("<li>", "<li data-gold>").replace("<div>", "<div data-gold>"), side()]
            run = []
    rest = "".join(run)
    main = "".join(parts) + rest.replace("<p>", "<p data-gold>").replace("<h1>", "<h1 data-gold>").replace("<h2>", "<h2 data-gold>").replace("<li>", "<li data-gold>").replace("<div>", "<div data-gold>")
    said = pick(['<div class="comment"><p>', '<li class="comment"><p>', "<p>", '<p class="comment-text">', "<div>", "<li>"])
    talk = _inside(pick(_TALK[part]), (f"<h3>{esc(words(1, 3))}</h3>" if rng.random() < 0.5 else "") + "".join(_inside(said, esc(pick(pool)[: int(rng.integers(20, 300))])) for _ in range(int(rng.integers(1, 6))))) if rng.random() < 0.6 else ""
    form = f'<form class="search" action="/s"><p>{esc(words(1, 6))}</p><input type="text"></form>' if rng.random() < 0.4 else ""
    inner_talk = talk if rng.random() < 0.4 else ""
    content = _inside(opening, main + inner_talk)
    head = "<!DOCTYPE html><html><head><title>x</title></head><body>"
    before = (_inside(pick(_TOPS[part]), f"<p>{esc(words(1, 6))}</p>") if rng.random() < 0.6 else "") + (_inside(pick(_MENUS[part]), menu()) if rng.random() < 0.8 else "") + "".join(side() for _ in range(int(rng.integers(0, 3))))
    after = ("" if inner_talk else talk) + form + "".join(side() for _ in range(int(rng.integers(0, 3)))) + _inside(pick(_ENDS[part]), f"<p>{esc(words(2, 12))}</p>" if rng.random() < 0.5 else "&copy; " + esc(words(2, 12)))
    return head + before + content + after + "</body></html>"


def labelled(pages: list[str], part: slice = slice(None)) -> list[list[Block]]:
    """Training pages: those that mark their article, and the sample's texts in other layouts, whose names are of a part
    of each list."""
    rng = np.random.default_rng(11)
    read = [blocks(p) for p in pages]
    out, texts = [], []
    for p in read:
        own = [b for b in p if b.marked]
        if own:
            for b in p:
                b.gold = False
            for b in own:
                b.gold = True
            out.append(p[:TRAIN_BLOCKS])
        paragraphs = [b.text for b in (own or [b for b in p if len(b.text) > 80])]
        if paragraphs:
            texts.append(paragraphs[:TRAIN_PARAGRAPHS])
    pool = [t for p in texts for t in p]
    for paragraphs in texts:
        out += [blocks(_layout(rng, paragraphs, pool, part))[:TRAIN_BLOCKS] for _ in range(LAYOUTS)]
    return out


def train(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", n: int = TRAIN_PAGES) -> Chain:
    """Weights from at most `n` pages of at most `TRAIN_CHARS` characters with different ids, chosen by a hash of the id."""
    pages = T.narrow(pages, (id_col, "page_id", "bigint"), (html_col, "html", "string"))
    some = T.sampled(pages.select(F.xxhash64("page_id").alias("at"), "html"), "at", n, F.length("html") <= TRAIN_CHARS)
    return fit(labelled([r.html for r in sorted(some.collect())]))


def extract_text(pages: DataFrame, model: Chain, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor(shared.value)
        for b in batches:
            pages_ = T.as_strings(b.column(2))
            for i, j in T.slices(pages_, 4 << 20):
                text = [extract(p) for p in pages_.slice(i, j - i).to_pylist()]
                yield pa.record_batch([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    pages = T.narrow(pages, (id_col, "page_id", "bigint"), (url_col, "url", "string"), (html_col, "html", "string"))
    return pages.mapInArrow(mapper, "page_id long, url string, text string, n_chars long")
