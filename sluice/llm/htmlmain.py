"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between the boundaries of block-level elements.
Each block has features of its ancestors (tags, pairs of tags, words of class, id and role) and of its
text (length, share of links, punctuation). The field is trained on labelled pages by gradient
ascent on the conditional likelihood, and each page is decoded by Viterbi. The text of scripts,
styles and the head is never a block; a head without an end tag ends at the first element of the body.

A null or empty html, or one without main text, gives an empty text. Broken markup is read as far as it goes:
unclosed elements end with their parent, a tag that is cut off at the end is dropped, and of an
element whose content is no text only the tag where it closes itself or has no end tag (scripts and styles: the rest). Pages of
any length are taken whole. Repeated rows are extracted alike; null keys and urls are kept; an
empty table gives an empty one; columns other than key, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .util import mapped

#: Elements whose content is no text of the page.
_RAW = "script|style|noscript|template|svg|iframe|object|canvas|select|textarea|title|math"
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})(?=[\s/>])"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_TAG_END = re.compile(r"(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|[^>]*(?:>|\Z)")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW.split("|")}
#: A slash at the end of an attribute's bare value belongs to it.
_BARE_VALUE = re.compile(r"=\s*[^\s\"'>]+\Z")
#: Elements that don't end the head where its end tag is left out.
_HEAD_TAGS = frozenset("head html base basefont bgsound link meta noframes".split())
_ATTRS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption button label".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A tag that opens ends an open element of these.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


@dataclass(frozen=True)
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]  # (tag, words of its class, id and role) from the root
    linked: int  # characters inside links


def _squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    path: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link, at, in_head = 0, 0, 0, False
    endless: set[str] = set()  # raw elements without an end tag from here on

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _squeeze(parts)
            if text:
                out.append(Block(text, tuple(path), min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(low: int, high: int) -> None:
        nonlocal linked
        if low < high and not in_head:
            text = page[low:high]
            if "&" in text:
                text = entities.unescape(text)
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def after(raw: str, low: int) -> int:
        """Where the text goes on after a raw element whose name ends at ``low``."""
        m = _TAG_END.match(page, low)
        attrs = m["attrs"] or ""
        if raw not in ("script", "style") and attrs.endswith("/") and not _BARE_VALUE.search(attrs):
            return m.end()
        end = None if raw in endless else _RAW_END[raw].search(page, low)
        if end:
            return end.end()
        endless.add(raw)
        return len(page) if raw in ("script", "style") else m.end()

    while m := _MARKUP.search(page, at):
        add(at, m.start())
        at = m.end()
        if m["raw"]:
            at = after(m["raw"].lower(), at)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "head":
            in_head = not m["close"]
        elif not m["close"] and tag not in _HEAD_TAGS:
            in_head = False
        if tag not in BLOCK_TAGS:
            if tag == "a":
                in_link = 0 if m["close"] else 1
            elif tag in ("br", "wbr", "img") and tag != "wbr":
                parts.append(" ")
            continue
        flush()
        in_link = 0
        if m["close"]:
            for k in range(len(path) - 1, -1, -1):
                if path[k][0] == tag or path[k][0] in _HEADINGS and tag in _HEADINGS:
                    del path[k:]
                    break
            continue
        if path and path[-1][0] == "p":
            path.pop()
        for k in range(len(path) - 1, -1, -1):
            if path[k][0] in _ENDS.get(tag, ()):
                del path[k:]
            elif path[k][0] in BLOCK_TAGS:
                break
        if tag in VOID_TAGS:
            continue
        attrs, words = m["attrs"], ()
        if attrs and "=" in attrs:
            words = tuple(w for a in _ATTRS.findall(attrs) for w in _WORDS.findall("".join(a).lower()))
        path.append((tag, words))
    add(at, len(page))
    flush()
    return out


def _band(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def features(block: Block, first: bool, last: bool) -> list[str]:
    f, seen = ["bias"], set()
    near = "none"
    for tag, words in block.path:
        if tag not in seen:
            seen.add(tag)
            f.append("in=" + tag)
        f += ["word=" + w for w in words]
        if tag in ("nav", "header", "footer", "aside", "form", "article", "main", "section", "ul", "ol", "table", "blockquote", "figure"):
            f.append(f"pair={near}>{tag}")
            near = tag
    f += ["inner=" + w for w in next((words for _, words in reversed(block.path) if words), ())]
    if block.path:
        f.append("own=" + block.path[-1][0])
    f.append("near=" + near)
    n = len(block.text)
    f.append(f"length={_band(n, (20, 60, 150, 400))}")
    f.append(f"links={_band(block.linked / n, (0.01, 0.35, 0.8))}")
    f.append(f"stops={_band(sum(map(block.text.count, '.!?')), (1, 2, 4))}")
    if "©" in block.text:
        f.append("copyright")
    if first:
        f.append("first")
    if last:
        f.append("last")
    return f


def page_features(found: list[Block]) -> list[list[str]]:
    return [features(b, i == 0, i == len(found) - 1) for i, b in enumerate(found)]


@dataclass(frozen=True)
class Field:
    """Weights of the two labels (1: main text): emission by feature for label 1, start, transitions."""

    emit: dict[str, float]
    start: tuple[float, float]
    move: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, page: list[list[str]]) -> list[int]:
        """The most probable labels of a page's blocks."""
        if not page:
            return []
        emit, back = self.emit, []
        score0, score1 = self.start
        score1 += sum(emit.get(f, 0.0) for f in page[0])
        (m00, m01), (m10, m11) = self.move
        for block in page[1:]:
            e = sum(emit.get(f, 0.0) for f in block)
            a, b = score0 + m00 >= score1 + m10, score0 + m01 > score1 + m11
            back.append((0 if a else 1, 0 if b else 1))
            score0, score1 = (score0 + m00 if a else score1 + m10), (score0 + m01 if b else score1 + m11) + e
        labels = [int(score1 > score0)]
        for prev in reversed(back):
            labels.append(prev[labels[-1]])
        return labels[::-1]


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Sample:
    """Labelled pages for training. Weights are in the order of ``names``, then two for the start and four for moves."""

    def __init__(self, pages: list[list[list[str]]], labels: list[list[int]]):
        self.names = sorted({f for p in pages for b in p for f in b})
        place = {f: i for i, f in enumerate(self.names)}
        self.n, self.t = n, t = len(pages), max(map(len, pages))
        x = np.zeros((n, t, len(self.names)), np.float32)
        y, self.mask = np.zeros((n, t), int), np.zeros((n, t), bool)
        for i, (p, own) in enumerate(zip(pages, labels, strict=True)):
            for j, b in enumerate(p):
                x[i, j, [place[f] for f in b]] = 1
            y[i, : len(own)], self.mask[i, : len(p)] = own, True
        self.flat, self.last, self.both = x.reshape(n * t, -1), self.mask.sum(axis=1) - 1, self.mask[:, 1:]
        k = len(self.names)
        self.gold = np.zeros(k + 6)
        self.gold[:k] = self.flat.T @ ((y == 1) & self.mask).ravel().astype(np.float32)
        np.add.at(self.gold, k + y[:, 0], 1)
        np.add.at(self.gold, k + 2 + (2 * y[:, :-1] + y[:, 1:])[self.both], 1)

    def slope(self, theta: np.ndarray) -> np.ndarray:
        """The gradient of the mean log-likelihood (forward and backward over all pages at once)."""
        n, t, k, mask, both = self.n, self.t, len(self.names), self.mask, self.both
        start, move = theta[k : k + 2], theta[k + 2 :].reshape(2, 2)
        emit = np.zeros((n, t, 2))
        emit[:, :, 1] = (self.flat @ theta[:k].astype(np.float32)).reshape(n, t)
        fore, aft = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        fore[:, 0] = start + emit[:, 0]
        for j in range(1, t):
            step = _logsum(fore[:, j - 1, :, None] + move, 1) + emit[:, j]
            fore[:, j] = np.where(mask[:, j, None], step, fore[:, j - 1])
        for j in range(t - 2, -1, -1):
            step = _logsum(move + (emit[:, j + 1] + aft[:, j + 1])[:, None, :], 2)
            aft[:, j] = np.where(mask[:, j + 1, None], step, 0)
        total = _logsum(fore[np.arange(n), self.last], 1)
        node = np.exp(fore + aft - total[:, None, None]) * mask[:, :, None]
        edge = np.exp(fore[:, :-1, :, None] + move + (emit + aft)[:, 1:, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        expected = np.concatenate([self.flat.T @ node[:, :, 1].ravel().astype(np.float32), node[:, 0].sum(axis=0), edge.sum(axis=(0, 1)).ravel()])
        return (self.gold - expected) / n


def train(pages: list[list[list[str]]], labels: list[list[int]], steps: int = 150, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Gradient ascent on the conditional log-likelihood, with steps that follow the gradients' mean and size."""
    sample = Sample(pages, labels)
    theta = np.zeros(len(sample.gold))
    drift, speed = np.zeros(len(theta)), np.zeros(len(theta))
    for step_no in range(1, steps + 1):
        slope = sample.slope(theta) - decay * theta
        drift, speed = 0.9 * drift + 0.1 * slope, 0.99 * speed + 0.01 * slope**2
        theta += rate * (drift / (1 - 0.9**step_no)) / (np.sqrt(speed / (1 - 0.99**step_no)) + 1e-8)
    k = len(sample.names)
    move = theta[k + 2 :].reshape(2, 2).tolist()
    return Field(dict(zip(sample.names, theta[:k].tolist(), strict=True)), tuple(theta[k : k + 2].tolist()), (tuple(move[0]), tuple(move[1])))


#: Marks main text while a page is made.
_MAIN = "\ue000"


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A made page and the label of each of its leaf blocks; layouts, names and lengths vary."""
    letters = "abcdefghilmnoprstuv"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 10)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def text(label: int, a: int, b: int, stop: bool = True) -> str:
        out = phrase(a, b).capitalize()
        if stop and rng.random() < 0.9:
            out = ". ".join([out, *(phrase(1, 14).capitalize() for _ in range(rng.choice([0, 0, 1, 3])))]) + "."
        return (_MAIN if label else "") + out

    def named(tag: str, *names: str) -> str:
        how = rng.choice(["class", "class", "id"])
        return f'<{tag} {how}="{rng.choice(names)}">'

    def links(label: int = 0) -> str:
        items = "".join(f'<li><a href="/{word()}">{text(label, 1, 3, False)}</a></li>' for _ in range(rng.randint(2, 8)))
        return f"<ul>{items}</ul>"

    def menu() -> str:
        return rng.choice(["<nav>%s</nav>", named("nav", "menu", "main-nav", "navbar") + "%s</nav>", named("div", "menu", "nav", "topnav", "navigation", "breadcrumbs") + "%s</div>"]) % links()

    def advert() -> str:
        body = lambda: rng.choice(["<p>%s</p>", "%s", '<a href="/x">%s</a>']) % text(0, 1, 30)
        names = ("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner", "promotion")
        tag = rng.choice(["div", "div", "aside", "section"])
        return named(tag, *names) + body() + f"</{tag}>"

    def notice() -> str:
        names = ("notice", "cookie-notice", "cookie", "cookies", "consent", "alert", "gdpr", "popup", "modal", "disclaimer", "paywall")
        tag = rng.choice(["div", "div", "aside", "section"])
        return named(tag, *names) + "".join(f"<p>{text(0, 3, 30)}</p>" for _ in range(rng.randint(1, 2))) + f"</{tag}>"

    def sidebar() -> str:
        inner = "".join(rng.choice([lambda: f"<h3>{text(0, 1, 4, False)}</h3>", links, lambda: f"<p>{text(0, 3, 25)}</p>"])() for _ in range(rng.randint(1, 4)))
        names = ("sidebar", "related", "widget", "rail", "recommended", "share", "social", "newsletter", "tags", "trending")
        return rng.choice([f"<aside>{inner}</aside>", named("aside", *names) + inner + "</aside>", named("div", *names) + inner + "</div>", named("section", *names) + inner + "</section>"])

    def form() -> str:
        names = ("search", "subscribe", "newsletter", "login", "signup", "contact")
        inner = f"<label>{text(0, 1, 4, False)}</label><input name=q>" + rng.choice(["", f"<p>{text(0, 2, 20)}</p>"]) + f"<button>{text(0, 1, 2, False)}</button>"
        return rng.choice(["<form>", named("form", *names)]) + inner + "</form>"

    def comments() -> str:
        one = lambda: rng.choice([named("div", "comment", "comment-body", "reply"), "<li class=comment>", '<article class="comment">', "<div>"])
        inner = rng.choice(["", f"<h2>{text(0, 1, 3, False)}</h2>", f"<h3>{text(0, 1, 3, False)}</h3>"])
        for _ in range(rng.randint(1, 5)):
            open_ = one()
            tag = re.match(r"<(\w+)", open_)[1]
            inner += open_ + "".join(f"<p>{text(0, 2, 40)}</p>" for _ in range(rng.randint(1, 2))) + f"</{tag}>"
        tag = rng.choice(["div", "section", "ol"])
        return named(tag, "comments", "comment-list", "responses", "discussion", "user-comments", "reader-comments", "disqus") + inner + f"</{tag}>"

    def head() -> str:
        inner = rng.choice(["", f"<h1>{text(0, 1, 4, False)}</h1>", f"<p>{text(0, 1, 12)}</p>", text(0, 1, 4, False)]) + rng.choice(["", links()])
        return rng.choice(["<header>%s</header>", named("header", "site-header", "masthead", "header", "top") + "%s</header>", named("div", "header", "masthead", "site-header", "topbar") + "%s</div>"]) % inner

    def foot() -> str:
        inner = rng.choice([f"&copy; {phrase(1, 4)} &middot; {phrase(2, 15)}.", f"<p>&copy; {phrase(2, 12)}</p>", f"<p>{phrase(2, 20)}.</p>", f"{phrase(2, 20)}."]) + rng.choice(["", "", links()])
        return rng.choice(["<footer>%s</footer>", named("footer", "site-footer", "footer") + "%s</footer>", named("div", "footer", "site-footer", "copyright") + "%s</div>"]) % inner

    def paragraphs() -> str:
        out = ""
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12])):
            kind = rng.random()
            if kind < 0.7:
                out += f"<p>{text(1, 1, 60)}</p>" if rng.random() < 0.85 else f"<p><b>{text(1, 1, 10)}<br><p>{text(1, 1, 40)}</p>"
            elif kind < 0.78:
                out += (lambda n: f"<h{n}>{text(1, 1, 6, False)}</h{n}>")(rng.randint(2, 4))
            elif kind < 0.85:
                out += "<ul>" + "".join(f"<li>{text(1, 1, 25)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
            elif kind < 0.9:
                out += f"<blockquote><p>{text(1, 2, 30)}</p></blockquote>"
            elif kind < 0.94:
                out += f"<table><tr><td>{text(1, 1, 3, False)}</td><td>{text(1, 1, 3, False)}</td></tr></table>"
            elif kind < 0.97:
                out += f'<p><a href="/z">{text(1, 1, 6)}</a></p>'
            else:
                out += f"<section><h2>{text(1, 1, 4, False)}</h2><p>{text(1, 3, 40)}</p></section>"
            if rng.random() < 0.12:
                out += rng.choice([advert, sidebar, notice, form])()
        return out

    def article() -> str:
        title = f"<h1>{text(1, 1, 12, False)}</h1>"
        title = rng.choice([title, title, f"<header>{title}</header>", ""])
        body = title + paragraphs() + rng.choice(["", "", comments() if rng.random() < 0.3 else ""])
        names = ("content", "post", "entry-content", "article", "article-body", "story", "post-content", "main-content", "text", "body")
        open_ = rng.choice(["<article>", "<article>", "<main>", named("div", *names), named("article", *names), "<main><article>", "<main>" + named("div", *names), ""])
        return open_ + body + "".join(f"</{x}>" for x in re.findall(r"<(\w+)", open_)[::-1])

    order = [rng.choice([head, menu, menu, advert, notice, sidebar, form]) for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4]))] + [article]
    order += [rng.choice([comments, comments, sidebar, advert, form, menu]) for _ in range(rng.randint(0, 3))]
    order += [foot] if rng.random() < 0.8 else []
    body = "".join(part() for part in order)
    if rng.random() < 0.3:
        body = "<div>" + body + "</div>"
    page = f"<!DOCTYPE html><html><head><title>{phrase(1, 5)}</title><style>p{{}}</style></head><body>{body}</body></html>"
    return page.replace(_MAIN, ""), [int(_MAIN in b.text) for b in blocks(page)]


def made_pages(n: int, seed: int) -> tuple[list[list[list[str]]], list[list[int]]]:
    rng, pages, labels = random.Random(seed), [], []
    while len(pages) < n:
        page, own = labelled_page(rng)
        if len(own) <= MAX_BLOCKS:
            pages.append(page_features(blocks(page)))
            labels.append(own)
    return pages, labels


#: Labelled pages that the field is trained on, made by rule from a fixed seed.
TRAINING_PAGES, MAX_BLOCKS = 400, 40

_trained: list[Field] = []


def trained() -> Field:
    if not _trained:
        _trained.append(train(*made_pages(TRAINING_PAGES, seed=1)))
    return _trained[0]


def extract(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    labels = field.decode(page_features(found))
    return "\n\n".join(b.text for b, k in zip(found, labels, strict=True) if k)


def main_text(df: DataFrame, field: Field | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of each page."""
    sent = df.sparkSession.sparkContext.broadcast(field or trained())
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, sent.value) for h in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [key, url, "text", "n_chars"])

    return mapped(df.select(key, url, html), run, f"`{key}` {kind}, `{url}` string, text string, n_chars long")
