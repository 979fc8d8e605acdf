"""Main text of web pages by a recurrent labeller of blocks.

A page is cut into blocks: runs of text between tags that break a line. Each block has a vector of
its tag path (tags, classes and ids, hashed), of its hashed words and of a few figures. A
bidirectional LSTM reads a page's blocks in order and labels each as main text or not. It is trained
here, on pages that a generator writes with known labels; its weights are a few kilobytes.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutalake.llm.common import Words, slices

PATH, WORDS, FIGURES, HIDDEN = 40, 16, 8, 16
WIDTH = PATH + WORDS + FIGURES
PAGES, EPOCHS, SEED = 700, 8, 11

#: Tags that neither break a line nor end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label img input".split())
#: Tags without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = "script|style|noscript|template|head|title|svg|iframe|object|math|canvas|audio|video|select|textarea"
_OPENING = re.compile(rf"<!--|<(?:({SILENT})\b|(/?)([a-z][a-z0-9:-]*))|<[!?]", re.I)
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PARTS = re.compile(r"[a-z]+")
#: A tag that opens ends an open one of its kind.
_ENDS_SAME = frozenset("p li dt dd tr td th option".split())


class Step:
    """An element on the way to a block: its parent, tag, and the signed hashes of all tags and names down to it."""

    __slots__ = ("parent", "tag", "depth", "sums", "below")

    def __init__(self, parent: Step | None, tag: str, names: str):
        self.parent, self.tag = parent, tag
        self.depth = parent.depth + 1 if parent else 0
        self.sums = _signs([tag, *(f".{x}" for x in names.split())]) if tag else np.zeros(PATH, dtype=np.float32)
        if parent:
            self.sums = self.sums + parent.sums
        self.below: dict[tuple[str, str], Step] = {}

    def vector(self) -> np.ndarray:
        """The path's hashes, those of the two innermost tags also by place."""
        if not self.depth:
            return np.tanh(_signs(["", "0:"]) / 2)
        own = self.sums + _signs([f"0:{self.tag}"])
        if self.depth > 1:
            own = own + _signs([f"1:{self.parent.tag}"])
        return np.tanh(own / 2)


@lru_cache(maxsize=20_000)
def _sign(text: str) -> np.ndarray:
    v = np.zeros(PATH, dtype=np.float32)
    h = zlib.crc32(text.encode())
    for shift in (0, 8, 16):
        v[(h >> shift) % PATH] += 1.0 if (h >> (shift + 7)) & 1 else -1.0
    return v


def _signs(texts: list[str]) -> np.ndarray:
    return np.sum([_sign(x) for x in texts], axis=0, dtype=np.float32)


class _Scanner:
    """Ends of tags in time linear in the page: scans that fail, as quotes never close, share a budget."""

    def __init__(self, page: str):
        self.page, self.budget, self.lost = page, 4 * len(page), set()

    def tag_end(self, at: int) -> int:
        """Behind the > of a tag whose attributes begin here, quotes observed; without it the next >, or the page's end."""
        if self.budget > 0:
            if m := _REST.match(self.page, at):
                return m.end()
            self.budget -= len(self.page) - at
        k = self.page.find(">", at)
        return len(self.page) if k < 0 else k + 1

    def find(self, pattern: re.Pattern, at: int) -> re.Match | None:
        """The next match; a pattern that is nowhere isn't sought again."""
        if pattern in self.lost:
            return None
        m = pattern.search(self.page, at)
        if m is None:
            self.lost.add(pattern)
        return m


_ENDS = {x: re.compile(rf"</{x}\s*>", re.I) for x in SILENT.split("|")}
_BODY = re.compile(r"<body\b", re.I)


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag or none for comments and silent elements, whether it closes, attributes) in order."""
    scan, at = _Scanner(page), 0
    while m := _OPENING.search(page, at):
        if m.group() == "<!--":
            k = page.find("-->", m.end())
            at = len(page) if k < 0 else k + 3
            yield m.start(), at, "", False, ""
        elif m.group(1):
            end = scan.tag_end(m.end())
            close = scan.find(_ENDS[m.group(1).lower()], end) or scan.find(_BODY, end)
            at = len(page) if close is None else close.start() if close.group().lower() == "<body" else close.end()
            yield m.start(), at, "", False, ""
        elif m.group(3):
            at = scan.tag_end(m.end())
            yield m.start(), at, m.group(3).lower(), bool(m.group(2)), page[m.end() : at - 1]
        else:
            k = page.find(">", m.end())
            at = len(page) if k < 0 else k + 1
            yield m.start(), at, "", False, ""


def blocks(page: str, root: Step | None = None) -> list[tuple[Step, str, int]]:
    """(path, text, characters inside links) of each block with text, in page order; in time linear in the page."""
    out: list[tuple[Step, str, int]] = []
    root = root or Step(None, "", "")
    stack: list[Step] = [root]
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = at = in_link = 0
    path = root

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((path, text, linked))
            parts.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        if "&" in raw:
            raw = entities.unescape(raw)
        parts.append(raw)
        if in_link:
            linked += len(raw)

    def leave(tag: str, depth: int) -> None:
        """Ends the innermost open element of a tag, if one is among so many innermost ones."""
        if not opened.get(tag):
            return
        k, last = len(stack) - 1, max(0, len(stack) - 1 - depth)
        while k > last and stack[k].tag != tag:
            k -= 1
        if k > last:
            for x in stack[k:]:
                opened[x.tag] -= 1
            del stack[k:]

    for start, end, tag, closes, attributes in _tags(page):
        if start > at:
            put(page[at:start])
        at = end
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = not closes
            if tag not in ("ins", "span"):
                continue
        else:
            close()
            in_link = 0
        if closes:
            leave(tag, len(stack))
        elif tag not in VOID and not attributes.endswith("/"):
            if tag in _ENDS_SAME:
                leave(tag, 3)
            names = " ".join(" ".join(_PARTS.findall("".join(x).lower())) for x in _NAMES.findall(attributes)) if attributes else ""
            own = stack[-1].below.get((tag, names))
            if own is None:
                own = stack[-1].below[tag, names] = Step(stack[-1], tag, names)
            stack.append(own)
            opened[tag] = opened.get(tag, 0) + 1
        if tag not in INLINE:
            path = stack[-1]
    if at < len(page):
        put(page[at:])
    close()
    return out


def features(page: list[tuple[Step, str, int]], counts: np.ndarray) -> np.ndarray:
    """The input of each block. counts: signed hashed words, (blocks, WORDS + 1), the last the number of words."""
    n = len(page)
    x = np.zeros((n, WIDTH), dtype=np.float32)
    if not n:
        return x
    chars = np.array([len(t) for _, t, _ in page], dtype=np.float32)
    x[:, :PATH] = [p.vector() for p, _, _ in page]
    words = counts[:, WORDS]
    x[:, PATH : PATH + WORDS] = counts[:, :WORDS] / np.sqrt(np.maximum(words, 1))[:, None] / 2
    f = x[:, PATH + WORDS :]
    f[:, 0] = np.log1p(chars) / 6
    f[:, 1] = np.log1p(words) / 5
    f[:, 2] = [k / max(1, len(t)) for _, t, k in page]
    f[:, 3] = [t[-1] in ".!?" for _, t, _ in page]
    f[:, 4] = np.arange(n) / max(1, n - 1)
    f[:, 5] = chars / max(1.0, chars.max())
    f[:, 6] = [max(0, p.depth - 1) / 8 for p, _, _ in page]
    f[:, 7] = ["©" in t or "|" in t for _, t, _ in page]
    return x


def word_counts(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), WORDS + 1), dtype=np.float32)
    for first, data, offsets in slices(pa.array(texts, pa.large_string())):
        words = Words(data, offsets)
        h = words.hashes()
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        code = owner * WORDS + (h % np.uint64(WORDS)).astype(np.int64)
        out[first : first + len(offsets) - 1, :WORDS] = np.bincount(code, sign, (len(offsets) - 1) * WORDS).reshape(-1, WORDS)
        out[first : first + len(offsets) - 1, WORDS] = np.diff(words.bounds)
    return out


def inputs_of(pages: list[list[tuple[Step, str, int]]]) -> list[np.ndarray]:
    counts = word_counts([t for page in pages for _, t, _ in page])
    ends = np.cumsum([0, *map(len, pages)])
    return [features(page, counts[ends[k] : ends[k + 1]]) for k, page in enumerate(pages)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one logistic output a block."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {f"{d}{k}": v for d in "fb" for k, v in (("x", draw(WIDTH, 4 * HIDDEN)), ("h", draw(HIDDEN, 4 * HIDDEN)), ("c", np.repeat(np.array([0, 1, 0, 0], dtype=np.float32), HIDDEN)))}
        self.w |= {"o": draw(2 * HIDDEN, 1), "d": np.zeros(1, dtype=np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States over time; padding keeps the state as it is. x: (time, pages, WIDTH)."""
        wx, wh, c0 = self.w[f"{d}x"], self.w[f"{d}h"], self.w[f"{d}c"]
        t, b, _ = x.shape
        gates = (x.reshape(t * b, -1) @ wx + c0).reshape(t, b, -1)
        h, c = np.zeros((b, HIDDEN), dtype=np.float32), np.zeros((b, HIDDEN), dtype=np.float32)
        out, tape = np.zeros((t, b, HIDDEN), dtype=np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = gates[k] + h @ wh
            i, f, o = (_sigmoid(z[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in (0, 1, 2))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[k][:, None]
            c2 = m * (f * c + i * g) + (1 - m) * c
            th = np.tanh(c2)
            h2 = m * (o * th) + (1 - m) * h
            if keep:
                tape.append((k, h, c, i, f, o, g, th, m))
            h, c = h2, c2
            out[k] = h
        return out, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], axis=2)
        return (both @ self.w["o"])[:, :, 0] + self.w["d"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        p = _sigmoid((both @ self.w["o"])[:, :, 0] + self.w["d"])
        n = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n)
        dz = (mask * (p - y) / n).astype(np.float32)
        grad = {"o": np.tensordot(both, dz, ((0, 1), (0, 1)))[:, None], "d": dz.sum(keepdims=True)[0]}
        for j, d in enumerate("fb"):
            wh = self.w[f"{d}h"]
            out = dz[:, :, None] * self.w["o"][j * HIDDEN : (j + 1) * HIDDEN, 0]
            dh, dc = np.zeros_like(out[0]), np.zeros_like(out[0])
            gx, gh, gc = np.zeros_like(self.w[f"{d}x"]), np.zeros_like(wh), np.zeros_like(self.w[f"{d}c"])
            for k, h0, c0, i, f, o, g, th, m in reversed(runs[d][1]):
                dh = dh + out[k]
                live = dh * m
                dct = (dc * m) + live * o * (1 - th**2)
                dgates = np.concatenate([dct * g * i * (1 - i), dct * c0 * f * (1 - f), live * th * o * (1 - o), dct * i * (1 - g**2)], axis=1)
                gx += x[k].T @ dgates
                gh += h0.T @ dgates
                gc += dgates.sum(0)
                dh = dgates @ wh.T + dh * (1 - m)
                dc = dct * f + dc * (1 - m)
            grad |= {f"{d}x": gx, f"{d}h": gh, f"{d}c": gc}
        return loss, grad

    def train(self, xs: list[np.ndarray], ys: list[np.ndarray], epochs: int, batch: int = 32, rate: float = 0.01, seed: int = SEED) -> float:
        """Adam over batches of pages of like length; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        order = np.argsort([len(x) for x in xs], kind="stable")
        groups = [order[a : a + batch] for a in range(0, len(order), batch)]
        step, losses = 0, [0.0]
        for _ in range(epochs):
            losses = []
            for k in rng.permutation(len(groups)):
                x, mask = padded([xs[i] for i in groups[k]])
                y = np.zeros(mask.shape, dtype=np.float32)
                for j, i in enumerate(groups[k]):
                    y[: len(ys[i]), j] = ys[i]
                loss, grad = self.gradients(x, mask, y)
                losses.append(loss)
                step += 1
                for name, g in grad.items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.w[name] = (self.w[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        return float(np.mean(losses))

    def label(self, pages: list[list[tuple[Step, str, int]]]) -> list[np.ndarray]:
        """Whether each block is main text, for each page."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        xs = inputs_of(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            n = at + 1
            while n < len(order) and n - at < 256 and len(pages[order[n]]) * (n - at + 1) <= 20_000:
                n += 1
            x, mask = padded([xs[k] for k in order[at:n]])
            z = self.logits(x, mask) > 0
            for j, k in enumerate(order[at:n]):
                out[k] = z[: len(pages[k]), j]
            at = n
        return out


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(x) for x in xs)
    x, mask = np.zeros((t, len(xs), WIDTH), dtype=np.float32), np.zeros((t, len(xs)), dtype=np.float32)
    for j, own in enumerate(xs):
        x[: len(own), j] = own
        mask[: len(own), j] = 1
    return x, mask


class PageWriter:
    """Writes training pages; main text carries a mark, which is taken out of the blocks again."""

    MARK = "\ue000"
    MAIN = ["<article>", "<main>", '<div class="content">', '<div id="content">', '<div class="post">', '<div class="entry-content">', '<section class="story">', '<div class="article-body">', '<main><article class="post">', "<div>", '<div class="text">', '<div id="main"><div class="body">', '<article class="entry">', '<div role="main">']
    MENU = ["<nav>", '<div class="nav">', '<div id="menu">', '<header><nav class="menu">', '<div class="breadcrumbs">', '<ul class="navigation">', '<nav class="navbar">', '<div class="topbar">']
    HEAD = ["<header>", '<div class="header">', '<div id="masthead">', '<div class="site-header">']
    FOOT = ["<footer>", '<div class="footer">', '<div id="footer">', '<footer class="site-footer">', '<div class="copyright">']
    SIDE = ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<aside class="widget">', '<div class="related">', '<div class="recommended">', '<section class="related-posts">']
    ADS = ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="banner">', '<div class="sponsored">', '<div id="ad-slot">', '<aside class="promo">', '<section class="ad-container">']
    NOTICE = ['<div class="cookie">', '<div class="cookie-notice">', '<div class="notice">', '<div class="alert">', '<div class="gdpr consent">', '<div class="newsletter">', '<div class="popup">', '<div id="banner-notice">', '<div class="share">', '<div class="social">', '<div class="subscribe">']
    TALK = ['<section class="comments">', '<div id="comments">', '<div class="comments">', '<ol class="comment-list">', '<div class="comment">', '<div class="discussion replies">', '<div class="user-comments">']

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, options: list[str]) -> str:
        return options[int(self.rng.integers(len(options)))]

    def word(self) -> str:
        return "".join(self.pick(["ra", "te", "lo", "in", "er", "st", "mi", "qu", "ao", "en", "de", "th", "é", "ü", "ble"]) for _ in range(int(self.rng.integers(1, 5))))

    def text(self, low: int, high: int) -> str:
        n = int(np.exp(self.rng.uniform(np.log(low), np.log(high))))
        words = [self.word() for _ in range(max(1, n))]
        junk = self.rng.random()
        if junk < 0.1:
            words = [x + self.pick(["###", "$$$", "&amp;&amp;", "%%%", "!!", " |"]) for x in words]
        elif junk < 0.15:
            words = [x.upper() for x in words]
        return (" ".join(words)).capitalize() + self.pick([".", ".", ".", "!", "?", "", ","])

    @staticmethod
    def end(opening: str) -> str:
        return "".join(f"</{x}>" for x in reversed(re.findall(r"<([a-z0-9]+)", opening)))

    def wrap(self, opening: str, inner: str) -> str:
        return opening + inner + self.end(opening)

    def links(self, n: int) -> str:
        made = [f'<a href="/{self.word()}">{self.text(1, 5)}</a>' for _ in range(n)]
        return self.pick(["<ul>" + "".join(f"<li>{x}</li>" for x in made) + "</ul>", " | ".join(made), "".join(f"<div>{x}</div>" for x in made), "".join(f"<p>{x}</p>" for x in made)])

    def paragraph(self) -> str:
        r, body = self.rng.random(), self.MARK + self.text(1, 160)
        if r < 0.1:
            return f"<p><b>{body}<br>"
        if r < 0.16:
            return f'<p>{body} <a href="#">{self.text(1, 6)}</a> {self.text(1, 20)}</p>'
        if r < 0.2:
            return f"<blockquote>{body}</blockquote>"
        if r < 0.26:
            return "<ul>" + "".join(f"<li>{self.MARK}{self.text(1, 25)}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>"
        if r < 0.3:
            return f"<h2>{self.MARK}{self.text(1, 9)}</h2>"
        if r < 0.33:
            return f"<div>{body}</div>"
        return f"<p>{body}</p>"

    def aside(self, kind: list[str]) -> str:
        opening = self.pick(kind)
        if kind is self.TALK:
            inner = "".join(self.pick(['<div class="comment">', "<li>", "<div>", '<article class="comment">']) + f"<p>{self.text(3, 60)}</p>" for _ in range(int(self.rng.integers(1, 6))))
        elif kind in (self.MENU, self.SIDE):
            inner = self.links(int(self.rng.integers(2, 9)))
            if self.rng.random() < 0.3:
                inner = f"<h3>{self.text(1, 4)}</h3>" + inner
        else:
            inner = self.pick([self.text(2, 25), f"<p>{self.text(2, 40)}</p>", f'<a href="#">{self.text(2, 9)}</a>', f"<p>{self.text(2, 15)}</p>" + self.links(2)])
        if kind is self.FOOT and self.rng.random() < 0.6:
            inner = f"&copy; {self.word()} &middot; {inner}"
        return self.wrap(opening, inner)

    def form(self) -> str:
        return f'<form action="/{self.word()}"><label>{self.text(1, 4)}</label><input type="text"><button>{self.text(1, 3)}</button>' + self.pick(["", f"<p>{self.text(2, 20)}</p>"]) + "</form>"

    def page(self) -> str:
        chance = self.rng.random
        inner = [f"<h1>{self.MARK}{self.text(2, 14)}</h1>"] if chance() < 0.85 else []
        for _ in range(int(np.exp(self.rng.uniform(0, 3.2)))):
            inner.append(self.paragraph())
            if chance() < 0.04:
                inner.append(self.aside(self.pick_kind([self.ADS, self.NOTICE, self.SIDE])))
        if chance() < 0.08:
            inner.append(self.aside(self.TALK) if chance() < 0.5 else self.form())
        parts = [self.aside(k) for k, p in ((self.NOTICE, 0.25), (self.HEAD, 0.35), (self.MENU, 0.8), (self.ADS, 0.6), (self.SIDE, 0.2)) if chance() < p]
        parts.append(self.wrap(self.pick(self.MAIN), "".join(inner)))
        parts += [self.aside(k) for k, p in ((self.ADS, 0.25), (self.SIDE, 0.3), (self.TALK, 0.35)) if chance() < p]
        if chance() < 0.25:
            parts.append(self.form())
        parts += [self.aside(k) for k, p in ((self.NOTICE, 0.15), (self.FOOT, 0.85)) if chance() < p]
        return f"<html><head><title>{self.text(1, 9)}</title></head><body>" + "".join(parts) + "</body></html>"

    def pick_kind(self, kinds: list[list[str]]) -> list[str]:
        return kinds[int(self.rng.integers(len(kinds)))]


def training_pages(n: int, seed: int) -> tuple[list[list[tuple[Step, str, int]]], list[np.ndarray]]:
    """(blocks, labels) of written pages."""
    writer = PageWriter(seed)
    pages, labels = [], []
    for _ in range(n):
        found = blocks(writer.page())
        labels.append(np.array([PageWriter.MARK in t for _, t, _ in found], dtype=np.float32))
        pages.append([(p, " ".join(t.replace(PageWriter.MARK, "").split()), k) for p, t, k in found])
    return pages, labels


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller, trained on written pages; the same weights for the same arguments."""
    found, labels = training_pages(pages, seed)
    model = Labeller(seed)
    model.train(inputs_of(found), labels, epochs, seed=seed)
    return model


def main_text(pages: DataFrame, labeller: Labeller | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main) of every row.

    Null and empty pages have the empty text. Blocks of main text are joined by two line ends, in
    page order. Repeated rows are read each; an empty table gives no rows; other columns are neither
    read nor returned. Any markup is read: what isn't a tag is text, open elements end with the page.
    """
    shared = pages.sparkSession.sparkContext.broadcast(labeller or trained())
    source = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = [blocks(x) for x in batch.column("html").slice(at, 500).to_pylist()]
                kept = shared.value.label(found)
                texts = ["\n\n".join(t for (_, t, _), good in zip(page, own, strict=True) if good) for page, own in zip(found, kept, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").slice(at, 500), batch.column("url").slice(at, 500), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([int(x.sum()) for x in kept], pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")
