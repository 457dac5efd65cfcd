"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks: runs of text between block tags, each with the path of its open
elements. A bidirectional LSTM in numpy reads the sequence of a page's blocks, each as hashed tags,
class and id words of its path, hashed words of its text and a few lengths, and so labels every block
with the whole document as context. The blocks labelled as main text are joined by line breaks.

The labeller is trained here, on the driver, within seconds and with a fixed seed, on pages made by
rule: layouts of articles in various wrappers among menus, notices, adverts, forms and comments, in
made-up words. Only its weights (some hundred kilobytes, whatever the data) are broadcast.

Edge cases: null and empty html give an empty text; markup that never ends is text or is skipped like
browsers do; a page of any length is read whole; repeated rows are read each; an empty table gives an
empty result; input columns named as a result column are replaced by it.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_left
from collections.abc import Generator, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import map_columns, slices

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
#: Where markup begins, and the characters that decide where a tag ends.
START, MARK = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)"), re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: HTML's elements without an end tag, whose content is no markup and no text of the page, and inside of lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I | re.A) for t in ("script", "style", "title", "textarea")}
#: Marks what a template element holds, which is no part of the page.
HIDDEN_TAG = "template"
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag that ends an open one of these kinds.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body div article section main aside nav header footer form blockquote".split())
PATHS, WORDS, NUMBERS, HIDDEN = 1024, 128, 8, 16
WIDTH = PATHS + WORDS + NUMBERS
SLICE_CHARS = 1_000_000


def hashed(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


@lru_cache(200_000)
def path_bits(tag: str, attributes: str) -> int:
    """The hashed tag and words of an element as bits of a number."""
    out = 1 << hashed(tag, PATHS)
    for m in ATTRIBUTE.finditer(attributes):
        for w in re.findall(r"[a-z]+", (m[1] or m[2] or m[3] or "").lower()):
            out |= 1 << hashed("." + w, PATHS)
    return out


def tags(page: str) -> Generator[tuple[int, int, bool, str | None, str], int | None, None]:
    """(begin, end, whether an end tag, name in lower case or None for what is none, attributes) of the page's markup.

    Every character is looked at a bounded number of times: no tag is looked for behind the last ">", and where a quote
    is not closed as it should be, the ends of all tags behind are found at once, from the last one backwards. The
    caller may send the place to go on from.
    """
    last = page.rfind(">") + 1
    pos, marks, close = 0, None, None
    while True:
        if marks is None:
            m = TAG.search(page, pos, last)
            if not m:
                break
            begin, end = m.span()
            if m[5] is not None:  # no end outside of quotes
                marks, close = tag_ends(page, last)
            found = (bool(m[1]), m[2], m[3]) if m[2] else (bool(m[4]), m[5], m[6])
        else:
            m = START.search(page, pos, last)
            if not m:
                break
            begin = m.start()
            if m[2]:
                k = bisect_left(marks, m.end())
                end = close[k] if k < len(marks) and close[k] >= 0 else page.find(">", m.end())
                found = bool(m[1]), m[2], page[m.end() : end]
                end += 1
            else:
                end = last if m[0] == "<!--" else page.find(">", m.end()) + 1
                if m[0] == "<!--" and (k := page.find("-->", m.end(), last)) >= 0:
                    end = k + 3
                found = False, None, ""
        if found[1] is None and page.startswith("<!--", begin) and not page.endswith("-->", begin + 4, end):
            end = len(page)  # a comment without an end
        sent = yield begin, end, found[0], found[1].lower() if found[1] else None, found[2] or ""
        pos = end if sent is None else sent
        if sent is not None:
            yield  # type: ignore[misc]
    if (rest := page.find("<!--", max(pos, last))) >= 0:
        yield rest, len(page), False, None, ""


def tag_ends(page: str, last: int) -> tuple[list[int], list[int]]:
    """Places of quotes and ">", and for each where a tag ends that is outside of quotes there, or -1."""
    marks = [m.start() for m in MARK.finditer(page, 0, last)]
    close, later = [-1] * (len(marks) + 1), {}
    for k in range(len(marks) - 1, -1, -1):
        c = page[marks[k]]
        if c == ">":
            close[k] = marks[k]
        else:
            close[k] = close[later[c] + 1] if c in later else -1
            later[c] = k
    return marks, close


def blocks(page: str | None) -> list[tuple[int, str, int]]:
    """Leaf blocks in page order: the bits of the path, text with single spaces, and characters inside links.

    An element has the bits of its path with it, so that a block costs the same however many elements are open.
    """
    page = page or ""
    out: list[tuple[int, str, int]] = []
    open_: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}
    scopes: list[int] = []
    held: list[str] = []
    linked = at = in_link = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text and not places.get(HIDDEN_TAG):
                out.append((open_[-1][1] if open_ else 0, text, linked))
            held.clear()
        linked = 0

    def say(a: int, b: int) -> None:
        nonlocal linked
        if a < b:
            text = entities.unescape(page[a:b]) if "&" in page[a:b] else page[a:b]
            held.append(text)
            linked += len(text) * (in_link > 0)

    def leave(k: int) -> None:
        """Close all elements from the k-th on."""
        while len(open_) > k:
            tag = open_.pop()[0]
            places[tag].pop()
            if tag in SCOPE:
                scopes.pop()

    markup = tags(page)
    for begin, stop, end, tag, attributes in markup:
        say(at, begin)
        at = stop
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                held.append(" ")
            elif tag == "a":
                in_link = 0 if end else 1
            continue
        if end:
            if places.get(tag):
                flush()
                leave(places[tag][-1])
            continue
        flush()
        in_link = 0
        if tag in RAW:
            close = RAW[tag].search(page, stop)
            at = close.start() if close else len(page)
            markup.send(at)
            continue
        if tag in VOID:
            continue
        if tag in ENDS or tag in SCOPE or tag[0] == "h" and tag[1:].isdigit():
            last = max((places[t][-1] for t in ENDS.get(tag, {"p"}) if places.get(t)), default=-1)
            if last > (scopes[-1] if scopes else -1):
                leave(last)
        places.setdefault(tag, []).append(len(open_))
        if tag in SCOPE:
            scopes.append(len(open_))
        open_.append((tag, (open_[-1][1] if open_ else 0) | path_bits(tag, attributes)))
    say(at, len(page))
    flush()
    return out


def features(leaves: list[tuple[int, str, int]], from_start: bool = True, to_end: bool = True) -> np.ndarray:
    """A row for each block of a page, or of a part of it."""
    x = np.zeros((len(leaves), WIDTH), np.float32)
    if leaves:
        raw = np.frombuffer(b"".join(path.to_bytes(PATHS // 8, "little") for path, _, _ in leaves), np.uint8)
        x[:, :PATHS] = np.unpackbits(raw.reshape(len(leaves), -1), axis=1, bitorder="little")
        split = [text.split(" ") for _, text, _ in leaves]
        n_words, n = np.array(list(map(len, split))), np.array([len(text) for _, text, _ in leaves])
        found = np.fromiter((hashed(w.lower(), WORDS) for words in split for w in words), np.int64, n_words.sum())
        counts = np.bincount(np.repeat(np.arange(len(leaves)), n_words) * WORDS + found, minlength=len(leaves) * WORDS)
        x[:, PATHS : PATHS + WORDS] = counts.reshape(len(leaves), WORDS) / n_words[:, None]
        ends, linked = [text[-1] in ".!?…\"'”»" for _, text, _ in leaves], np.array([y for _, _, y in leaves])
        for k, numbers in enumerate((np.log1p(n) / 8, np.log1p(n_words) / 6, linked / n, ends, n_words < 4, 0, 0, 1)):
            x[:, PATHS + WORDS + k] = numbers
        x[0, PATHS + WORDS + 5], x[-1, PATHS + WORDS + 6] = from_start, to_end
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.minimum(np.maximum(x, -30), 30)))


class Labeller:
    """Two LSTMs, one for each direction, and a logistic output. Weights: wx, wh, b of either, then the output's."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = []
        for _ in range(2):
            wx = np.zeros((WIDTH, 4 * HIDDEN), np.float32)
            wx[PATHS:] = r.normal(0, 0.1, (WIDTH - PATHS, 4 * HIDDEN))
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p += [wx + r.normal(0, 0.01, wx.shape).astype(np.float32), r.normal(0, 0.25, (HIDDEN, 4 * HIDDEN)).astype(np.float32), bias]
        self.p += [r.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)]

    def project(self, leaves: list) -> tuple[np.ndarray, np.ndarray]:
        """What a page's blocks put into either LSTM, from their features in parts."""
        parts = (features(leaves[k : k + 2000], k == 0, k + 2000 >= len(leaves)) for k in range(0, len(leaves), 2000))
        ways = zip(*([x @ self.p[3 * d] + self.p[3 * d + 2] for d in range(2)] for x in parts), strict=True)
        return tuple(np.concatenate(w) for w in ways)

    def run(self, x: list, keep: bool = False):
        """Probabilities of the blocks of pages (features, or what project makes), all of a batch at once, by step. With keep, also what learning needs."""
        size = lambda a: len(a[0]) if isinstance(a, tuple) else len(a)
        lengths = np.array([size(a) for a in x])
        steps, shortest, n = int(lengths.max(initial=0)), int(lengths.min(initial=1 << 62)), len(x)
        trace, hidden = [], []
        for d in range(2):
            wx, wh, b = self.p[3 * d : 3 * d + 3]
            z_in = np.zeros((steps, n, 4 * HIDDEN), np.float32)
            for k, a in enumerate(x):
                z = a[d] if isinstance(a, tuple) else a @ wx + b
                z_in[: len(z), k] = z[::-1] if d else z
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            hs, kept = np.zeros((steps, n, HIDDEN), np.float32), []
            for t in range(steps):
                z = z_in[t] + h @ wh
                gates = sigmoid(z[:, : 3 * HIDDEN])
                i, f, o = (gates[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
                g = np.tanh(z[:, 3 * HIDDEN :])
                before = (h, c)
                if keep or t >= shortest:
                    on = (t < lengths)[:, None]
                    c = np.where(on, f * c + i * g, c)
                    h = np.where(on, o * np.tanh(c), h)
                else:  # all pages go on
                    c = f * c + i * g
                    h = o * np.tanh(c)
                hs[t] = h
                if keep:
                    kept.append((i, f, o, g, c, *before, on))
            trace.append(kept)
            hidden.append([hs[: size(a), k][::-1] if d else hs[: size(a), k] for k, a in enumerate(x)])
        w, b = self.p[6:]
        both = [np.concatenate([p, q], 1) for p, q in zip(*hidden, strict=True)]
        probs = [sigmoid(a @ w + b) for a in both]
        return (probs, both, trace) if keep else probs

    def gradient(self, x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
        probs, both, trace = self.run(x, keep=True)
        total = sum(map(len, x))
        errors = [(p - t).astype(np.float32) / total for p, t in zip(probs, y, strict=True)]
        out = [np.zeros_like(a) for a in self.p]
        out[6] = sum(a.T @ e for a, e in zip(both, errors, strict=True))
        out[7] = np.array([sum(e.sum() for e in errors)], np.float32)
        steps = len(trace[0])
        for d in range(2):
            wh = self.p[3 * d + 1]
            up = np.zeros((steps, len(x), HIDDEN), np.float32)
            for k, e in enumerate(errors):
                s = e[:, None] * self.p[6][d * HIDDEN : (d + 1) * HIDDEN]
                up[: len(e), k] = s[::-1] if d else s
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            dz = np.zeros((steps, len(x), 4 * HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1):
                i, f, o, g, c, h0, c0, on = trace[d][t]
                now = np.where(on, dh + up[t], 0)
                th = np.tanh(c)
                dcn = np.where(on, dc, 0) + now * o * (1 - th * th)
                dz[t] = np.concatenate([dcn * g * i * (1 - i), dcn * c0 * f * (1 - f), now * th * o * (1 - o), dcn * i * (1 - g * g)], 1)
                out[3 * d + 1] += h0.T @ dz[t]
                dh = np.where(on, dz[t] @ wh.T, dh)
                dc = np.where(on, dcn * f, dc)
            for k, a in enumerate(x):
                z = dz[: len(a), k]
                out[3 * d] += a.T @ (z[::-1] if d else z)
            out[3 * d + 2] = dz.sum((0, 1))
        return out

    def fit(self, x: list[np.ndarray], y: list[np.ndarray], epochs: int = 6, batch: int = 16, rate: float = 0.02, seed: int = 1) -> Labeller:
        """Adam over pages in batches of like length."""
        r = np.random.default_rng(seed)
        m, v, t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        order = sorted(range(len(x)), key=lambda k: len(x[k]))
        batches = [order[k : k + batch] for k in range(0, len(order), batch)]
        for epoch in range(epochs):
            for k in r.permutation(len(batches)):
                t += 1
                for j, g in enumerate(self.gradient([x[i] for i in batches[k]], [y[i] for i in batches[k]])):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.99 * v[j] + 0.01 * g * g
                    self.p[j] -= rate * 0.6**epoch * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-6)
        return self


def made_page(r: np.random.Generator) -> tuple[str, dict[str, int]]:
    """A page made by rule, and 1 for each block text that is main text, 0 for the others."""
    pick = lambda *x: x[r.integers(len(x))]
    syllables = [a + b for a in "bdfgklmnprstvz" for b in ("a", "e", "i", "o", "u", "an", "er", "in")]
    word = lambda: "".join(r.choice(syllables, r.integers(1, 4)))
    line = lambda a, b: " ".join(word() for _ in range(r.integers(a, b))).capitalize()
    truth: dict[str, int] = {}

    def leaf(tag: str, text: str, main: int, attributes: str = "") -> str:
        truth[text] = main
        inner = pick(text, text, f"<b>{text}</b>", f"<span>{text}</span>")
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def links(n: int, item: str = "li") -> str:
        out = []
        for _ in range(n):
            text = line(1, 4)
            truth[text] = 0
            out.append(f'<{item}><a href="/{word()}">{text}</a></{item}>')
        return "".join(out)

    def named(*names: str) -> str:
        if r.random() < 0.1:  # sites have words of their own, too
            return f' {pick("class", "id")}="{word()}"'
        return pick(f' class="{pick(*names)}"', f' class="{pick(*names)} {word()}"', f' id="{pick(*names)}"')

    prose = lambda: ". ".join(line(4, 14) for _ in range(r.integers(1, 5))) + pick(".", ".", ".", "!", "?", "")

    def remark(told: bool) -> str:
        """A reader's comment. Without a telling name, its author, date or reply link tell."""
        who = lambda: pick(leaf(pick("p", "div", "h4"), line(1, 4), 0, pick("", named("author", "user", "name"))), links(1, "div"))
        about = "".join(who() for _ in range(r.integers(0 if told else 1, 3)))
        said = "".join(leaf("p", prose(), 0) for _ in range(1 + (r.random() < 0.2)))
        answer = links(1, pick("p", "div")) if r.random() < 0.4 else ""
        t = pick("div", "div", "li", "section")
        return f"<{t}{pick('', named('comment', 'reply', 'response'))}>{about}{said}{answer}</{t}>"

    def comments() -> str:
        t, told = pick("div", "section", "ol", "aside"), r.random() < 0.6
        known = ("comments", "comment-list", "comment", "replies", "discussion", "responses", "respond", "reactions", "disqus", "reader-comments", "feedback")
        name = named(*known) if told else pick("", f' class="{word()}"', f' id="{word()}"')
        title = leaf(pick("h2", "h3", "p"), line(1, 4), 0) if r.random() < 0.4 else ""
        return f"<{t}{name}>{title}{''.join(remark(told) for _ in range(r.integers(1 if told else 2, 5)))}</{t}>"

    boiler = {
        "menu": lambda: (f"<nav><ul>{links(r.integers(2, 7))}</ul></nav>" if r.random() < 0.5 else f"<{(t := pick('div', 'ul'))}{named('menu', 'nav', 'navigation', 'navbar', 'topnav', 'breadcrumb', 'breadcrumbs', 'tabs', 'toc')}>{links(r.integers(2, 7), 'li' if t == 'ul' else pick('div', 'li'))}</{t}>"),
        "header": lambda: f"<{(t := pick('header', 'div'))}{'' if t == 'header' else named('header', 'masthead', 'banner', 'top', 'site-header', 'logo')}>{leaf(pick('h1', 'div', 'p'), line(1, 6), 0)}{links(r.integers(0, 3), 'div')}</{t}>",
        "sidebar": lambda: f"<{(t := pick('aside', 'div', 'section'))}{'' if t == 'aside' and r.random() < 0.6 else named('sidebar', 'aside', 'widget', 'related', 'rail', 'recommended', 'popular', 'trending', 'more-stories', 'side')}>{leaf(pick('h2', 'h3', 'h4'), line(1, 4), 0)}{pick(lambda: links(r.integers(1, 6)), lambda: leaf('p', prose(), 0))()}</{t}>",
        "ad": lambda: f"<div{named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-slot', 'sponsor', 'promotion')}>{pick(lambda: leaf('p', prose(), 0), lambda: leaf('div', line(2, 8), 0), lambda: links(1, 'div'))()}</div>",
        "bare ad": lambda: leaf("div", pick(prose(), line(2, 9)), 0, named("ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor")),
        "notice": lambda: f"<div{named('cookie', 'cookies', 'notice', 'consent', 'cookie-banner', 'gdpr', 'alert', 'newsletter', 'subscribe', 'paywall', 'popup', 'modal', 'disclaimer', 'banner')}>{leaf('p', prose(), 0)}</div>",
        "form": lambda: f"<form{pick('', named('search', 'login', 'signup', 'contact'))}>{leaf(pick('label', 'p', 'div', 'legend'), line(1, 8), 0)}<input type='text'></form>",
        "comments": comments,
        "share": lambda: f"<div{named('share', 'social', 'sharing', 'tags', 'byline-tools', 'toolbar', 'pagination', 'pager', 'buttons')}>{links(r.integers(1, 5), pick('li', 'div'))}</div>",
        "footer": lambda: f"<{(t := pick('footer', 'div'))}{'' if t == 'footer' else named('footer', 'site-footer', 'copyright', 'bottom', 'legal', 'colophon')}>{pick(lambda: leaf('p', '© ' + line(2, 9) + pick('.', ''), 0), lambda: leaf('div', prose(), 0), lambda: links(r.integers(1, 5)))()}</{t}>",
        "bare footer": lambda: leaf("footer", pick("© ", "") + line(2, 4) + " · " + prose(), 0),
    }

    def article() -> str:
        out = [leaf("h1", line(2, 9), 1)] if r.random() < 0.8 else []
        for _ in range(r.integers(1, 9)):
            kind = r.random()
            if kind < 0.7:
                out.append(leaf("p", prose() if r.random() < 0.85 else line(1, 4) + ".", 1))
            elif kind < 0.78:
                out.append(leaf(pick("h2", "h3"), line(1, 6), 1))
            elif kind < 0.83:
                out.append(f"<blockquote>{leaf('p', prose(), 1)}</blockquote>")
            elif kind < 0.9:
                out.append(f"<{(t := pick('ul', 'ol'))}>{''.join(leaf('li', line(2, 12), 1) for _ in range(r.integers(1, 5)))}</{t}>")
            elif kind < 0.93:
                out.append(f"<table><tr>{''.join(leaf('td', line(1, 4), 1) for _ in range(r.integers(1, 5)))}</tr></table>")
            elif kind < 0.95:
                out.append(leaf("pre", line(3, 12), 1))
            else:
                out.append(boiler[pick("ad", "bare ad", "share", "form", "notice", "sidebar")]())
        return "".join(out)

    def parts(names: list[str], least: int, most: int) -> str:
        return "".join(boiler[names[r.integers(len(names))]]() for _ in range(r.integers(least, most)))

    top = parts(["menu", "header", "ad", "bare ad", "notice", "form"], 0, 4)
    wrap = pick("article", "article", "article", "main", "div-named", "section-named", "div", "bare", "both")
    inner = article()
    if r.random() < 0.25 and wrap in ("article", "main", "both"):
        inner += comments()
    if wrap in ("article", "main"):
        body = f"<{wrap}>{inner}</{wrap}>"
    elif wrap == "both":
        body = f"<main><article{pick('', named('post', 'story'))}>{inner}</article></main>"
    elif wrap.endswith("named"):
        t = wrap.split("-")[0]
        body = f"<{t}{named('content', 'post-content', 'entry-content', 'article-body', 'story', 'main', 'post', 'body', 'text', 'article')}>{inner}</{t}>"
    else:
        body = f"<div>{inner}</div>" if wrap == "div" else inner
    if r.random() < 0.12:  # laid out by a table, the menu in a cell of its own
        side = f"<td{pick('', named('menu', 'left', 'nav', 'sidebar'))}>{links(r.integers(2, 7), pick('p', 'div', 'li'))}</td>"
        cell = f"<td{pick('', named('content', 'main', 'right'))}>{body}</td>"
        body = f"<table><tr>{side}{cell}</tr></table>"
    bottom = parts(["footer", "bare footer", "comments", "sidebar", "share", "ad", "form", "menu", "notice"], 0, 4)
    whole = top + body + bottom
    whole = f"<div{pick('', named('wrapper', 'page', 'container', 'layout'))}>{whole}</div>" if r.random() < 0.3 else whole
    return f"<html><head><title>{line(1, 6)}</title></head><body{pick('', named('home', 'page', 'site'))}>{whole}</body></html>", truth


@lru_cache(1)
def trained(pages: int = 700, seed: int = 3) -> Labeller:
    """The labeller, fitted to pages made by rule."""
    r = np.random.default_rng(seed)
    x, y = [], []
    for _ in range(pages):
        page, truth = made_page(r)
        leaves = blocks(page)
        x.append(features(leaves))
        y.append(np.array([truth[t] for _, t, _ in leaves], np.float32))
    return Labeller().fit(x, y)


def label(own: Labeller, pages: list[list], most: int = 60_000) -> Iterator[np.ndarray]:
    """Whether each block of each page is main text; pages of like length go together, up to some blocks."""
    out: dict[int, np.ndarray] = {}
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    while order:
        longest, n = len(pages[order[-1]]), 1
        while n < len(order) and (n + 1) * longest <= most and n < 256:
            n += 1
        some, order = order[-n:], order[:-n]
        for k, p in zip(some, own.run([own.project(pages[k]) for k in some]), strict=True):
            out[k] = p > 0.5
    for k in range(len(pages)):
        yield out.get(k, np.zeros(0, bool))


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """pages with text (the main text) and n_chars."""
    held = pages.sparkSession.sparkContext.broadcast(trained().p)

    def make(batch: pa.RecordBatch) -> Iterator:
        own = Labeller.__new__(Labeller)
        own.p = held.value
        raw = batch.column(html_col).to_pylist()
        for a, b in slices(raw, SLICE_CHARS):
            leaves = [blocks(x) for x in raw[a:b]]
            texts = ["\n".join(t for (_, t, _), main in zip(page, chosen, strict=True) if main) for page, chosen in zip(leaves, label(own, leaves), strict=True)]
            yield (a, b), [texts, list(map(len, texts))]

    return map_columns(pages, T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]), make)
