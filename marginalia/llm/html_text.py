"""Main text of web pages: a recurrent labeller reads a page's blocks in order, from both ends."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

#: Pages that give sentences and addresses for the training layouts, how many sentences, and how many layouts are made.
SEED_PAGES = 200
SENTENCES = 5000
LAYOUTS = 1200
HIDDEN = 16
PATH_BUCKETS, WORD_BUCKETS = 128, 32
WIDTH = PATH_BUCKETS + WORD_BUCKETS + 5
#: Blocks whose features are in memory at a time while a page is labelled.
AT_ONCE = 4096

#: Elements whose text is never shown, those whose content isn't markup, those that stand inside a line, have no end tag, or may stand in the head.
UNSEEN = frozenset("script style noscript template title svg math iframe object canvas audio video textarea xmp noembed noframes".split())
RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: The innermost open elements that the start of another one closes; every other block closes a paragraph.
CLOSES = {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr"), "option": ("option",)}

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
BEFORE_ATTRIBUTE, ATTRIBUTE, EQUALS, UNQUOTED = re.compile(r"[\s/]*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
NAMES = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
LETTERS = re.compile(r"[^a-z]+")
SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    path: tuple[int, ...]  # buckets of the open elements and of the words of their class, id and role
    last: int  # bucket of the innermost of these
    text: str
    linked: int  # characters of it inside links


class Scanner:
    """Tags, texts and skipped parts of a page in one forward pass; nothing is looked for twice where it was not found."""

    def __init__(self, page: str):
        self.page = page
        self.missing: set[str] = set()  # what doesn't occur any more

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def attributes_end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose attributes begin ``at``, -1 if the page ends in it; quoted values may hold ``>``."""
        page = self.page
        end = self.find(">", at)
        if end < 0:
            return -1
        if not (page.count('"', at, end) % 2 or page.count("'", at, end)):
            return end
        while True:
            at = BEFORE_ATTRIBUTE.match(page, at).end()
            if at >= len(page):
                return -1
            if page[at] == ">":
                return at
            at = ATTRIBUTE.match(page, at).end()
            equals = EQUALS.match(page, at)
            if equals:
                at = equals.end()
                quote = page[at : at + 1]
                if quote in ('"', "'") and quote:
                    closing = self.find(quote, at + 1)
                    if closing < 0:  # a quote that nothing closes: the tag ends at the next >
                        return self.find(">", at)
                    at = closing + 1
                else:
                    at = UNQUOTED.match(page, at).end()

    def raw_end(self, tag: str, at: int) -> tuple[int, int]:
        """(start, end) of the end tag of an element that holds no markup; the page's end if it has none."""
        page, what = self.page, f"</{tag}"
        if what in self.missing:
            return len(page), len(page)
        for m in re.compile(f"</{tag}(?=[\\s/>])", re.I).finditer(page, at):
            end = self.find(">", m.end())
            return m.start(), end + 1 if end >= 0 else len(page)
        self.missing.add(what)
        return len(page), len(page)

    def pieces(self) -> Iterator[tuple[str, str, str, bool]]:
        """(text before it, tag or "", its attributes, whether it is an end tag); the text after the last tag comes with no tag."""
        page, at, start = self.page, 0, 0
        while True:
            lt = page.find("<", at)
            if lt < 0 or lt + 1 >= len(page):
                yield page[start:], "", "", False
                return
            follows = page[lt + 1]
            closing = follows == "/"
            name = TAG_NAME.match(page, lt + 1 + closing)
            if name:
                end = self.attributes_end(name.end())
                tag = name[0].lower()
                if end < 0:  # a tag that the page ends in isn't shown
                    yield page[start:lt], "", "", False
                    return
                yield page[start:lt], tag, page[name.end() : end], closing
                start = at = end + 1
                if tag in RAW and not closing:
                    inner, at = self.raw_end(tag, at)
                    if inner == len(page) and tag not in ("script", "style"):  # never closed: only the tag is left out
                        at = start
                    start = at
                    yield "", tag, "", True
                continue
            if follows in "!?/":  # comments and what browsers take for them
                until = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
                end = self.find(until, lt + 2)
                yield page[start:lt], "<!", "", False
                if end < 0:
                    return
                start = at = end + len(until)
                continue
            at = lt + 1  # a plain <


def _bucket(word: str, n: int) -> int:
    return xxhash.xxh32_intdigest(word) % n


def blocks(page: str | None) -> list[Block]:
    """The page's runs of text between block tags, in time linear in the page.

    Elements that are never shown are left out at any depth; the head ends where its end tag, the body or anything
    that can't stand in a head begins. Attribute values end where browsers end them. A link ends with its end tag
    or with the element that it began in.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...], bool]] = []  # tag, path buckets, whether it is inside something unseen
    opened: dict[tuple[str, bool], int] = {}  # open elements by tag and by whether they are inside something unseen
    held: dict[int, int] = {}  # path buckets of the open elements, and how often
    parts: list[str] = []
    unseen = linked = 0
    link: int | None = None  # depth that the open link began at

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append(Block(tuple(held), stack[-1][1][-1] if stack else -1, text, min(linked, len(text))))
        linked = 0

    def push(tag: str, attributes: str) -> None:
        nonlocal unseen
        names = [f"<{tag}>"]
        for n in NAMES.finditer(attributes) if "=" in attributes else ():
            names += [w for w in LETTERS.split((n[1] or n[2] or n[3] or "").lower()) if w]
        buckets = (*(_bucket(w, PATH_BUCKETS) for w in names), _bucket(names[-1] + "/", PATH_BUCKETS))
        stack.append((tag, buckets, unseen > 0))
        opened[tag, unseen > 0] = opened.get((tag, unseen > 0), 0) + 1
        unseen += tag in UNSEEN
        for b in buckets[:-1]:
            held[b] = held.get(b, 0) + 1

    def pop() -> str:
        nonlocal unseen, link
        tag, buckets, inside = stack.pop()
        opened[tag, inside] -= 1
        unseen -= tag in UNSEEN
        for b in buckets[:-1]:
            held[b] -= 1
            if not held[b]:
                del held[b]
        if link is not None and link > len(stack):
            link = None
        return tag

    def end(tag: str) -> None:
        while pop() != tag:
            pass

    for before, tag, attributes, closing in Scanner(page or "").pieces():
        if before and not unseen:
            if opened.get(("head", False)) and not before.isspace():
                end("head")
            parts.append(before)
            if link is not None:
                linked += len(before.strip())
        if tag in ("", "<!"):
            continue
        if not closing and not unseen and tag not in IN_HEAD and opened.get(("head", False)):
            end("head")
        if tag == "a":
            link = None if closing else len(stack)
        if tag in INLINE:
            if tag in ("br", "img") and not unseen:
                parts.append(" ")
            continue
        inside = bool(opened.get((tag, True)))
        if tag not in UNSEEN and (not unseen or closing and not inside and opened.get((tag, False))):
            flush()
        if closing:
            if inside or opened.get((tag, False)):
                end(tag)
            continue
        if tag == "head" and any(x != "html" for x, _, _ in stack[-2:]):
            continue
        if not unseen and tag not in UNSEEN:
            while stack and stack[-1][0] in CLOSES.get(tag, ("p",)):
                pop()
        if tag not in VOID and not attributes.endswith("/"):
            push(tag, attributes)
    flush()
    return out


def vectors(found: list[Block], start: int = 0, stop: int | None = None) -> np.ndarray:
    """A row for each block of found[start:stop]: hashed parts of its path, hashed words (shares), its length, link share and place."""
    some = found[start:stop]
    x = np.zeros((len(some), WIDTH), np.float32)
    for i, b in enumerate(some):
        x[i, list(b.path)] = 1
        if b.last >= 0:
            x[i, b.last] = 1
        own = b.text.lower().split()
        for w in own:
            x[i, PATH_BUCKETS + _bucket(w, WORD_BUCKETS)] += 1 / len(own)
        x[i, -5:] = (np.log1p(len(b.text)) / 8, b.linked / len(b.text), (start + i) / len(found), b.text[-1] in ".!?…", 1)
    return x


class Labeller(NamedTuple):
    """Two recurrent layers (one for each direction) of ``HIDDEN`` cells and a linear output."""

    wx: np.ndarray  # direction, WIDTH, 4 * HIDDEN
    wh: np.ndarray  # direction, HIDDEN, 4 * HIDDEN
    b: np.ndarray  # direction, 4 * HIDDEN
    out: np.ndarray  # 2 * HIDDEN + 1


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _run(seen: np.ndarray, wh: np.ndarray, mask: np.ndarray, taped: bool = True) -> tuple[np.ndarray, list]:
    """Hidden states of one direction over (page, step, weighted input); steps that the mask leaves out keep the state."""
    n, steps, _ = seen.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    states, tape = np.zeros((n, steps, HIDDEN), np.float32), []
    for t in range(steps):
        z = seen[:, t] + h @ wh
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[:, t, None]
        new = f * c + i * g
        if taped:
            tape.append((h, c, i, f, o, g, new, m))
        c = np.where(m, new, c)
        h = np.where(m, o * np.tanh(new), h)
        states[:, t] = h
    return states, tape


def _back(dstates: np.ndarray, x: np.ndarray, wh: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, steps, width = x.shape
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    dzs, dwh = np.zeros((n, steps, 4 * HIDDEN), np.float32), np.zeros_like(wh)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, new, m = tape[t]
        dh = dh + dstates[:, t]
        th = np.tanh(new)
        dn = np.where(m, dc + dh * o * (1 - th * th), 0)
        do = np.where(m, dh * th, 0) * o * (1 - o)
        dz = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), do, dn * i * (1 - g * g)], axis=1)
        dzs[:, t] = dz
        dwh += h.T @ dz
        dh = np.where(m, 0, dh) + dz @ wh.T
        dc = np.where(m, dn * f, dc)
    return x.reshape(-1, width).T @ dzs.reshape(-1, 4 * HIDDEN), dwh, dzs.sum((0, 1))


def _pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    most = max(map(len, rows))
    x, mask = np.zeros((len(rows), most, rows[0].shape[1]), np.float32), np.zeros((len(rows), most), bool)
    for i, r in enumerate(rows):
        x[i, : len(r)], mask[i, : len(r)] = r, True
    return x, mask


def weighed(model: Labeller, found: list[Block]) -> np.ndarray:
    """The blocks' features through the input weights of both directions, some blocks at a time."""
    wx, b = np.concatenate(model.wx, axis=1), np.concatenate(model.b)
    return np.concatenate([vectors(found, at, at + AT_ONCE) @ wx + b for at in range(0, len(found), AT_ONCE)] or [np.zeros((0, len(b)), np.float32)])


def predict(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page the probabilities that its blocks are main text. Pages of like length go together."""
    out: list[np.ndarray] = [np.empty(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order:
        take = max(1, 20_000 // len(pages[order[min(len(order), 256) - 1]]))
        now, order = order[: min(256, take)], order[min(256, take) :]
        x, mask = _pad([weighed(model, pages[i]) for i in now])
        ahead, _ = _run(x[..., : 4 * HIDDEN], model.wh[0], mask, False)
        behind, _ = _run(x[:, ::-1, 4 * HIDDEN :], model.wh[1], mask[:, ::-1], False)
        p = _sigmoid(np.concatenate([ahead, behind[:, ::-1]], axis=2) @ model.out[:-1] + model.out[-1])
        for j, i in enumerate(now):
            out[i] = p[j, : len(pages[i])]
    return out


def fit(rows: list[np.ndarray], labels: list[np.ndarray], epochs: int = 6, seed: int = 5) -> Labeller:
    """Adam on the log loss of every block, in batches of pages of like length."""
    rng = np.random.default_rng(seed)
    shapes = [(2, WIDTH, 4 * HIDDEN), (2, HIDDEN, 4 * HIDDEN), (2, 4 * HIDDEN), (2 * HIDDEN + 1,)]
    p = [rng.normal(0, 0.1, s).astype(np.float32) for s in shapes]
    p[2][:, HIDDEN : 2 * HIDDEN] += 1  # cells remember at first
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
    batches = [order[i : i + 32] for i in range(0, len(order), 32)]
    for _ in range(epochs):
        for k in rng.permutation(len(batches)).tolist():
            x, mask = _pad([rows[i] for i in batches[k]])
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(batches[k]):
                y[j, : len(labels[i])] = labels[i]
            ahead, tape = _run(x @ p[0][0] + p[2][0], p[1][0], mask)
            back, tape2 = _run(x[:, ::-1] @ p[0][1] + p[2][1], p[1][1], mask[:, ::-1])
            both = np.concatenate([ahead, back[:, ::-1]], axis=2)
            d = np.where(mask, _sigmoid(both @ p[3][:-1] + p[3][-1]) - y, 0) / mask.sum()
            dboth = d[..., None] * p[3][:-1]
            one = _back(dboth[..., :HIDDEN], x, p[1][0], tape)
            two = _back(dboth[:, ::-1, HIDDEN:], x[:, ::-1], p[1][1], tape2)
            grads = [np.stack(z) for z in zip(one, two)] + [np.append((both * d[..., None]).sum((0, 1)), d.sum()).astype(np.float32)]
            step += 1
            for q in range(4):
                m[q] = 0.9 * m[q] + 0.1 * grads[q]
                v[q] = 0.999 * v[q] + 0.001 * grads[q] ** 2
                p[q] -= 0.01 * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.999**step)) + 1e-8)
    return Labeller(*p)


#: What wraps main text and what wraps the rest, as tags and words of class names.
MAIN_WRAPS = ("article", "main", "article", 'div class="content"', 'div class="post-body"', 'div id="article"', 'section class="story"', 'div class="entry text"', 'main role="main"', 'div class="article-body"')
REST_WRAPS = (
    "nav", "header", "footer", "aside", 'div class="ad"', 'div class="ads banner"', 'div class="advert"', 'div class="sponsored promo"', 'div class="sidebar"', 'aside class="related"', 'div class="menu"',
    'div class="cookie notice"', 'div class="cookie-banner"', 'div class="consent notice"', 'form class="search"', 'form', 'div class="newsletter signup"', 'div class="subscribe"', 'div class="breadcrumbs"', 'ul class="nav"',
    'div class="share social"', 'section class="comments"', 'div id="comments"', 'div class="comment"', 'ol class="comment-list"', 'div class="popup modal"', 'div class="widget"', 'div class="footer"', 'div class="header"',
    'section class="related"', 'div class="pagination"', 'div role="navigation"', 'div role="banner"', 'div role="complementary"', 'div role="contentinfo"', 'div class="toolbar"', 'div class="alert notice"', 'div class="tags meta"',
)


def layout(sentences: list[str], rng: random.Random) -> tuple[str, list[str]]:
    """A made page over true sentences, and its main blocks' texts."""
    used = iter(range(10**9))

    def say(n: int) -> str:
        return f"{' '.join(rng.choice(sentences) for _ in range(n))} m{next(used)}"

    def wrap(w: str, inner: str) -> str:
        return f"<{w}>{inner}</{w.split()[0]}>"

    def rest() -> str:
        w = rng.choice(REST_WRAPS)
        kind = rng.random()
        if kind < 0.35:
            inner = "<ul>" + "".join(f'<li><a href="#">{" ".join(say(1).split()[-rng.randint(2, 5):])}</a></li>' for _ in range(rng.randint(2, 7))) + "</ul>"
        elif kind < 0.7:
            inner = say(1)
        else:
            inner = "".join(f"<{t}>{say(rng.randint(1, 3))}</{t}>" for t in (rng.choice(("p", "p", "div", "h3", "li", "span")) for _ in range(rng.randint(1, 4))))
        return wrap(w, inner)

    main: list[str] = []

    def body() -> str:
        inner = []
        for k in range(rng.randint(1, 9)):
            text = say(rng.choice((1, 1, 2, 4, 8))) if rng.random() < 0.9 else " ".join(say(1).split()[-3:])
            main.append(text)
            tag = "h1" if k == 0 and rng.random() < 0.7 else rng.choice(("p", "p", "p", "p", "h2", "li", "blockquote", "pre", "td", "div"))
            inner.append(f"<table><tr><td>{text}</td></tr></table>" if tag == "td" else f"<ul><li>{text}</li></ul>" if tag == "li" else f"<{tag}>{text}</{tag}>")
            if rng.random() < 0.2:
                inner.append(rest())
        return "".join(inner)

    page = "".join(rest() for _ in range(rng.randint(0, 4)))
    mid = wrap(rng.choice(MAIN_WRAPS), body())
    if rng.random() < 0.3:
        mid = wrap(rng.choice(("div", 'div class="container"', 'div id="page"', 'div class="wrapper row"')), mid + "".join(rest() for _ in range(rng.randint(0, 2))))
    return page + mid + "".join(rest() for _ in range(rng.randint(0, 4))), main


def train(pages: DataFrame, seed_pages: int = SEED_PAGES, layouts: int = LAYOUTS, sentences: int = SENTENCES) -> Labeller:
    """Fit to ``layouts`` made pages, whose labels are known, over at most ``sentences`` sentences of at most ``seed_pages`` pages, those of the smallest hashes."""
    some = pages.where("html is not null").orderBy(F.xxhash64("page_id", "html")).limit(seed_pages).select("html").toArrow().to_pandas()
    found = {s.strip() for page in some["html"] for b in blocks(page) for s in b.text.split(". ") if s.strip()}
    said = sorted(found, key=lambda x: (xxhash.xxh64_intdigest(x), x))[:sentences] or ["The page has some text"]
    rng = random.Random(11)
    rows, labels = [], []
    for _ in range(layouts):
        page, main = layout(said, rng)
        own = blocks(page)
        if own:
            rows.append(vectors(own))
            labels.append(np.array([b.text in {SPACE.sub(" ", html.unescape(m)).strip() for m in main} for b in own], np.float32))
    return fit(rows, labels)


def extract(pages: DataFrame, seed_pages: int = SEED_PAGES, layouts: int = LAYOUTS) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its main blocks in order, joined by line feeds.

    Null and empty pages, and pages without a main block, give an empty text. Null ids and addresses stay null;
    repeated rows give a row each; other columns are ignored; an empty table gives an empty result. Pages of any
    length are read whole, in time linear in their length.
    """
    own = pages.select("page_id", "url", "html")
    shared = pages.sparkSession.sparkContext.broadcast(train(own, seed_pages, layouts))

    @F.pandas_udf(T.StringType())
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for series in batches:
            out: list[str] = []
            for at in range(0, len(series), 512):
                found = [blocks(p) for p in series.iloc[at : at + 512]]
                good = predict(model, found)
                out += ["\n".join(b.text for b, p in zip(bs, ps) if p >= 0.5) for bs, ps in zip(found, good)]
            yield pd.Series(out, dtype="object")

    out = own.withColumn("text", main_text("html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
