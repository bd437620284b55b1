"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, the runs of text between block-level tags.  Each block is
a vector of its hashed tag path, its hashed words and a few figures; a bidirectional LSTM
in numpy reads the whole page's sequence and says of every block whether it belongs to the
article, so a block is judged in the context of all others.

The model is trained when the operator runs, on a bounded sample of the pages.  Their
labels come from what authors' markup says (an article element, navigation, elements named
like furniture); the model never sees that verdict, only the tags, names, words and layout.
Each sampled page is also learnt with invented page furniture mixed in, with its names
scrambled and its telling elements renamed, so that the labels must be found from the text
and its place in the page, and with parts of the article in elements named like furniture.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

# HTML elements by how their text is laid out or used.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("script style template iframe svg canvas head title select textarea button audio video map".split())
RAW_TAGS = frozenset("script style iframe title textarea head".split())  # their insides are not markup, or end the head
CLOSES_P = BLOCK_TAGS - {"body", "html"}
# Names that page authors give to page furniture, and to articles.
FURNITURE = frozenset("ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot colophon copyright sidebar side aside widget widgets related recommended cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search form share sharing social follow comment comments commentlist reply replies respond responses disqus discussion feedback pagination pager skip toolbar tags complementary contentinfo dialog".split())
CONTENT = frozenset("article main content post entry story body text".split())
#: Names that parts of an article may have as well; there only linked text under them is furniture.
SOFT = frozenset("side widget widgets alert search form share sharing social follow header headers menu notice notices discussion feedback tags dialog response responses related recommended top".split())
_STEMS = ("advert", "breadcrumb", "comment", "cookie", "disqus", "footer", "masthead", "navbar", "navigation", "newsletter", "sidebar", "sponsor", "subscri")
_LAYOUT = frozenset("has with without no layout".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog search".split())

# A quote opens a value only after an equals sign; an unquoted value may hold quotes.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z][a-z0-9]*")

_TAGS = sorted(BLOCK_TAGS)
_TAG_AT = {t: k for k, t in enumerate(_TAGS)}
NAME_DIMS, WORD_DIMS = 128, 64
#: Figures of a block before its tags, hashed names and hashed words.
FIGURES = 19
PATH_DIMS = len(_TAGS) + NAME_DIMS
DIMS = FIGURES + PATH_DIMS + WORD_DIMS + len(_TAGS)
HIDDEN = 16


#: Innermost elements of a block that its vector tells apart.
NEAR = 32


class Element:
    """An open element, linked to the one around it, so that deep pages take memory and time in proportion."""

    __slots__ = ("parent", "own", "depth", "top", "inside", "furniture")

    def __init__(self, parent: Element | None, tag: str, names: tuple[str, ...]):
        self.parent, self.own = parent, (tag, names)
        if parent is None:
            self.depth, self.top, self.inside, self.furniture = 0, self, False, (False, False)
            return
        self.depth = parent.depth + 1
        self.top = self if self.depth <= 3 else parent.top
        self.inside = parent.inside or tag in ("article", "main")
        telling = tag in FURNITURE_TAGS or tag == "header" and not parent.inside
        named = names and tag not in ("body", "html", "article", "main")
        # What the markup says of text in it, and of linked text.
        self.furniture = tuple(was or telling or bool(named) and _names_furniture(names, parent.inside, linked) for linked, was in enumerate(parent.furniture))

    def near(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """The innermost elements, outermost of them first."""
        out, at = [], self
        while at.parent is not None and len(out) < NEAR:
            out.append(at.own)
            at = at.parent
        return tuple(reversed(out))


class Tree:
    """The elements of a page; elements with equal paths are one."""

    def __init__(self):
        self.root = Element(None, "", ())
        self.known: dict[tuple[int, str, tuple[str, ...]], Element] = {}

    def child(self, parent: Element, tag: str, names: tuple[str, ...]) -> Element:
        key = (id(parent), tag, names)
        if key not in self.known:
            self.known[key] = Element(parent, tag, names)
        return self.known[key]


class Block:
    """A leaf block: the element that holds it, its text and how much of it is linked."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path: Element, text: str, linked: float):
        self.path, self.text, self.linked = path, text, linked


def _raw_end(html: str, at: int, name: str) -> re.Match | None:
    return re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)


def _tags(html: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of tags, comments and whole raw elements; what is not to be heeded has no name."""
    out, at, foreign, endless = [], 0, 0, set()
    while found := _TOKEN.search(html, at):
        at, name, closing, attrs = found.end(), (found[2] or "").lower(), found[1] == "/", found[3] or ""
        if name == "svg" and not attrs.endswith("/"):
            foreign = max(0, foreign + (-1 if closing else 1))
        if name in RAW_TAGS and not closing:
            if foreign and attrs.endswith("/"):
                name = ""
            elif name not in endless and (end := _raw_end(html, at, name)):
                at = end.end()
            elif name == "head":
                endless.add(name)
                name = ""
            else:
                at = len(html)
        out.append((found.start(), at, name, closing, attrs))
    return out


def _skipped_ends(tags: list[tuple[int, int, str, bool, str]], size: int) -> dict[int, int]:
    """Where elements whose text is skipped end, by their starts, in one pass.

    One ends at its closing tag; without one inside the element around it, before the first
    block-level tag after its start.
    """
    ends: dict[int, int] = {}
    block: dict[int, int] = {}  # of skipped elements, the first block-level tag in them
    waiting: list[int] = []
    open_: list[tuple[str, int]] = []
    count: Counter = Counter()
    for start, end, name, closing, attrs in tags:
        skipped = name in SKIPPED_TAGS and name not in RAW_TAGS
        layout = name in BLOCK_TAGS and name not in RAW_TAGS
        if layout:
            block.update(dict.fromkeys(waiting, start))
            waiting.clear()
        if closing:
            while count[name]:
                last, at = open_.pop()
                count[last] -= 1
                if at >= 0:
                    ends[at] = end if last == name else block.get(at, start)
                if last == name:
                    break
        elif skipped and not (name == "svg" and attrs.endswith("/")):
            waiting.append(start)
            open_.append((name, start))
            count[name] += 1
        elif layout and name not in VOID_TAGS:
            open_.append((name, -1))
            count[name] += 1
    return ends | {at: block.get(at, size) for _, at in open_ if at >= 0}


def parse(html: str) -> list[Block]:
    """The blocks of a page in order; never fails, whatever the markup; time and memory grow with its size."""
    tree, blocks = Tree(), []
    stack = [tree.root]
    opened: Counter = Counter()
    texts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(texts).split())
        if text:
            blocks.append(Block(stack[-1], text, min(1.0, linked / len(text))))
        texts.clear()
        linked = 0

    def close(until: str) -> None:
        while (last := stack.pop().own[0]) != until:
            opened[last] -= 1
        opened[until] -= 1

    tags = _tags(html)
    ends = _skipped_ends(tags, len(html))
    at = 0
    for start, end, name, closing, attrs in [*tags, (len(html), len(html), "", False, "")]:
        if start < at:
            continue
        if start > at:
            text = unescape(html[at:start])
            texts.append(text)
            if links:
                linked += len(text)
        at = end
        if name in SKIPPED_TAGS and not closing:
            at = ends.get(start, end)
            if name in BLOCK_TAGS:
                flush()
        elif name == "a":
            links = 0 if closing else 1
        elif name == "br":
            texts.append(" ")
        elif name in BLOCK_TAGS:
            flush()
            if closing:
                if opened[name]:
                    close(name)
            elif name not in VOID_TAGS:
                if name in CLOSES_P and stack[-1].own[0] == "p":
                    close("p")
                if name in ("li", "dt", "dd", "tr", "td", "th") and stack[-1].own[0] == name:
                    close(name)
                names = tuple(_NAME.findall(" ".join(x for m in _ATTR.findall(attrs) for x in m).lower())) if "=" in attrs else ()
                stack.append(tree.child(stack[-1], name, names))
                opened[name] += 1
    flush()
    return blocks


@lru_cache(1 << 14)
def _names_furniture(names: tuple[str, ...], inside: bool, linked: bool) -> bool:
    """Whether an element's names say furniture; a header of a post and a layout with a sidebar do not."""
    names = tuple(n.rstrip("0123456789") for n in names)
    if any(n in _LAYOUT for n in names):
        return False
    titled = any(n in CONTENT for n in names)
    said = [n for n in names if (n in FURNITURE or n.startswith(_STEMS)) and not (titled and n == "header")]
    return any(n not in SOFT for n in said) or bool(said) and (linked or not inside)


def taught(blocks: list[Block]) -> list[int]:
    """Labels that the markup gives: 1 for blocks of the article.  The model is not shown them, nor how they come."""
    has_article = any(b.path.inside for b in blocks)
    return [int(not b.path.furniture[b.linked > 0.5] and (b.path.inside or not has_article)) for b in blocks]


@lru_cache(1 << 16)
def _word_bin(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "replace")) & (WORD_DIMS - 1)


@lru_cache(1 << 14)
def _path_part(path: tuple[tuple[str, tuple[str, ...]], ...]) -> np.ndarray:
    """The part of a block's vector that its innermost elements alone decide: the tags around it and hashed names."""
    out = np.zeros(PATH_DIMS, np.float32)
    for depth, (tag, names) in enumerate(path):
        if tag in _TAG_AT:
            out[_TAG_AT[tag]] = 1.0 if depth == len(path) - 1 else 0.6
        for name in names:
            out[len(_TAGS) + zlib.crc32(name.encode("utf-8", "replace")) % NAME_DIMS] += 0.5
    return out


def vectors(blocks: list[Block]) -> np.ndarray:
    """A row for each block: figures of its text and place, its tag path and names, its words, and how its tags differ from the page's."""
    out = np.zeros((len(blocks), DIMS), np.float32)
    count = len(blocks)
    alike = Counter(b.path for b in blocks)
    parts: dict[Element, np.ndarray] = {}
    linked = sum(b.linked > 0.5 for b in blocks) / max(count, 1)
    within: Counter = Counter()  # characters of text below an element at the top of the page, and below a block's parent
    for b in blocks:
        within[3, b.path.top] += len(b.text)
        within[0, b.path.parent or b.path] += len(b.text)
        if b.path not in parts:
            parts[b.path] = _path_part(b.path.near())
    whole = max(sum(len(b.text) for b in blocks), 1)
    for i, b in enumerate(blocks):
        row = out[i]
        words = b.text.split(" ")
        n = len(words)
        tag = b.path.own[0]
        row[:FIGURES] = (
            1.0, min(n, 400) ** 0.5 / 10, np.log1p(len(b.text)) / 6, b.linked, min(sum(map(b.text.count, ".!?")) / n, 2.0), min(b.text.count(",") / n, 2.0),
            i / max(count - 1, 1), b.text[-1:] in ".!?\"”", "©" in b.text or "|" in b.text or "»" in b.text, n < 4, min(count, 100) / 100,
            tag in ("p", "blockquote", "pre"), tag in ("li", "td", "dd", "dt", "th"), tag[:1] == "h" and tag[1:].isdigit(), min(b.path.depth, NEAR) / 10,
            np.log1p(alike[b.path]) / 4, linked, within[3, b.path.top] / whole, within[0, b.path.parent or b.path] / whole,
        )
        row[FIGURES : FIGURES + PATH_DIMS] = parts[b.path]
        row[FIGURES + PATH_DIMS : FIGURES + PATH_DIMS + WORD_DIMS] = np.bincount(list(map(_word_bin, words)), minlength=WORD_DIMS) / (max(1.0, n**0.5) * 3)
    tags = out[:, FIGURES : FIGURES + len(_TAGS)]
    out[:, DIMS - len(_TAGS) :] = tags - tags.mean(axis=0) if count else 0
    return out


class Example(NamedTuple):
    """A block to learn from: its innermost elements, outermost first, its text and how much of it is linked."""

    path: tuple[tuple[str, tuple[str, ...]], ...]
    text: str
    linked: float


def _rooted(examples: list[Example]) -> list[Block]:
    """The examples of one page as its blocks."""
    tree, out = Tree(), []
    for x in examples:
        at = tree.root
        for tag, names in x.path:
            at = tree.child(at, tag, names)
        out.append(Block(at, x.text, x.linked))
    return out


def examples(html: str, stretch: int = 1 << 18) -> list[tuple[Example, int]]:
    """Blocks of a page and the labels that its markup gives, in order: all, or a stretch of at most ``stretch`` characters.

    The stretch starts at a place that a hash chooses; names count as characters, and single
    blocks of more are left out.
    """
    blocks = parse(html)
    labels = taught(blocks)
    pairs = [(Example(b.path.near(), b.text, b.linked), y) for b, y in zip(blocks, labels)] if len(blocks) <= stretch else None
    weigh = lambda x: len(x.text) + sum(len(t) + sum(map(len, names)) for t, names in x.path)
    if pairs is not None and sum(weigh(x) for x, _ in pairs) <= stretch:
        return pairs
    out, left = [], stretch
    for k in range(zlib.crc32(html.encode("utf-8", "replace")) % len(blocks), len(blocks)):
        x = Example(blocks[k].path.near(), blocks[k].text, blocks[k].linked)
        if weigh(x) > stretch:
            continue
        left -= weigh(x)
        if left < 0:
            break
        out.append((x, labels[k]))
    return out


# Invented furniture that is mixed into pages while training; {w} is a word and {s} a sentence of the page.
_INVENTED = [
    ((("header", ()),), ("{w} home about contact", "{w}: {w} {w} {w}", "{w} {w} | log in | register")), ((("div", ("site", "header")),), ("{w} {w} {w}", "skip to content", "{w} {w} | {w}")),
    ((("div", ("menu",)), ("ul", ()), ("li", ())), ("{w} {w}", "home", "about us", "contact", "products", "blog", "{w}")), ((("nav", ()), ("ul", ()), ("li", ())), ("{w}", "{w} {w}", "home", "news")),
    ((("aside", ()), ("p", ())), ("{s}", "read also: {w} {w} {w}", "related: {s}")), ((("div", ("sidebar",)), ("p", ())), ("{s}", "popular posts", "about the author: {s}")),
    ((("div", ("widget",)), ("h3", ())), ("{w} {w} {w}", "recent posts", "categories", "archives")), ((("div", ("related",)), ("ul", ()), ("li", ())), ("{w} {w} {w}", "{w} {w} {w} {w} {w} {w}")),
    ((("div", ("cookie", "notice")), ("p", ())), ("We use cookies to improve this site. {s}", "This website uses cookies, accept them. Privacy policy", "{s} Accept all cookies")),
    ((("div", ("alert", "banner")),), ("Notice: {s}", "{s} Dismiss", "Please log in to continue. {s}", "Important: {s} Close")),
    ((("section", ("comments",)), ("p", ())), ("{w} says: {s}", "Great article, thank you {w}.", "I agree with {w}. {s}", "{s} Thanks for sharing this!", "@{w} {s}", "{s}")),
    ((("div", ("comment", "list")), ("div", ("comment",)), ("p", ())), ("{w} wrote on 3 May: {s}", "{s} Reply", "Nice post! {s}", "2 days ago {w}: {s}", "I think {s}", "{s} {s}")),
    ((("ol", ("commentlist",)), ("li", ())), ("{w} {w} at 10:42 pm: {s}", "{s} Reply Report", "Thank you, very helpful. {s}", "{w}: {s}")),
    ((("form", ()), ("p", ())), ("{w} {w}", "name", "your e-mail", "search", "subscribe now")), ((("form", ("newsletter",)), ("div", ()), ("p", ())), ("Subscribe to our newsletter. {s}", "Sign up now and {s}", "{s} Your e-mail address")),
    ((("div", ("advert",)), ("p", ())), ("Advertisement. {s}", "{s}", "{s} Buy now!", "Save 20% today. {s}")), ((("div", ("ads", "sponsored")),), ("{s}", "Sponsored: {s}", "Ad: {s} Shop now", "{s} Order today")),
    ((("div", ("share",)),), ("{w} {w}", "share tweet email", "share this", "follow us on {w}")), ((("div", ("breadcrumb",)),), ("{w} » {w} » {w}", "home > {w} > {w}")),
    ((("footer", ()), ("p", ())), ("© {w} {w} · {s}", "Copyright 2020 {w}. All rights reserved.", "{s} Terms of use | Privacy policy", "Imprint {w} {w}")),
    ((("div", ("footer",)), ("p", ())), ("© 2021 {w} {w}", "All rights reserved. {s}", "{s}", "Contact: {w} {w}, privacy, terms", "{s} Powered by {w}")),
]


# Elements that an article's blocks may also be in.
_HOLDERS = [(("ul", ()), ("li", ())), (("ol", ()), ("li", ())), (("blockquote", ()),), (("blockquote", ()), ("p", ())), (("h2", ()),), (("h3", ()),), (("pre", ()),), (("div", ()),), (("figure", ()), ("figcaption", ())), (("table", ()), ("tr", ()), ("td", ())), (("dl", ()), ("dd", ())), (("div", ("entry", "header")), ("h1", ())), *[(("p", ()),)] * 6]


#: Elements and names of furniture that parts of an article are put in while training.
_LENT = [(t, (n,)) for n in ("form", "menu", "share", "discussion", "notice", "alert", "social", "widget", "search", "tags", "related", "feedback") for t in ("div", "section", "table")]
_TELLING = frozenset("article main nav footer header aside section form menu dialog search".split())


def _letters(rng: np.random.Generator) -> str:
    return "".join("abcdefghijklmnopqrstuvwxyz"[k] for k in rng.integers(26, size=int(rng.integers(1, 9))))


def _lent(rng: np.random.Generator) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """An element with a furniture name, often beside a name of no meaning."""
    tag, names = _LENT[rng.integers(len(_LENT))]
    more = (_letters(rng),)
    return ((tag, (names, names + more, more + names, more)[rng.integers(4)]),)


def _otherwise(b: Example, lent: tuple, rng: np.random.Generator) -> Example:
    """A block of an article in another element, below ``lent`` ones, sometimes cut to a few words or partly linked."""
    words = b.text.split(" ")
    if rng.random() < (0.2 if lent else 0.5):
        at = int(rng.integers(len(words)))
        words = words[at : at + int(rng.integers(1, 25))]
    base = b.path[:-1] if b.path and b.path[-1][0] in ("p", "h1", "h2", "h3", "div") else b.path
    linked = float(rng.random() * 0.5) if rng.random() < 0.3 else b.linked
    return Example(base + lent + _HOLDERS[rng.integers(len(_HOLDERS))], " ".join(words), linked)


def _with_furniture(blocks: list[Example], labels: list[int], rng: np.random.Generator, within: float = 0.14) -> tuple[list[Example], list[int]]:
    """The page with invented furniture before and after its article, and with the chance ``within`` after each block in it."""
    pool = [w for b in blocks for w in b.text.split(" ")] or ["page"]
    prefix = (("html", ()), ("body", ()))
    article = next((b.path[: k + 1] for b in blocks for k, (t, _) in enumerate(b.path) if t == "article"), prefix)

    def invented(inner: bool) -> list[Example]:
        path, texts = _INVENTED[rng.integers(len(_INVENTED))]
        pick = lambda n: " ".join(pool[k] for k in rng.integers(len(pool), size=n))
        sentence = lambda: pick(int(rng.integers(4, 40))).capitalize().rstrip(".,") + "."
        out = []
        for _ in range(int(rng.integers(1, 6))):
            text = texts[rng.integers(len(texts))]
            filled = re.sub(r"\{(\w)\}", lambda m: pick(1) if m[1] == "w" else sentence(), text)
            out.append(Example((article if inner else prefix) + path, filled, float(rng.random() < 0.5 and "{s}" not in text)))
        return out

    out, marks = [], []
    swap = rng.random() < 0.25  # an article without an article element
    holder = (("div", ("content",)),) if rng.random() < 0.5 else (("main", ()),) if rng.random() < 0.5 else (("div", ()),)
    for _ in range(int(rng.integers(0, 4))):
        new = invented(False)
        out += new
        marks += [0] * len(new)
    for b, y in zip(blocks, labels):
        if swap and y:
            b = Example(tuple(x for part in b.path for x in (holder if part[0] == "article" else (part,))), b.text, b.linked)
        if y and rng.random() < 0.5:
            b = _otherwise(b, _lent(rng) if rng.random() < 0.85 else (), rng)
        out.append(b)
        marks.append(y)
        if y and rng.random() < within:
            new = invented(not swap)
            out += new
            marks += [0] * len(new)
    for _ in range(int(rng.integers(0, 6))):
        new = invented(False)
        out += new
        marks += [0] * len(new)
    return out, marks


def _scrambled(blocks: list[Example], rng: np.random.Generator) -> list[Example]:
    """The page with its names replaced and its telling elements renamed, alike wherever they occur; sometimes the article keeps its element."""
    names: dict[str, str] = {}
    kept = {"article", "main"} if rng.random() < 0.8 else set()

    def new(name: str) -> str:
        if name not in names:
            names[name] = _letters(rng)
        return names[name]

    def part(tag: str, own: tuple[str, ...]) -> tuple[str, tuple[str, ...]]:
        return ("div" if tag in _TELLING - kept else tag), tuple(map(new, own))

    return [Example(tuple(part(t, own) for t, own in b.path), b.text, b.linked) for b in blocks]


class BiLstm:
    """A bidirectional LSTM with a logistic output for every step."""

    def __init__(self, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 0.15, (DIMS, 4 * HIDDEN))
            self.w["h" + d] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            self.w["c" + d] = np.zeros(4 * HIDDEN)
            self.w["c" + d][HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        self.w["o"] = rng.normal(0, 0.2, 2 * HIDDEN)
        self.w["s"] = rng.normal(0, 0.05, DIMS)

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """Hidden states (T, B, H) in reading order ``d``; gates too if they are to be kept."""
        steps, batch = mask.shape
        pre = x @ self.w["x" + d] + self.w["c" + d]
        h, c = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
        out = np.zeros((steps, batch, HIDDEN))
        tape = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.w["h" + d]
            gates = self._sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tanh_c = np.tanh(c_new)
            if keep:
                tape.append((t, h, c, i, f, o, g, tanh_c, m))
            h, c = m * (o * tanh_c) + (1 - m) * h, m * c_new + (1 - m) * c
            out[t] = h
        return out, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(T, B) of padded sequences (T, B, DIMS)."""
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], axis=2)
        return both @ self.w["o"] + x @ self.w["s"]

    def _gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        p = self._sigmoid(both @ self.w["o"] + x @ self.w["s"])
        weight = mask * np.where(y == 1, 1.0, 3.0)  # furniture is rarer, and more various
        dz = weight * (p - y) / max(weight.sum(), 1)
        grad = {"o": np.einsum("tb,tbh->h", dz, both), "s": np.einsum("tb,tbd->d", dz, x)}
        for n, d in enumerate("fb"):
            d_out = dz[:, :, None] * self.w["o"][n * HIDDEN : (n + 1) * HIDDEN]
            dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
            d_pre = np.zeros((*mask.shape, 4 * HIDDEN))
            d_h = np.zeros_like(self.w["h" + d])
            for t, h, c, i, f, o, g, tanh_c, m in reversed(runs[d][1]):
                dh = dh + d_out[t]
                live = dh * m
                dc_new = live * o * (1 - tanh_c**2) + dc * m
                part = np.concatenate([dc_new * g * i * (1 - i), dc_new * c * f * (1 - f), live * tanh_c * o * (1 - o), dc_new * i * (1 - g**2)], axis=1)
                d_pre[t] = part
                d_h += h.T @ part
                dh = part @ self.w["h" + d].T + dh * (1 - m)
                dc = dc_new * f + dc * (1 - m)
            grad["h" + d] = d_h
            grad["c" + d] = d_pre.sum(axis=(0, 1))
            grad["x" + d] = np.einsum("tbd,tbk->dk", x, d_pre)
        return grad

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, rate: float = 0.02, batch: int = 24, seed: int = 5) -> None:
        """Adam over shuffled batches of pages of similar length."""
        rng = np.random.Generator(np.random.PCG64(seed))
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        pages = sorted((p for p in pages if len(p[1])), key=lambda p: len(p[1]))
        groups = [pages[k : k + batch] for k in range(0, len(pages), batch)]
        step = 0
        for epoch in range(epochs):
            for k in rng.permutation(len(groups)):
                x, mask = padded([p[0] for p in groups[k]])
                y = np.zeros(mask.shape)
                for b, (_, labels) in enumerate(groups[k]):
                    y[: len(labels), b] = labels
                grad = self._gradients(x, mask, y)
                norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
                step += 1
                slow = rate * (0.5 ** (epoch / max(epochs / 4, 1)))
                for name, g in grad.items():
                    g = g / max(1.0, norm)
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.w[name] -= slow * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x, mask = np.zeros((steps, len(rows), DIMS), np.float32), np.zeros((steps, len(rows)))
    for b, r in enumerate(rows):
        x[: len(r), b], mask[: len(r), b] = r, 1
    return x, mask


def train_labeller(htmls: list[str], epochs: int = 14, seed: int = 3) -> BiLstm | None:
    """A labeller fitted to these pages; see :func:`fit_labeller`."""
    return fit_labeller([examples(html) for html in htmls], epochs, seed)


def fit_labeller(drawn: list[list[tuple[Example, int]]], epochs: int = 14, seed: int = 3) -> BiLstm | None:
    """A labeller fitted to these pages, each as it is, with furniture mixed in, and with its names and elements scrambled.

    None if no page has a block: there is nothing to learn from.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    pages = []
    for page in drawn:
        if not page:
            continue
        blocks, labels = map(list, zip(*page))
        pages += [(vectors(_rooted(blocks)), np.array(labels, float))] * 2  # as often as with names scrambled
        for hide in (False, True, True, True):
            # Without names, furniture in the midst of an article cannot be told from it.
            more, marks = _with_furniture(blocks, labels, rng, 0.02 if hide else 0.14)
            x = vectors(_rooted(_scrambled(more, rng) if hide else more))
            if rng.random() < 0.5:  # the words of a page may say nothing, and its names neither
                x[:, FIGURES + PATH_DIMS : FIGURES + PATH_DIMS + WORD_DIMS] = 0
            if rng.random() < 0.3:
                x[:, FIGURES + len(_TAGS) : FIGURES + PATH_DIMS] = 0
            pages.append((x, np.array(marks, float)))
    if not pages:
        return None
    model = BiLstm()
    # Very long pages are learnt in stretches, so that a batch stays small.
    pages = [(x[k : k + 120], y[k : k + 120]) for x, y in pages for k in range(0, len(y), 120)]
    model.train(pages, epochs)
    return model


def label_pages(model: BiLstm | None, pages: list[list[Block]], cells: int = 8192) -> list[np.ndarray]:
    """For each page, whether its blocks belong to the article; pages of similar length run together.

    Without a model, the markup's own labels are all there is.
    """
    if model is None:
        return [np.array(taught(page), bool) for page in pages]
    out = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= cells:
            end += 1
        x, mask = padded([vectors(pages[k]) for k in order[at:end]])
        z = model.logits(x, mask)
        for b, k in enumerate(order[at:end]):
            out[k] = z[: len(pages[k]), b] > 0
        at = end
    return out


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str | None = "url", html_col: str = "html",
    sample: int = 240, stretch: int = 1 << 18, model: BiLstm | None = None,
) -> DataFrame:
    """(id_col, url_col, text, n_chars, n_blocks, n_kept) for every row of ``pages``.

    ``text`` holds the article's blocks in page order, joined by two newlines; character
    references are decoded and white space in a block is one space.  Null and empty pages
    give an empty text, an empty table no rows; pages are read whole, however long.  Without
    a ``model`` one is trained on at most ``sample`` pages that are not empty, chosen by a
    hash of the id, each with at most ``stretch`` characters of blocks (:func:`examples`).
    If none of these has a block, the markup's own labels count.  Repeated rows and null ids
    are extracted like others; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("id"), (F.col(url_col) if url_col else F.lit(None).cast("string")).alias("url"), F.col(html_col).alias("html"))
    if model is None:
        fits = rows.where(F.length("html") > 0)
        chosen = fits.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
        drawn = fits.join(F.broadcast(stored(chosen, "chosen")), "id").select("id", "html").dropDuplicates(["id"])

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                taken = [json.dumps(examples(h, stretch)) for h in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(taken, pa.string())], names=["id", "taken"])

        taken = drawn.mapInArrow(draw, f"id {pages.schema[id_col].dataType.simpleString()}, taken string").orderBy("id").collect()
        read = lambda x: Example(tuple((tag, tuple(names)) for tag, names in x[0]), x[1], x[2])
        model = fit_labeller([[(read(x), y) for x, y in json.loads(r["taken"])] for r in taken])
    labeller = model

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                parsed = [parse(h) if h else [] for h in part.column(2).to_pylist()]
                keep = label_pages(labeller, parsed)
                texts = ["\n\n".join(b.text for b, k in zip(blocks, marks) if k) for blocks, marks in zip(parsed, keep)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, parsed), pa.int64()), pa.array([int(k.sum()) for k in keep], pa.int64())],
                    names=["id", "url", "text", "n_chars", "n_blocks", "n_kept"],
                )

    id_type = pages.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(work, f"id {id_type}, url string, text string, n_chars long, n_blocks long, n_kept long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col or "url"})
