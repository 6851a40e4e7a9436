"""Operator 9: main text of html pages by a linear-chain conditional random field over leaf blocks.

A page becomes its leaf blocks: runs of text between block-level tags or line breaks, with the tags and class words of their
ancestors. Comments, scripts, styles and the title hold no block. The model labels the blocks of a page, in order, as main
text or not, from ancestor and text features, from where the block stands to the container that holds most of the page's text, and from the
label of the block before (Viterbi); the main text is the blocks labelled so, joined by a space.

It is trained on labelled pages (``labelled_pages`` makes them from layouts, seeded; any list of html and the texts of its main
blocks will do) by the exact gradient of the log likelihood. Reading and labelling a page take time in proportion to its length,
whatever its markup.

Nulls and odd rows: a null or empty html, or one without text, gives an empty text; markup that is cut off or wrongly nested is
read as far as it goes (a ``<`` that begins no tag is text); a repeated page gives its text again; a null page_id or url
stays null; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.session import table

BITS = 16
STEPS, RATE, RIDGE = 150, 0.1, 5e-5
PAGES, SEED = 1000, 9

#: What may begin at a ``<``: a comment, another declaration, or a tag's name.
_OPEN = re.compile(r"""<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))""")
_TURN = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_DIGITS = re.compile(r"&#([0-9]{20,});?")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw text up to the closing tag, or to the end of the page without one.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea")}
#: Left out with all that they hold; of one that nothing closes only the tag is.
SKIPPED = frozenset("noscript template iframe svg select button".split())
_EMPTY = re.compile(r"""(?:^|[\s"'])/\s*\Z""")
#: A tag of the left set ends an open one of the right set.
_ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_BLOCKS_END_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
#: Blocks that text is made of; the others contain it.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote table caption thead tbody tfoot tr td th figure figcaption pre center".split())
LANDMARKS = frozenset("article main aside nav header footer form body".split())
KEYWORDS = ("advert", "comment", "consent", "cookie", "copyright", "home", "login", "menu", "newsletter", "privacy", "promo", "related", "reply", "rights", "share", "sign", "sponsor", "subscribe", "terms", "written")


class Step:
    """A block-level element: its tag and class words, what it stands in, and the innermost container around its text."""

    __slots__ = ("up", "tag", "words", "container", "marks", "near", "seen")

    def __init__(self, up: Step | None, tag: str, words: frozenset[str]):
        self.up, self.tag, self.words = up, tag, words
        self.container: Step = up.container if up and tag in FLOW else self
        self.marks: tuple[str, ...] = (up.marks if up else ()) + ((tag,) if tag in LANDMARKS else ())
        self.marks = self.marks[-3:]
        self.near: list[float | None] = [None, None, None]
        self.seen: tuple[frozenset[int], float] | None = None

    def above(self) -> Iterator[Step]:
        step: Step | None = self
        while step:
            yield step
            step = step.up


@dataclass(slots=True)
class Block:
    text: str
    step: Step
    linked: int


class _Tags:
    """The tags of a page, one after the other."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.dead: set[int] = set()  # places outside quotes from which a quote stays open to the end
        self.lone = {'"': len(page), "'": len(page)}  # from here on such a quote has no partner

    def close(self, at: int) -> int:
        """The ``>`` that ends the tag whose attributes begin at ``at``; one in quotes counts only if a quote is left open."""
        first, tried = at, []
        while at not in self.dead and (m := _TURN.search(self.page, at)):
            if m[0] == ">":
                return m.start()
            tried.append(at)
            to = self.page.find(m[0], m.end()) if m.start() < self.lone[m[0]] else -1
            if to < 0:
                self.lone[m[0]] = min(self.lone[m[0]], m.start())
                break
            at = to + 1
        self.dead.update(tried)
        return self.page.find(">", first)

    def next(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        """Start, end, name (None for what is no tag), whether it closes, and attributes of the next one from ``at`` on."""
        while m := _OPEN.search(self.page, at):
            if m[1]:
                to = self.page.find("-->", m.end())
                return m.start(), len(self.page) if to < 0 else to + 3, None, False, ""
            if m[2]:
                to = self.page.find(">", m.end())
                return m.start(), len(self.page) if to < 0 else to + 1, None, False, ""
            if m.start() > self.last:
                at = m.end()  # text, and perhaps a comment after it
                continue
            to = self.close(m.end())
            return m.start(), to + 1, m[4].lower(), bool(m[3]), self.page[m.end() : to]
        return None

    def after_raw(self, name: str, at: int) -> int:
        """The end of the closing tag of raw text, or of the page."""
        m = RAW[name].search(self.page, at)
        to = self.page.find(">", m.end()) if m else -1
        return len(self.page) if to < 0 else to + 1


def _closed(tags: _Tags, at: int) -> dict[int, int]:
    """For the end of each tag of ``SKIPPED`` from ``at`` on that is closed, the end of its closing tag."""
    found, left = {}, {t: [] for t in SKIPPED}
    while m := tags.next(at):
        _, at, name, end, extra = m
        if name is None:
            continue
        if end:
            if left.get(name):
                found[left[name].pop()] = at
        elif name in RAW:
            if not (left["svg"] and _EMPTY.search(extra)):
                at = tags.after_raw(name, at)
        elif name in SKIPPED and not (name in ("svg", "iframe") and _EMPTY.search(extra)):
            left[name].append(at)
    return found


def _text(raw: str) -> str:
    """With character references decoded; numbers too long to be one stay too large."""
    if "&" not in raw:
        return raw
    return entities.unescape(_DIGITS.sub(lambda m: f"&#{m[1].lstrip('0')[:9] or '0'};", raw) if "&#" in raw else raw)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page that hold text."""
    out: list[Block] = []
    tags, at, page = _Tags(page or ""), 0, page or ""
    root = Step(None, "", frozenset())
    stack: list[tuple[str, Step]] = []  # inline elements carry the step that they stand in
    places: dict[str, list[int]] = {}
    outer: list[int] = []  # places of the block-level elements
    parts: list[str] = []
    linked = anchors = 0
    closed: dict[int, int] | None = None

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(_text(raw))
            if anchors and not raw.isspace():
                linked += len(parts[-1])

    def close() -> None:
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Block(text, stack[-1][1] if stack else root, linked))
            parts.clear()
        linked = 0

    def cut(i: int) -> None:
        nonlocal anchors
        while len(stack) > i:
            name = stack.pop()[0]
            places[name].pop()
            anchors -= name == "a"
            if outer and outer[-1] == len(stack):
                outer.pop()

    while m := tags.next(at):
        start, to, name, end, extra = m
        add(page[at:start])
        at = to
        if name is None:
            continue
        if name not in INLINE:
            close()
        if end:
            i = places[name][-1] if places.get(name) else -1
            if i >= 0 and (name not in INLINE or not outer or i > outer[-1]):
                cut(i)
        elif name in RAW:
            at = tags.after_raw(name, at)
        elif name in SKIPPED:
            if closed is None:
                closed = _closed(tags, start)
            at = closed.get(at, at)
        elif name not in VOID and name != "head":  # what a head may hold has no text; other text ends it
            ends = ("p",) if name in _BLOCKS_END_P else _ENDS.get(name, ())
            if outer and stack[outer[-1]][0] in ends:
                cut(outer[-1])
            step = stack[-1][1] if stack else root
            if name not in INLINE:
                words = {w.lower() for a in _ATTRIBUTE.finditer(extra) for w in _WORD.findall(a[2] or a[3] or a[4] or "")} if "=" in extra else ()
                step = Step(step, name, frozenset(words))
                outer.append(len(stack))
            places.setdefault(name, []).append(len(stack))
            stack.append((name, step))
            anchors += name == "a"
    add(page[at:])
    close()
    return out


@lru_cache(1 << 14)
def _number(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


def _own(step: Step) -> set[int]:
    """Features of all that stands in the element, however deep."""
    return {_number(f"tag {step.tag}"), *(_number(f"class {w}") for w in step.words)}


def _near(step: Step, depth: int) -> list[int]:
    """Features of what stands in the element at this depth."""
    return [_number(f"near {depth} {step.tag}"), *(_number(f"near {depth} class {w}") for w in step.words)]


_KEYS = re.compile("|".join(KEYWORDS))
_TEXT = {f: _number(f) for f in ("bias", "stops", "copyright", *(f"length {k}" for k in range(24)), *(f"link {k}" for k in range(4)), *(f"key {k}" for k in KEYWORDS), *(f"stands {k}" for k in ("in", "below", "outside")))}


def stands(found: list[Block]) -> list[str]:
    """Where each block of a page stands to the container with most text: in it, below it in another one, or outside."""
    held: dict[int, int] = {}
    for b in found:
        held[id(b.step.container)] = held.get(id(b.step.container), 0) + len(b.text) - b.linked
    most = max(held.values(), default=0)
    first = next((b.step.container for b in found if held[id(b.step.container)] == most), None)
    known = {id(first): "in"}
    for b in found:
        way, step = [], b.step.container
        while step and id(step) not in known:
            way.append(step)
            step = step.up and step.up.container
        told = known[id(step)] if step else "outside"
        for x in way:
            known[id(x)] = "below" if told != "outside" else "outside"
    return [known[id(b.step.container)] for b in found]


def block_features(block: Block, stand: str) -> list[int]:
    """Features of the text, of its place, and of the nearest landmarks."""
    text = block.text
    share = block.linked / len(text)
    found = [_TEXT["bias"], _TEXT[f"length {min(len(text).bit_length(), 23)}"], _TEXT[f"link {0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.9 else 3}"]]
    found += [_TEXT[f"stands {stand}"], _number(f"{stand} {block.step.tag}"), _number("marks " + " ".join(block.step.marks)), _number(f"container {stand} {block.step.container.tag}")]
    if text[-1] in ".!?…":
        found.append(_TEXT["stops"])
    if "©" in text:
        found.append(_TEXT["copyright"])
    if len(text) < 200:
        found += {_TEXT[f"key {k}"] for k in _KEYS.findall(text.lower())}
    return found


def path_features(step: Step) -> list[int]:
    """Features of the elements that a block stands in."""
    every = list(step.above())
    return [*sorted(set().union(*map(_own, every))), *(f for depth, x in enumerate(every[:3]) for f in _near(x, depth))]


@dataclass
class Model:
    weights: np.ndarray
    start: float
    #: step[a][b]: from label a to label b.
    step: np.ndarray

    def _path(self, step: Step) -> float:
        """The sum of the weights of ``path_features``; each element adds only what none around it has, and weighs something."""
        w, way, x = self.weights, [], step
        while x.seen is None:
            way.append(x)
            if x.up is None:
                break
            x = x.up
        for x in reversed(way):
            seen, total = x.up.seen if x.up else (frozenset(), 0.0)
            new = [f for f in _own(x) - seen if w[f]]
            x.seen = (seen.union(new), total + sum(w[f] for f in new)) if new else (seen, total)
        total, x = step.seen[1], step
        for depth in range(3):
            if x is None:
                break
            if x.near[depth] is None:
                x.near[depth] = float(sum(w[f] for f in _near(x, depth)))
            total, x = total + x.near[depth], x.up
        return total

    def scores(self, found: list[Block]) -> list[float]:
        w = self.weights
        return [float(sum(w[f] for f in block_features(b, stand))) + self._path(b.step) for b, stand in zip(found, stands(found), strict=True)]

    def decode(self, found: list[Block]) -> list[bool]:
        """The labels of a page's blocks by Viterbi. The blocks are read by one model only."""
        if not found:
            return []
        (aa, ab), (ba, bb) = self.step.tolist()
        no, yes, back = 0.0, 0.0, []
        for i, e in enumerate(self.scores(found)):
            if i == 0:
                no, yes = 0.0, self.start + e
                back.append((0, 0))
            else:
                n0, n1, y0, y1 = no + aa, yes + ba, no + ab, yes + bb
                back.append((int(n1 > n0), int(y1 > y0)))
                no, yes = max(n0, n1), max(y0, y1) + e
        label, out = int(yes > no), []
        for b in reversed(back):
            out.append(label == 1)
            label = b[label]
        return out[::-1]


class Chains:
    """Labelled pages as arrays: which blocks there are, their labels, and their features."""

    def __init__(self, pages: Sequence[tuple[list[Block], list[bool]]]):
        self.n, self.longest = len(pages), max(len(p[0]) for p in pages)
        self.mask, self.y = np.zeros((self.n, self.longest), dtype=bool), np.zeros((self.n, self.longest))
        index, where = [], []
        for i, (found, labels) in enumerate(pages):
            self.mask[i, : len(found)], self.y[i, : len(found)] = True, labels
            for j, (b, stand) in enumerate(zip(found, stands(found), strict=True)):
                f = [*block_features(b, stand), *path_features(b.step)]
                index += f
                where += [i * self.longest + j] * len(f)
        self.index, self.where = np.array(index), np.array(where)
        self.pairs = self.mask[:, 1:]
        y = self.y
        self.gold = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & self.pairs).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)

    def loss(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """The negative log likelihood of the labels and its gradient; forward and backward passes run over all pages at once."""
        n, longest, mask, y = self.n, self.longest, self.mask, self.y
        w, start, move = theta[: 1 << BITS], theta[1 << BITS], theta[-4:].reshape(2, 2)
        own = np.bincount(self.where, weights=w[self.index], minlength=n * longest).reshape(n, longest)
        e = np.stack([np.zeros_like(own), own], axis=2)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = e[:, 0] + np.array([0, start])
        for t in range(1, longest):
            on = np.logaddexp(alpha[:, t - 1, :1] + move[0], alpha[:, t - 1, 1:] + move[1]) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], on, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = beta[:, t + 1] + e[:, t + 1]
            on = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
            beta[:, t] = np.where(mask[:, t + 1, None], on, 0)
        log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha[..., 1] + beta[..., 1] - log_z[:, None]) * mask
        expected = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                joint = alpha[:, :-1, a] + move[a, b] + e[:, 1:, b] + beta[:, 1:, b] - log_z[:, None]
                expected[a, b] = np.exp(np.minimum(joint, 0))[self.pairs].sum()
        slope = np.empty_like(theta)
        slope[: 1 << BITS] = np.bincount(self.index, weights=(p - y).ravel()[self.where], minlength=1 << BITS)
        slope[1 << BITS] = (p[:, 0] - y[:, 0]).sum()
        slope[-4:] = (expected - self.gold).ravel()
        gold = (own * y * mask).sum() + start * y[:, 0].sum() + (self.gold * move).sum()
        return float(log_z.sum() - gold), slope


def fit(pages: Sequence[tuple[list[Block], list[bool]]]) -> Model:
    """Maximises the penalised log likelihood of labelled chains."""
    pages = [p for p in pages if p[0]]
    if not pages:
        return Model(np.zeros(1 << BITS), 0.0, np.zeros((2, 2)))
    chains = Chains(pages)
    total = chains.mask.sum()
    theta = np.zeros((1 << BITS) + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        slope = chains.loss(theta)[1] / total + RIDGE * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model(theta[: 1 << BITS].copy(), float(theta[1 << BITS]), theta[-4:].reshape(2, 2).copy())


#: Layouts of the labelled pages: for each part of a page that isn't main text, the tags and class names it may stand in.
PARTS = {
    "nav": (("nav", "div", "ul", "header"), ("nav", "menu", "navbar", "breadcrumb", "topnav", "navigation", "site-nav")),
    "header": (("header", "div"), ("header", "masthead", "banner", "top-bar", "site-header", "logo")),
    "footer": (("footer", "div"), ("footer", "site-footer", "copyright", "bottom", "legal")),
    "side": (("aside", "div", "section"), ("sidebar", "side", "widget", "related", "recommended", "trending", "popular-posts")),
    "advert": (("div", "aside", "section"), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad")),
    "notice": (("div", "section"), ("cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "popup", "paywall")),
    "form": (("form", "div"), ("form", "newsletter", "subscribe", "login", "search", "signup", "contact-form")),
    "comments": (("section", "div", "ol"), ("comments", "comment-list", "discussion", "responses", "reader-comments", "disqus", "replies")),
    "share": (("div", "ul"), ("share", "social", "sharing", "tags", "share-buttons")),
}
MAIN = (("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "entry-content"), ("div", "article-body"), ("div", "post"), ("section", "story"), ("div", "main"))
_WORDS = {
    "nav": ("Home", "About", "Contact", "Menu", "News"),
    "footer": ("&copy; 2024", "All rights reserved", "Privacy", "Terms"),
    "advert": ("Advertisement", "Sponsored", "Promo"),
    "notice": ("We use cookies", "Accept", "Consent"),
    "form": ("Subscribe", "Login", "Sign up", "Newsletter", "Search"),
    "comments": ("Comments", "Reply", "wrote"),
    "share": ("Share", "Tweet"),
    "side": ("Related", "Most read"),
}


def labelled_pages(n: int = PAGES, seed: int = SEED, parts: dict = PARTS, mains: Sequence[tuple[str, str]] = MAIN, unknown: float = 0.3) -> list[tuple[str, set[str]]]:
    """Pages and the texts of their main blocks. ``unknown``: share of the class names that are made up."""
    rng = random.Random(seed)
    serial = iter(range(1 << 40))
    made_up = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz") + rng.choice("aeiouy") for _ in range(rng.randint(2, 4)))
    MEANT = ("nav", "aside", "footer", "form", "header")  # tags that say by themselves what they hold

    def prose(low: int, high: int) -> str:
        names = ["".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        return f"{' '.join(names).capitalize()} x{next(serial)}{rng.choice(['.', '.', '.', '!', ''])}"

    def opened(tag: str, name: str) -> str:
        return f'<{tag} {rng.choice(("class", "class", "class", "id"))}="{name}">' if name else f"<{tag}>"

    def part(kind: str, inside: bool = False) -> str:
        tags, names = parts[kind]
        tag, name = rng.choice(tags), rng.choice(names)
        if rng.random() < unknown:
            name = made_up()
        if rng.random() < 0.15 and (tag in MEANT or inside):
            name = ""
        say = lambda: rng.choice(_WORDS.get(kind, ("",))) + " " + prose(1, 6) if rng.random() < 0.4 else prose(1, 5)
        if tag in ("ul", "ol") or kind in ("nav", "share"):
            body = "".join(f'<li><a href="#">{say()}</a></li>' for _ in range(rng.randint(2, 7)))
            body = body if tag in ("ul", "ol") else f"<ul>{body}</ul>"
        elif kind == "comments":
            each = lambda: rng.choice((f'<div class="{rng.choice(("comment", "reply", made_up()))}"><p>{prose(4, 40)}</p></div>', f"<p>{prose(2, 40)}</p>", f"<li>{prose(3, 40)}</li>", f"<p><b>{prose(1, 2)}</b> {prose(3, 30)}</p>"))
            body = (f"<h3>{say()}</h3>" if rng.random() < 0.5 else "") + "".join(each() for _ in range(rng.randint(1, 5)))
        elif kind == "form":
            body = f'<label>{say()}</label><input name="q"><p>{say()}</p>'
        elif kind in ("side", "footer", "header") and rng.random() < 0.6:
            body = f"<h4>{say()}</h4>" + "".join(rng.choice((f'<p><a href="/">{say()}</a></p>', f"<p>{prose(3, 25)}</p>", prose(3, 25))) for _ in range(rng.randint(1, 4)))
        else:
            body = rng.choice(("<p>{}</p>", "{}", "<div>{}</div>", "<span>{}</span>")).format(say() + " " + prose(3, 30))
        return f"{opened(tag, name)}{body}</{tag}>"

    def page() -> tuple[str, set[str]]:
        mine: set[str] = set()

        def own(low: int, high: int, link: bool = True) -> str:
            text = prose(low, high)
            mine.add(text)
            head, _, tail = text.partition(" ")
            if link and rng.random() < 0.3:
                return rng.choice((f'<a href="/x">{head}</a> {tail}', f"<b>{head}</b> {tail}", f"<em>{head} {tail}</em>", f"<b>{head} {tail}"))
            return text

        within = lambda: part(rng.choice(("advert", "share", "side", "form", "notice", "comments", "advert")), True)
        body, kinds = [], (
            (8, lambda: f"<p>{own(4, 90)}</p>"),
            (2, lambda: f"<p>{own(1, 6)}</p>"),
            (1, lambda: f"<h2>{own(2, 6)}</h2>"),
            (1, lambda: "<ul>" + "".join(f"<li>{own(2, 15)}</li>" for _ in range(3)) + "</ul>"),
            (1, lambda: f"<blockquote>{own(5, 30)}</blockquote>"),
            (2, lambda: f"<p>{own(3, 30)}<br>{own(3, 30)}<br>"),
            (0.7, lambda: "<table>" + (f"<caption>{own(2, 6)}</caption>" if rng.random() < 0.5 else "") + f"<tr><td>{own(1, 4)}<td>{own(1, 4)}</table>"),
            (0.7, lambda: f'<figure><img src="i"><figcaption>{own(2, 10)}</figcaption></figure>'),
            (2, within),
        )
        if rng.random() < 0.8:
            title = f"<h1>{own(3, 10, False)}</h1>"
            body.append(f"<header>{title}</header>" if rng.random() < 0.1 else title)
        for _ in range(rng.randint(1, 9)):
            body.append(rng.choices([k[1] for k in kinds], [k[0] for k in kinds])[0]())
        inner = "".join(body)
        if rng.random() < 0.3:
            inner = f"{opened('div', rng.choice(('content', 'text', 'body', 'entry', made_up(), '')))}{inner}</div>"
        for kind, share in (("share", 0.15), ("side", 0.15), ("comments", 0.4), ("footer", 0.1)):
            inner += part(kind, True) if rng.random() < share else ""
        tag, name = rng.choice(mains)
        if rng.random() < unknown:
            name = made_up()
        wrapped = f"{opened(tag, name)}{inner}</{tag}>"
        before = [part(k) for k in ("notice", "header", "nav", "advert") if rng.random() < 0.6]
        after = [part(k) for k in ("share", "comments", "side", "advert", "form", "nav", "notice", "footer") if rng.random() < 0.45]
        if rng.random() < 0.3:
            before.append(part("side"))
        whole = "".join([*before, wrapped, *after])
        whole = f"{opened('div', rng.choice(('page', 'wrapper', 'container', made_up())))}{whole}</div>" if rng.random() < 0.3 else whole
        return f"<!DOCTYPE html><html><head><title>{prose(2, 6)}</title><style>p{{}}</style></head><body>{whole}<script>x='<p>'</script></body></html>", mine

    return [page() for _ in range(n)]


def train(pages: Sequence[tuple[str, set[str]]]) -> Model:
    found = [(blocks(page), main) for page, main in pages]
    return fit([(own, [b.text in main for b in own]) for own, main in found])


@lru_cache(1)
def standard() -> Model:
    """The model of the made-up layouts; it reads no table, so a session trains it once."""
    return train(labelled_pages())


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page."""

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = []
            for page in batch.column(2).to_pylist():
                found = blocks(page)
                texts.append(" ".join(b.text for b, main in zip(found, model.decode(found), strict=True) if main))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), standard())
