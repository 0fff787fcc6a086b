"""Main-text extraction from HTML: a linear-chain conditional random field over DOM leaf blocks.

The page is cut by one pass over its tags into leaf blocks: text between block-level tags, with the
ancestors that are open there (implied end tags close; script, style, textarea and title are skipped as raw text). Buttons,
lists of options, drawings, embedded objects and their like are blocks of their own if they hold text and nothing if they
don't; one that is never closed is no element. Each block has
binary features of its ancestors (tags, and words of their class, id and role) and of its text (length,
link share, marks, place in the page). Two labels, main and other, form a chain; weights maximise the
conditional likelihood (forward-backward, AdaGrad), and pages are decoded by Viterbi.

Training pages are labelled: ``training_pages`` writes a bounded number of pages with a fixed seed, in
many layouts, and knows which blocks are main text. The model is trained on the driver once a process
and has some hundred weights.

Text of a block: character references decoded, white space (and ``<br>``) to one space, trimmed; empty
blocks go; main blocks are joined in page order by a line feed.

Defined results: null and empty pages have an empty text; text outside any element is a block of its
own; an unclosed tag or comment ends at the end of the page; repeated rows are read alike.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import ship
from .common import slices, strings

# Kinds of HTML elements.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math annotation mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
EMBEDDED = frozenset("audio button canvas datalist iframe map meter noembed noframes noscript object optgroup option picture progress select svg template video".split())
NO_BLOCKS = frozenset("button optgroup option select svg".split())  # a block that starts inside ends them
SAME_CLOSE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
PARAGRAPH_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

KNOWN = INLINE | VOID | RAW | EMBEDDED | PARAGRAPH_ENDS | frozenset("body html head li dt dd tr td th tbody thead tfoot caption colgroup legend summary search slot".split())

NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

# Words of class, id and role names, by what they tell.
HINTS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager topbar tabs skip submenu navi",
    "head": "header masthead banner logo site-header brand hero-nav top-bar",
    "foot": "footer foot copyright colophon contentinfo site-footer legal imprint",
    "side": "sidebar side aside rail complementary widget related recommended more trending popular recirc secondary see-also teaser teasers",
    "ad": "ad ads advert advertisement adv sponsor sponsored promo promoted promotion banner-ad adsense adbox advertorial dfp commercial",
    "note": "cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter paywall signup login disclaimer toast announcement notification",
    "talk": "comment comments commentlist reply replies respond discussion disqus thread responses reader reviews",
    "share": "share sharing social follow buttons toolbar tools actions tags meta byline",
    "form": "form search searchbox input login-form feedback survey poll",
    "main": "article content main post entry story body text article-body post-content entry-content main-content articlebody storybody prose",
}
HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}
SPLIT = re.compile(r"[\s_-]+")


def hints(attrs: str) -> frozenset[str]:
    """What the attributes of a tag tell."""
    out = set()
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c or "").lower()
        if name in ("class", "id", "role"):
            for word in value.split():
                for w in (word, *SPLIT.split(word)):
                    if w in HINT_OF:
                        out.add(HINT_OF[w])
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            out.add("hidden")
    return frozenset(out)


class Leaf:
    """A leaf block: its text, its ancestors' features, and how many of its characters are link text."""

    __slots__ = ("text", "above", "linked")

    def __init__(self, text: str, above: tuple[str, ...], linked: int):
        self.text, self.above, self.linked = text, above, linked


def tags(html: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, name, attributes, closing) of each tag in order; comments and declarations have no name.

    A ``>`` in quotes ends no tag. Where a quote stays open the first ``>`` does; all such fruitless scans together read
    at most ``8 * len(html)`` characters, so malformed pages take linear time. Without a further ``>`` the rest is text.
    """
    at, end, scans, gt = 0, len(html), 8 * len(html), -1
    while (lt := html.find("<", at)) >= 0:
        if html.startswith("<!--", lt):
            close = html.find("-->", lt + 4)
            at = close + 3 if close >= 0 else end
            yield lt, at, "", "", False
            continue
        if gt < lt:
            gt = html.find(">", lt)
        if gt < 0:
            return
        if html[lt + 1] in "!?":
            at = gt + 1
            yield lt, at, "", "", False
            continue
        m = NAME.match(html, lt + 1)
        if m is None:
            at = lt + 1
            continue
        stop = gt + 1
        if m.end() <= gt:
            inner = html[m.end() : stop]
            if ('"' in inner or "'" in inner) and not QUOTED.fullmatch(inner) and scans > 0:
                q = QUOTED.match(html, m.end())
                scans -= (q.end() if q else end) - stop
                stop = q.end() if q else stop
        at = stop
        yield lt, stop, m[1].lower(), html[m.end() : stop - 1], html[lt + 1] == "/"


def leaves(html: str | None) -> list[Leaf]:
    """Leaf blocks in page order."""
    if not html:
        return []
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = links = 0
    lazy = -1  # the lowest embedded element on the stack that holds no text so far: what lies outside goes on around it
    last_close: dict[str, int] = {}
    headed = False

    def flush() -> None:
        nonlocal linked, lazy
        if parts:
            raw = "".join(parts)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            depth = lazy if lazy >= 0 else len(stack)
            if text:
                out.append(Leaf(text, stack[depth - 1][1] if depth else (), linked))
            parts.clear()
        linked, lazy = 0, -1

    def say(text: str) -> None:
        nonlocal linked
        if lazy >= 0 and not text.isspace():
            flush()
        parts.append(text)
        if links:
            linked += len(text)

    def cut(i: int) -> None:
        nonlocal lazy
        for n, _ in stack[i:]:
            opened[n] -= 1
        del stack[i:]
        lazy = lazy if lazy < i else -1

    def closed_later(name: str, at: int) -> bool:
        if name not in last_close:
            last_close[name] = max((m.start() for m in re.finditer(f"</{name}\\b", html, re.I)), default=-1)
        return last_close[name] >= at

    at = 0
    for start, stop, name, attrs, closing in tags(html):
        if start < at:
            continue  # inside raw text
        if start > at:
            say(html[at:start])
        at = stop
        if not name:
            continue
        if name in RAW:
            if not closing and not attrs.rstrip().endswith("/"):
                flush()
                close = re.compile(f"</{name}\\b[^>]*>?", re.I).search(html, at)
                at = close.end() if close else len(html)
            continue
        if name == "head":
            if not closing and not headed:
                close = re.compile(r"</head\b[^>]*>|<body\b", re.I).search(html, at)
                if close:
                    at = close.start() if close[0][1] != "/" else close.end()
            headed = True
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                links = max(0, links - 1) if closing else links + 1
            continue
        if closing:
            if not opened[name]:
                if name not in EMBEDDED:
                    flush()
                continue
            i = len(stack) - 1
            while stack[i][0] != name:
                i -= 1
            if lazy < 0 or i < lazy:
                flush()
            cut(i)
            continue
        if name in EMBEDDED:
            kept = opened["select"] or opened["datalist"] if name in ("option", "optgroup") else closed_later(name, at)
            if attrs.rstrip().endswith("/") or not kept:
                continue
            if name == "button" and opened[name]:
                flush()
                cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            elif lazy < 0 and stack and stack[-1][0] in EMBEDDED:
                flush()
            if lazy < 0:
                lazy = len(stack)
        else:
            while (name in PARAGRAPH_ENDS or name in SAME_CLOSE) and stack and stack[-1][0] in NO_BLOCKS:
                if lazy < 0:
                    flush()
                cut(len(stack) - 1)
            if lazy < 0:
                flush()
            if name in PARAGRAPH_ENDS and stack and stack[-1][0] == "p":
                cut(len(stack) - 1)  # at most an empty paragraph inside an embedded element
        if name in SAME_CLOSE:
            same = {"dt", "dd"} if name in ("dt", "dd") else {"td", "th"} if name in ("td", "th") else {name}
            if any(opened[n] for n in same):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in SAME_CLOSE[name]:
                        break
                    if stack[i][0] in same:
                        if lazy < 0 or i < lazy:
                            flush()
                        cut(i)
                        break
            if name in EMBEDDED and lazy < 0:
                lazy = len(stack)
        if name in VOID or attrs.rstrip().endswith("/"):
            continue
        above = stack[-1][1] if stack else ()
        fresh = [f"t:{name if name in KNOWN else 'other'}", *(f"h:{h}" for h in sorted(hints(attrs)))]
        stack.append((name, tuple(dict.fromkeys((*above, *fresh)))))
        opened[name] += 1
    if at < len(html):
        say(html[at:])
    flush()
    return out


BOILER = ("h:nav", "h:head", "h:foot", "h:side", "h:ad", "h:note", "h:talk", "h:share", "h:form", "h:hidden", "t:nav", "t:header", "t:footer", "t:aside", "t:form", *(f"t:{n}" for n in sorted(EMBEDDED)))


@lru_cache(maxsize=4096)
def ancestor_features(above: tuple[str, ...]) -> tuple[str, ...]:
    """Features of the ancestors: each of them, pairs with an enclosing article or main, and whether any is telling."""
    some = set(above)
    out = list(above)
    inside = "t:article" in some or "t:main" in some or "h:main" in some
    bad = [b for b in BOILER if b in some]
    out.append("in:main" if inside else "in:none")
    out += [f"in:{inside}&{b}" for b in bad]
    out.append(f"bad:{min(len(bad), 2)}")
    out.append(f"clean:{inside and not bad}")
    return tuple(out)


def features(blocks: list[Leaf]) -> list[tuple[str, ...]]:
    """Binary features of each block of a page."""
    n = len(blocks)
    out = []
    for i, b in enumerate(blocks):
        size = len(b.text)
        share = b.linked / size if size else 0
        f = (
            *ancestor_features(b.above),
            "len:0" if size < 15 else "len:1" if size < 60 else "len:2" if size < 200 else "len:3",
            "link:0" if share < 0.1 else "link:1" if share < 0.6 else "link:2",
            "stop" if b.text[-1] in ".!?…。\"”" else "open",
            "rights" if "©" in b.text or "(c)" in b.text[:12].lower() else "plain",
            "place:0" if i == 0 else "place:2" if i == n - 1 else "place:1",
        )
        out.append(f)
    return out


class Chain:
    """Weights of the field: ``w[feature] = (other, main)``, ``step[a][b]``, ``first[a]``."""

    def __init__(self):
        self.w: dict[str, list[float]] = {}
        self.step = [[0.0, 0.0], [0.0, 0.0]]
        self.first = [0.0, 0.0]

    def emissions(self, page: list[tuple[str, ...]]) -> list[tuple[float, float]]:
        get = self.w.get
        out = []
        for f in page:
            a = b = 0.0
            for x in f:
                w = get(x)
                if w is not None:
                    a += w[0]
                    b += w[1]
            out.append((a, b))
        return out

    def decode(self, page: list[tuple[str, ...]]) -> list[int]:
        """Viterbi; ties go to the label main."""
        if not page:
            return []
        e = self.emissions(page)
        (s00, s01), (s10, s11) = self.step
        a, b = self.first[0] + e[0][0], self.first[1] + e[0][1]
        back = []
        for x, y in e[1:]:
            from_a, from_b = (0 if a + s00 > b + s10 else 1), (0 if a + s01 > b + s11 else 1)
            back.append((from_a, from_b))
            a, b = max(a + s00, b + s10) + x, max(a + s01, b + s11) + y
        label = 1 if b >= a else 0
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]

    def marginals(self, page: list[tuple[str, ...]]) -> tuple[list[float], list[list[list[float]]]]:
        """P(main) of each block and the pair probabilities of neighbours, by forward-backward."""
        e = self.emissions(page)
        add = lambda p, q: max(p, q) + log(1 + exp(-abs(p - q)))
        fwd = [(self.first[0] + e[0][0], self.first[1] + e[0][1])]
        for x, y in e[1:]:
            a, b = fwd[-1]
            fwd.append((add(a + self.step[0][0], b + self.step[1][0]) + x, add(a + self.step[0][1], b + self.step[1][1]) + y))
        bwd = [(0.0, 0.0)]
        for x, y in reversed(e[1:]):
            a, b = bwd[-1]
            bwd.append((add(self.step[0][0] + x + a, self.step[0][1] + y + b), add(self.step[1][0] + x + a, self.step[1][1] + y + b)))
        bwd.reverse()
        z = add(*fwd[-1])
        main = [exp(fwd[i][1] + bwd[i][1] - z) for i in range(len(e))]
        pairs = [[[exp(fwd[i - 1][p] + self.step[p][q] + e[i][q] + bwd[i][q] - z) for q in (0, 1)] for p in (0, 1)] for i in range(1, len(e))]
        return main, pairs

    def fit(self, pages: list[tuple[list[tuple[str, ...]], list[int]]], epochs: int = 12, rate: float = 0.5, ridge: float = 1e-3) -> Chain:
        """AdaGrad on the conditional log-likelihood."""
        past: dict = {}

        def move(key, row: list[float], k: int, g: float) -> None:
            g -= ridge * row[k]
            p = past[(key, k)] = past.get((key, k), 1e-6) + g * g
            row[k] += rate * g / p**0.5

        rng = random.Random(7)
        for _ in range(epochs):
            rng.shuffle(pages)
            for page, gold in pages:
                main, pairs = self.marginals(page)
                grad: dict[str, float] = {}
                for f, p, y in zip(page, main, gold, strict=True):
                    for x in f:
                        grad[x] = grad.get(x, 0.0) + y - p
                for x, g in grad.items():
                    row = self.w.setdefault(x, [0.0, 0.0])
                    move(x, row, 1, g)
                    move(x, row, 0, -g)
                for a in (0, 1):
                    move("first", self.first, a, (gold[0] == a) - (main[0] if a else 1 - main[0]))
                    for b in (0, 1):
                        move(f"step{a}", self.step[a], b, sum((gold[i] == a and gold[i + 1] == b) - pairs[i][a][b] for i in range(len(pairs))))
        return self


def training_pages(n: int = 240, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Labelled pages: HTML and, per leaf block, 1 for main text. Layouts are drawn with a fixed seed."""
    rng = random.Random(seed)
    vowel = "ae io ou a e i o u".split()
    word = lambda: "".join(rng.choice("bcdfghlmnprstvw") + rng.choice(vowel) for _ in range(rng.randint(1, 4)))

    def phrase(lo: int, hi: int, stop: bool = False) -> str:
        w = [word() for _ in range(rng.randint(lo, hi))]
        w[0] = w[0].capitalize()
        return " ".join(w) + ("." if stop else "")

    def prose() -> str:
        r = rng.random()
        if r < 0.12:
            return phrase(1, 3, rng.random() < 0.7)  # very short paragraphs are main text too
        if r < 0.2:
            return phrase(8, 60).upper() + "!!"
        if r < 0.28:
            return " ".join(f"{word()}{rng.choice(['***', '&amp;&amp;', '|', '###'])}" for _ in range(rng.randint(5, 40)))
        return " ".join(phrase(4, 18, True) for _ in range(rng.randint(1, 6)))

    pages = []
    for _ in range(n):
        gold: list[int] = []
        html: list[str] = ["<!DOCTYPE html><html><head><title>x</title></head><body>"]
        pick = rng.choice

        def block(inner: str, y: int, tag: str = "p", attrs: str = "") -> None:
            html.append(f"<{tag}{attrs}>{inner}</{tag}>")  # noqa: B023
            gold.append(y)  # noqa: B023

        def link() -> str:
            return f'<a href="/{word()}">{phrase(1, 4)}</a>'

        def attr(names: list[str]) -> str:
            return f' {pick(["class", "id", "class"])}="{pick(names)}"'  # noqa: B023

        def menu() -> None:
            kind = pick(["nav", "div", "ul"])
            html.append(f"<{kind}{attr(['menu', 'navbar', 'main-nav', 'breadcrumb']) if kind != 'nav' or rng.random() < 0.3 else ''}>")  # noqa: B023
            for _ in range(rng.randint(2, 8)):
                block(link(), 0, "li")
            html.append(f"</{kind}>")  # noqa: B023

        def boiler(names: list[str], tags: list[str], lo: int = 1, hi: int = 4) -> None:
            kind = pick(tags)
            named = attr(names) if kind in ("div", "section", "ul") or rng.random() < 0.5 else ""
            html.append(f"<{kind}{named}>")  # noqa: B023
            for _ in range(rng.randint(lo, hi)):
                r = rng.random()
                block(link() if r < 0.3 else phrase(2, 12, rng.random() < 0.5) if r < 0.6 else prose(), 0, pick(["p", "div", "li", "h3"]))
            html.append(f"</{kind}>")  # noqa: B023

        extras = [
            lambda: boiler(["sidebar", "widget", "related", "side right", "trending"], ["aside", "div"]),
            lambda: boiler(["ad", "ads", "ad-slot", "sponsored", "promo box"], ["div", "section", "aside"], 1, 2),
            lambda: boiler(["cookie-notice", "newsletter", "alert", "popup", "subscribe"], ["div", "section"], 1, 2),
            lambda: boiler(["search-form", "login"], ["form"], 1, 3),
            lambda: boiler(["share", "social", "post-tags"], ["div", "ul"], 1, 3),
            lambda: boiler(["x", "y"], ["noscript", "object", "canvas", "video", "audio", "template", "iframe"], 1, 2),
            lambda: block(f"<{(n := pick(['button', 'select', 'svg']))}>{phrase(1, 4)}</{n}>", 0, "div"),  # noqa: B023
        ]
        if rng.random() < 0.7:
            top = pick(["<header>", '<header class="site-header">', '<div id="header">'])
            html.append(top)
            block(phrase(1, 4), 0, pick(["div", "p", "h2", "h1"]))
            if rng.random() < 0.5:
                menu()
            html.append("</header>" if top.startswith("<header") else "</div>")
        if rng.random() < 0.8:
            menu()
        if rng.random() < 0.2:  # a menu that nothing names
            outer, inner = pick([("<table><tr>", "td"), ("<div>", "span"), ("<div>", "div"), ("<ul>", "li")])
            html.append(outer)
            for _ in range(rng.randint(2, 6)):
                block(link(), 0, "div" if inner == "span" else inner)
            html.append("</tr></table>" if inner == "td" else "</ul>" if inner == "li" else "</div>")
        for e in extras:
            if rng.random() < 0.2:
                e()
        if rng.random() < 0.15:
            html.append(pick(["<!-- x -->", "<script>var a='<p>';</script>"]))
        if rng.random() < 0.3:
            html.append(f"<div{attr(['ad', 'ads', 'advert'])}>{phrase(3, 20, True)}</div>")
            gold.append(0)
        shell = pick(["<article>", "<article>", "<article>", "<main>", "<main><article>", '<div class="content">', '<div id="main-content">', '<div class="post-content">', "<div>", "<section>"])
        html.append(shell)
        if rng.random() < 0.8:
            wrap = rng.random() < 0.15
            html.append("<div>" if wrap else "")
            block(phrase(2, 10), 1, "h1")
            html.append("</div>" if wrap else "")
        for _ in range(rng.randint(1, 9)):
            r = rng.random()
            if r < 0.62:
                block(prose(), 1)
            elif r < 0.7:
                block(f"<b>{prose()}</b> {phrase(3, 8)}", 1)
            elif r < 0.76:
                block(phrase(1, 6), 1, pick(["h2", "h3"]))
            elif r < 0.82:
                html.append(pick(["<ul>", "<ol>"]))
                for _ in range(rng.randint(1, 4)):
                    block(phrase(1, 12), 1, "li")
                html.append("</ul></ol>")
            elif r < 0.86:
                html.append("<blockquote>")
                block(prose(), 1)
                html.append("</blockquote>")
            elif r < 0.89:
                html.append("<table><tr>")
                for _ in range(rng.randint(1, 4)):
                    block(phrase(1, 3), 1, "td")
                html.append("</tr></table>")
            elif r < 0.92:
                html.append("<figure>")
                block(phrase(3, 9), 1, "figcaption")
                html.append("</figure>")
            elif r < 0.94:
                block(f"{phrase(3, 9)} {link()} {phrase(2, 7, True)}", 1)
            else:
                pick(extras)()
        comments = lambda: boiler(["comments", "comment-list", "discussion", "respond"], ["section", "div", "section"], 1, 6)
        if rng.random() < 0.2:
            comments()
        html.append("</article>" if "article" in shell else "")
        html.append("</main>" if "main>" in shell else "</div>" if "<div" in shell else "</section>" if "<section" in shell else "")
        if rng.random() < 0.3:
            comments()
        for e in extras:
            if rng.random() < 0.2:
                e()
        if rng.random() < 0.85:
            html.append(pick(["<footer>", '<footer class="foot">', '<div id="footer">', '<div class="site-footer">']))
            tag = "footer" if "<footer" in html[-1] else "div"
            r = rng.random()
            if r < 0.5:
                html.append(f"&copy; {word()} &middot; {phrase(1, 14, True)}")
                gold.append(0)
            else:
                for _ in range(rng.randint(1, 4)):
                    block(link() if rng.random() < 0.6 else phrase(2, 14, True), 0, pick(["p", "li", "div"]))
            html.append(f"</{tag}>")
        html.append("</body></html>")
        pages.append(("".join(html), gold))
    return pages


@lru_cache(maxsize=1)
def trained() -> Chain:
    """The field, trained on those training pages whose blocks and labels line up."""
    pages = []
    for html, gold in training_pages():
        blocks = leaves(html)
        if len(blocks) == len(gold) and gold:
            pages.append((features(blocks), gold))
    return Chain().fit(pages)


def extract(html: str | None, chain: Chain) -> list[tuple[str, int]]:
    """(text, label) of each leaf block."""
    blocks = leaves(html)
    return [(b.text, y) for b, y in zip(blocks, chain.decode(features(blocks)), strict=True)]


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html", carry: tuple[str, ...] = ("url",), chain: Chain | None = None) -> DataFrame:
    """The operator: ``(key, carry..., text, n_chars, blocks, n_blocks)``.

    ``blocks`` are the main blocks; ``n_blocks`` counts all blocks of the page.
    """
    ship(pages.sparkSession)
    src = pages.select(F.col(key).alias("_key"), *carry, F.col(html).alias("_html"))
    schema = T.StructType([*src.drop("_html").schema.fields, T.StructField("blocks", T.ArrayType(T.StringType())), T.StructField("n_blocks", T.LongType())])
    shared = pages.sparkSession.sparkContext.broadcast(chain or trained())  # some hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "_html", 4 << 20):
            got = [extract(h, model) for h in strings(batch, "_html")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([[t for t, y in g if y] for g in got], pa.list_(pa.string())), pa.array([len(g) for g in got], pa.int64())], names=schema.names
            )

    text = F.array_join("blocks", "\n")
    return src.mapInArrow(run, schema).select(F.col("_key").alias(key), *carry, text.alias("text"), F.length(text).cast("long").alias("n_chars"), "blocks", "n_blocks")
