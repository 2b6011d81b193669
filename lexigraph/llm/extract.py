"""Main text of web pages by minimum-cut labelling.

A page is read into blocks: runs of text between tags that break lines, with white space made
one space and character references decoded. A linear classifier gives each block a cost of being
content and a cost of being boilerplate, from its own tag, its length, links and sentences, and
what the elements above it are and are called. These costs, log odds, are the terminal capacities
of a flow network. Smoothness edges join a block with its neighbour on the page, and with the next
block below the same container, more strongly the closer the two are in the tree. A minimum cut
separates source and sink with the least sum of costs and broken edges; the source's side is the
article.

Classifier and edges are trained together, by pseudo-likelihood, on made pages of many layouts
(``layouts``): so a name or a short text alone decides little, and what stands around a block much.

Before any flow is sent, blocks whose classifier costs differ by more than all their edges
together are given their side, which every minimum cut gives them, too; their edges become
costs of their neighbours. The flow is then found for what is left.

Text in scripts, styles, templates, comments, forms' controls and hidden elements is never a
block. Defined results: a null or empty page has no text; a page without blocks, or whose blocks
are all boilerplate, gives an empty string; rows are taken one by one, so equal pages and ids give
equal rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from html import unescape
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import layouts
from .common import need, ship

ship(__name__)

#: An opening or closing tag after its "<"; quotes after "=" may hold ">". Possessive, so that no text is read twice.
TAG = re.compile(r"""(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>="']++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
SENTENCE = re.compile(r"[.!?。！？](?:\s|$|[\"'”’)])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page.
SILENT = frozenset("script style noscript template iframe object svg canvas annotation annotation-xml select textarea button option datalist audio video head title".split())
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in "script style textarea title iframe noscript".split()}
IN_HEAD = frozenset("title meta link script style base noscript template".split())
INLINE = frozenset(
    "a abbr acronym annotation annotation-xml b bdi bdo big br cite code data del dfn em font i img ins kbd label maction mark math menclose merror mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover q rp rt ruby s samp semantics small span strike strong sub sup svg time tt u var wbr".split()
)
#: Elements deeper than this are read as if they stood at this depth, as browsers do.
MOST_DEPTH = 512
#: What an element's tag, role and names may say about the blocks below it.
SIGNS = ("nav", "header", "footer", "aside", "form", "dialog", "content", "ad", "notice", "comment", "share", "wording")
SIGN = {s: 1 << i for i, s in enumerate(SIGNS)}
BAD = sum(SIGN[s] for s in SIGNS if s not in ("content", "wording"))
ELEMENT = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "dialog": "dialog", "article": "content", "main": "content"}
ROLE = {"navigation": "nav", "menu": "nav", "menubar": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "form": "form", "dialog": "dialog", "alertdialog": "dialog", "alert": "notice", "article": "content", "main": "content"}
#: Words in class and id names.
NAMED = {
    **dict.fromkeys("nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sitemap toc".split(), "nav"),
    **dict.fromkeys("footer foot bottom colophon copyright legal imprint".split(), "footer"),
    **dict.fromkeys("sidebar side aside rail widget widgets gutter".split(), "aside"),
    **dict.fromkeys("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted teaser adsense".split(), "ad"),
    **dict.fromkeys("cookie cookies consent gdpr notice notification alert popup modal overlay paywall toast disclaimer announcement".split(), "notice"),
    **dict.fromkeys("comment comments discussion reply replies respond commentlist reader feedback".split(), "comment"),
    **dict.fromkeys("share sharing social follow tags tagcloud related recommended recommendations recommend trending popular more newsletter subscribe subscription signup login signin register search".split(), "share"),
    **dict.fromkeys("header masthead topbar toolbar branding logo".split(), "header"),
    **dict.fromkeys("article content post entry story body main text prose".split(), "wording"),
}
#: With one of these a name tells how a page is laid out, not what an element is.
LAYOUT = frozenset("has with no layout".split())
CONTAINERS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    __slots__ = ("block", "content", "depth", "holds", "links", "number", "parent", "signs", "silent", "tag", "within")

    def __init__(self, tag: str, parent: Element | None, number: int, signs: int, silent: bool):
        self.tag, self.parent, self.number, self.signs = tag, parent, number, signs
        self.depth = parent.depth + 1 if parent else 0
        self.silent = silent or (parent is not None and parent.silent)
        self.links = (parent.links if parent else 0) + (tag == "a")
        self.block = parent.block if parent and tag in INLINE else self  # the nearest element that breaks lines
        self.content = tag in CONTAINERS and not signs & BAD or parent is not None and parent.content
        self.within = self.content or signs == SIGN["wording"] or parent is not None and parent.within  # what is called content, too
        self.holds = False  # has the page's content container below it


class Block:
    __slots__ = ("element", "links", "text")

    def __init__(self, text: str, links: int, element: Element):
        self.text, self.links, self.element = text, links, element


#: Elements that an opening tag closes, as browsers do, up to the nearest of the second set.
CLOSES = {
    **dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl div section article aside header footer nav main form table pre blockquote address fieldset figure hr menu details".split(), ({"p"}, {"div", "td", "th", "li", "body", "section", "article", "aside", "blockquote", "button"})),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


def own_signs(tag: str, attributes: str, inside_content: bool) -> tuple[int, bool]:
    """What an element's tag, role and names say; whether its text is silent."""
    found = {ELEMENT[tag]} if tag in ELEMENT else set()
    silent = tag in SILENT
    if attributes and not attributes.isspace():
        names: set[str] = set()
        for m in ATTRIBUTE.finditer(attributes):
            key = m[1].lower()
            value = m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names.update(NAME.findall(CAMEL.sub(" ", value).lower()))
            elif key == "role" and value.strip().lower() in ROLE:
                found.add(ROLE[value.strip().lower()])
            elif key == "hidden" or key == "style" and HIDDEN.search(value) or key == "aria-hidden" and value.lower() == "true":
                silent = True
        if tag not in ("html", "body") and LAYOUT.isdisjoint(names):
            told = {NAMED[n] for n in names if n in NAMED}
            found |= told if told == {"wording"} else told - {"wording"}
    if inside_content:
        found.discard("header")  # an article's own header holds its title
    return sum(SIGN[s] for s in found), silent


class Scanner:
    """Tags of a page from left to right. No part of the page is read more than a fixed number of times."""

    def __init__(self, html: str):
        self.html, self.size = html, len(html)
        self.last = html.rfind(">")  # a "<" after it opens nothing

    def next(self, at: int) -> tuple[int, int, re.Match | None]:
        """Start and end of the next markup from this place on, and the match if it is a tag; the page's size twice at the end."""
        html = self.html
        while True:
            start = html.find("<", at)
            if start < 0 or start > self.last:
                return self.size, self.size, None
            after = html[start + 1 : start + 2]
            if after in ("!", "?"):
                for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                    if html.startswith(opening, start):
                        end = html.find(closing, start + len(opening))
                        return start, (end + len(closing) if end >= 0 else self.size), None
                return start, html.index(">", start) + 1, None
            if m := TAG.match(html, start + 1):
                return start, m.end(), m
            at = start + 1


def blocks_of(html: str) -> tuple[list[Block], list[Element]]:
    """The page's blocks, and its elements, in order."""
    here = Element("html", None, 0, 0, False)
    elements, out = [here], []
    stack = [here]
    opened: dict[str, int] = {"html": 1}
    parts: list[tuple[str, bool]] = []  # text and whether it is in a link

    def flush():
        if parts:
            text = SPACE.sub(" ", unescape("".join(t for t, _ in parts))).strip()
            if text:
                out.append(Block(text, sum(len(t.strip()) for t, a in parts if a), stack[-1].block))
            parts.clear()

    def close(depth: int):
        """Close all elements from this place in the stack on."""
        for e in stack[depth:]:
            opened[e.tag] -= 1
        del stack[depth:]

    scanner = Scanner(html)
    at, size = 0, len(html)
    while at < size:
        start, end, m = scanner.next(at)
        if start > at and stack[-1].tag == "head" and not html[at:start].isspace():
            close(len(stack) - 1)  # a head that is not closed ends where text starts
        here = stack[-1]
        if start > at and not here.silent:
            parts.append((html[at:start], here.links > 0))
        at = end
        if m is None:
            continue
        tag = m[2].lower()
        inline = tag in INLINE
        if tag == "br":
            if not here.silent:
                parts.append((" ", here.links > 0))
            continue
        if here.tag == "head" and not m[1] and tag not in IN_HEAD:
            close(len(stack) - 1)
        if not inline:
            flush()
        if m[1]:  # a closing tag
            if opened.get(tag):
                depth = len(stack) - 1
                while depth > 0 and stack[depth].tag != tag and not (inline and stack[depth].tag not in INLINE):
                    depth -= 1
                if depth > 0 and stack[depth].tag == tag:  # an inline tag does not close what blocks hold open
                    close(depth)
            continue
        if (rule := CLOSES.get(tag)) and any(opened.get(t) for t in rule[0]):
            depth, last = len(stack) - 1, 0
            while depth > 0 and stack[depth].tag not in rule[1]:
                if stack[depth].tag in rule[0]:
                    last = depth
                    if tag != "tr":
                        break
                depth -= 1
            if last:
                close(last)
        if tag in VOID:
            continue
        parent = stack[-1]
        signs, silent = own_signs(tag, m[3], parent.within)
        e = Element(tag, parent, len(elements), signs, silent)
        elements.append(e)
        if tag in CONTAINERS and not signs & BAD:
            up = parent
            while up is not None and not up.holds:
                up.holds, up = True, up.parent
        if tag in RAW:  # up to its own closing tag nothing is markup
            closing = RAW[tag].search(html, at)
            end = html.find(">", closing.end()) if closing else -1
            at = end + 1 if end >= 0 else size
        elif not m[3].endswith("/") or tag not in ("svg", "iframe", "math"):
            if len(stack) < MOST_DEPTH or e.silent and not parent.silent:
                stack.append(e)
                opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out, elements


def context(blocks: list[Block], elements: list[Element]) -> list[int]:
    """The signs above the blocks of each element."""
    size = [0] * len(elements)
    for b in blocks:
        size[b.element.number] += len(b.text)
    for e in reversed(elements[1:]):
        size[e.parent.number] += size[e.number]
    out = [0]
    for e in elements[1:]:
        own = e.signs
        # what wraps the content, or a form around a whole page, says nothing about its blocks
        if e.holds and e.tag not in ("nav", "footer", "aside"):
            own &= ~BAD
        if own & SIGN["form"] and 2 * size[e.number] > size[0]:
            own &= ~SIGN["form"]
        out.append(out[e.parent.number] | own)
    return out


WORDS = (1, 3, 6, 11, 21, 41)
TAGS = {**dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), 0), "p": 1, **dict.fromkeys("li dt dd".split(), 2), **dict.fromkeys("td th caption".split(), 3), **dict.fromkeys("blockquote pre figcaption".split(), 4), **dict.fromkeys("html body article main".split(), 5)}
N_TAGS = 7
FEATURES = len(WORDS) + 2 + 3 + 1 + N_TAGS + len(SIGNS) + 3


def features(blocks: list[Block], elements: list[Element]) -> np.ndarray:
    """Classifier inputs of every block: length, links, sentences, its tag, the signs above it, a copyright mark, whether it stands alone below the body, and whether the page's content container leaves it out."""
    signs = context(blocks, elements)
    out = np.zeros((len(blocks), FEATURES))
    for row, b in zip(out, blocks):
        text = b.text
        row[bisect_right(WORDS, text.count(" ") + 1) - 1] = 1
        at = len(WORDS)
        row[at] = min(1.0, b.links / len(text))
        row[at + 1] = row[at] > 0.5
        at += 2
        for _ in islice(SENTENCE.finditer(text), 3):
            row[at] = 1
            at += 1
        at = len(WORDS) + 5
        row[at] = text[-1] in ".!?:…。！？"
        row[at + 1 + TAGS.get(b.element.tag, N_TAGS - 1)] = 1
        at += 1 + N_TAGS
        above = signs[b.element.number]
        for i in range(len(SIGNS)):
            row[at + i] = above >> i & 1
        row[-3] = "©" in text
        row[-2] = b.element.tag not in TAGS and b.element.depth > 0 and b.element.parent.tag in ("html", "body")
        row[-1] = elements[0].holds and not above & SIGN["content"]
    return out


#: Kinds of smoothness edges. Neighbours on the page: of one kind below one parent, below one parent, near in the tree, or none of these.
#: Blocks with others between them: next of their kind below one parent, next below one parent, next below one grandparent.
#: And neighbours of which one stands below something that is no content by its signs, and the other does not.
EDGES = ("twins", "siblings", "near", "order", "next twin", "next child", "next grandchild", "border")
NEAR = 4
SHARES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)


def smoothness(blocks: list[Block], elements: list[Element]) -> list[tuple[int, int, int]]:
    """(block, block, kind) of neighbours on the page, and of blocks next to each other under one container."""
    signs = context(blocks, elements)
    bad = [signs[b.element.number] & BAD for b in blocks]
    edges: dict[tuple[int, int], int] = {}
    last: dict[tuple, int] = {}
    for i, block in enumerate(blocks):
        e = block.element
        if i:
            edges[i - 1, i] = closeness(blocks[i - 1].element, e) if bad[i - 1] == bad[i] else EDGES.index("border")
        parent = e.parent
        for above, more, kind in ((parent, (e.tag, e.signs), 4), (parent, (), 5), (parent.parent if parent else None, (), 6)):
            if above is not None and above.tag not in ("html", "body"):
                key = (above.number, kind, bad[i], *more)
                if key in last:
                    edges.setdefault((last[key], i), kind)
                last[key] = i
    return [(a, b, kind) for (a, b), kind in edges.items()]


def closeness(a: Element, b: Element) -> int:
    """The kind of edge between neighbours on the page; a title starts anew, and the page itself is no container."""
    if b.tag == "h1":
        return 3
    if a is b or a.parent is b.parent:
        return 0 if a is b or (a.tag, a.signs) == (b.tag, b.signs) else 1
    for _ in range(NEAR):
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        elif b.parent is not None:
            b = b.parent
        if a is b:
            return 3 if a.tag in ("html", "body") else 2
    return 3


@dataclass(frozen=True)
class Potentials:
    """Weights of features (log odds of content) and of each kind of edge."""

    weights: tuple[float, ...]
    edges: tuple[float, ...]

    def costs(self, blocks: list[Block], elements: list[Element]) -> list[float]:
        """Cost of calling each block content less that of calling it boilerplate."""
        return (-(features(blocks, elements) @ np.array(self.weights))).tolist()

    def smooth(self, blocks: list[Block], elements: list[Element]) -> list[tuple[int, int, float]]:
        return [(a, b, self.edges[kind]) for a, b, kind in smoothness(blocks, elements)]


def train(pages: list[tuple[list[Block], list[Element], np.ndarray]], ridge: float = 1.0, rounds: int = 30) -> Potentials:
    """Piece by piece: the classifier by logistic regression; an edge's weight is the log odds that blocks it joins have one label.

    pages: blocks, elements, and the labels (True: content) of each page.
    """
    x = np.concatenate([features(blocks, elements) for blocks, elements, _ in pages])
    y = np.concatenate([labels for _, _, labels in pages]).astype(np.float64)
    theta = np.zeros(FEATURES)
    for _ in range(rounds):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(FEATURES), x.T @ (y - p) - ridge * theta)
        theta += step
        if np.abs(step).max() < 1e-6:
            break
    seen = np.ones((len(EDGES), 2))
    for blocks, elements, labels in pages:
        for a, b, kind in smoothness(blocks, elements):
            seen[kind, int(labels[a] == labels[b])] += 1
    return Potentials(tuple(theta.tolist()), tuple(np.maximum(0.0, np.log(seen[:, 1] / seen[:, 0])).tolist()))


@cache
def trained() -> Potentials:
    """Fitted on made pages of many layouts; edges, which overlap, count by the share that is best on other made pages."""
    fitted = train([labelled(page) for page in layouts.pages()])
    others = [labelled(page) for page in layouts.pages(layouts.PAGES, layouts.SEED + 1)]

    def wrong(share: float) -> int:
        tried = Potentials(fitted.weights, tuple(share * w for w in fitted.edges))
        return sum(int((np.array(minimum_cut(tried.costs(b, e), tried.smooth(b, e))) != labels).any()) for b, e, labels in others)

    share = min(SHARES, key=wrong)
    return Potentials(fitted.weights, tuple(share * w for w in fitted.edges))


def labelled(page: str) -> tuple[list[Block], list[Element], np.ndarray]:
    """Blocks of a made page, whose article's texts start with a mark."""
    blocks, elements = blocks_of(page)
    labels = np.array([layouts.MARK in b.text for b in blocks], bool)
    for b in blocks:
        b.text = b.text.replace(layouts.MARK, "") or "-"
    return blocks, elements, labels


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's (content's) side of a minimum cut; nodes that cost nothing either way stay out.

    costs: above 0 is the capacity to the sink side's label content, below 0 that of boilerplate.
    """
    n = len(costs)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    total = [0.0] * n
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
        total[a] += w
        total[b] += w
    cost, side = list(costs), [None] * n
    # blocks that no cut can label otherwise, and what follows from them
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(cost[i]) > total[i]:
            side[i] = cost[i] < 0
            for j, w in near[i]:
                if side[j] is None:
                    cost[j] += -w if side[i] else w
                    total[j] -= w
                    todo.append(j)
    left = [i for i in range(n) if side[i] is None]
    if left:
        place = {i: k for k, i in enumerate(left)}
        inner = [(place[i], place[j], w) for i in left for j, w in near[i] if i < j and j in place]
        for i, content in zip(left, _max_flow_side([cost[i] for i in left], inner)):
            side[i] = content
    return side


def _max_flow_side(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Dinic's algorithm; capacities are whole thousandths, so it ends. True: reachable from the source in the residual network."""
    n = len(cost)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def add(a: int, b: int, there: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(cost):
        whole = round(c * 1000)
        if whole < 0:
            add(source, i, -whole, 0)
        elif whole > 0:
            add(i, sink, whole, 0)
    for a, b, w in edges:
        whole = round(w * 1000)
        add(a, b, whole, whole)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if not room[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[a] < len(head[a]):
                e = head[a][turn[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(head[a]):
                path.append(head[a][turn[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break


def main_text(html: str | None, potentials: Potentials | None = None) -> str:
    blocks, elements = blocks_of(html or "")
    if not blocks:
        return ""
    potentials = potentials or trained()
    side = minimum_cut(potentials.costs(blocks, elements), potentials.smooth(blocks, elements))
    return "\n".join(b.text for b, content in zip(blocks, side) if content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    need(pages, "page_id", "url", "html")
    potentials = trained()

    @F.pandas_udf("string")
    def run(htmls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in htmls:
            yield pd.Series([main_text(h, potentials) for h in part], dtype=object)

    return pages.select("page_id", "url", run("html").alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
