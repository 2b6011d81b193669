"""Made web pages of many layouts, to train the main-text extractor on.

Every text of the article starts with ``MARK``. Pages differ in their elements, names and order:
regions have telling elements, roles or names, names that say nothing, or (seldom) ones that
mislead; articles hold headings, lists, quotes, tables, adverts, forms and notes of readers.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

MARK = ""
SEED = 11
PAGES = 700
MISLEADING = 0.08

#: Names of regions; the words they are made of are those that the extractor knows, or say nothing.
NAMES = {
    "nav": ("nav", "main-nav", "menu", "top-menu", "navbar", "breadcrumbs", "pagination", "toc"),
    "header": ("header", "site-header", "masthead", "topbar", "page-header"),
    "footer": ("footer", "page-footer", "bottom", "copyright", "site-foot", "legal"),
    "aside": ("sidebar", "side", "widget", "rail", "aside-right"),
    "ad": ("ad", "ads", "ad-slot", "advert", "advertisement", "sponsored", "promo", "banner"),
    "notice": ("cookie-notice", "consent", "notice", "alert", "popup", "overlay", "announcement"),
    "comment": ("comments", "comment", "comment-list", "discussion", "replies", "reader-comments"),
    "share": ("share", "social", "related", "newsletter", "tags", "recommended", "popular", "signup"),
    "content": ("content", "post", "entry-content", "article-body", "story", "text", "main"),
    "plain": ("box", "row", "c12", "wrap", "inner", "block-a", "x1", "grid", "section"),
}
ELEMENTS = {"nav": ("nav",), "header": ("header",), "footer": ("footer",), "aside": ("aside",)}
ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "aside": "complementary", "notice": "alert"}


class Maker:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.syllables = rng.sample(["an", "be", "co", "der", "en", "for", "ga", "hi", "in", "lo", "mer", "no", "or", "pa", "ri", "st", "tion", "un", "ver", "we"], 9)

    def word(self) -> str:
        return "".join(self.rng.choice(self.syllables) for _ in range(self.rng.randint(1, 4)))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def prose(self, n: int, links: float = 0.02) -> str:
        """About n words in sentences, with some inline markup."""
        r, out = self.rng, []
        while n > 0:
            size = min(n, r.randint(1, 18))
            sentence = [self.word() for _ in range(size)]
            sentence[0] = sentence[0].capitalize()
            if r.random() < links:
                at = r.randrange(size)
                sentence[at] = f'<a href="/{sentence[at]}">{sentence[at]}</a>'
            elif r.random() < 0.05:
                sentence[-1] = f"<b>{sentence[-1]}</b>"
            out.append(" ".join(sentence) + r.choice(("." if r.random() < 0.95 else "", ".", ".", "!", "?")))
            n -= size
        return " ".join(out)

    def some(self, least: int, most: int) -> int:
        """A number between the two, small ones more often."""
        return least + int((most - least + 1) * self.rng.random() ** 2)

    def links(self, n: int, words: tuple[int, int] = (1, 3)) -> list[str]:
        return [f'<a href="/{self.word()}">{self.words(self.rng.randint(*words))}</a>' for _ in range(n)]

    def region(self, kind: str, inside: str) -> str:
        """The markup of a region, in an element and with names that tell its kind, or not."""
        r = self.rng
        names = NAMES[kind]
        draw = r.random()
        if kind in ELEMENTS and draw < 0.5:
            tag, told = r.choice(ELEMENTS[kind]), r.random() < 0.4
        else:
            tag, told = r.choice(("div", "div", "section", "ul" if inside.startswith("<li") else "div")), draw < 0.8
        if r.random() < MISLEADING:
            names, told = NAMES[r.choice(sorted(NAMES))], True
        elif not told:
            names = NAMES["plain"]
        said = f' {r.choice(("class", "class", "id"))}="{r.choice(names)}"' if told or r.random() < 0.5 else ""
        if kind in ROLES and r.random() < 0.08:
            said += f' role="{ROLES[kind]}"'
        return f"<{tag}{said}>{inside}</{tag}>"

    def nav(self) -> str:
        links = self.links(self.rng.randint(2, 9))
        if self.rng.random() < 0.7:
            return self.region("nav", "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>")
        return self.region("nav", self.rng.choice((" | ", " ", "<br>")).join(links))

    def header(self) -> str:
        tag, name = self.rng.choice(("h1", "div", "p", "h2", "h2")), self.words(self.rng.randint(1, 4))
        parts = [f"<{tag}>{name if self.rng.random() < 0.6 else self.prose(self.some(1, 8))}</{tag}>"]
        if self.rng.random() < 0.5:
            parts.append(self.nav())
        if self.rng.random() < 0.3:
            parts.append(f"<p>{self.prose(self.some(2, 10))}</p>")
        return self.region("header", "".join(parts))

    def footer(self) -> str:
        r = self.rng
        parts = [("&copy; " if r.random() < 0.75 else "") + f"{r.randint(1999, 2026)} {self.words(2)}. {self.prose(self.some(1, 25))}"]
        if r.random() < 0.4:
            parts = [f"<p>{parts[0]}</p>", "<p>" + " ".join(self.links(r.randint(1, 5))) + "</p>"]
        return self.region("footer", "".join(parts))

    def ad(self) -> str:
        text = self.prose(self.some(2, 30), links=0.1)
        return self.region("ad", text if self.rng.random() < 0.6 else f"<p>{text}</p>")

    def notice(self) -> str:
        inner = f"<p>{self.prose(self.some(4, 45), links=0.1)}</p>" + (f"<button>{self.word()}</button>" if self.rng.random() < 0.5 else "")
        return self.region("notice", inner)

    def form(self) -> str:
        r = self.rng
        fields = "".join(f"<label>{self.words(r.randint(1, 4))}</label><input name={self.word()}>" for _ in range(r.randint(0, 3)))
        return f"<form action=/{self.word()}>{fields}<button>{self.word()}</button>" + (f"<p>{self.prose(self.some(2, 20))}</p>" if r.random() < 0.5 else "") + "</form>"

    def aside(self) -> str:
        r, parts = self.rng, []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.7:
                parts.append(f"<h3>{self.words(r.randint(1, 4))}</h3>")
            if r.random() < 0.6:
                parts.append("<ul>" + "".join(f"<li>{x}</li>" for x in self.links(r.randint(1, 6), (2, 9))) + "</ul>")
            if r.random() < 0.5:
                parts.append(f"<p>{self.prose(self.some(3, 50), links=0.1)}</p>")
        return self.region("aside", "".join(parts) or f"<p>{self.prose(12)}</p>")

    def cards(self) -> str:
        """Teasers of other articles, each in an article of its own."""
        r = self.rng
        cards = [f"<article><h3>{self.links(1, (2, 9))[0]}</h3>" + (f"<p>{self.prose(self.some(3, 30))}</p>" if r.random() < 0.7 else "") + "</article>" for _ in range(r.randint(1, 4))]
        return self.region(r.choice(("share", "aside")), f"<h2>{self.words(2)}</h2>" * r.randint(0, 1) + "".join(cards))

    def share(self) -> str:
        if self.rng.random() < 0.25:
            return self.cards()
        if self.rng.random() < 0.3:
            return self.region("share", f"<p>{self.prose(self.some(2, 20))}</p>" + self.form())
        return self.region("share", f"<h3>{self.words(2)}</h3>" * self.rng.randint(0, 1) + "<ul>" + "".join(f"<li>{x}</li>" for x in self.links(self.rng.randint(1, 6), (1, 8))) + "</ul>")

    def comments(self) -> str:
        r, parts = self.rng, []
        if r.random() < 0.7:
            parts.append(f"<h2>{self.words(r.randint(1, 2))}</h2>")
        tag = r.choice(("div", "li", "article", "section"))
        own = r.choice(NAMES["comment"]) if r.random() < 0.7 else r.choice(NAMES["plain"])
        for _ in range(self.some(1, 8)):
            by = r.choice((f"<b>{self.word()}</b>", f"<p>{self.words(2)}</p>", f"<div>{self.word()} {r.randint(1, 28)}.{r.randint(1, 12)}.</div>", ""))
            text = "".join(f"<p>{self.prose(self.some(1, 60))}</p>" for _ in range(r.randint(1, 2)))
            parts.append(f'<{tag} class="{own}">{by}{text}</{tag}>')
        if r.random() < 0.4:
            parts.append(self.form())
        return self.region("comment", "".join(parts))

    def article(self, wide: bool) -> str:
        """The article's own parts; wide: with things among them that are none."""
        r, m = self.rng, MARK
        title = f"<h1>{m}{self.words(r.randint(1, 12))}</h1>"
        if r.random() < 0.2:
            title = f"<header>{title}<p>{m}{self.words(r.randint(2, 6))}</p></header>"
        parts = [title] if r.random() < 0.93 else []
        style = r.random()  # most pages have paragraphs, some only divisions or line breaks
        if style < 0.07:
            return "".join(parts) + m + r.choice(("<br><br>", "<br>", "<hr>" + m)).join(self.prose(self.some(4, 130)) for _ in range(self.some(1, 12)))
        for _ in range(self.some(1, 22)):
            kind = r.random()
            if kind < 0.74:
                text = self.prose(self.some(1, 130))
                parts.append(f"<div>{m}{text}</div>" if style < 0.12 else r.choice((f"<p>{m}{text}</p>", f"<p>{m}{text}</p>", f"<p>{m}<b>{text}<br><p>{m}{self.prose(self.some(1, 40))}</p>", f"<p>{m}{text}")))
            elif kind < 0.82:
                parts.append(f"<h{r.randint(2, 4)}>{m}{self.words(r.randint(1, 8))}</h2>")
            elif kind < 0.88:
                parts.append("<ul>" + "".join(f"<li>{m}{self.prose(self.some(1, 20))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.91:
                parts.append(f"<blockquote>{m}{self.prose(self.some(4, 40))}</blockquote>")
            elif kind < 0.94:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{m}{self.words(r.randint(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif kind < 0.96:
                parts.append(f"<pre>{m}{self.words(self.some(4, 40))}</pre>")
            elif kind < 0.98:
                parts.append(f"<figure><img src=/x><figcaption>{m}{self.words(self.some(2, 12))}</figcaption></figure>")
            else:
                parts.append(f"<div>{m}{self.prose(self.some(2, 60))}</div>")
        if wide:
            for make in (self.ad, self.share, self.form, self.notice, self.aside):
                if r.random() < 0.25:
                    parts.insert(r.randint(1, len(parts)), make())
        return "".join(parts)

    def page(self) -> str:
        r = self.rng
        inner = self.article(r.random() < 0.5)
        comments = self.comments() if r.random() < 0.35 else ""
        within = r.random() < 0.4
        if within:
            inner += comments
        kind = r.random()
        if kind < 0.5:
            inner = f"<article>{inner}</article>"
        elif kind < 0.6:
            inner = f"<main>{inner}</main>"
        elif kind < 0.92:
            inner = f'<div {r.choice(("class", "id"))}="{r.choice(NAMES["content"])}">{inner}</div>'
        elif kind < 0.97:
            inner = f'<div class="{r.choice(NAMES["plain"])}">{inner}</div>'
        if not within:
            inner += comments
        if r.random() < 0.3:
            inner = f'<div class="{r.choice(NAMES["plain"])}">{inner}</div>'
        before = [x for x, p in ((self.notice, 0.2), (self.header, 0.45), (self.nav, 0.6), (self.ad, 0.35), (self.aside, 0.1)) if r.random() < p]
        after = [x for x, p in ((self.share, 0.25), (self.aside, 0.3), (self.form, 0.15), (self.ad, 0.1), (self.footer, 0.85), (self.notice, 0.08)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        inner = "".join(x() for x in before) + inner + "".join(x() for x in after)
        if r.random() < 0.15:
            inner = f"<main>{inner}</main>"
        return f"<html><head><title>t</title></head><body>{inner}</body></html>"


def pages(count: int = PAGES, seed: int = SEED) -> Iterator[str]:
    for n in range(count):
        yield Maker(random.Random(seed * 1_000_003 + n)).page()
