"""URLs, robots rules and the parts of a page: Python for single strings, columns where the engine can do without."""

from __future__ import annotations

import re
import sys
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import parse_qs, quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements whose text is no text of a page.
UNSEEN = ("script", "style", "noscript", "template")
PORTS = {"http": 80, "https": 443}


def normalize_url(url: str) -> str | None:
    """Without the fragment, as a URL parser writes it; None if it is not absolute http or https."""
    try:
        parts = urlsplit(url.strip())
        port = parts.port
    except ValueError:
        return None
    if parts.scheme.lower() not in PORTS or not parts.hostname:
        return None
    scheme, host = parts.scheme.lower(), parts.hostname.lower()
    where = host if port in (None, PORTS[scheme]) else f"{host}:{port}"
    if parts.username:
        where = f"{parts.netloc.rpartition('@')[0]}@{where}"
    path = urlsplit(urljoin(f"{scheme}://{host}/", parts.path or "/")).path or "/"
    return urlunsplit((scheme, where, quote(path, safe="/%:@!$&'()*+,;=-._~[]|^"), quote(parts.query, safe="/%:@!$&()*+,;=?-._~[]|^{}`\\"), ""))


def resolve(base: str, href: str) -> str | None:
    """A link's target, normalized; None unless it is http or https."""
    try:
        return normalize_url(urljoin(base, href.strip()))
    except ValueError:
        return None


def host_of(url: str) -> str | None:
    return urlsplit(url).hostname


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title: str | None = None
        self.nodes: list[str] = []
        self.links: list[str] = []
        self._hidden: list[str] = []
        self._in_title = False

    def handle_starttag(self, tag, attrs):
        if tag in UNSEEN:
            self._hidden.append(tag)
        if tag == "title" and self.title is None:
            self._in_title, self.title = True, ""
        if tag == "a":
            href = dict(attrs).get("href")
            if href is not None:
                self.links.append(href)

    def handle_endtag(self, tag):
        if self._hidden and tag == self._hidden[-1]:
            self._hidden.pop()
        if tag == "title":
            self._in_title = False

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        if not self._hidden and data.strip():
            self.nodes.append(data.strip())


_REFERENCE = re.compile(r"&(#?\w+;)?")


def only_ended(html: str) -> str:
    """html in which a reference that no semicolon ends, such as one that was cut, stands for its own characters."""
    known = lambda name: name is not None and (name[0] == "#" or name in html5)
    return _REFERENCE.sub(lambda m: m[0] if known(m[1]) else f"&amp;{m[1] or ''}", html)


def read_page(html: str, url: str, reverse: bool = False, ended: bool = False) -> tuple[str, str, list[str]]:
    """Title (the URL if there is none), text and normalized links. reverse: text nodes from last to first.

    ended: only references that a semicolon ends are replaced; browsers also read some without it.
    """
    page = _Page()
    page.feed(only_ended(html) if ended else html)
    page.close()
    nodes = page.nodes[::-1] if reverse else page.nodes
    links = [x for x in (resolve(url, h) for h in page.links) if x]
    return (page.title or "").strip() or url, "".join(n + " " for n in nodes), links


def parse_robots(text: str) -> list[str]:
    """Path prefixes that are closed to every agent. Each user-agent line decides anew whether rules apply."""
    applies, closed = False, []
    for line in text.splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            applies = value == "*"
        elif key == "disallow" and applies and value:
            closed.append(value)
    return closed


def robots_rules(text: Column) -> Column:
    """``parse_robots`` of a column."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([parse_robots(t or "") for t in texts], dtype=object)

    return run(text)


def normalized(url: Column) -> Column:
    """``normalize_url`` of a column."""

    @F.pandas_udf("string")
    def run(urls: pd.Series) -> pd.Series:
        return pd.Series([normalize_url(u) if u else None for u in urls], dtype=object)

    return run(url)


def is_allowed(path: Column, closed: Column) -> Column:
    return ~F.exists(F.coalesce(closed, F.array().cast("array<string>")), lambda p: F.startswith(path, p))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def without_fragment(url: Column) -> Column:
    """Normalization of URLs that are clean but for a fragment."""
    return F.regexp_replace(url, "#.*$", "")


def decode_basic(text: Column) -> Column:
    """Character references that pages use most; ``read_page`` knows all of them."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def page_title(html: Column, url: Column) -> Column:
    title = F.trim(decode_basic(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.when(title == "", url).otherwise(title)


def page_text(html: Column, reverse: bool = False) -> Column:
    """Trimmed text nodes, a space after each, in page order."""
    seen = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    for tag in UNSEEN:
        seen = F.regexp_replace(seen, rf"(?is)<{tag}\b.*?</{tag}\s*>", "<>")
    nodes = F.transform(F.split(seen, "<[^>]*>"), lambda x: F.regexp_replace(decode_basic(x), r"^\s+|\s+$", ""))
    nodes = F.filter(nodes, lambda x: x != "")
    nodes = F.reverse(nodes) if reverse else nodes
    return F.array_join(F.transform(nodes, lambda x: F.concat(x, F.lit(" "))), "")


def page_links(html: Column) -> Column:
    """Raw double-quoted href values of links."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"'), 1)


def link_target(url: Column, href: Column) -> Column:
    """Absolute target of root-relative and absolute links; null for others."""
    site = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    return F.when(href.rlike("^https?://"), without_fragment(href)).when(href.rlike("^/(?!/)"), without_fragment(F.concat(site, href)))


def escape(text: str) -> str:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = text.replace(char, name)
    return text


def query_parameter(query: str, name: str = "q") -> str:
    return parse_qs(query, keep_blank_values=True).get(name, [""])[0]


def format_bytes(n: int) -> str:
    if n < 1024:
        return f"{n} B"
    for unit, size in (("KB", 1 << 10), ("MB", 1 << 20)):
        if n < size << 10:
            return f"{n / size:.1f} {unit}"
    return f"{n / (1 << 30):.1f} GB"


def format_bytes_column(n: Column) -> Column:
    scaled = [F.format_string(f"%.1f {u}", F.bround(n / F.lit(float(s)), 1)) for u, s in (("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30))]
    return F.when(n < 1 << 10, F.format_string("%d B", n)).when(n < 1 << 20, scaled[0]).when(n < 1 << 30, scaled[1]).otherwise(scaled[2])


