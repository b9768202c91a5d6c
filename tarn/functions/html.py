"""HTML without foreign parsers: a small DOM, a subset of XPath, links, forms, items and main text, as Pandas UDFs.

XPath: absolute or // steps of tag names or *, predicates [n], [@a], [@a='v'], [contains(@a,'v')], and a last step
@attribute or text(). (path)[n] is the n-th of all that the path selects, and more steps may follow.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style noscript template".split())
BLOCKS = frozenset("p div li ul ol table tr td th h1 h2 h3 h4 h5 h6 section article header footer nav br title body".split())


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    parent: Node | None = None
    begin: int = -1
    inner: str | None = None

    def nodes(self) -> Iterator[Node]:
        """This element and all below it, in document order; no recursion, as pages nest deeply."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self, hidden: frozenset[str] = HIDDEN) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in hidden:
                if n.tag in BLOCKS:
                    out.append(" ")
                    stack.append(" ")
                stack.extend(reversed(n.children))
        return re.sub(r"\s+", " ", "".join(out)).strip()


class _Builder(HTMLParser):
    def __init__(self, page: str | None = None):
        """With the page itself, elements that have an end tag get what stands between their tags."""
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")
        self.page = page
        self.lines = [] if page is None else [0, *(m.end() for m in re.finditer("\n", page))]

    def place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs}, parent=self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n
            if self.page is not None:
                n.begin = self.place() + len(self.get_starttag_text() or "")

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, parent=self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent
            if self.page is not None:
                n.inner = self.page[n.begin : self.place()]

    def handle_data(self, data):
        self.at.children.append(data)


def parsed(page: str, inner: bool = False) -> Node:
    b = _Builder(page if inner else None)
    b.feed(page)
    b.close()
    return b.root


STEP = re.compile(r"(//|/)?(@?[\w*:-]+(?:\(\))?)((?:\[[^\]]*\])*)")
PREDICATE = re.compile(r"\[\s*(?:(\d+)|@([\w:-]+)\s*(?:=\s*(['\"])(.*?)\3)?|contains\(\s*@([\w:-]+)\s*,\s*(['\"])(.*?)\6\s*\))\s*\]")

NTH = re.compile(r"\((.+)\)\[\s*([1-9]\d*)\s*\](.*)")


def xpath(root: Node, path: str) -> list[Node | str]:
    """Elements or strings that a path of the subset selects, in document order."""
    found: list[Node | str] = [root]
    if m := NTH.fullmatch(path):
        found, path = xpath(root, m[1])[int(m[2]) - 1 : int(m[2])], m[3]
    for axis, name, tests in STEP.findall(path):
        elements = [n for n in found if isinstance(n, Node)]
        if name.startswith("@"):
            pool = [x for n in elements for x in (n.nodes() if axis == "//" else [n])]
            found = [n.attrs[name[1:]] for n in pool if name[1:] in n.attrs]
            continue
        if name == "text()":
            pool = [x for n in elements for x in (n.nodes() if axis == "//" else [n])]
            found = [c for n in pool for c in n.children if isinstance(c, str)]
            continue
        out: list[Node | str] = []
        seen: set[int] = set()
        for n in elements:
            parents = n.nodes() if axis == "//" else [n]
            for p in parents:
                same = [c for c in p.children if isinstance(c, Node) and name in ("*", c.tag)]
                for number, attr, quote, value, within, _, part in PREDICATE.findall(tests):
                    if number:
                        same = same[int(number) - 1 : int(number)]
                    elif within:
                        same = [c for c in same if part in c.attrs.get(within, "")]
                    else:
                        same = [c for c in same if attr in c.attrs and (not quote or c.attrs[attr] == value)]
                for c in same:
                    if id(c) not in seen:
                        seen.add(id(c))
                        out.append(c)
        found = out
    return found


def strings(found: list[Node | str], decoded: tuple[str, ...] | None = None) -> list[str]:
    """Their texts. With names of character references: elements as they stand between their tags, but for these references."""
    if decoded is None:
        return [x if isinstance(x, str) else x.text() for x in found]
    some = re.compile("&(?:" + "|".join(map(re.escape, decoded)) + ");")
    return [x if isinstance(x, str) else some.sub(lambda m: entities.unescape(m[0]), x.inner) for x in found if isinstance(x, str) or x.inner is not None]


STRINGS = T.ArrayType(T.StringType())


def links(page: str, base: str, path: str = "//a/@href") -> list[str]:
    """Distinct absolute links in document order; a base element counts."""
    root = parsed(page)
    for b in xpath(root, "//base/@href"):
        base = urljoin(base, str(b))
        break
    out = [urljoin(base, h.strip()) for h in strings(xpath(root, path)) if h.strip() and not h.strip().lower().startswith(("javascript:", "mailto:", "#"))]
    return list(dict.fromkeys(out))


def extract_links(path: str = "//a/@href"):
    """A column function (html, base url) -> links."""

    @F.pandas_udf(STRINGS)
    def run(page: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([links(p or "", b or "", path) for p, b in zip(page, base, strict=True)])

    return run


def extract(path: str, decoded: tuple[str, ...] | None = None):
    """A column function html -> strings that a path selects; ``decoded``: as the page has them but for these references."""

    @F.pandas_udf(STRINGS)
    def run(page: pd.Series) -> pd.Series:
        return pd.Series([strings(xpath(parsed(p or "", decoded is not None), path), decoded) for p in page])

    return run


FORM = T.ArrayType(T.StructType([T.StructField("action", T.StringType()), T.StructField("method", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))]))


@F.pandas_udf(FORM)
def extract_forms(page: pd.Series) -> pd.Series:
    """Forms with their action, method and fields."""
    out = []
    for p in page:
        forms = []
        for f in xpath(parsed(p or ""), "//form"):
            inputs = [n for n in f.nodes() if n.tag in ("input", "textarea", "select") and n.attrs.get("name")]
            forms.append({"action": f.attrs.get("action", ""), "method": f.attrs.get("method", "get").lower(), "fields": {n.attrs["name"]: n.attrs.get("value", "") for n in inputs}})
        out.append(forms)
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def inner_text(page: pd.Series) -> pd.Series:
    """The text a reader sees: no scripts, styles or comments, entities decoded, white space as single spaces."""
    return pd.Series([None if p is None else parsed(p).text() for p in page], dtype=object)


def main_text(page: str) -> str:
    """Text of the element whose own paragraphs hold the most text that is no link."""
    root = parsed(page)
    best, most = root, 0.0
    for n in root.nodes():
        if n.tag in HIDDEN:
            continue
        own = 0.0
        for c in n.children:
            if isinstance(c, Node) and c.tag in ("p", "h1", "h2", "blockquote", "pre"):
                words = len(c.text())
                own += words - 2 * sum(len(a.text()) for a in xpath(c, "//a"))
        if own > most:
            best, most = n, own
    return best.text() if most else root.text()


@F.pandas_udf(T.StringType())
def extract_main_text(page: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else main_text(p) for p in page], dtype=object)


ITEMS = T.ArrayType(T.MapType(T.StringType(), T.StringType()))


def extract_items(item: str, tags: dict[str, str], mandatory: tuple[str, ...] = ()):
    """A column function html -> one map of tags for each node of the item path; items without mandatory tags are left out."""

    @F.pandas_udf(ITEMS)
    def run(page: pd.Series) -> pd.Series:
        out = []
        for p in page:
            items = []
            for n in xpath(parsed(p or ""), item):
                if isinstance(n, Node):
                    got = {k: " ".join(strings(xpath(n, path))).strip() for k, path in tags.items()}
                    if all(got[m] for m in mandatory):
                        items.append(got)
            out.append(items)
        return pd.Series(out)

    return run


def fill_template(rules: dict[str, list[dict]]):
    """A column function html -> tags by rules {path, join, default, regex, decoded}; a tag's rules are tried in turn, the first that finds text wins.

    With ``decoded`` (names of references) a rule takes elements as the page has them but for these references, blank ones too.
    """
    inner = any("decoded" in r for options in rules.values() for r in options)

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def run(page: pd.Series) -> pd.Series:
        out = []
        for p in page:
            root, got = parsed(p or "", inner), {}
            for tag, options in rules.items():
                for r in options:
                    found = [s for s in strings(xpath(root, r["path"]), r.get("decoded")) if "decoded" in r or s.strip()]
                    if r.get("regex"):
                        found = ["".join(m) if isinstance(m, tuple) else m for s in found for m in re.findall(r["regex"], s)]
                    if found:
                        got[tag] = r.get("join", " ").join(found)
                        break
                else:
                    got[tag] = next((r["default"] for r in options if "default" in r), "")
            out.append(got)
        return pd.Series(out)

    return run


def feed_entries(text: str) -> list[dict[str, str]]:
    """Entries of an RSS or Atom feed: title, link, date, summary; no entry of a text that is no feed."""
    import xml.etree.ElementTree as ET

    try:
        root = ET.fromstring(text.encode())
    except ET.ParseError:
        return []
    local = lambda e: e.tag.rsplit("}", 1)[-1].lower()
    names = {"title": "title", "link": "link", "pubdate": "date", "published": "date", "updated": "date", "date": "date", "description": "summary", "summary": "summary", "content": "summary"}
    out = []
    for e in root.iter():
        if local(e) in ("item", "entry"):
            got: dict[str, str] = {}
            for c in e:
                key = names.get(local(c))
                if key and key not in got:
                    got[key] = (c.get("href") or "".join(c.itertext())).strip()
            out.append(got)
    return out


@F.pandas_udf(ITEMS)
def parse_feed(text: pd.Series) -> pd.Series:
    return pd.Series([feed_entries(t or "") for t in text])
