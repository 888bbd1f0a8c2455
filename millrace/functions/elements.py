"""HTML as an array of elements, so that layouts are read with SQL expressions.

One Arrow pass flattens a page; which elements a layout needs, and how they relate,
is then said with array functions on positions: an element holds another if that
one's ``pos`` lies after its own and not after its ``last``. ``descendants`` and ``at`` read
positions without a scan, and ``let`` evaluates a value once that a condition on every
element needs, so that the work of a layout grows with the page and not with its square.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ELEMENTS = "array<struct<pos:int,last:int,up:int,tag:string,classes:array<string>,id:string,title:string,href:string,name:string,content:string,text:string,lead:string,own:string,markdown:string,before:array<int>>>"
_CHILDLESS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


_UNREAD = {"script", "style", "template"}


def _tidy(text: str) -> str:
    return " ".join(text.split())


class _Flattener(HTMLParser):
    """Elements in order of their start; open ones stand on a stack with what they have gathered."""

    def __init__(self, base: str, marks: Sequence[tuple[str, str | None]] = ()):
        super().__init__(convert_charrefs=True)
        self.base, self.marks, self.found, self.open = base, marks, [], []
        self.top = [None] * len(marks)

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        up = self.open[-1]["pos"] if self.open else -1
        node = {"pos": len(self.found), "last": len(self.found), "up": up, "tag": tag, "classes": given.get("class", "").split(), "id": given.get("id"), "title": given.get("title")}
        node |= {"href": given.get("href"), "name": (given.get("name") or "").lower() or None, "content": given.get("content"), "own": None, "_text": [], "_lead": [], "_md": []}
        siblings = self.open[-1]["_marked"] if self.open else self.top
        node |= {"before": list(siblings), "_marked": [None] * len(self.marks)}
        for i, (kind, cls) in enumerate(self.marks):
            if tag == kind and (cls is None or cls in node["classes"]):
                siblings[i] = node["pos"]
        self.found.append(node)
        self.open.append(node)
        if tag in _CHILDLESS:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _CHILDLESS:
            self._close()

    def handle_endtag(self, tag):
        if any(n["tag"] == tag for n in self.open):
            while self.open and self._close() != tag:
                pass

    def handle_data(self, data):
        if self.open and self.open[-1]["tag"] not in _UNREAD:
            node = self.open[-1]
            if data.strip() and node["own"] is None:
                node["own"] = data.strip()
            for part in ("_text", "_lead"):
                node[part].append(data)
            node["_md"].append(re.sub(r"\s+", " ", data))

    def _close(self) -> str:
        node = self.open.pop()
        node["last"] = len(self.found) - 1
        del node["_marked"]
        text, lead, md = ("".join(node.pop(part)) for part in ("_text", "_lead", "_md"))
        node["text"], node["lead"] = _tidy(text), _tidy(lead)
        node["markdown"] = "\n".join(_tidy(line) for line in md.split("\n")).strip()
        if self.open:
            outer = self.open[-1]
            outer["_text"].append(text)
            if node["tag"] != "p":
                outer["_lead"].append(lead)
            href = urljoin(self.base, node["href"]) if node["tag"] == "a" and node["href"] else None
            linked = f"[{node['text']}]({href})" if href and node["text"] else node["text"]
            outer["_md"].append("\n" if node["tag"] == "br" else linked if node["tag"] == "a" else node["markdown"])
        return node["tag"]

    def finish(self) -> list[dict]:
        self.close()
        while self.open:
            self._close()
        return self.found


def elements_of(html: str | None, base: str = "", marks: Sequence[tuple[str, str | None]] = ()) -> list[dict]:
    parser = _Flattener(base, marks)
    parser.feed((html or "").replace("\0", ""))
    return parser.finish()


def elements(html: Column, base: str = "", marks: Sequence[tuple[str, str | None]] = ()) -> Column:
    """All elements of a page in order; links are absolute in ``markdown`` only.

    ``before`` holds, for each of ``marks`` (tag, and class or None), the position of the last such element
    that starts before this one under the same parent, or null.
    """

    def batch(pages: pd.Series) -> pd.Series:
        return pd.Series([elements_of(p, base, marks) for p in pages])

    return F.pandas_udf(batch, ELEMENTS)(html)


# --- expressions on the array -----------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(found: Column, pos: Column) -> Column:
    """The element at ``pos`` of the whole page ``found``; null for none."""
    return F.get(found, pos)


def descendants(found: Column, x: Column) -> Column:
    """The elements inside ``x``, in order; null for none."""
    return F.when(x["last"] > x["pos"], F.transform(F.sequence(x["pos"] + 1, x["last"]), lambda i: at(found, i)))


def some(found: Column, condition: Callable[[Column], Column]) -> Column:
    return F.filter(found, condition)


def first(found: Column, condition: Callable[[Column], Column]) -> Column:
    return F.get(some(found, condition), F.lit(0))


def last(found: Column, condition: Callable[[Column], Column]) -> Column:
    return F.try_element_at(some(found, condition), F.lit(-1))


def inside(x: Column, outer: Column) -> Column:
    return (x["pos"] > outer["pos"]) & (x["pos"] <= outer["last"])


def is_a(x: Column, tag: str, cls: str | None = None) -> Column:
    same = x["tag"] == tag
    return same & F.array_contains(x["classes"], cls) if cls else same


def tagged(tag: str) -> Callable[[Column], Column]:
    return lambda x: x["tag"] == tag


def titled(x: Column, *parts: str) -> Column:
    """A link whose title holds one of ``parts``."""
    hit = F.lit(False)
    for p in parts:
        hit |= F.coalesce(x["title"].contains(p), F.lit(False))
    return (x["tag"] == "a") & hit


def absolute(url: Column, base: str) -> Column:
    """``url`` against the site ``base``; null for none."""
    site = base.rstrip("/")
    full = F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url).when(url.startswith("//"), F.concat(F.lit(site.split("//")[0]), url))
    return F.when(url != "", full.when(url.startswith("/"), F.concat(F.lit(site), url)).otherwise(F.concat(F.lit(f"{site}/"), url)))
