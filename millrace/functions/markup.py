"""HTML to records with the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ANCHORS = "array<struct<href:string,label:string>>"
_SKIPPED = {"script", "style", "head", "nav", "template"}
_BLOCKS = {"p", "div", "li", "br", "tr", "ul", "ol", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "table"}


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.href: str | None = None
        self.words: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.flush()
            self.href = dict(attrs).get("href")

    def handle_data(self, data):
        if self.href is not None:
            self.words.append(data)

    def handle_endtag(self, tag):
        if tag == "a":
            self.flush()

    def flush(self):
        if self.href:
            self.found.append({"href": self.href, "label": " ".join("".join(self.words).split())})
        self.href, self.words = None, []


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.lists: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.hidden += 1
        elif tag in _BLOCKS:
            self.out.append("\n")
            if re.fullmatch("h[1-6]", tag):
                self.out.append("#" * int(tag[1]) + " ")
            elif tag == "li":
                self.out.append("- ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        elif tag in _BLOCKS:
            self.out.append("\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def anchors_of(html: str | None, base: str = "") -> list[dict]:
    parser = _Anchors()
    parser.feed(html or "")
    parser.flush()
    return [{"href": urljoin(base, a["href"]), "label": a["label"]} for a in parser.found]


def markdown_of(html: str | None) -> str:
    """Headings, lists and emphasis as Markdown; blank lines between blocks collapsed."""
    parser = _Markdown()
    parser.feed(html or "")
    lines = (re.sub(r"[ \t]+", " ", line).strip() for line in "".join(parser.out).split("\n"))
    return "\n".join(line for line in lines if line)


def anchors(html: Column, base: Column | None = None) -> Column:
    """All links with a target, resolved against ``base``."""

    def batch(htmls: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([anchors_of(h, b or "") for h, b in zip(htmls, bases, strict=True)])

    return F.pandas_udf(batch, ANCHORS)(html, F.lit("") if base is None else base)


def markdown(html: Column) -> Column:
    def batch(htmls: pd.Series) -> pd.Series:
        return pd.Series([markdown_of(h) for h in htmls])

    return F.pandas_udf(batch, "string")(html)


def breadcrumb(trail: Column, separator: str = ">") -> Column:
    """section, subsection and organisation out of a trail of two, three or more parts."""
    parts = F.filter(F.transform(F.split(F.coalesce(trail, F.lit("")), separator), lambda p: F.trim(p)), lambda p: p != "")
    at = lambda i: F.get(parts, F.lit(i))
    n = F.size(parts)
    return F.struct(
        at(0).alias("section"),
        F.when(n >= 3, at(1)).alias("subsection"),
        F.when(n >= 3, F.element_at(parts, -1)).when(n == 2, at(1)).alias("organization"),
    )
