"""Text search: query builder, boolean match, headline, facets, paged search.

Here every text is read and a token matches a term by prefix, on lower-cased words with
accents kept and a short stop list removed; ``postings`` answers the same queries from an
index, with or without stems.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import coded
from millrace.operators.relational import keep_first, keyset_page

#: Words without weight in a search: fixed values.
STOP_WORDS = ("de", "la", "el", "los", "las", "y", "en", "a", "del", "por", "para", "con", "un", "una")


def words(text: Column) -> Column:
    """All words of the text, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}][\p{L}\p{N}-]*)"), F.lit(1))


def tokens(*texts: Column) -> Column:
    """The searchable words of the texts."""
    return F.filter(words(F.concat_ws(" ", *texts)), lambda w: ~w.isin(*STOP_WORDS))


def terms(text: str) -> list[str]:
    """The words of a query; everything but letters, digits and dashes separates."""
    return [w.lower() for w in re.findall(r"[^\W_](?:[^\W_]|-)*", text)]


def _starting(term: str) -> Callable[[Column], Column]:
    return lambda word: word.startswith(term)


@dataclass(frozen=True)
class BooleanQuery:
    """Groups of alternatives, all of which must match, and exclusions; a phrase's words must all match."""

    groups: tuple[tuple[str, ...], ...] = ()
    exclude: tuple[str, ...] = ()

    @classmethod
    def of_words(cls, text: str) -> BooleanQuery:
        return cls(tuple((w,) for w in terms(text)))

    def as_text(self) -> str:
        """The query in prefix-term notation: & and, | or, ! not."""

        def phrase(p: str) -> str:
            ws = [f"{w}:*" for w in terms(p)]
            return ws[0] if len(ws) == 1 else f"({' & '.join(ws)})"

        def group(g: Sequence[str]) -> str:
            ps = [phrase(p) for p in g if terms(p)]
            return ps[0] if len(ps) == 1 else f"({' | '.join(ps)})" if ps else ""

        parts = [x for x in map(group, self.groups) if x]
        parts += [f"!{phrase(p)}" for p in self.exclude if terms(p)]
        return " & ".join(parts)

    def matches(self, words: Column) -> Column | None:
        """A condition on an array of tokens; None if the query is empty."""

        def phrase(p: str) -> Column:
            return reduce(lambda a, b: a & b, (F.exists(words, _starting(t)) for t in terms(p)))

        conditions = [reduce(lambda a, b: a | b, map(phrase, g)) for g in ([p for p in g if terms(p)] for g in self.groups) if g]
        conditions += [~phrase(p) for p in self.exclude if terms(p)]
        return reduce(lambda a, b: a & b, conditions) if conditions else None


def headline(text: Column, words: Sequence[str], most: int = 60, before: int = 20) -> Column:
    """Up to ``most`` words around the first hit, hits marked; null if there is none."""
    hit = rf"(?i)^\W*(?:{'|'.join(map(re.escape, words))})"
    parts = F.split(F.trim(text), r"\s+")
    first = F.array_position(F.transform(parts, lambda w: w.rlike(hit)), True).cast("int")
    shown = F.slice(parts, F.greatest(first - before, F.lit(1)), F.lit(most))
    marked = F.transform(shown, lambda w: F.when(w.rlike(hit), F.regexp_replace(w, r"([\p{L}\p{N}-]+)", "<mark>$1</mark>")).otherwise(w))
    return F.when(first > 0, F.array_join(marked, " "))


def facet_counts(df: DataFrame, facets: dict[str, tuple[str, int]]) -> DataFrame:
    """facet, name, n: the most frequent values of each column, and the total.

    One scan and one shuffle for all of them: a row offers its value to every facet.
    """
    offered = [F.struct(F.lit(facet).alias("facet"), F.col(column).cast("string").alias("name")) for facet, (column, _) in facets.items()]
    offered.append(F.struct(F.lit("total").alias("facet"), F.lit(None).cast("string").alias("name")))
    counted = df.select(F.inline(F.array(*offered))).groupBy("facet", "name").agg(F.count(F.lit(1)).alias("n"))
    most = max([1, *(k for _, k in facets.values())])
    best = Window.partitionBy("facet").orderBy(F.desc("n"), F.asc_nulls_last("name"))
    ranked = counted.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= most)  # a literal, so that each task keeps few rows before the shuffle
    own = coded("facet", {facet: k for facet, (_, k) in facets.items()} | {"total": 1})
    found = ranked.filter(F.col("nth") <= own).drop("nth")
    empty = df.sparkSession.createDataFrame([("total", None, 0)], "facet string, name string, n long")
    return found.unionByName(empty).groupBy("facet", "name").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Search:
    """A search over a table with keys (newest first), text columns and facets."""

    keys: tuple[str, ...]
    text: tuple[str, ...]
    facets: dict[str, tuple[str, int]] = field(default_factory=dict)
    unique: bool = False  # no two rows share a key, so that nothing need be shuffled to keep one

    def text_matches(self, df: DataFrame, wanted: BooleanQuery) -> DataFrame:
        """The rows of which one text column matches; all of them if the query is empty."""
        hits = [c for c in (wanted.matches(tokens(F.coalesce(F.col(t), F.lit("")))) for t in self.text) if c is not None]
        return df.filter(reduce(lambda a, b: a | b, hits)) if hits else df

    def matching(self, df: DataFrame, wanted: BooleanQuery, *filters: Column) -> DataFrame:
        """One row a key: the first by text columns of those that match in any text column."""
        for f in filters:
            df = df.filter(f)
        df = self.text_matches(df, wanted)
        return df if self.unique else keep_first(df, self.keys, [F.asc_nulls_last(t) for t in self.text])

    def page(self, df: DataFrame, wanted: BooleanQuery, *filters: Column, size: int = 20, after: Sequence | None = None) -> DataFrame:
        return keyset_page(self.matching(df, wanted, *filters), self.keys, size, after)

    def counts(self, df: DataFrame, wanted: BooleanQuery, *filters: Column) -> DataFrame:
        """Facets and total of all matches, whatever the page."""
        return facet_counts(self.matching(df, wanted, *filters), self.facets)
