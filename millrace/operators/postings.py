"""Indexes for text: positional postings of words and postings of character trigrams.

An index is a Parquet folder whose rows are sorted and range-partitioned by term, so a
query reads the pages of its own terms: exact terms and prefixes are ranges, which the
scan compares with the statistics of files, row groups and pages. A row is the posting list
of a term in one Arrow batch of documents: a term is written and shuffled once a batch, not
once a document. The first key is part of the range, so a term in every document is spread
over as many files as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.stemming import spanish_stem, stem_prefix, stem_table
from millrace.operators.relational import small_side
from millrace.operators.search import STOP_WORDS, BooleanQuery, Search, terms, words

PAGE_ROWS, GROUP_BYTES = 2_000, 8 << 20


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def write_sorted(rows: DataFrame, folder: str, *order: str) -> None:
    """Rows that are partitioned by ranges of ``order``, sorted, in pages small enough to be skipped."""
    writer = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite")
    writer.option("parquet.block.size", GROUP_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(folder)


def _lists(batches: Iterator[pa.RecordBatch], fields: Sequence[str], left_out: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """field, term, first, keys, starts, positions of list columns (one a field) beside the key, a row a term and batch.

    ``positions`` are those of the term in all its documents, one after the other; those of the n-th key
    begin at ``starts[n]`` and end where the next begin.
    """
    for batch in batches:
        key = batch.column(0)
        for column, field in zip(batch.columns[1:], fields, strict=True):
            begin = column.offsets.to_numpy().astype(np.int64)
            coded = column.values.slice(begin[0], begin[-1] - begin[0]).dictionary_encode()
            size = np.diff(begin)
            doc = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(doc)) - np.repeat(begin[:-1] - begin[0], size)
            code = coded.indices.to_numpy(zero_copy_only=False)
            if left_out and len(code):
                kept = ~np.isin(coded.dictionary.to_numpy(zero_copy_only=False).astype(str), list(left_out))[code]
                code, doc, place = code[kept], doc[kept], place[kept]
            if not len(code):
                continue
            order = np.argsort(code, kind="stable")
            code, doc, place = code[order], doc[order], place[order]
            posting = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(doc) != 0)))
            term = np.flatnonzero(np.append(True, np.diff(code[posting]) != 0))  # its first posting
            ends, token_ends = np.append(term, len(posting)), np.append(posting[term], len(code))
            held = np.diff(ends)
            starts = np.insert(posting - np.repeat(posting[term], held), ends[1:], np.diff(token_ends))  # and where the last one ends
            keys = key.take(pa.array(doc[posting]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([field] * len(term), pa.string()),
                    coded.dictionary.take(pa.array(code[posting][term])),
                    keys.take(pa.array(term)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), keys),
                    pa.ListArray.from_arrays(pa.array((ends + np.arange(len(ends))).astype(np.int32)), pa.array(starts.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(token_ends.astype(np.int32)), pa.array(place.astype(np.int32))),
                ],
                names=["field", "term", "first", "keys", "starts", "positions"],
            )


def posting_lists(df: DataFrame, key: str, terms: dict[str, Column], left_out: Sequence[str] = ()) -> DataFrame:
    """``_lists`` of arrays of terms, one for each field; no shuffle."""
    read = df.select(F.col(key).alias("key"), *(column.alias(f"terms{n}") for n, column in enumerate(terms.values())))
    kind, of = read.schema["key"].dataType.simpleString(), read.schema["terms0"].dataType.elementType.simpleString()
    schema = f"field string, term {of}, first {kind}, keys array<{kind}>, starts array<int>, positions array<int>"
    return read.mapInArrow(partial(_lists, fields=list(terms), left_out=left_out), schema)


@dataclass(frozen=True)
class WordIndex:
    """Postings (field, term, key, positions) of the text columns ``fields``, and the stems of the terms.

    Positions count all words of a text from 0; stop words have a position but no posting. Null texts
    have no words. Rows that share a key are one document, whose postings hold the words of all.
    """

    spark: SparkSession
    folder: str
    key: str
    fields: tuple[str, ...]
    stemmed: bool = False

    def build(self, df: DataFrame) -> WordIndex:
        """Write the index: words are gathered batch by batch, and the lists shuffled once, by ranges."""
        found = posting_lists(df, self.key, {f: words(F.coalesce(F.col(f), F.lit(""))) for f in self.fields}, STOP_WORDS)
        write_sorted(found, f"{self.folder}/postings", "field", "term", "first")
        if self.stemmed:
            write_sorted(stem_table(self.blocks()), f"{self.folder}/stems", "stem", "term")
        return self

    def blocks(self) -> DataFrame:
        """The lists as they are stored."""
        return self.spark.read.parquet(f"{self.folder}/postings")

    def postings(self, *where: Column) -> DataFrame:
        """field, term, key, positions: a row a document, of the lists for which ``where`` holds."""
        blocks = reduce(DataFrame.filter, where, self.blocks())
        own = lambda key, n: F.struct(key.alias("key"), F.slice("positions", F.get("starts", n) + 1, F.get("starts", n + 1) - F.get("starts", n)).alias("positions"))
        return blocks.select("field", "term", F.inline(F.transform("keys", own)))

    def stems(self) -> DataFrame:
        return self.spark.read.schema("term string, stem string").parquet(f"{self.folder}/stems")

    def lists(self, wanted: Sequence[str]) -> DataFrame:
        """The lists of every word that starts with one of ``wanted``; t0, t1, ... tell with which.

        In a stemmed index both sides are compared by their stems: the words of the stems in range are
        looked up first, then their postings.
        """
        if not self.stemmed:
            hits = [stem_prefix(F.col("term"), w) for w in wanted]
            return self.blocks().filter(any_of(hits)).select("field", "term", "keys", *(h.alias(f"t{i}") for i, h in enumerate(hits)))
        hits = [stem_prefix(F.col("stem"), spanish_stem(w)) for w in wanted]
        chosen = self.stems().filter(any_of(hits)).select("term", *(h.alias(f"t{i}") for i, h in enumerate(hits)))
        return self.blocks().select("field", "term", "keys").join(small_side(chosen), "term")

    def keys(self, wanted: BooleanQuery, df: DataFrame) -> DataFrame | None:
        """The keys of documents of which one field satisfies ``wanted``; None for an empty query.

        The lists that the query names are read once and met by key: all groups intersect, the phrases of
        a group are united, exclusions are taken away. Without any group every document of ``df`` is
        a hit but those whose fields are all excluded.
        """
        groups = [[terms(p) for p in g if terms(p)] for g in wanted.groups]
        groups, exclude = [g for g in groups if g], [terms(p) for p in wanted.exclude if terms(p)]
        used = sorted({w for p in [*(p for g in groups for p in g), *exclude] for w in p})
        if not used:
            return None
        flag = {w: F.col(f"t{i}") for i, w in enumerate(used)}
        whole = lambda phrase: all_of([flag[w] for w in phrase])
        flags = [f"t{i}" for i in range(len(used))]
        met = self.lists(used).select("field", F.explode("keys").alias("key"), *flags).groupBy("key", "field").agg(*(F.bool_or(t).alias(t) for t in flags))
        excluded = any_of([whole(p) for p in exclude])
        if groups:
            return met.filter(all_of([any_of([whole(p) for p in g]) for g in groups]) & ~excluded).select("key").distinct()
        gone = met.filter(excluded).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(self.fields))
        named = df.select(F.col(self.key).alias("key")).distinct()
        return named.join(gone.select(F.col("key").alias("_gone")), F.col("key").eqNullSafe(F.col("_gone")), "left_anti")

    def phrase(self, text: str) -> DataFrame:
        """key, field and first: where the words of ``text`` stand side by side; stop words match any word."""
        sought = [(w, i) for i, w in enumerate(terms(text)) if w not in STOP_WORDS]
        lists = self.postings(F.col("term").isin([w for w, _ in sought]))
        offsets = F
        for word in dict.fromkeys(w for w, _ in sought):
            offsets = offsets.when(F.col("term") == word, F.array(*(F.lit(i) for w, i in sought if w == word)))
        starts = lists.select("key", "field", F.explode("positions").alias("pos"), offsets.alias("offsets"))
        starts = starts.select("key", "field", F.explode(F.transform("offsets", lambda o: F.struct(o.alias("o"), (F.col("pos") - o).alias("start")))).alias("s"))
        met = starts.groupBy("key", "field", "s.start").agg(F.count_distinct("s.o").alias("n")).filter((F.col("n") == len(sought)) & (F.col("start") >= 0))
        return met.groupBy("key", "field").agg(F.min("start").alias("first"))


@dataclass(frozen=True)
class IndexedSearch(Search):
    """A search whose text condition is answered by a ``WordIndex`` over the same columns."""

    index: WordIndex | None = None

    def text_matches(self, df: DataFrame, wanted: BooleanQuery) -> DataFrame:
        keys = self.index.keys(wanted, df)
        if keys is None:
            return df
        return df.join(keys.withColumnRenamed("key", "_hit"), F.col(self.index.key).eqNullSafe(F.col("_hit")), "left_semi")


def grams(text: Column) -> Column:
    """Hashes of the different trigrams of characters in the lower-cased text; none in a shorter one."""
    letters = F.split(F.lower(text), "")
    following = F.arrays_zip(letters.alias("a"), F.slice(letters, 2, F.length(text) + 1).alias("b"), F.slice(letters, 3, F.length(text) + 1).alias("c"))
    whole = F.filter(following, lambda t: t["c"].isNotNull() & (t["c"] != ""))
    return F.array_distinct(F.transform(whole, lambda t: F.xxhash64(F.concat(t["a"], t["b"], t["c"]))))


def literal_runs(pattern: str) -> list[str]:
    """The parts of a LIKE pattern between its wildcards; a backslash makes the next character literal."""
    runs, escaped = [""], False
    for c in pattern:
        if escaped or c not in "%_\\":
            runs[-1] += c
            escaped = False
        elif c == "\\":
            escaped = True
        else:
            runs.append("")
    return [r for r in runs if r]


@dataclass(frozen=True)
class TrigramIndex:
    """Lists of the documents that hold a trigram, for ILIKE on one text column with a leading wildcard."""

    spark: SparkSession
    folder: str
    key: str
    column: str

    def build(self, df: DataFrame) -> TrigramIndex:
        found = posting_lists(df, self.key, {self.column: F.coalesce(grams(F.col(self.column)), F.array().cast("array<bigint>"))})
        write_sorted(found.select(F.col("term").alias("gram"), "first", "keys"), self.folder, "gram", "first")
        return self

    def lists(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def _grams_of(self, patterns: Sequence[str]) -> list[list[int]]:
        """The trigrams that every match of a pattern must hold, by the functions that index and ILIKE use."""
        lowered = self.spark.range(1).select(*(F.lower(F.lit(p)) for p in patterns)).first()
        runs = [literal_runs(p) for p in lowered]
        parts = self.spark.range(1).select(*(F.array_distinct(F.flatten(F.array(*(grams(F.lit(r)) for r in rs)))) if rs else F.array().cast("array<bigint>") for rs in runs)).first()
        return [list(p) for p in parts]

    def candidates(self, patterns: Sequence[str]) -> DataFrame | None:
        """Keys that hold all trigrams of one of the patterns; None if one of them has no trigram."""
        wanted = self._grams_of(patterns)
        if not all(wanted):
            return None
        place = {x: n for n, x in enumerate(sorted({x for g in wanted for x in g}))}
        bit = [F.when(F.col("gram") == x, 1) for x in place]  # counted a gram, as a key may stand in several lists of one
        lists = self.lists().filter(F.col("gram").isin(list(place))).select("gram", F.explode("keys").alias("key"))
        met = lists.groupBy("key").agg(*(F.max(b).alias(f"g{n}") for n, b in enumerate(bit)))
        return met.filter(any_of([all_of([F.col(f"g{place[x]}").isNotNull() for x in g]) for g in wanted])).select("key")

    def matching(self, df: DataFrame, include: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
        """Rows whose column is ILIKE any of ``include`` and none of ``exclude``.

        ILIKE is evaluated on candidates only; a pattern without three literal characters in a row makes
        every row one. A null column matches nothing; without ``include`` only the exclusions count.
        """
        keys = self.candidates(include) if include else None
        if keys is not None:
            df = df.join(keys.withColumnRenamed("key", "_hit"), F.col(self.key).eqNullSafe(F.col("_hit")), "left_semi")
        text = F.col(self.column)
        wanted = any_of([text.ilike(p) for p in include]) if include else F.lit(True)
        return df.filter(wanted & all_of([~text.ilike(p) for p in exclude]))
