"""Benchmark decontamination by spaced seeds.

Texts become lower-case words (runs of letters and digits), each word a 64-bit
hash. A seed is a fixed mask over a few words: the hash covers the positions that
the mask selects and ignores the others, so a leak with some words replaced still
meets. Documents are hashed under every mask at every position and joined with the
seeds of the test items. A leak is

* a passage of at least ``MIN_WORDS`` words that starts and ends with words that
  agree, or
* the whole item,

aligned without gaps, of which ``MIN_SHARE`` of the words agree. ``MASKS`` hit every
placement of a fifth of replaced words in 13 to 25 words (the tests enumerate them);
a longer leak divides into such lengths, one of which has no larger share replaced.

The first hit of a document and item on each diagonal is verified over the whole
diagonal: of all passages on it between two runs of agreeing words, and the whole
item where it fits, the one with most agreeing words is the overlap.

Plan: documents are read once and never shuffled. Seeds are broadcast in blocks
of at most ``BLOCK_SEEDS`` rows; a larger benchmark is worked off block by block,
each a scan of its own. Verified hits are combined by (doc_id, item_id) with partial
aggregation, so a passage in a third of all documents makes a row a document.

Defined results: null or empty texts hold no leak, and items of fewer
words than the shortest mask take no part, those below ``MIN_WORDS`` are found
whole if copied word by word, and with replaced words where a mask hits; rows with equal doc_id are told apart by text;
repeated rows give one result row; extra columns are ignored; an empty table on
either side gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import free_names

#: Selected positions of the seeds.
MASKS = ("111011", "11111")
MIN_WORDS, MIN_SHARE = 13, 0.8
BLOCK_SEEDS = 1_000_000


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds_at(words: str, at: str) -> Column:
    """One struct a mask that ends within ``words``: its number and the hash of the words it selects from ``at`` on."""
    return F.array(
        *(
            F.when(
                F.col(at) + len(mask) <= F.size(words),
                F.struct(F.lit(n).alias("mask"), F.xxhash64(F.lit(n), *(F.get(F.col(words), F.col(at) + k) for k, bit in enumerate(mask) if bit == "1")).alias("seed")),
            )
            for n, mask in enumerate(MASKS)
        )
    )


def _spread(df: DataFrame, words: str, at: str) -> DataFrame:
    """A row for each position and mask; outer generators keep the words computed once."""
    span = min(map(len, MASKS))
    starts = F.when(F.size(words) >= span, F.sequence(F.lit(0), F.size(words) - span))
    placed = df.withColumn(at, F.explode_outer(starts)).filter(F.col(at).isNotNull())
    return placed.withColumn("s", F.explode_outer(_seeds_at(words, at))).filter("s is not null").select(*placed.columns, "s.mask", "s.seed")


def _once(value: Column) -> Column:
    """``value`` behind a generator, so that filters and lambdas do not compute it again."""
    return F.explode_outer(F.array(value))


def _earlier_hit(k: Column, at: Column) -> Column:
    """Whether a mask agrees at ``k`` of ``same``, before the hit's own position ``at`` or by an earlier mask there."""
    found = F.lit(False)
    for n, mask in enumerate(MASKS):
        agrees = (k < at) | (F.col("mask") > n)
        for i, bit in enumerate(mask):
            if bit == "1":
                agrees &= F.coalesce(F.get(F.col("same"), k + i), F.lit(False))
        found |= agrees
    return found


def _best(same: Column, agreed: Column) -> Column:
    """The passage with most agreeing words: struct of matched and overlap words and, negative, its place; null if none is a leak.

    ``agreed`` counts the agreeing words before each place of ``same``.
    """
    n = F.size(same)
    at = lambda i: F.coalesce(F.get(same, i), F.lit(False))
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: at(i) & ~at(i - 1))
    ends = F.filter(F.sequence(F.lit(1), n), lambda j: at(j - 1) & ~at(j))
    passage = lambda i, j: F.struct((F.get(agreed, j) - F.get(agreed, i)).alias("matched_words"), (j - i).alias("overlap_words"), (-i).alias("before"))
    enough = lambda i, j: F.get(agreed, j) - F.get(agreed, i) >= MIN_SHARE * (j - i)
    passages = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(ends, lambda j: (j - i >= MIN_WORDS) & enough(i, j)), lambda j: passage(i, j))))
    whole = F.when((n == F.size("item_words")) & enough(F.lit(0), n), passage(F.lit(0), n))
    return F.greatest(F.array_max(passages), whole)


def _verified(hits: DataFrame) -> DataFrame:
    d = F.col("doc_at") - F.col("item_at")
    first, last = F.greatest(F.lit(0), -d), F.least(F.size("item_words"), F.size("words") - d)
    same = F.transform(F.sequence(first, last - 1), lambda p: F.get(F.col("item_words"), p) == F.get(F.col("words"), p + d))
    placed = hits.withColumn("same", _once(same))
    at = F.col("item_at") - first
    leading = placed.filter(~F.exists(F.sequence(F.lit(0), at), lambda k: _earlier_hit(k, at)))
    agreed = F.aggregate("same", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x.cast("int"))))
    counted = leading.withColumn("agreed", _once(agreed))
    found = counted.withColumn("b", _once(_best(F.col("same"), F.col("agreed")))).filter("b is not null")
    return found.withColumns({"matched_words": F.col("b.matched_words"), "overlap_words": F.col("b.overlap_words"), "first_word": d + first - F.col("b.before")})


def leaks(docs: DataFrame, benchmark: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """doc_id, text_mark, item_id, matched_words, overlap_words, first_word: a row for each document and item."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("item_words")).filter(F.size("item_words") >= min(map(len, MASKS)))
    n_seeds = items.agg(F.sum(F.size("item_words"))).first()[0] or 0
    blocks = max(1, -(-n_seeds * len(MASKS) // BLOCK_SEEDS))
    read = docs.select(F.col(doc).alias("doc_id"), F.xxhash64("text").alias("text_mark"), word_hashes(F.col("text")).alias("words"))
    spread = _spread(read, "words", "doc_at")
    parts = []
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else items
        seeds = _spread(own, "item_words", "item_at").select("mask", "seed", "item_id", "item_at")
        whole = own.select(F.col("item_id").alias("whole_id"), "item_words").dropDuplicates()
        hits = spread.join(F.broadcast(seeds), ["mask", "seed"]).join(F.broadcast(whole), F.col("item_id").eqNullSafe(F.col("whole_id"))).drop("whole_id")
        parts.append(_verified(hits).select("doc_id", "text_mark", "item_id", "matched_words", "overlap_words", "first_word"))
    found = reduce(DataFrame.unionByName, parts)
    best = F.max(F.struct("matched_words", "overlap_words", (-F.col("first_word")).alias("before"))).alias("b")
    return found.groupBy("doc_id", "text_mark", "item_id").agg(best).select(
        "doc_id", "text_mark", "item_id", F.col("b.matched_words").alias("matched_words"), F.col("b.overlap_words").alias("overlap_words"), (-F.col("b.before")).alias("first_word")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold a leak."""
    mark, d, m = free_names(docs, "text_mark_of_row", "d", "m")
    bad = leaks(docs, benchmark, doc=doc).select(F.col("doc_id").alias(d), F.col("text_mark").alias(m)).distinct()
    keyed = docs.withColumn(mark, F.xxhash64("text"))
    return keyed.join(bad, F.col(doc).eqNullSafe(F.col(d)) & (F.col(mark) == F.col(m)), "left_anti").drop(mark)


def query(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    found = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *(F.col(c).cast("long").alias(c) for c in ("matched_words", "overlap_words", "first_word")))
