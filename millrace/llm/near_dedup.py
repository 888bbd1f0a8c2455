"""MinHash near-dedup with ProbMinHash signatures.

A document is its weighted set of five-word shingles. Every shingle runs a
Poisson process whose rate is its weight; each arrival falls into one of
``COMPONENTS`` components, and a component keeps the shingle of its earliest
arrival. A shingle stops as soon as its next arrival comes after the latest kept
one (early termination). Two signatures agree in a component with probability
equal to the sets' probability Jaccard similarity. Bands of ``ROWS`` components
propose candidates, which are verified with the exact similarity of the texts.

Scale. Equal texts are folded first (by a 128-bit key, partial aggregation), so
copies never meet each other. Buckets of at most ``SMALL`` texts are verified pair
by pair. In a larger bucket a pivot, the text with the most company, is compared
with all members, and what it links is one class. Of the pairs left there, those
are verified that can be similar at all. A shingle is rare if at most ``RARE``
texts of these buckets have it; a rare shingle lists the pairs that share it. Any
other pair shares common shingles only, and its similarity is at most
1 / (1/P + 1/Q - 1), P and Q being the shares of the two texts that such shingles
can make up. The bound is exact and linear to prepare, and rules out variants that
differ in places of their own, the bulk of any large group. So no link that the
bands propose goes unverified. Open: texts that recombine the same few sentences
have common shingles only and are not ruled out; of such a group most pairs that
share a band are verified, which grows with its square. Comparisons are dealt in
blocks. Classes are connected components by alternating large-star
and small-star steps; their edges live in Spark throughout, and every step is
checkpointed. The number of jobs depends on the depth of the link graph, not on
the size of the groups.

Defined results: equality and shingles are of lower-cased words split at white
space; texts of one to four words are a single shingle; null and empty texts are
each alone; repeated rows are documents with equal text; a class is named by its
smallest doc_id (null if all ids in it are null); an empty table gives no rows;
extra columns pass through ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import free_name, release_memory, reliable_checkpoint, table
from millrace.llm.shingles import mixed, normalized, probability_jaccard, text_key, weighted_shingles

BANDS, ROWS = 24, 6
COMPONENTS = BANDS * ROWS
SIMILARITY = 0.8
SMALL, RARE, CHUNK = 9, 8, 512
SLACK = 1e-9  # of rounding in the bounds
GROUP = 128  # sets that advance together
BLOCK_PAIRS = 2048
_ROUND = 0xD1342543DE82EF95
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)


def prob_minhash(sets: list[tuple[np.ndarray, np.ndarray]], components: int = COMPONENTS) -> np.ndarray:
    """Signatures of sets (distinct shingles, weights): for each component the shingle of the earliest arrival.

    All sets advance together; sets of few shingles take several arrivals at a time.
    """
    out = np.zeros((len(sets), components), np.uint64)
    by_size = sorted(range(len(sets)), key=lambda i: len(sets[i][0]))
    at = 0
    while at < len(by_size):
        least = max(1, len(sets[by_size[at]][0]))
        group = [i for i in by_size[at : at + GROUP] if len(sets[i][0]) <= 2 * least]
        out[group] = _advance([sets[i] for i in group], components, max(1, 2 * components // least))
        at += len(group)
    return out


def _advance(sets: list[tuple[np.ndarray, np.ndarray]], components: int, ahead: int) -> np.ndarray:
    sizes = [len(s) for s, _ in sets]
    owner, alive, rate = np.repeat(np.arange(len(sets)), sizes), np.concatenate([s for s, _ in sets]), np.concatenate([w for _, w in sets]).astype(float)
    time, limit = np.zeros(len(alive)), np.full(len(sets), np.inf)
    earliest, kept = np.full(len(sets) * components, np.inf), np.zeros(len(sets) * components, np.uint64)
    step = 0
    while len(alive):
        steps = np.array([(step + k) * _ROUND % 2**64 for k in range(1, ahead + 1)], np.uint64)
        step += ahead
        draw = mixed(alive[:, None] + steps)
        times = time[:, None] + np.cumsum(-np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53), axis=1) / rate[:, None]
        place = owner[:, None] * components + (mixed(draw) % np.uint64(components)).astype(np.int64)
        row, column = np.nonzero(times < earliest[place])
        new, where = times[row, column], place[row, column]
        late_first = np.argsort(-new, kind="stable")  # of equal places the last, so the earliest, stays
        earliest[where[late_first]] = new[late_first]
        kept[where[late_first]] = alive[row[late_first]]
        limit = earliest.reshape(len(sets), components).max(axis=1)
        running = times[:, -1] < limit[owner]
        owner, alive, rate, time = owner[running], alive[running], rate[running], times[running, -1]
    return kept.reshape(len(sets), components)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    rows = signatures.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(_BAND, rows.shape[:2])
    for k in range(ROWS):
        key = mixed(key + rows[:, :, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """row, doc_id, mark (hash of the raw text), key (of the normalised text), bands (null without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                norms = [normalized(t) for t in part.column(3).to_pylist()]
                keys = [text_key(n) for n in norms]
                new = {k: n for k, n in zip(keys, norms, strict=True) if n and k not in seen}
                if len(seen) > 20_000:
                    seen, new = {}, {k: n for k, n in zip(keys, norms, strict=True) if n}
                if new:
                    seen.update(zip(new, band_keys(prob_minhash([weighted_shingles(n) for n in new.values()])), strict=True))
                bands = [seen[k] if n else None for k, n in zip(keys, norms, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["row", "doc_id", "mark", "key", "bands"])
        release_memory()

    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return read.mapInArrow(sign, "row long, doc_id long, mark long, key binary, bands array<long>")


def _similar(texts: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Of one block of pairs: those whose texts are similar enough."""
    sets = {node: weighted_shingles(normalized(text)) for node, text in zip(texts["node"], texts["text"], strict=True)}
    hit = [probability_jaccard(*sets[a], *sets[b]) >= SIMILARITY for a, b in zip(pairs["a"], pairs["b"], strict=True)]
    return pairs.loc[hit, ["a", "b"]]


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough.

    Pairs are dealt by hashes of both ends, so a block holds each text once
    however many of its pairs need it, and a pivot's pairs spread over blocks.
    """
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    side = max(1, round(((counts["all"] or 0) / BLOCK_PAIRS) ** 0.5))
    other = max(side, -(-(counts["most"] or 0) // CHUNK))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    dealt = pairs.select(part("a", side).alias("ga"), part("b", other).alias("gb"), "a", "b")
    wanted = dealt.select("ga", "gb", F.explode(F.array("a", "b")).alias("node")).distinct()
    held = wanted.join(texts, "node").select(F.col("ga").alias("ta"), F.col("gb").alias("tb"), "node", "text")
    return held.groupBy("ta", "tb").cogroup(dealt.groupBy("ga", "gb")).applyInPandas(_similar, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node connected with it) for every node of ``edges`` (a, b)."""

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))

    edges = reliable_checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(least(large), "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = reliable_checkpoint(small)
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def _shingle_rows(texts: DataFrame) -> DataFrame:
    """node, x, w: the distinct shingles of each text and how often they occur."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                sets = [weighted_shingles(normalized(t)) for t in part.column(1).to_pylist()]
                nodes = np.repeat(part.column(0).to_numpy(), [len(s) for s, _ in sets])
                x, w = (np.concatenate([s[i] for s in sets]) if sets else np.zeros(0) for i in range(2))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(x.astype(np.uint64).view(np.int64)), pa.array(w.astype(np.int64))], names=["node", "x", "w"])
        release_memory()

    return texts.select("node", "text").mapInArrow(spread, "node long, x long, w long")


def _set_sizes(texts: DataFrame) -> DataFrame:
    """node, total (weight of its shingles) and extra (what repeats add to it)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [weighted_shingles(normalized(t)) for t in batch.column(1).to_pylist()]
            total = [int(w.sum()) for _, w in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array([t - len(s) for t, (s, _) in zip(total, sets, strict=True)], pa.int64())], names=["node", "total", "extra"])

    return texts.select("node", "text").mapInArrow(measure, "node long, total long, extra long")


def _within_reach(rare_a=0, rare_b=0):
    """Whether a and b can be similar: shares of common shingles, and of the rare ones that both hold."""

    def share(own: str, other: str, rare):
        most = F.least(F.col(f"{own}.common"), F.col(f"{other}.common") - F.col(f"{other}.common_extra") + F.col(f"{own}.extra"))
        return F.least(F.lit(1.0), (most + rare) / F.col(f"{own}.total"))

    p, q = share("a", "b", rare_a), share("b", "a", rare_b)
    return (p > 0) & (q > 0) & (1 / p + 1 / q <= 1 / SIMILARITY + 1 + SLACK)


def _pairs_within_reach(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``rows`` (band, node, label, main) with different labels that share a band and can be similar."""
    own = texts.join(rows.select("node").distinct(), "node", "left_semi")
    spread = _shingle_rows(own)
    rare = spread.groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= RARE)
    held = reliable_checkpoint(spread.join(rare, "x"))
    lost = held.groupBy("node").agg(F.sum("w").alias("rare"), F.sum(F.col("w") - 1).alias("rare_extra"), F.sum(F.when(F.col("n") == 1, F.col("w")).otherwise(0)).alias("alone"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    sized = _set_sizes(own).join(lost, "node", "left").filter(F.col("total") - zero("alone") >= SIMILARITY * F.col("total") - SLACK)
    sized = reliable_checkpoint(sized.select("node", "total", "extra", (F.col("total") - zero("rare")).alias("common"), (F.col("extra") - zero("rare_extra")).alias("common_extra")))
    labels = rows.select("node", "label").distinct()
    known = sized.join(labels, "node")

    shared = held.filter("n > 1").join(sized.select("node"), "node", "left_semi")
    met = shared.select("x", F.col("node").alias("a"), F.col("w").alias("wa")).join(shared.select("x", F.col("node").alias("b"), F.col("w").alias("wb")), "x").filter("a < b")
    summed = met.groupBy("a", "b").agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb")).withColumnsRenamed({"a": "na", "b": "nb"})
    by_rare = summed.join(known.alias("a"), F.col("na") == F.col("a.node")).join(known.alias("b"), F.col("nb") == F.col("b.node")).filter(F.col("a.label") != F.col("b.label"))
    by_rare = by_rare.filter(_within_reach(F.col("wa"), F.col("wb"))).select(F.col("na").alias("a"), F.col("nb").alias("b"))

    likely = rows.join(sized.filter(F.col("common") >= SIMILARITY * F.col("total") - SLACK), "node")
    main = F.col("b.label") == F.col("b.main")
    by_common = likely.filter("label <> main").alias("a").join(likely.alias("b"), F.col("a.band") == F.col("b.band"))
    by_common = by_common.filter((F.col("a.label") != F.col("b.label")) & (main | (F.col("a.node") < F.col("b.node"))) & _within_reach())
    ends = (F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))
    return by_common.select(*ends).distinct().unionByName(by_rare).distinct()


def similar_links(representatives: DataFrame, texts_of) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between the nodes of ``representatives`` (node, bands, ...), and node, label of their components.

    ``texts_of(nodes)`` gives node, text for the nodes that share a bucket.
    """
    spread = representatives.select("node", F.explode("bands").alias("band"))
    # counts and pivots are checkpointed apart from their joins, so that adaptive execution can split a frequent band there
    sizes = reliable_checkpoint(spread.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    held = reliable_checkpoint(spread.join(sizes, "band"))
    texts = reliable_checkpoint(texts_of(held.select("node").distinct()))
    few, many = held.filter(F.col("n") <= SMALL), held.filter(F.col("n") > SMALL)
    close = few.select("band", F.col("node").alias("a")).join(few.select("band", F.col("node").alias("b")), "band").filter("a < b").select("a", "b")
    crowds = many.groupBy("node").agg(F.sum("n").alias("crowd"))  # the text that the others are copies of stands out
    pivots = many.join(crowds, "node").groupBy("band").agg(F.max(F.struct("crowd", F.xxhash64("node").alias("h"), "node")).alias("p"))
    pivots = reliable_checkpoint(pivots)
    star = many.join(pivots, "band").select(F.least("p.node", "node").alias("a"), F.greatest("p.node", "node").alias("b")).filter("a <> b")
    links = reliable_checkpoint(_verify(reliable_checkpoint(close.unionByName(star).distinct()), texts))
    labels = reliable_checkpoint(connected_components(links))

    wide = many.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    sides = wide.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed_bands = sides.groupBy("band").agg(F.max(F.struct("c", "label")).alias("m"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("band", F.col("m.label").alias("main"))
    mixed_bands = reliable_checkpoint(mixed_bands)
    undecided = reliable_checkpoint(wide.join(mixed_bands, "band"))
    if undecided.isEmpty():
        return links, labels
    more = reliable_checkpoint(_verify(reliable_checkpoint(_pairs_within_reach(undecided, texts)), texts))
    of = undecided.select("node", "label").distinct()
    between = more.join(of.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(of.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    merged = connected_components(between.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    every = labels.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).withColumn("label", F.col("node")))
    every = every.groupBy("node").agg(F.min("label").alias("label"))  # a node without a link so far is its own label
    renamed = every.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    return links.unionByName(more), reliable_checkpoint(renamed.select("node", F.coalesce("to", "label").alias("label")))


def near_duplicate_classes(docs: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """row, doc_id, mark, class_id, class_size, n_links and is_kept for every row of ``docs``.

    ``n_links`` counts the verified links between the row's text and different texts; pairs whose
    texts had a common class already were not compared.
    """
    signed = reliable_checkpoint(signatures(docs, doc))
    folded = signed.filter(F.col("bands").isNotNull()).groupBy("key").agg(F.min(F.struct("row", "doc_id", "mark", "bands")).alias("r"))
    representatives = reliable_checkpoint(folded.select("key", F.col("r.row").alias("node"), F.col("r.doc_id").alias("doc_id"), F.col("r.mark").alias("mark"), F.col("r.bands").alias("bands")))

    def texts_of(nodes: DataFrame) -> DataFrame:
        handles = representatives.join(nodes, "node", "left_semi").select("node", F.col("doc_id").alias("d"), F.col("mark").alias("m"))
        read = docs.select(F.col(doc).cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
        met = read.join(handles, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
        return met.select("node", "text").dropDuplicates(["node"])

    links, labels = similar_links(representatives, texts_of)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = representatives.select("key", "node").join(labels, "node", "left").join(degree, "node", "left").select("key", "n_links", F.coalesce("label", "node").alias("class"))
    members = signed.join(named, "key", "left").select("row", "doc_id", "mark", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class", F.col("row")).alias("class"))
    members = reliable_checkpoint(members)
    names = members.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("first"))
    names = reliable_checkpoint(names)  # apart from the join, so that adaptive execution can split a large class there
    return members.join(names, "class").select("row", "doc_id", "mark", "class_id", "class_size", "n_links", (F.col("row") == F.col("first.row")).alias("is_kept"))


def drop_near_duplicates(docs: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """One document of each class: the one with the smallest id."""
    mark, nth, kept_id, kept_mark = (free_name(docs, c) for c in ("text_mark", "nth_copy", "kept_id", "kept_mark"))
    classes = reliable_checkpoint(near_duplicate_classes(docs, doc=doc))
    kept = classes.filter("is_kept").select(F.col("doc_id").alias(kept_id), F.col("mark").alias(kept_mark))
    keyed = docs.withColumn(mark, F.xxhash64("text"))
    once = keyed.join(kept, F.col(doc).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(mark) == F.col(kept_mark)), "left_semi")
    if classes.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return once.select(*docs.columns)
    # rows that repeat id and text cannot be told apart by them: the first one stays
    order = Window.partitionBy(doc, mark).orderBy(*(F.col(c) for c in docs.columns if c != "text"))
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    return once.withColumn(nth, F.row_number().over(order)).filter((F.col(nth) == 1) | blank).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicate_classes(docs).select("doc_id", "class_id", "class_size", "n_links", "is_kept")
