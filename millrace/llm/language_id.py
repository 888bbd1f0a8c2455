"""Language ID by Bayesian evidence fusion.

For every language l the log posterior is the sum of

* the text's log likelihood under a byte-trigram model of l, tempered, since
  neighbouring trigrams are not independent: the mean a trigram, over the whole
  text, counts like at most ``MOST_TRIGRAMS`` * ``TEMPER`` independent ones,
* log P(declared markup language | l) and log P(address suffix | l), both from
  smoothed grouped counts over all rows,
* the log prior of l at the row's host, smoothed hierarchically:
  P(l | host) = (n(host, l) + A P(l | parent)) / (n(host) + A), the parent's
  likewise towards the whole corpus; n are summed text posteriors.

Evidence that a row lacks (null or empty) adds nothing. A row is rejected
(language ``und``) if its text has no letters, or fits even the likeliest
language far worse than that language's own texts do.

Trigram models are fitted on a documented sample a language: all rows with
letters that declare it, or about ``SAMPLE`` of them chosen by a hash if there
are more, whole texts. Every language of ``MIN_TRIGRAMS`` trigrams has a model,
however rare it is; the counts that reach the driver are at most BUCKETS a
language. The ``MAX_LANGUAGES`` largest have evidence and priors of their own; the
others share one class in these, which speaks with the likeliest of them by text
and declared language. A row whose declared language has too little text for a
model is not rejected for that: unless it fits another as well as that language's
own texts do, it keeps its declared language, with confidence 0. Priors and evidence
tables are grouped aggregations over all rows (partial sums before the shuffle,
so one host with a third of the rows is a row a task); they are joined back by
broadcast only below ``BROADCAST_KEYS`` keys, else by a shuffled join whose hot
side adaptive execution splits. Texts never travel: the scores do.

Defined results: null or empty text has likelihood one everywhere and is
rejected; repeated rows are judged one by one; without any declared language no
model can be fitted and every row is rejected, and if all have too little text the
declared language is taken; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import free_names, release_memory, reliable_checkpoint, table

SAMPLE, MAX_LANGUAGES, MIN_TRIGRAMS, BUCKETS = 12_000, 64, 200, 1 << 15  # SAMPLE rows a language
TEMPER, MOST_TRIGRAMS = 0.25, 400  # a text speaks as loud as at most so many independent trigrams
HOST_WEIGHT, PARENT_WEIGHT, EVIDENCE_WEIGHT = 20.0, 50.0, 1.0
MISFIT, SPREAD = 3.5, 6.0  # nats a trigram below the language's own mean; allowance for short texts, over the root of their length
DECLARED_WEIGHT = 3.0  # nats for the declared one among the languages beyond the largest
BROADCAST_KEYS = 20_000
LETTER = r"[A-Za-z]|[^\x00-\x7f]"
UNKNOWN = "und"


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of the lower-cased texts, letters and single blanks only, and each text's count."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"".join(b"\0" + p + b"\0" for p in parts), np.uint8)  # a gap before and after each text
    ends = np.cumsum([len(p) + 2 for p in parts])
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    kept = letter | (raw == 0)
    kept[1:] |= letter[:-1]  # the byte after a letter stands for the gap
    symbols = np.where(letter, raw, 32).astype(np.int64)[kept]
    owner = np.searchsorted(ends, np.flatnonzero(kept), side="right")
    if len(symbols) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    same = (owner[2:] == owner[:-2]) & (symbols[1:-1] != 32)
    code = (symbols[:-2] * 65599 + symbols[1:-1] * 257 + symbols[2:]) * 0x9E3779B1
    tri = ((code >> 12) & (BUCKETS - 1))[same]
    return tri, np.bincount(owner[2:][same], minlength=len(texts) + 1)[: len(texts)]


class TrigramModels:
    """Log probabilities of hashed trigrams a language, and how well its own texts fit; the first ``head`` are the largest."""

    def __init__(self, languages: list[str], counts: np.ndarray, head: int | None = None):
        self.languages, self.head = languages, len(languages) if head is None else head
        self.log_p = np.empty((counts.shape[1], len(languages)), np.float32)
        self.own = np.zeros(len(languages))
        for j, row in enumerate(counts):
            p = (row + 0.05) / (row + 0.05).sum()
            self.log_p[:, j] = np.log(p)
            self.own[j] = (p * np.log(p)).sum()

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log likelihood a trigram (texts x languages) and the number of trigrams."""
        tri, n = _trigrams(texts)
        total = np.zeros((len(texts), len(self.languages)))
        held = np.flatnonzero(n)
        if len(tri):
            starts = np.concatenate([[0], np.cumsum(n[held])[:-1]])
            for j in range(len(self.languages)):
                total[held, j] = np.add.reduceat(self.log_p[tri, j].astype(np.float64), starts)
        return total / np.maximum(n, 1)[:, None], n


def primary_tag(tag: Column) -> Column:
    """The primary language subtag, lower case; null if there is none."""
    found = F.regexp_extract(F.lower(tag), r"^\s*([a-z]{2,3})(?:[-_].*)?\s*$", 1)
    return F.when(found != "", found)


def fit_models(rows: DataFrame, *, sample: int = SAMPLE) -> TrigramModels:
    """``rows`` has id, text, declared; ``sample`` bounds the rows a language."""
    declared = rows.filter(F.col("declared").isNotNull() & F.col("text").rlike(LETTER)).select("id", "text", "declared")
    every = declared.groupBy("declared").agg(F.ceil(F.count("*") / sample).alias("every"))
    chosen = declared.join(F.broadcast(every), "declared").filter(F.pmod(F.xxhash64(F.lit(41), "id", F.length("text")), F.col("every")) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for lang, group in pd.DataFrame({"t": part.column(0).to_pylist(), "l": part.column(1).to_pylist()}).groupby("l"):
                    tri, _ = _trigrams([t or "" for t in group["t"]])
                    sums[lang] = sums.get(lang, 0) + np.bincount(tri, minlength=BUCKETS)
        release_memory()
        for lang, s in sums.items():
            held = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held)), pa.array(held), pa.array(s[held])], names=["lang", "bucket", "n"])

    counted = chosen.select("text", "declared").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = reliable_checkpoint(counted)
    sizes = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    largest = sorted((lang for lang, n in sizes.items() if n >= MIN_TRIGRAMS), key=lambda lang: (-sizes[lang], lang))
    languages = sorted(largest[:MAX_LANGUAGES]) + sorted(largest[MAX_LANGUAGES:])
    counts = np.zeros((len(languages), BUCKETS), np.float32)
    if languages:
        held = counted.filter(F.col("lang").isin(languages)).toArrow()
        row = pc.index_in(held.column("lang"), value_set=pa.array(languages)).to_numpy()
        counts[row, held.column("bucket").to_numpy()] = held.column("n").to_numpy()
    return TrigramModels(languages, counts, min(len(languages), MAX_LANGUAGES))


def _normalized(values: Column) -> Column:
    top = F.array_max(values)
    weights = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, v: a + v)
    return F.transform(weights, lambda v: v / total)


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + F.coalesce(y, F.lit(0.0)))


def _sized_join(left: DataFrame, right: DataFrame, on: str, size: int) -> DataFrame:
    small = size <= BROADCAST_KEYS
    return left.join(F.broadcast(right) if small else right, on, "left")


def identify(rows: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """``rows`` has id, text, declared, suffix, host, parent.

    Returns id, mark (a hash of the text, which tells rows of one id apart), lang, confidence, accepted, fit.
    """
    rows = rows.withColumn("declared", primary_tag(F.col("declared")))
    models = fit_models(rows, sample=sample)
    languages, head = models.languages, models.head
    n = head + (len(languages) > head)  # classes: the largest languages, and one for all others
    place = {lang: j for j, lang in enumerate(languages)}
    if not n:
        spoken = F.col("declared").isNotNull() & F.coalesce(F.col("text").rlike(LETTER), F.lit(False))
        return rows.select("id", F.xxhash64("text").alias("mark"), F.when(spoken, F.col("declared")).otherwise(UNKNOWN).alias("lang"), F.lit(0.0).alias("confidence"), spoken.alias("accepted"), F.lit(0.0).alias("fit"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                means, counts = models.score([t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()])
                loud = means * (np.minimum(counts, MOST_TRIGRAMS) * TEMPER)[:, None]
                own = np.array([place.get(d, -1 if d is None else -2) for d in part.column(part.schema.get_field_index("declared")).to_pylist()], np.int64)
                best, every = means.argmax(1), np.arange(len(means))
                fit = np.where(counts > 0, means[every, best] - models.own[best], 0.0)
                rest: list[str | None] = [None] * len(means)
                if n > head:
                    weighed = loud[:, head:].copy()
                    said = np.flatnonzero(own >= head)
                    weighed[said, own[said] - head] += DECLARED_WEIGHT
                    at = head + weighed.argmax(1)
                    rest, loud = [languages[j] for j in at], np.column_stack([loud[:, :head], loud[every, at]])
                keys = [part.column(part.schema.get_field_index(c)) for c in ("id", "mark", "declared", "suffix", "host", "parent")]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(list(loud), pa.list_(pa.float64())), pa.array(counts, pa.int64()), pa.array(fit), pa.array(rest, pa.string()), pa.array(own == -2)],
                    names=["id", "mark", "declared", "suffix", "host", "parent", "loud", "n", "fit", "rest", "unmodelled"],
                )
        release_memory()

    keyed = rows.select("id", F.xxhash64("text").alias("mark"), *(F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("declared", "suffix", "host", "parent")), "text")
    scored = keyed.mapInArrow(score, "id long, mark long, declared string, suffix string, host string, parent string, loud array<double>, n long, fit double, rest string, unmodelled boolean")
    scored = reliable_checkpoint(scored.withColumn("soft", _normalized(F.col("loud"))))

    def summed(key: str, name: str) -> DataFrame:
        sums = F.array(*(F.sum(F.get("soft", F.lit(i))) for i in range(n)))
        return scored.filter((F.col("n") > 0) & F.col(key).isNotNull()).groupBy(key).agg(sums.alias(name))

    total = scored.filter("n > 0").agg(*(F.sum(F.get("soft", F.lit(i))) for i in range(n))).first()
    whole = np.array([v or 0.0 for v in total]) + 1.0
    base = F.array(*(F.lit(float(v)) for v in whole / whole.sum()))

    def smoothed(counts: Column, towards: Column, weight: float) -> Column:
        n_all = F.aggregate(counts, F.lit(0.0), lambda a, v: a + v)
        return F.zip_with(counts, towards, lambda c, t: (c + weight * t) / (n_all + weight))

    def likelihood(key: str) -> tuple[DataFrame, int]:
        """log P(key | l), smoothed over all values that occur, so that it adds up to one; and their number."""
        counts = reliable_checkpoint(summed(key, "c"))
        values, *held = counts.agg(F.count(F.lit(1)), *(F.sum(F.get("c", F.lit(i))) for i in range(n))).first()
        out_of = F.array(*(F.lit((v or 0.0) + values * EVIDENCE_WEIGHT) for v in held))
        return counts.select(key, F.zip_with("c", out_of, lambda c, t: F.log((c + EVIDENCE_WEIGHT) / t)).alias(f"log_{key}")), values

    parents = summed("parent", "pc").select("parent", smoothed(F.col("pc"), base, PARENT_WEIGHT).alias("pp"))
    hosts = scored.filter(F.col("host").isNotNull()).groupBy("host").agg(F.min("parent").alias("parent")).join(summed("host", "hc"), "host", "left").join(parents, "parent", "left")
    none = F.array(*[F.lit(0.0)] * n)
    towards = F.coalesce("pp", base)
    priors = hosts.select("host", F.transform(smoothed(F.coalesce("hc", none), towards, HOST_WEIGHT), lambda p: F.log(p)).alias("log_host"))

    fused = scored
    for key, (right, size) in (("declared", likelihood("declared")), ("suffix", likelihood("suffix")), ("host", (priors, priors.count()))):
        fused = _sized_join(fused, right, key, size)
    posterior = F.col("loud")
    for key in ("declared", "suffix", "host"):
        posterior = _added(posterior, F.coalesce(f"log_{key}", F.transform(base, lambda p: F.log(p)) if key == "host" else none))
    names = F.array(*map(F.lit, languages[:head]), *[F.col("rest")] * (n - head))
    judged = fused.withColumn("posterior", _normalized(posterior)).withColumn("confidence", F.array_max("posterior"))
    spread = SPREAD / F.sqrt(F.greatest("n", F.lit(1)))
    by_tag = (F.col("n") > 0) & F.col("unmodelled") & (F.col("fit") <= -spread)
    accepted = (F.col("n") > 0) & (F.col("unmodelled") | (F.col("fit") > -(MISFIT + spread)))
    likeliest = F.get(names, F.array_position("posterior", F.col("confidence")).cast("int") - 1)
    return judged.select(
        "id",
        "mark",
        F.when(by_tag, F.col("declared")).when(accepted, likeliest).otherwise(UNKNOWN).alias("lang"),
        F.when(by_tag, 0.0).otherwise(F.round("confidence", 6)).alias("confidence"),
        accepted.alias("accepted"),
        F.round("fit", 6).alias("fit"),
    )


def document_evidence(docs: DataFrame) -> DataFrame:
    """A document's declared language is its ``lang``, its host its ``source``; it has no address."""
    source = F.col("source").cast("string")
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), source.alias("host"), F.regexp_extract(source, r"^(\D*)", 1).alias("parent"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Text and ``lang`` attribute from the markup; suffix and host from the address."""
    html = F.coalesce("html", F.lit(""))
    visible = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|head|nav)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#:]*)", 1))
    first = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://[^/?#]*/([a-z]{2})(?:[/?#]|$)", 1)
    top = F.regexp_extract(host, r"([^.]+)$", 1)
    return pages.select(
        F.col("page_id").alias("id"),
        visible.alias("text"),
        F.regexp_extract(html, r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z_-]+)""", 1).alias("declared"),
        F.when(first != "", F.concat(top, F.lit("/"), first)).otherwise(top).alias("suffix"),
        host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("parent"),
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected ones; ``lang`` becomes the identified language."""
    mark, found, own_id, own_mark = free_names(docs, "text_mark", "found_lang", "id", "mark")
    judged = identify(document_evidence(docs)).filter("accepted").groupBy("id", "mark").agg(F.min("lang").alias("lang")).toDF(own_id, own_mark, found)
    keyed = docs.withColumn(mark, F.xxhash64("text"))
    kept = keyed.join(judged, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(mark) == F.col(own_mark)))
    return kept.withColumn("lang", F.col(found)).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return identify(document_evidence(table(spark, sf_dir, "documents"))).select(F.col("id").alias("doc_id"), "lang", "confidence", "accepted", "fit")


def query_pages(spark, sf_dir: str) -> DataFrame:
    return identify(page_evidence(table(spark, sf_dir, "pages"))).select(F.col("id").alias("page_id"), "lang", "confidence", "accepted", "fit")
