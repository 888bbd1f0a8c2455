"""Substring dedup by seed and extend: repeated passages of words, found from winnowed anchors.

A word is removed if a window of ``WINDOW`` consecutive words covers it whose words also
occur, in that order, in a document with a smaller doc_id. Windows are judged on the
input; what a document repeats of itself stays.

*Seeds.* Of the ``SEED``-word grams that lie in a window the one with the smallest hash
(ties to the left) is the window's anchor, so equal windows have equal anchors, about one
in five words is one, and documents without a common anchor have no window in common.
Consecutive windows with one anchor form its neighbourhood. Anchors are joined on their
hash; those that occur once in the corpus are dropped.

*Extension.* A match is extended to both sides of its anchor over all documents at once.
Where two neighbourhoods agree as a whole, the later document is covered from end to end
and goes no further. The first document of each different neighbourhood is extended word
by word, unless all documents with its anchor agree with it: j words before the anchor and
the rest after it, for every j that the neighbourhood allows. Documents that agree so far form a class, and all but those with its
smallest doc_id are covered there. Covered spans that touch are merged: the removed runs
are the longest that repeats of at least WINDOW words cover.

*Scale.* Nothing is compared in pairs and no group is held in memory: a class is a run of
sorted rows of which only the first is remembered. What repeats within a batch is settled
there: of equal neighbourhoods or classes only the smallest document's goes on, and anchors
with several neighbourhoods are known to be open and are dealt out at random beside one
witness. So a passage in a third of all documents is a row a batch, not a row a document.
The texts are shuffled once; both joins read the same exchange. Words are compared by
64-bit hashes, neighbourhoods and classes by two independent ones.

Defined results: null text has no words; null doc_ids come first, as one id; rows with
equal doc_id and text are one document, rows with equal doc_id and different texts are
told apart by 28 bits of the text's hash, and neither is earlier than the other; words are
runs of bytes other than blanks and 09 to 0D, compared byte by byte, of any length; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shingles import _BYTE, _tables, mixed

WINDOW, SEED = 13, 5
ANCHOR_WINDOW = WINDOW - SEED + 1  # so many grams a window holds
SLICE_BYTES, BLOCK_STARTS = 1 << 20, 1 << 18
ALONE, REPEATED, WITNESS, SPAN = 0, 1, 2, 3
MARK_BITS, PLACE_BITS, COUNT_BITS, KIND_BITS = 28, 30, 4, 2
NO_ID = -(2**63)

_RNG = np.random.default_rng(1313)
_STEPS = _RNG.integers(0, 2**63, (3, WINDOW), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POINT = np.uint64(0xD1342543DE82EF95)
_SALT = np.uint64(0x2545F4914F6CDD1D)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def _point_powers(n: int) -> list[np.ndarray]:
    """Powers of the neighbourhoods' base and of its inverse, at least ``n``."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (int(_POINT), pow(int(_POINT), -1, 2**64)):
            p = np.full(max(n, 1 << 19), base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of ``raw`` and the byte where it starts, a block of bytes at a time."""
    hashes, starts, at, size = [], [], 0, SLICE_BYTES
    while at < len(raw):
        block = raw[at : at + size]
        gap = _GAP[block]
        if at + size < len(raw):
            last = int(gap[::-1].argmax())
            if not gap[len(gap) - 1 - last]:  # one word and no end of it
                size *= 2
                continue
            block, gap = block[: len(block) - last], gap[: len(gap) - last]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
        first, end = edges[::2], edges[1::2]
        powers, inverse = _tables(len(block) + 1)
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(_BYTE[block] * powers[: len(block)], out=sums[1:])
        hashes.append(mixed((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64)))
        starts.append(first + at)
        at, size = at + len(block), SLICE_BYTES
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _gram(words: np.ndarray, at: np.ndarray | slice, width: int, steps: np.ndarray) -> np.ndarray:
    """A hash of the ``width`` words from each position on."""
    total = np.uint64(width) + words[at] * steps[0]
    for k in range(1, width):
        total += words[slice(at.start + k, at.stop + k) if isinstance(at, slice) else at + k] * steps[k]
    return mixed(total)


def _neighbourhoods(words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (key, context, first window, number of windows): every anchor of texts that end at ``ends``."""
    starts = len(words) - WINDOW + 1
    for lo in range(0, max(starts, 0), BLOCK_STARTS):
        n = min(BLOCK_STARTS, starts - lo)
        grams = _gram(words, slice(lo, lo + n + ANCHOR_WINDOW - 1), SEED, _STEPS[0])
        least, anchor = grams[:n].copy(), np.arange(n)
        for k in range(1, ANCHOR_WINDOW):
            smaller = grams[k : k + n] < least
            np.copyto(least, grams[k : k + n], where=smaller)
            anchor[smaller] = np.flatnonzero(smaller) + k
        window = np.arange(lo, lo + n)
        inside = window + WINDOW <= ends[np.searchsorted(ends, window, side="right")]
        window, anchor, least = window[inside], anchor[inside], least[inside]
        if not len(window):
            continue
        head = np.flatnonzero(np.append(True, (np.diff(anchor) != 0) | (np.diff(window) != 1)))
        count = np.diff(np.append(head, len(window)))
        first, key = window[head], least[head]
        end = first + count - 1 + WINDOW
        part = words[lo : lo + n + WINDOW - 1]
        powers, inverse = _point_powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers[: len(part)], out=sums[1:])
        before = (anchor[head] + lo - first).astype(np.uint64)
        context = mixed((sums[end - lo] - sums[first - lo]) * inverse[first - lo] + before * _STEPS[1][0] + count.astype(np.uint64) * _STEPS[1][1])
        yield key, context, first, count


def _slices(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, word hashes, where each text's words end) of texts of about SLICE_BYTES in all."""
    lo = size = 0
    for i, t in enumerate(texts, start=1):
        size += len(t) + 1
        if size >= SLICE_BYTES or i == len(texts):
            raw = np.frombuffer(b" ".join(texts[lo:i]), np.uint8)
            hashes, starts = word_hashes(raw)
            yield lo, hashes, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts[lo:i]]))
            lo, size = i, 0


def _texts(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for n in names]


def _merged(did: np.ndarray, m: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Spans of the same text that touch or overlap, made one."""
    if not len(did):
        return [did, m, begin, end]
    order = np.lexsort((begin, m, did))
    did, m, begin, end = did[order], m[order], begin[order], end[order]
    text = np.cumsum(np.append(0, (np.diff(did) != 0) | (np.diff(m) != 0)))
    apart = int(end.max()) + 2
    upto = np.maximum.accumulate(end + text * apart)
    new = np.append(True, begin[1:] + text[1:] * apart > upto[:-1])
    return [did[new], m[new], begin[new], np.maximum.reduceat(end, np.flatnonzero(new))]


def _first_in_run(keys: list[np.ndarray], did: np.ndarray) -> np.ndarray:
    """For rows sorted by ``keys`` and ``did``: the number of the first row with the same keys."""
    new = np.append(True, np.any([np.diff(k) != 0 for k in keys], axis=0))
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _diverse(key: np.ndarray, context: np.ndarray) -> np.ndarray:
    """For rows sorted by key and context: whether the row's key has several contexts."""
    new = np.append(True, np.diff(key) != 0)
    other = ~new & np.append(False, np.diff(context) != 0)
    return np.logical_or.reduceat(other, np.flatnonzero(new))[np.cumsum(new) - 1]


def _packed(m: np.ndarray, place: np.ndarray, count: np.ndarray, kind: np.ndarray) -> np.ndarray:
    parts = [(m, PLACE_BITS + COUNT_BITS + KIND_BITS), (place, COUNT_BITS + KIND_BITS), (count, KIND_BITS), (kind, 0)]
    return sum((x.astype(np.uint64) << np.uint64(by)) for x, by in parts).view(np.int64)


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    u = packed.view(np.uint64)

    def part(by: int, bits: int) -> np.ndarray:
        return ((u >> np.uint64(by)) & np.uint64((1 << bits) - 1)).astype(np.int64)

    return part(PLACE_BITS + COUNT_BITS + KIND_BITS, MARK_BITS), part(COUNT_BITS + KIND_BITS, PLACE_BITS), part(KIND_BITS, COUNT_BITS), part(0, KIND_BITS)


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, context, did, packed (m, first window, windows, kind) of the anchors of (did, m, text); a SPAN holds begin and end as key and context."""
    for batch in batches:
        dids, marks = _numbers(batch, "did", "m")
        found = []
        for lo, words, ends in _slices(_texts(batch.column("text"))):
            begins = np.concatenate([[0], ends])
            for key, context, first, count in _neighbourhoods(words, ends):
                row = np.searchsorted(ends, first, side="right")
                found.append((key.view(np.int64), context.view(np.int64), dids[row + lo], marks[row + lo], first - begins[row], count))
        if not found:
            continue
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        found.clear()
        key, context, did, m, place, count = (c[np.lexsort((columns[2], columns[1], columns[0]))] for c in columns)
        later = did > did[_first_in_run([key, context], did)]
        spans = _merged(did[later], m[later], place[later], place[later] + count[later] - 1 + WINDOW)
        key, context, did, m, place, count = (c[~later] for c in (key, context, did, m, place, count))
        many = _diverse(key, context)
        witnesses = np.unique(key[many])
        zeros, none = np.zeros_like(spans[0]), np.zeros_like(witnesses)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([key, witnesses, spans[2]])),
                pa.array(np.concatenate([context, none, spans[3]])),
                pa.array(np.concatenate([did, none, spans[0]])),
                pa.array(np.concatenate([_packed(m, place, count, np.where(many, REPEATED, ALONE)), np.full_like(witnesses, WITNESS), _packed(spans[1], zeros, zeros, np.full_like(zeros, SPAN))])),
            ],
            names=["key", "context", "did", "packed"],
        )


def _settled(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Of whole runs of a key: what an earlier document covers, and a row for each neighbourhood of a key that has several."""
    key, context, did, packed = rows
    m, place, count, kind = _unpacked(packed)
    several, alone = _diverse(key, context), kind == ALONE
    seen = np.append(True, np.diff(key) != 0)
    several |= np.logical_or.reduceat(~alone, np.flatnonzero(seen))[np.cumsum(seen) - 1]
    key, context, did, packed, m, place, count, several = (c[alone] for c in (key, context, did, packed, m, place, count, several))
    if not len(key):
        return [key, context, did, packed]
    later = did > did[_first_in_run([key, context], did)]
    spans, on = _merged(did[later], m[later], place[later], place[later] + count[later] - 1 + WINDOW), several & ~later
    zeros = np.zeros_like(spans[0])
    new = [spans[2], spans[3], spans[0], _packed(spans[1], zeros, zeros, np.full_like(zeros, SPAN))]
    return [np.concatenate([c[on], x]) for c, x in zip((key, context, did, packed), new, strict=True)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, context and did: spans, what was dealt out at random, and ``_settled`` runs.

    The rows of a key that is not dealt out are at most a few a batch of documents.
    """
    names = ["key", "context", "did", "packed"]
    held: list[list[np.ndarray]] = []

    def made(rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=names)

    for batch in batches:
        rows = _numbers(batch, *names)
        kind = rows[3] & ((1 << KIND_BITS) - 1)
        dealt = (kind == REPEATED) | (kind == SPAN)
        yield made([c[dealt] for c in rows])
        rows = [c[~dealt] for c in rows]
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last run may go on
        if cut or (held and held[0][0][0] != rows[0][0]):
            whole = [np.concatenate(c) for c in zip(*held, [c[:cut] for c in rows], strict=True)]
            yield made(_settled(whole))
            held = []
        held.append([c[cut:] for c in rows])
    if held:
        yield made(_settled([np.concatenate(c) for c in zip(*held, strict=True)]))


_SPAN_NAMES = ["did", "m", "begin", "end"]


class _Runs:
    """The smallest did of each run of equal keys, over batches that arrive sorted by keys and did."""

    def __init__(self) -> None:
        self.last: tuple | None = None

    def smallest(self, keys: list[np.ndarray], did: np.ndarray) -> np.ndarray:
        first = _first_in_run(keys, did)
        least = did[first]
        if self.last is not None and self.last[0] == tuple(int(k[0]) for k in keys):
            least[first == 0] = self.last[1]
        self.last = (tuple(int(k[-1]) for k in keys), int(least[-1]))
        return least


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """did, m, begin, end: a span where an earlier document has the whole neighbourhood, else its windows (end: minus their number)."""
    runs = _Runs()
    for batch in batches:
        if not batch.num_rows:
            continue
        key, context, did, packed = _numbers(batch, "key", "context", "did", "packed")
        m, place, count, kind = _unpacked(packed)
        span = kind == SPAN
        least = runs.smallest([key, context], did)
        covered = ~span & (did > least)
        merged = _merged(did[covered], m[covered], place[covered], place[covered] + count[covered] - 1 + WINDOW)
        open_ = ~span & ~covered
        parts = ([did[span], m[span], key[span], context[span]], merged, [did[open_], m[open_], place[open_], -count[open_]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=_SPAN_NAMES)


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, did, m, begin, end: the windows of (did, m, text, begins, ends) as classes (end: -1), and the spans that are known."""
    for batch in batches:
        dids, marks = _numbers(batch, "did", "m")
        sizes = np.diff(batch.column("begins").offsets.to_numpy())
        wanted = [batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("begins", "ends")]
        row = np.repeat(np.arange(batch.num_rows), sizes)
        known = wanted[1] >= 0
        spans = [[dids[row[known]], marks[row[known]], wanted[0][known], wanted[1][known]]]
        row, begin, count = row[~known], wanted[0][~known], -wanted[1][~known]
        found = []
        for lo, words, ends in _slices(_texts(batch.column("text"))):
            begins = np.concatenate([[0], ends])
            own = (row >= lo) & (row < lo + len(ends))
            window = np.repeat(begin[own], count[own]) + np.arange(count[own].sum()) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
            doc = np.repeat(row[own], count[own])
            at = window + begins[doc - lo]
            inside = at + WINDOW <= ends[doc - lo]  # of two texts with one handle only one has it
            doc, window, at = doc[inside], window[inside], at[inside]
            found.append((_gram(words, at, WINDOW, _STEPS[1]).view(np.int64), _gram(words, at, WINDOW, _STEPS[2]).view(np.int64), dids[doc], marks[doc], window))
        if found:
            columns = [np.concatenate(x) for x in zip(*found, strict=True)]
            a, b, did, m, window = (c[np.lexsort((columns[2], columns[1], columns[0]))] for c in columns)
        if not found or not len(a):
            a = b = did = m = window = np.zeros(0, np.int64)
        else:
            later = did > did[_first_in_run([a, b], did)]
            spans.append([did[later], m[later], window[later], window[later] + WINDOW])
            a, b, did, m, window = (c[~later] for c in (a, b, did, m, window))
        spans = _merged(*(np.concatenate(x) for x in zip(*spans, strict=True)))
        spread = spans[0] * _SALT.view(np.int64) ^ spans[2]
        columns = ([a, spread], [b, spread], [did, spans[0]], [m, spans[1]], [window, spans[2]], [np.full_like(window, -1), spans[3]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["a", "b", *_SPAN_NAMES])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """did, m, begin, end of what an earlier document covers; rows arrive sorted by class and did."""
    runs = _Runs()
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, did, m, begin, end = _numbers(batch, "a", "b", *_SPAN_NAMES)
        known = end >= 0
        least = runs.smallest([a, b, known], did)
        hit = known | (did > least)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(did[hit], m[hit], begin[hit], np.where(known, end, begin + WINDOW)[hit])], names=_SPAN_NAMES)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept words and the removed runs of (did, text, begins, ends)."""
    run_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        size, kept, runs = [], [], []
        for text, begins, ends in zip(_texts(batch.column("text")), batch.column("begins").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            words = text.split()  # of bytes: at blanks and 09 to 0D, nothing else
            size.append(len(words))
            none = np.zeros(len(begins or ()), np.int64)
            merged = _merged(none, none, np.array(begins or (), np.int64), np.array(ends or (), np.int64))[2:]
            spans = list(zip(*(x.tolist() for x in merged), strict=True))
            edges = [0, *(e for s in spans for e in s), len(words)]
            kept.append(b" ".join(w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in words[x:y]) if spans else b" ".join(words))
            runs.append([{"begin": x, "end": y} for x, y in spans])
        yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(runs, run_type)], names=["doc_id", "n_words", "kept", "removed"])


def _gathered(spans: DataFrame) -> DataFrame:
    """The spans of each text, as two arrays."""
    listed = spans.groupBy("did", "m").agg(F.collect_list(F.struct("begin", "end")).alias("s"))
    return listed.select("did", "m", F.col("s.begin").alias("begins"), F.col("s.end").alias("ends"))


def _dealt(rows: DataFrame, place: Column | list[str], *order: str) -> DataFrame:
    return rows.repartition(*(place if isinstance(place, list) else [place])).sortWithinPartitions(*order)


def remove_repeats(docs: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """doc_id, n_words, kept (binary: words joined by one blank) and removed (array of word spans) for every row of ``docs``."""
    mark = F.xxhash64("text").bitwiseAND((1 << MARK_BITS) - 1)
    keyed = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(NO_ID)).alias("did"), mark.alias("m"), F.col("text"))
    anchors = keyed.mapInArrow(_find_anchors, "key long, context long, did long, packed long")
    kind = F.col("packed").bitwiseAND((1 << KIND_BITS) - 1)
    by_seed = _dealt(anchors, F.when(kind.isin(ALONE, WITNESS), F.col("key")).otherwise(F.xxhash64("did", "key")), "key", "context", "did")
    shared = by_seed.mapInArrow(_shared, anchors.schema)
    neighbourhoods = _dealt(shared, ["key", "context"], "key", "context", "did")
    reached = neighbourhoods.mapInArrow(_agreeing, "did long, m long, begin long, end long")
    met = keyed.join(_gathered(reached), ["did", "m"])
    classes = met.mapInArrow(_extended, "a long, b long, did long, m long, begin long, end long")
    covered = _dealt(classes, ["a", "b"], "a", "b", "did").mapInArrow(_repeated, "did long, m long, begin long, end long")
    out = keyed.join(_gathered(covered), ["did", "m"], "left").select("did", "text", "begins", "ends")
    stripped = out.mapInArrow(_strip, "doc_id long, n_words long, kept binary, removed array<struct<begin:long,end:long>>")
    return stripped.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def query(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, p, array_to_string(w[p:p+12], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS p FROM d)),
f AS (SELECT g, min(doc_id) AS first FROM k GROUP BY g HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT doc_id, list(DISTINCT q) AS gone
      FROM (SELECT k.doc_id, unnest(range(p, p + 13)) AS q FROM k JOIN f USING (g) WHERE k.doc_id > f.first) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w
    ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""
