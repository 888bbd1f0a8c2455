"""Suffix-array dedup: maximal repeats from the interval tree of a sparse enhanced suffix array.

A byte is removed if a string of ``LENGTH`` bytes covers it that also starts
earlier (smaller doc_id, or earlier in the document). Matches never cross
documents; strings are judged on the input.

*Suffixes.* Only suffixes at synchronising positions are sorted: in each window
of LENGTH bytes the position of the ``SEED``-byte string with the smallest hash
(ties to the left). Equal windows choose equal positions, so two occurrences of
a repeated string always have suffixes in common, and every repeat shows as a
common prefix of sorted suffixes together with a common extension to the left.

*Array.* Suffixes are dealt by the hash of their first SEED bytes; those whose
seed occurs once in the corpus are dropped. In each partition they are sorted,
neighbours' common prefixes computed, and a stack scan of these yields the
common-prefix intervals, the nodes of the interval tree. In each node the left
extensions are tested for diversity: they are sorted too, and every maximal
class that agrees to the left makes a maximal repeat with all its occurrences.
Each occurrence but the first of its class is covered from its left extension to
the end of the common prefix.

*Scale.* Equal texts have equal suffixes throughout; the array keeps those of the
first such document, and each later one is a single repeat from end to end. Of
equal neighbourhoods within a batch the first becomes a leaf; the later ones are
repeats as far as the neighbourhood reaches, and leave the array as merged spans.
Equal seeds of a batch are counted before they are shuffled. So the inside of a
passage in a third of all documents is a row a batch and not a row a document; its
two ends, whose neighbourhoods differ, remain a row a document.
A partition is worked off in chunks of whole seeds. Texts are shuffled once
(both joins use the same exchange); what a document gathers, its positions and
spans, is bounded by its own length.

Defined results: null text counts as empty; documents of fewer than LENGTH bytes
lose nothing; null doc_ids come first; rows with equal doc_id and text are one
document, those with equal doc_id and different texts are ordered by a hash of
the text; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import hash128

LENGTH, SEED = 100, 24
REACH = LENGTH - SEED  # how far left of a synchronising position its windows start
CONTEXT = REACH + LENGTH
SLICE_BYTES, CHUNK_ROWS = 1 << 20, 150_000
LEFT_PAD, RIGHT_PAD = 0xFF, 0xFE  # bytes that UTF-8 never uses
ALONE, REPEATED, WITNESS = 0, 1, 2
MARK_BITS = 30  # of a text's hash, in a shuffled key: a handle only, texts are told apart by the whole hash
NO_ID = -(2**63)

_RNG = np.random.default_rng(77)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 17))
        _tables[:] = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _tables.append(np.cumprod(p, dtype=np.uint64))
    return _tables


def _seed_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the SEED bytes from each position on."""
    powers, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers[: len(raw)], out=sums[1:])
    h = (sums[SEED:] - sums[:-SEED]) * inverse[: len(raw) - SEED + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def synchronising_positions(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``raw`` (texts one after the other, ending at ``ends``) and their seeds' hashes."""
    if len(raw) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = _seed_hashes(raw)
    low = np.uint64(max(1, int(len(raw)).bit_length()))
    keys = (hashes >> low << low) | np.arange(len(hashes), dtype=np.uint64)
    chosen = (_sliding_least(keys, REACH + 1) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    starts = np.arange(len(chosen))
    chosen = chosen[starts + LENGTH <= ends[np.searchsorted(ends, starts, side="right")]]
    chosen = np.unique(chosen)
    return chosen, hashes[chosen]


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_BYTES:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _texts(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _find_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, did, packed (m, position, kind) of the synchronising positions of (did, m, text)."""
    for batch in batches:
        dids, marks = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        texts = _texts(batch.column(2))
        keys, rows, places = [], [], []
        for lo, hi in _slices(texts):
            ends = np.cumsum([len(t) for t in texts[lo:hi]])
            at, seeds = synchronising_positions(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), ends)
            row = np.searchsorted(ends, at, side="right")
            keys.append(seeds)
            rows.append(row + lo)
            places.append(at - np.concatenate([[0], ends])[row])
        if not keys:
            continue
        key, row, place = np.concatenate(keys).view(np.int64), np.concatenate(rows), np.concatenate(places)
        same, index, count = np.unique(key, return_inverse=True, return_counts=True)
        many = count[index] > 1
        packed = (marks[row] << 33) | (place << 2) | np.where(many, REPEATED, ALONE)
        spread = (dids[row] * np.int64(0x2545F4914F6CDD1D)) ^ place  # known to be repeated: any partition will do
        witnesses = same[count > 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.where(many, spread, key), witnesses])), pa.array(np.concatenate([dids[row], np.zeros_like(witnesses)])), pa.array(np.concatenate([packed, np.full_like(witnesses, WITNESS)]))],
            names=["key", "did", "packed"],
        )


def _room(context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes of text each context has before and from its position on."""
    left, right = context[:, REACH - 1 :: -1] != LEFT_PAD, context[:, REACH:] != RIGHT_PAD
    return np.where(left.all(axis=1), REACH, left.argmin(axis=1)), np.where(right.all(axis=1), LENGTH, right.argmin(axis=1))


def _merged(did: np.ndarray, mark: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of the same text that touch or overlap, made one."""
    if not len(did):
        return did, mark, begin, end
    order = np.lexsort((begin, mark, did))
    did, mark, begin, end = did[order], mark[order], begin[order], end[order]
    text = np.cumsum(np.append(0, (did[1:] != did[:-1]) | (mark[1:] != mark[:-1])))
    apart = int(end.max()) + 2
    upto = np.maximum.accumulate(end + text * apart)
    new = np.append(True, begin[1:] + text[1:] * apart > upto[:-1])
    starts = np.flatnonzero(new)
    return did[new], mark[new], begin[new], np.maximum.reduceat(end, starts)


def _neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted positions of (did, mark, text, places, copies), but for copies: marks to leave out.

    A row is a position (key, context, did, mark, begin), or, without a context, a covered span: of equal
    contexts in a batch only the first goes on, the later ones are covered as far as the context reaches.
    """
    offsets = np.arange(-REACH, LENGTH)
    for batch in batches:
        dids, marks = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        texts, places = _texts(batch.column(2)), batch.column(3).to_pylist()
        leaves: dict[bytes, int] = {}
        found: list[tuple[np.ndarray, int, int, np.ndarray]] = []
        for did, mark, text, wanted, copies in zip(dids.tolist(), marks.tolist(), texts, places, batch.column(4).to_pylist(), strict=True):
            if copies and mark in copies:
                continue
            raw = np.frombuffer(text, np.uint8)
            at = np.unique(np.asarray(wanted, np.int64))
            at = at[at < len(raw)]
            for lo in range(0, len(at), 4096):
                some = at[lo : lo + 4096]
                index = some[:, None] + offsets
                context = raw[np.clip(index, 0, len(raw) - 1)]
                context[index < 0] = LEFT_PAD
                context[index >= len(raw)] = RIGHT_PAD
                blob = context.tobytes()
                own = [leaves.setdefault(blob[i * CONTEXT : (i + 1) * CONTEXT], len(leaves)) for i in range(len(some))]
                found.append((np.array(own, np.int64), did, mark, some))
        if not found:
            continue
        leaf, at = (np.concatenate([f[i] for f in found]) for i in (0, 3))
        did, mark = (np.repeat([f[i] for f in found], [len(f[0]) for f in found]) for i in (1, 2))
        matrix = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, CONTEXT)
        order = np.lexsort((at, mark, did, leaf))
        first = order[np.append(True, np.diff(leaf[order]) != 0)]  # by leaf
        head = first[leaf]
        later = (did != did[head]) | (mark != mark[head]) | (at != at[head])
        before, after = _room(matrix)
        later &= (before + after >= LENGTH)[leaf]
        span_did, span_mark, begin, end = _merged(did[later], mark[later], at[later] - before[leaf[later]], at[later] + after[leaf[later]])
        key = np.zeros(len(leaves), np.uint64)
        for k in range(SEED):
            key = (key ^ _BYTE[matrix[:, REACH + k]]) * np.uint64(_BASE)
        spread = (span_did * np.int64(0x2545F4914F6CDD1D)) ^ begin
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([key.view(np.int64), spread])),
                pa.array([*leaves, *[None] * len(spread)], pa.binary()),
                *(pa.array(np.concatenate([own[first], spans])) for own, spans in ((did, span_did), (mark, span_mark), (at, begin))),
                pa.array(np.concatenate([np.full(len(first), -1, np.int64), end])),
            ],
            names=["key", "context", "did", "mark", "begin", "end"],
        )


def _sorted_rows(matrix: np.ndarray) -> np.ndarray:
    rows = np.ascontiguousarray(matrix)
    return np.argsort(rows.view(np.dtype((np.void, rows.shape[1]))).ravel(), kind="stable")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes the rows of two matrices have in common."""
    different = a != b
    first = different.argmax(axis=1)
    return np.where(different.any(axis=1), first, a.shape[1])


def _nearest_earlier(common: list[int], rank: list[int], best: list[int], order: range) -> None:
    """For each row the longest extension shared with an earlier row before it in ``order``."""
    stack: list[tuple[int, int]] = []
    previous = None
    for i in order:
        shared = common[max(i, previous)] if previous is not None else 0
        previous = i
        while stack and stack[-1][0] >= rank[i]:
            shared = min(shared, stack.pop()[1])
        if stack:
            best[i] = max(best[i], shared)
        stack.append((rank[i], shared))


def covered_by_repeats(keys: np.ndarray, context: np.ndarray, did: np.ndarray, mark: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves (by number) and the byte spans that maximal repeats cover in them.

    A leaf has a seed key and a context; it is position ``at`` of the text that ``did`` and ``mark`` name.
    """
    left, right = context[:, REACH - 1 :: -1] if REACH else context[:, :0], context[:, REACH:]
    has_left, has_right = _room(context)
    by_place = np.lexsort((at, mark, did))
    new = np.append(True, np.any([x[by_place][1:] != x[by_place][:-1] for x in (did, mark, at)], axis=0))
    rank = np.empty(len(did), np.int64)
    rank[by_place] = np.cumsum(new)

    with_key = np.concatenate([keys.astype(">i8").view(np.uint8).reshape(-1, 8), right], axis=1)
    array = _sorted_rows(with_key)
    a, b = array[1:], array[:-1]
    lcp = np.where(keys[a] == keys[b], np.minimum(_agreement(right[a], right[b]), np.minimum(has_right[a], has_right[b])), 0)
    lcs = np.minimum(_agreement(left[a], left[b]), np.minimum(has_left[a], has_left[b]))
    left_rank = np.empty(len(keys), np.int64)
    left_rank[_sorted_rows(left)] = np.arange(len(keys))

    found: list[tuple[int, int, int]] = []
    rank_l, lcp_l, lcs_l, array_l = rank.tolist(), lcp.tolist(), lcs.tolist(), array.tolist()

    def node(common: int, outer: int, lo: int, hi: int) -> None:
        """The suffixes lo..hi of the array share ``common`` bytes, and no more than ``outer`` with their neighbours."""
        least, most = max(0, LENGTH - common), min(REACH, LENGTH - 1 - outer)
        if least > most:
            return
        if hi - lo == 1:
            x, y = array_l[lo], array_l[hi]
            if rank_l[x] != rank_l[y]:
                shared = min(lcs_l[lo], most)
                if shared >= least:
                    found.append((x if rank_l[x] > rank_l[y] else y, shared, least))
            return
        own = array[lo : hi + 1]
        own = own[np.argsort(left_rank[own])]
        rows = left[own]
        common_left = np.minimum(_agreement(rows[1:], rows[:-1]), np.minimum(has_left[own[1:]], has_left[own[:-1]]))
        shared_left, ranks = [0, *common_left.tolist()], rank[own].tolist()
        best = [-1] * len(ranks)
        _nearest_earlier(shared_left, ranks, best, range(len(ranks)))
        _nearest_earlier(shared_left, ranks, best, range(len(ranks) - 1, -1, -1))
        for leaf, shared in zip(own.tolist(), best, strict=True):
            if shared >= least:
                found.append((leaf, min(shared, most), least))

    stack: list[tuple[int, int]] = [(0, 0)]
    for i, common in enumerate([*lcp_l, 0], start=1):
        lo = i - 1
        while stack[-1][0] > common:
            deep, lo = stack.pop()
            node(deep, max(common, stack[-1][0]), lo, i - 1)
        if common > stack[-1][0]:
            stack.append((common, lo))

    leaf, shared, least = np.array(found, np.int64).reshape(-1, 3).T
    return leaf, at[leaf] - shared, at[leaf] - least + LENGTH


def _scan_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """did, mark, begin, end of what repeats cover; rows arrive sorted by key."""

    names = ["did", "mark", "begin", "end"]

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        table = table.combine_chunks()
        is_span = table.column("context").is_null()
        for part in table.filter(is_span).select(names).to_batches():
            yield part
        table = table.filter(pc.invert(is_span))
        if not table.num_rows:
            return
        keys, did, mark, at = (table.column(c).to_numpy() for c in ("key", "did", "mark", "begin"))
        context = np.frombuffer(b"".join(table.column("context").to_pylist()), np.uint8).reshape(-1, CONTEXT)
        hit, begin, end = covered_by_repeats(keys, context, did, mark, at)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(did[hit], mark[hit], begin, end)], names=names)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK_ROWS:
            table = pa.Table.from_batches(held)
            cut = int(np.searchsorted(table.column(0).to_numpy(), table.column(0)[-1].as_py()))  # the last seed may go on
            yield from work(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    if held:
        yield from work(pa.Table.from_batches(held))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept bytes and the maximal removed runs of (doc_id, text, spans, mark)."""
    span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts, kept, runs = _texts(batch.column(1)), [], []
        for text, spans, mark in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            merged: list[list[int]] = []
            for s in sorted((x["begin"], x["end"]) for x in spans or () if x["mark"] == mark):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            edges = [0, *(e for run in merged for e in run), len(text)]
            kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            runs.append([{"begin": x, "end": y} for x, y in merged])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(kept, pa.binary()), pa.array(runs, span_type)], names=["doc_id", "n_bytes", "kept", "removed"])


def _later_copies(keyed: DataFrame) -> DataFrame:
    """d, m and end of the texts that a smaller document repeats as a whole: each is one repeat from end to end."""
    texts = keyed.select("did", "mark", F.octet_length("text").cast("long").alias("end"), *(h.alias(n) for h, n in zip(hash128(F.col("text")), ("h1", "h2"), strict=True))).filter(F.col("end") >= LENGTH)
    place = F.struct("did", "mark")
    several = texts.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").drop("last")
    return texts.join(several, ["h1", "h2"]).filter(place != F.col("first")).select(F.col("did").alias("d"), F.col("mark").alias("m"), "end").distinct()


def remove_repeats(docs: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, kept (binary) and removed (array of byte spans) for every row of ``docs``."""
    read = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("mark"), F.col("text"))
    handle_of = lambda mark: F.col(mark).bitwiseAND((1 << MARK_BITS) - 1)
    keyed = read.withColumn("m", handle_of("mark"))
    seeds = keyed.select("did", "m", "text").mapInArrow(_find_seeds, "key long, did long, packed long")
    counted = seeds.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    kind = F.col("packed").bitwiseAND(3)
    wanted = counted.filter((kind == REPEATED) | ((kind == ALONE) & (F.col("n") > 1)))
    unpacked = wanted.select(F.col("did").alias("d"), F.shiftright("packed", 33).alias("h"), F.shiftright("packed", 2).bitwiseAND(0x7FFFFFFF).alias("place"))
    copies = _later_copies(read)
    left_out = copies.groupBy("d", handle_of("m").alias("h")).agg(F.collect_set("m").alias("copies"))
    places = unpacked.groupBy("d", "h").agg(F.collect_list("place").alias("places")).join(left_out, ["d", "h"], "left")
    same = (F.col("did") == F.col("d")) & (F.col("m") == F.col("h"))
    met = keyed.join(places, same).select("did", "mark", "text", "places", "copies")
    leaves = met.mapInArrow(_neighbourhoods, "key long, context binary, did long, mark long, begin long, end long")
    covered = leaves.repartition("key").sortWithinPartitions("key").mapInArrow(_scan_array, "did long, mark long, begin long, end long")
    covered = covered.unionByName(copies.select(F.col("d").alias("did"), F.col("m").alias("mark"), F.lit(0).cast("long").alias("begin"), "end"))
    spans = covered.groupBy(F.col("did").alias("d"), handle_of("mark").alias("h")).agg(F.collect_list(F.struct("mark", "begin", "end")).alias("spans"))
    out = keyed.join(spans, same, "left").select("did", "text", "spans", "mark")
    stripped = out.mapInArrow(_strip, "doc_id long, n_bytes long, kept binary, removed array<struct<begin:long,end:long>>")
    return stripped.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def query(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

