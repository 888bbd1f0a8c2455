"""Packing token sequences: first-fit decreasing with a tournament tree.

Documents are tokenised where they are read and cut into full sequences and a
remainder. Only the pieces' keys, lengths and checksums travel on; they are
checkpointed and counted, and dealt into randomised groups of about
``GROUP_PIECES`` (a hash, so the deal can be repeated),
and in each group the remainders, longest first, go to the first sequence with
room. A tournament tree over the bins' free space finds it in O(log bins): each
inner node holds the larger free space of its two children, and the search goes
left whenever the left child has room.

A group's work and memory are bounded by the group size whatever the corpus is;
no group depends on another. Token ids stay in the pieces' table and are joined
only if sequences are to be written (``assemble``).

Defined results: null text counts as empty and is a single piece that holds the
end id; every id lies in exactly one piece; rows with equal doc_id are packed
one by one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import release_memory, reliable_checkpoint

SEQUENCE = 1024
END_ID = 0
GROUP_PIECES = 16384
CACHE_WORDS, SLICE_BYTES = 500_000, 4 << 20
PIECE_COLUMNS = ["doc_id", "row_mark", "start", "length", "doc_tokens", "ids_crc32", "ids"]
#: A blank before white space, and what the tokenizer's pattern and this one may tell apart.
TOGETHER = r" [\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[\x1c-\x1f\x{85}]"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordEncoder:
    """Token ids of whole texts, each with the end id behind it.

    The byte-level pattern never joins text across a blank that stands before a
    non-blank, so such a text is the sum of its blank-led words and a distinct
    word is tokenised once: the new words of a batch together, told apart by the
    tokens that begin with a blank. Texts with a blank before white space go to
    the tokenizer whole. Arrow splits texts and numbers the distinct words; ids
    are gathered from a pool, so Python touches distinct words only. The pool is
    emptied beyond ``CACHE_WORDS`` words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.filled = np.array([END_ID] * 1024, "<u4"), 1  # unit 0 is the end id
        self.first, self.length = np.zeros(1024, np.int64), np.ones(1024, np.int64)
        self.units = 1

    def _grown(self, array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, len(array)), array.dtype)])

    def _keep(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """New units at the end of the pool: their ids, one after the other."""
        n, m = self.units + len(lengths), self.filled + len(ids)
        self.pool = self._grown(self.pool, m)
        self.first, self.length = self._grown(self.first, n), self._grown(self.length, n)
        self.pool[self.filled : m] = ids
        self.length[self.units : n] = lengths
        self.first[self.units : n] = self.filled + np.cumsum(lengths) - lengths
        self.units, self.filled = n, m

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of blank + word for words that are new; the empty word comes alone."""
        for lo in range(0, len(words), 4096):
            some = words[lo : lo + 4096]
            (ids,) = self._ids([" " + " ".join(some)])
            cuts = np.flatnonzero(self.leads[ids])
            if len(cuts) == len(some) and cuts[0] == 0:
                lengths = np.diff(cuts, append=len(ids))
            else:
                parts = self._ids([" " + word for word in some])
                ids, lengths = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
            self.known.update(zip(some, range(self.units, self.units + len(some)), strict=True))
            self._keep(ids, lengths)

    def _units_of(self, words: pa.Array) -> np.ndarray:
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in self.known]
        if "" in new:
            new.remove("")
            self._learn([""])
        self._learn(new)
        unit = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        return unit[coded.indices.to_numpy(zero_copy_only=False)] if len(distinct) else unit

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and how many each text has."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, TOGETHER)
        split = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        words = split.flatten()
        heads, is_head = offsets[:-1], np.zeros(len(words), bool)
        is_head[heads] = True
        units = np.zeros(len(words), np.int64)
        units[~is_head] = self._units_of(words.filter(pa.array(~is_head)))
        learned = self.units, self.filled
        starts = pc.if_else(whole, texts, words.take(pa.array(heads))).to_pylist()
        parts = self._ids(starts)
        units[heads] = self.units + np.arange(len(parts))
        self._keep(np.concatenate(parts) if parts else np.zeros(0, "<u4"), np.array([len(p) for p in parts], np.int64))
        units = np.insert(units, offsets[1:], 0)
        lengths = self.length[units]
        ends = np.cumsum(lengths)
        index = np.repeat(self.first[units] - ends + lengths, lengths)
        index += np.arange(len(index))
        ids = self.pool[index]
        self.units, self.filled = learned  # the texts' beginnings are not kept
        upto = ends[offsets[1:] + np.arange(len(texts))] if len(texts) else ends
        return ids, np.diff(upto, prepend=0)


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder a worker process: what it has learned serves the process's later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``SLICE_BYTES``; a longer text is a run of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
        yield lo, hi
        lo = hi


def tokenized_pieces(docs: DataFrame, *, path: str, doc: str = "doc_id", sequence: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """Pieces of at most ``sequence`` ids one after the other for each document, with their checksums and ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        for batch in batches:
            for lo, hi in _slices(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                ids, totals = encode(part.column(2))
                counts = -(-totals // sequence)
                row = np.repeat(np.arange(len(totals)), counts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * sequence
                length = np.minimum(totals[row] - start, sequence)
                edges = np.concatenate([[0], np.cumsum(length)]) * 4
                raw = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                columns = [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(totals[row]), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(raw[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=PIECE_COLUMNS[: len(columns)])
            release_memory()

    read = docs.select(F.col(doc).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_mark"), F.col("text"))
    return read.mapInArrow(cut, ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in PIECE_COLUMNS[: 6 + with_ids]))


class TournamentTree:
    """Free space of bins in order; ``place`` finds the first with room and takes from it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with ``size`` free, and how much was free in it."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        had = free[node]
        free[node] = had - size
        leaf = node - self.leaves
        while node > 1:
            node //= 2
            larger = max(free[2 * node], free[2 * node + 1])
            if free[node] == larger:
                break
            free[node] = larger
        return leaf, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; ties keep their order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths == capacity).sum())
    bins[order[:full]] = np.arange(full)
    tree = TournamentTree(max(1, len(lengths) - full), capacity)
    for i in order[full:].tolist():
        leaf, had = tree.place(int(lengths[i]))
        bins[i], offsets[i] = full + leaf, capacity - had
    return bins, offsets


def pack(pieces: DataFrame, *, n_groups: int, sequence: int = SEQUENCE, seed: int = 17) -> DataFrame:
    """``pieces`` (doc_id, row_mark, start, length, ...) with sequence_id and offset."""
    group = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "row_mark", "start"), F.lit(n_groups)).alias("_group")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long", "offset long"])

    def of_group(key, pdf):
        pdf = pdf.sort_values(["doc_id", "row_mark", "start"], ignore_index=True).drop(columns="_group")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), sequence)
        return pdf.assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)

    return pieces.select("*", group).groupBy("_group").applyInPandas(of_group, schema)


def group_count(pieces: DataFrame) -> int:
    return max(1, round(pieces.count() / GROUP_PIECES))


def assemble(packed: DataFrame, pieces: DataFrame, *, sequence: int = SEQUENCE) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens and ids, padded unless the length is a power of two."""
    joined = packed.select("doc_id", "row_mark", "start", "sequence_id", "offset").join(pieces, ["doc_id", "row_mark", "start"])
    parts = joined.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def joined_ids(parts: pd.Series, n_tokens: pd.Series) -> pd.Series:
        pad = lambda n: 0 if n & (n - 1) == 0 else sequence - n
        return pd.Series([b"".join(p["ids"] for p in own) + bytes(4 * pad(int(n))) for own, n in zip(parts, n_tokens, strict=True)])

    return parts.select("sequence_id", "n_tokens", F.pandas_udf(joined_ids, "binary")("parts", "n_tokens").alias("ids"))


def packed_documents(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    pieces = reliable_checkpoint(tokenized_pieces(docs, path=path or tokenizer_path(), with_ids=False))
    return pack(pieces, n_groups=group_count(pieces)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    return packed_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
