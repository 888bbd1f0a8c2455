"""Whitening, vector codes and substring dedup against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import substring_dedup, vector_codes, vectors, whitening
from tests.llm.conftest import prose

VECTORS = "vec_id long, embedding array<float>, label int, x int, v string, component int, label_error string, of int"


def frame(spark, rows):
    """Rows (vec_id, embedding, label) beside columns that the operators use inside."""
    return spark.createDataFrame([(i, e, k, 1, "v", 2, "e", 3) for i, e, k in rows], VECTORS)


def odd_vectors(n=150, dim=48, seed=5):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in r.normal(0, 0.3, dim)], i % 4 if i % 5 else None) for i in range(n)]
    common = [0.25] * dim
    rows += [(n + i, common, 1) for i in range(n // 2)]  # a third of all rows are equal
    rows += [rows[3], rows[3], (None, rows[4][1], None), (7, rows[8][1], 2)]
    rows += [(900, None, 1), (901, [None, *[0.0] * (dim - 1)], 1), (902, [math.nan] * dim, 1), (903, [math.inf] * dim, 1), (904, [0.5] * (dim - 1), 1), (905, [], 1)]
    return rows


def usable(rows, scale, offset, dim=48):
    return [(i, [math.floor(scale * float(np.float32(x))) + offset for x in e], k) for i, e, k in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]


# --- whitening ------------------------------------------------------------------------


def brute_whitening(rows, components=16):
    kept = usable(rows, 64, 1_000_000)
    fit = np.array(sorted({tuple(x) for _, x, _ in kept}), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums).astype(float) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1][:, :components]
    x = np.array([x for _, x, _ in kept], object)
    whitened = ((x * n - sums).astype(float) / n) @ directions / np.sqrt(values[:components])
    return [i for i, _, _ in kept], n, ((x * n - sums) ** 2).sum(axis=1), whitened, values[:components] / values.sum()


def test_whitening_matches_brute_force(spark):
    rows = odd_vectors()
    done = whitening.whiten(frame(spark, rows).repartition(7)).collect()
    ids, n, deviation, whitened, explained = brute_whitening(rows)
    assert len(done) == 16 * len(ids)
    found = {}
    for r in done:
        found.setdefault((r.vec_id is not None, r.vec_id or 0, r.deviation), {}).setdefault(r.component, []).append(r)
    signs = None
    for i, d, w in zip(ids, deviation, whitened, strict=True):
        got = found[(i is not None, i or 0, d)]
        assert sorted(got) == list(range(1, 17))
        values = np.array([got[c][0].whitened for c in range(1, 17)])
        signs = np.sign(values * w) if signs is None else signs
        assert np.allclose(values, signs * w, atol=1e-9)
        assert all(r.n == n and abs(r.explained - explained[c - 1]) < 1e-12 and r.identity_error < 1e-9 for c, rs in got.items() for r in rs)


def test_whitening_where_directions_are_missing(spark):
    one = [(i, [0.5, 0.25, 0.125], None) for i in range(5)]
    assert whitening.whiten(frame(spark, one)).collect() == []
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [], None), (2, None, 1)])).collect() == []
    line = [(i, [float(i), 2.0 * i, 7.0], None) for i in range(5)]  # one direction, a constant dimension
    done = whitening.whiten(frame(spark, line)).collect()
    assert {r.component for r in done} == {1} and len(done) == 5
    assert all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-9 for r in done)


def test_whitening_keeps_small_directions_apart(spark):
    """A covariance would square the ratio of 1e7 between the two directions."""
    r = np.random.default_rng(3)
    rows = [(i, [float(a * 2.0**26 + b), float(a * 2.0**26 - b)], None) for i, (a, b) in enumerate(zip(r.integers(-50, 50, 400), r.integers(-20, 20, 400)))]
    wide = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    done = whitening.whiten(wide).collect()
    assert {x.component for x in done} == {1, 2}
    assert all(x.identity_error < 1e-6 for x in done)


def test_deviation_beyond_64_bits_is_null():
    fit = whitening.Whitening(2**20, np.array([0, 0]), (0, 5), np.zeros((2, 0)), np.zeros(0), np.zeros(0))
    assert fit.deviations(np.array([[2**30, 1], [3, 1]])) == [None, (3 * 2**20) ** 2 + (2**20 - 5) ** 2]


def test_r_factors_merge_in_any_shape():
    rows = np.random.default_rng(1).normal(size=(500, 12))
    whole = rows.T @ rows
    parts = [whitening._upper(p) for p in np.array_split(rows, [3, 40, 41, 300])]
    while len(parts) > 1:
        parts = [whitening._upper(np.vstack(parts[i : i + 2])) for i in range(0, len(parts), 2)]
    assert np.allclose(parts[0].T @ parts[0], whole)


# --- vector codes ---------------------------------------------------------------------


def brute_codes(rows, dim=48):
    kept = usable(rows, 256, 0, dim)
    sub = dim // 16
    parts = [[tuple(x[p * sub : (p + 1) * sub]) for _, x, _ in kept] for p in range(16)]
    first = sorted({i for i, _, _ in kept}, key=lambda i: (i is None, i))[:64]
    starts = [min(x for i, x, _ in kept if i == f) for f in first]
    books = [[tuple(s[p * sub : (p + 1) * sub]) for s in starts] for p in range(16)]

    def best(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), n) for n, e in enumerate(book))

    for _ in range(2):
        for p in range(16):
            members = {}
            for v in parts[p]:
                members.setdefault(best(v, books[p])[1], []).append(v)
            books[p] = [tuple(sum(m[d] for m in members[n]) // len(members[n]) for d in range(sub)) if n in members else e for n, e in enumerate(books[p])]
    out = []
    for r, (i, _, label) in enumerate(kept):
        found = [best(parts[p][r], books[p]) for p in range(16)]
        out.append((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), label))
    by_label = {}
    for _, _, error, label in out:
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, code, error, by_label[label], digest) for i, code, error, label in out), key=repr)


@pytest.mark.parametrize("n", [150, 9])  # fewer ids than entries
def test_vector_codes_match_brute_force(spark, n):
    rows = odd_vectors(n)
    done = vector_codes.compress(frame(spark, rows).repartition(5))
    assert sorted(map(tuple, done.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr) == brute_codes(rows)


def test_vector_codes_with_many_labels(spark, monkeypatch):
    rows = [(i, e, None if k is None else k + i) for i, e, k in odd_vectors(60)[:60]]
    want = brute_codes(rows)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 3)
    done = vector_codes.compress(frame(spark, rows))
    assert sorted(map(tuple, done.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr) == want


def test_vector_codes_of_nothing_and_of_odd_dimensions(spark):
    assert vector_codes.compress(frame(spark, [])).collect() == []
    assert vector_codes.compress(frame(spark, [(1, None, 2), (2, [], 2)])).collect() == []
    done = vector_codes.compress(frame(spark, [(i, [0.1 * i] * 5, None) for i in range(4)])).collect()
    assert [(r.code, r.error, r.label_error) for r in sorted(done)] == [(f"0{i}" * 5 + "00" * 11, 0, 0) for i in range(4)]


def test_distances_accumulate_and_ties_go_to_the_smaller_entry():
    part = np.array([[0, 5, 2], [0, 5, 0]])  # (dimension, row)
    code, distance = vector_codes.nearest(part, np.array([[4, 0], [0, 0], [5, 5]]))
    assert code.tolist() == [1, 2, 0] and distance.tolist() == [0, 0, 4]


def test_the_commonest_dimension_is_kept(spark):
    kept, dim = vectors.integer_vectors(frame(spark, [(1, [1.0], 0), (2, [1.0, 2.0], 0), (3, [3.0], 0)]), 2, 1, 100, others=("vec_id",))
    assert dim == 1 and sorted(map(tuple, kept.collect())) == [(1, [3]), (3, [7])]


# --- substring dedup ------------------------------------------------------------------

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_substrings(rows):
    words = [WORD.findall((t or "").encode()) for _, t in rows]
    earliest = {}
    for (d, _), w in zip(rows, words, strict=True):
        for p in range(len(w) - 12):
            key = tuple(w[p : p + 13])
            earliest[key] = min(earliest.get(key, (True, math.inf)), (d is not None, d or 0))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {q for p in range(len(w) - 12) if earliest[tuple(w[p : p + 13])] < (d is not None, d or 0) for q in range(p, p + 13)}
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def stripped(docs):
    done = substring_dedup.remove_repeats(docs)
    return sorted(((r.doc_id, r.n_words, sum(s.end - s.begin for s in r.removed), bytes(r.kept)) for r in done.collect()), key=repr)


def test_substring_dedup_matches_brute_force(spark):
    r = random.Random(8)
    rows = []
    for i in range(120):  # few words, so windows repeat by chance, overlap and tie
        words = [r.choice("ab") for _ in range(r.randrange(60))] if i % 3 else [r.choice(["é", "ab", " ", "x y", "\x1c"]) for _ in range(r.randrange(40))]
        rows.append((r.randrange(90), r.choice([" ", "\n", "\t \x0b", "  "]).join(words)))
    passage = prose(40, 3).split()
    for i in range(60):
        cut = r.randrange(25)
        rows.append((200 + i, " ".join(prose(r.randrange(20), i).split() + passage[cut : cut + r.randrange(5, 30)] + prose(r.randrange(20), 99 - i).split())))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert stripped(docs) == brute_substrings(rows)


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_substring_dedup_of_a_passage_in_every_document(spark, batch):
    """One batch or many: what a batch settles itself is what the shuffles would find."""
    passage, rows = prose(50, 1), []
    for i in range(90):
        rows.append((i // 2 if i % 5 == 0 else i, f"{prose(i % 17, i)} {passage if i % 3 else passage[: 4 * i]} {prose(15, i // 4)}"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert stripped(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute_substrings(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_substring_dedup_over_blocks_and_long_words(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 64)
    monkeypatch.setattr(substring_dedup, "BLOCK_STARTS", 5)
    long_word = "w" * 1000
    rows = [(1, prose(80, 1)), (2, "a b " + prose(80, 1)), (3, " ".join([long_word] * 20)), (4, f" {long_word}" * 15), (5, "\n"), (6, prose(12, 1)), (7, prose(13, 1))]
    words, starts = substring_dedup.word_hashes(np.frombuffer(rows[2][1].encode(), np.uint8))
    assert len(words) == 20 and len(set(words.tolist())) == 1 and starts[1] == 1001
    done = list(substring_dedup._neighbourhoods(words, np.array([len(words)])))
    assert sum(int(c.sum()) for *_, c in done) == 8
    assert stripped(spark.createDataFrame(rows, "doc_id long, text string")) == brute_substrings(rows)


def test_substring_dedup_odd_rows(odd_documents, no_documents):
    assert stripped(odd_documents.withColumns({"m": F.lit(1), "did": F.lit("x"), "key": F.lit(2)})) == brute_substrings([(r.doc_id, r.text) for r in odd_documents.collect()])
    assert substring_dedup.remove_repeats(no_documents).collect() == []


def test_substring_dedup_reports_runs(spark):
    rows = [(1, " ".join(map(str, range(40)))), (2, "x " + " ".join(map(str, range(5, 25))) + " y " + " ".join(map(str, range(20, 40))))]
    done = {r.doc_id: [tuple(s) for s in r.removed] for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert done == {1: [], 2: [(1, 21), (22, 42)]}
