"""Line dedup, suffix-array dedup and near-dedup against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np

from millrace.llm import line_dedup, near_dedup, suffix_dedup
from millrace.llm.shingles import normalized, probability_jaccard, weighted_shingles
from tests.llm.conftest import prose


def brute_lines(docs):
    """text by (doc_id, text) after removing later three-line windows; equal rows count once."""
    order = sorted({(d is not None, d or 0, t) for d, t in docs}, key=lambda x: x[:2])
    seen, out = {}, {}
    for known, d, t in order:
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            key = tuple(lines[p : p + 3])
            if key in seen:
                gone |= {p, p + 1, p + 2}
            seen.setdefault(key, (d, p))
        out[(d if known else None, t)] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def test_line_dedup_matches_brute_force(odd_documents):
    got = line_dedup.dedup_lines(odd_documents)
    assert got.columns == [*odd_documents.columns, "n_lines", "n_removed"]
    source = [(r.doc_id, r.text or "") for r in odd_documents.collect()]
    want = brute_lines(source)
    rows = got.collect()
    assert len(rows) == len(source)
    assert sorted((r.doc_id or 0, r.text, r.n_removed) for r in rows) == sorted((d or 0, *want[(d, t)]) for d, t in source)


def test_line_dedup_of_nothing(no_documents):
    assert line_dedup.dedup_lines(no_documents).count() == 0


def brute_repeats(docs: list[tuple[int, bytes]], length: int = suffix_dedup.LENGTH):
    first, out = {}, {}
    for d, b in sorted(docs):
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], (d, p))
    for d, b in docs:
        covered = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (d, p):
                covered[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~covered])
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out[d] = (len(b), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeats_of(spark, texts: dict[int, str | None]):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = suffix_dedup.remove_repeats(docs).collect()
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in rows}
    assert len(rows) == len(texts)
    return got


def test_suffix_dedup_matches_brute_force(spark):
    r = random.Random(3)
    shared = [prose(n, 50 + n) for n in (14, 17, 20, 40, 200)]
    texts: dict[int, str | None] = {0: None, 1: "", 2: "short", 3: "a" * 700, 4: "ab" * 300, 5: "é" * 130, 6: "x" * 99, 7: "x" * 100, 8: "x" * 101}
    for d in range(10, 60):
        parts = [prose(r.randrange(1, 30), 1000 + d)]
        for _ in range(r.randrange(4)):
            s = r.choice(shared)
            lo, hi = sorted(r.randrange(len(s)) for _ in range(2))
            parts += [s[lo:hi], prose(r.randrange(0, 6), 3000 + d)]
        texts[d] = " ".join(parts)
    texts |= {60: texts[11], 61: texts[11], 62: texts[12] + texts[13], 63: shared[4], 64: shared[4][1:] + "é", 65: shared[4].replace(" ", "  ", 1)}
    assert repeats_of(spark, texts) == brute_repeats([(d, (t or "").encode()) for d, t in texts.items()])


def test_suffix_dedup_many_variants_of_a_passage(spark):
    """Left and right extensions of every length: all nodes of the interval tree are visited."""
    core = prose(12, 7)[:90]
    texts = {d: prose(9, 500 + d)[: 40 + d] + prose(9, 77)[-d % 13 :] + core + prose(20, 78)[: d % 31] + prose(6, 900 + d) for d in range(80)}
    assert repeats_of(spark, texts) == brute_repeats([(d, t.encode()) for d, t in texts.items()])


def test_suffix_dedup_tells_texts_of_one_id_apart(spark, monkeypatch):
    """Different texts under one id and under null ids, with handles that nearly always collide."""
    monkeypatch.setattr(suffix_dedup, "MARK_BITS", 2)
    passage = prose(25, 31)
    texts = [prose(12, 4000 + i) + (passage if i % 7 == 0 else "") + prose(5, 5000 + i) for i in range(140)]
    texts += [texts[3], texts[7], "tiny", "  "]  # copies of whole texts
    rows = [(None if i % 2 else i % 3, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    mark = {r.text: r.mark for r in docs.selectExpr("text", "xxhash64(text) AS mark").collect()}
    known = sorted({(suffix_dedup.NO_ID if d is None else d, mark[t], t) for d, t in rows})
    place = {(d, t): n for n, (d, _, t) in enumerate(known)}
    want = brute_repeats([(n, t.encode()) for n, (_, _, t) in enumerate(known)])
    got = sorted((r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == sorted(want[place[suffix_dedup.NO_ID if d is None else d, t]] for d, t in rows)


def test_suffix_dedup_odd_rows(odd_documents, no_documents):
    rows = suffix_dedup.remove_repeats(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert [len(r.kept) for r in by_id[3]] == [0, 0]  # copies of document 1
    assert len(by_id[None][0].kept) == by_id[None][0].n_bytes  # null ids come first
    assert suffix_dedup.remove_repeats(no_documents).count() == 0


def brute_classes(texts: dict[int, str | None], least: float = near_dedup.SIMILARITY):
    """Connected components of exact similarity over all pairs."""
    norm = {d: normalized(t) for d, t in texts.items()}
    sets = {d: weighted_shingles(n) for d, n in norm.items()}
    parent = {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if norm[a] and norm[b] and root(a) != root(b) and probability_jaccard(*sets[a], *sets[b]) >= least:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in ids}


def variants(base: str, n: int, edits: int, seed: int):
    r = random.Random(seed)
    for _ in range(n):
        words = base.split()
        for _ in range(edits):
            words[r.randrange(len(words))] = "edit" + str(r.randrange(1000))
        yield " ".join(words)


def test_near_dedup_matches_brute_force(spark):
    texts: dict[int, str | None] = {0: None, 1: "", 2: "two words", 3: "Two  WORDS", 4: "other words"}
    for k in range(12):
        base = prose(60 + 10 * k, 200 + k)
        for v in [base, base.upper(), *variants(base, 4, 1 + k % 3, k)]:
            texts[len(texts)] = v
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs).collect()}
    assert got == brute_classes(texts)


def test_near_dedup_large_bucket(spark):
    """A group whose buckets go through the pivot rounds keeps every link."""
    base = prose(150, 5)
    texts = dict(enumerate([base, *variants(base, 150, 2, 8), *(prose(100, 700 + i) for i in range(20))]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs).collect()}
    assert got == brute_classes(texts)


def test_near_dedup_of_variants_beyond_the_pivot(spark):
    """Variants from near to far of one text, some linked only to each other, with words from a small vocabulary."""
    base = prose(120, 6)
    texts = {0: base}
    for k in range(160):
        texts[len(texts)] = next(variants(base, 1, 1 + k % 12, 900 + k))
    for k in range(1, 161, 8):  # a neighbour each, and one cut short
        texts[len(texts)] = next(variants(texts[k], 1, 1, 5000 + k))
        texts[len(texts)] = " ".join(texts[k].split()[: 100 + k % 20])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = near_dedup.near_duplicate_classes(docs).collect()
    want = brute_classes(texts)
    assert len(set(want.values())) > 20
    assert {r.doc_id: r.class_id for r in rows} == want
    assert all((r.n_links > 0) == (r.class_size > 1) for r in rows)


def test_near_dedup_recall_on_documents(spark):
    """Recall against all pairs of the given table: every class is found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute_classes({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs).collect()}
    assert sum(d != c for d, c in want.items()) > 50
    assert got == want


def test_near_dedup_odd_rows(odd_documents, no_documents):
    rows = near_dedup.near_duplicate_classes(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    classes = defaultdict(set)
    for r in rows:
        classes[r.doc_id].add(r.class_id)
    assert classes[1] == classes[2] == classes[3] == {1}
    assert classes[4] == {4} and classes[5] == {5} and classes[6] == {6} and classes[None] == {None}
    kept = near_dedup.drop_near_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(d or 0 for d in (1, 4, 5, 6, None, 8, 9, 11, 12, 13, 14, 15))  # 10 is near 9
    assert near_dedup.near_duplicate_classes(no_documents).count() == 0
    assert near_dedup.drop_near_duplicates(no_documents).count() == 0


def test_signatures_estimate_probability_jaccard():
    r = np.random.default_rng(1)
    universe = r.integers(0, 2**63, 400).astype(np.uint64)
    v, w = r.integers(1, 6, 300), r.integers(1, 6, 300)
    a, b = universe[:300], universe[100:]
    order_a, order_b = np.argsort(a), np.argsort(b)
    exact = probability_jaccard(a[order_a], v[order_a], b[order_b], w[order_b])
    slow = sum(1 / sum(max(dict(zip(a, v)).get(y, 0) / v[i], dict(zip(b, w)).get(y, 0) / dict(zip(b, w))[x]) for y in set(a) | set(b)) for i, x in list(enumerate(a))[100:103])
    fast = probability_jaccard(a[order_a], v[order_a], b[order_b], w[order_b])
    assert 0 < slow < fast == exact
    signatures = near_dedup.prob_minhash([(a, v), (b, w)], 4096)
    assert abs((signatures[0] == signatures[1]).mean() - exact) < 0.04


def test_probability_jaccard_of_plain_sets_is_jaccard():
    a, b = np.arange(10, dtype=np.uint64), np.arange(5, 15, dtype=np.uint64)
    one = np.ones(10, int)
    assert abs(probability_jaccard(a, one, b, one) - 5 / 15) < 1e-12
    assert probability_jaccard(a, one, a, one) == 1.0
