"""Chat formatting, top-k, packing, quality, decontamination, language ID, URL rules, pipeline."""

from __future__ import annotations

import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat_format, cover_tree, decontaminate, language_id, packing, quality, url_rules
from millrace.llm.queries import ORACLES, QUERIES
from tests.compare import assert_same
from tests.llm import brute
from tests.llm.conftest import prose
from tests.llm.test_text_dedup import brute_classes, brute_lines


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(name, spark, sf, duck):
    assert_same(QUERIES[name](spark, sf), duck, ORACLES[name])


# --- chat formatting ----------------------------------------------------------------


def test_chat_round_trip_of_hostile_texts(spark):
    r = random.Random(4)
    pieces = ["\\", "### ", "</turn>", "\n", "user", ":", " ", "é", "#", "<", "\\\\", "\n</turn>\n", "### user:\n"]
    rows = [(c, t, r.choice(["user", "assistant", "odd\nrole", "b\\n", "", None]), "".join(r.choice(pieces) for _ in range(r.randrange(8)))) for c in range(60) for t in range(4)]
    rows += [(None, 0, "user", None), (100, None, None, None), (101, 1, "user", "same"), (101, 1, "user", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    done = chat_format.format_chats(turns).collect()
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    assert len(done) == len(want)
    for row in done:
        assert row.identical
        assert [(x.role, x.text) for x in row.turns] == [x[1:] for x in sorted(want[row.conv_id])]


def test_loss_spans_cover_the_trained_texts(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "héllo\nyou"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    row = chat_format.format_chats(turns).select("formatted", chat_format.loss_spans(F.col("formatted")).alias("s")).first()
    assert [row.formatted[x.start : x.end] for x in row.s] == ["héllo\nyou", ""]


# --- exact top-k ----------------------------------------------------------------------


def brute_top(vectors, k=10):
    usable = {i: np.floor(1024 * np.asarray(v, dtype=np.float32).astype(np.float64)).astype(object) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in (i for i in usable if i % 100 == 0):
        scored = sorted((-int(usable[q] @ usable[i]) if len(usable[q]) else 0, i) for i in usable if i != q and len(usable[i]) == len(usable[q]))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], start=1)]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    r = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in np.float32(r.normal(size=16) * (1 + i % 3))]) for i in range(900)]
    vectors += [(1000 + i, vectors[5][1]) for i in range(60)]  # many equal vectors
    vectors += [(2000, None), (2001, [None] * 16), (2002, [float("nan")] * 16), (2003, [float("inf")] * 16), (2100, []), (2101, []), (2200, [1.0] * 3), (2201, [2.0] * 3), (None, [1.0] * 16)]
    vectors += [(2300, [3e9] * 4), (2301, [-3e9] * 4), (2302, [1.0] * 4)]  # beyond exact doubles
    vectors += [vectors[0]]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = cover_tree.top_k(cover_tree.quantized(df), is_query=F.col("vec_id") % 100 == 0)
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert sorted(map(tuple, got.collect())) == [(q, n, i, clip(s)) for q, n, i, s in brute_top(vectors)]
    assert cover_tree.top_k(cover_tree.quantized(df.filter("false")), is_query=F.lit(True)).count() == 0


def test_repeated_rows_count_once(spark, duck):
    r = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in np.float32(r.normal(size=8))]) for i in range(300)]
    vectors += [(1000 + i, [9.0] * 8) for i in range(30)]  # one vector under many ids,
    vectors += [(1000, [9.0] * 8)] * 40  # one of them in more than k + 1 rows
    vectors += [(7, [5.0] * 8)] * 3 + [(100, [-9.0] * 8)] * 2  # and ids with two vectors, one of them a query
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = cover_tree.top_k(cover_tree.quantized(df), is_query=F.col("vec_id") % 100 == 0)
    rows = ", ".join(f"({i}, {v}::FLOAT[])" for i, v in vectors)
    want = duck.sql(ORACLES["op3_cover_tree_top_k"].replace("FROM embeddings", f"FROM (VALUES {rows}) AS t(vec_id, embedding)")).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_over_many_blocks(spark, monkeypatch):
    """Clustered vectors, ties and a repeated row in the top ten: equal to brute force, and most pairs of blocks are ruled out."""
    monkeypatch.setattr(cover_tree, "DATA_BLOCK", 64)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", 8)
    r = np.random.default_rng(8)
    centres = r.normal(size=(20, 6)) * 8
    vectors = [(i, [float(x) for x in np.float32(centres[i // 7 % 20] + r.normal(size=6) * 0.05)]) for i in range(2000)]
    vectors += [(3000, vectors[0][1])] * 12 + [(3001 + i, vectors[1][1]) for i in range(15)]
    df = cover_tree.quantized(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    met = []
    block_top_k = cover_tree._bounded_pairs
    monkeypatch.setattr(cover_tree, "_bounded_pairs", lambda *a: met.append(block_top_k(*a)) or met[-1])
    got = cover_tree.top_k(df, is_query=F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == [(q, n, i, s) for q, n, i, s in brute_top(vectors)]
    pairs = met[0].collect()
    score = {r.query_id: r.score for r in got.filter("rank = 10").collect()}
    assert len(pairs) > 100 and sum(p.bound >= min(score.values()) for p in pairs) < len(pairs) / 2


def test_dual_tree_prunes_and_is_exact():
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 8)) * 3000
    data = np.floor(np.concatenate([c + r.normal(size=(60, 8)) * 20 for c in centres]))
    ids = np.arange(len(data))
    queries, query_ids = data[::5], ids[::5]
    best, scores, work = cover_tree.dual_tree_top_k(queries, query_ids, data, ids, 5)
    for row, q, i in zip(scores, queries, query_ids, strict=True):
        s = data @ q
        s[i] = -np.inf
        assert sorted(row.tolist(), reverse=True) == sorted(np.sort(s)[-5:].astype(int).tolist(), reverse=True)
    assert work["pruned"] > 0


def test_cover_tree_invariants():
    x = np.random.default_rng(4).normal(size=(500, 5))
    tree = cover_tree.CoverTree(x)
    for node, kids in enumerate(tree.children):
        points = tree.points[node]
        assert np.linalg.norm(x[points] - x[tree.centre[node]], axis=1).max() <= tree.radius[node] + 1e-9
        if kids:
            assert sorted(np.concatenate([tree.points[k] for k in kids]).tolist()) == sorted(points.tolist())
            assert tree.centre[node] in [tree.centre[k] for k in kids]
            centres = x[[tree.centre[k] for k in kids]]
            apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)[~np.eye(len(kids), dtype=bool)]
            assert not len(apart) or apart.min() > tree.radius[node] / cover_tree.BASE


# --- packing -----------------------------------------------------------------------------


def tokens_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    return [np.array([*e.ids, 0], dtype="<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def test_word_encoder_equals_the_tokenizer():
    texts = ["", "a", " a", "a ", "  a", "a  b\n c", "x\n\n y", "don't you'll 12 3,4 é ñ", "a\tb \tc", "\n", "   ", "nul\u0000 x", "a\u0085 b \x1c c", "日本語 \U0001f600 ok", "<|endoftext|> a<|endoftext|>b", prose(500, 1)]
    encode = packing.WordEncoder(packing.tokenizer_path())
    for again in range(3):
        if again == 2:
            encode._forget()
            texts = texts[::-1]
        ids, totals = encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(totals)[:-1])] == [x.tolist() for x in tokens_of(texts)]
    ids, totals = encode(pa.array([*texts, None, "b c"]).slice(3, len(texts) - 1))
    assert ids.tolist() == np.concatenate(tokens_of([*texts[3:], "", "b c"])).tolist()


def test_packing_groups_are_bounded_by_pieces(spark, monkeypatch):
    """Three very long documents make many pieces, and so several groups."""
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    docs = spark.createDataFrame([(i, prose(60_000, i)) for i in range(3)], "doc_id long, text string")
    rows = packing.packed_documents(docs).collect()
    groups = [r.sequence_id >> 32 for r in rows]
    assert len(rows) > 300 and len(set(groups)) >= 6
    assert max(groups.count(g) for g in set(groups)) < 100
    check_packing({i: prose(60_000, i) for i in range(3)}, rows)


def check_packing(source, rows):
    """Every id in one piece, gapless sequences, right sums."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, text in source.items():
        ids, at = tokens_of([text or ""])[0], 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SEQUENCE
    return by_sequence


def test_packing(spark, odd_documents, no_documents):
    source = {r.doc_id: r.text for r in odd_documents.collect() if r.doc_id != 3}
    check_packing(source, packing.packed_documents(odd_documents.filter("doc_id is null or doc_id <> 3")).collect())
    assert packing.packed_documents(odd_documents).filter("doc_id = 3 and start = 0").count() == 2
    assert packing.packed_documents(no_documents).count() == 0


def test_packing_pads_little(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.packed_documents(docs).collect()
    sequences = check_packing({r.doc_id: r.text for r in docs.collect()}, rows)
    used = sum(r.length for r in rows)
    assert len(sequences) * packing.SEQUENCE < 1.03 * used


def test_first_fit_decreasing_equals_the_slow_way():
    lengths = np.random.default_rng(5).integers(1, 1025, 700)
    bins, offsets = packing.first_fit_decreasing(lengths, 1024)
    free: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        at = next((b for b, f in enumerate(free) if f >= lengths[i]), None)
        if at is None:
            at = len(free)
            free.append(1024)
        assert (bins[i], offsets[i]) == (at, 1024 - free[at])
        free[at] -= lengths[i]


def test_assembled_sequences(spark):
    docs = spark.createDataFrame([(i, prose(40 * i, i)) for i in range(20)], "doc_id long, text string").coalesce(1)
    pieces = packing.tokenized_pieces(docs, path=packing.tokenizer_path())
    packed = packing.pack(pieces.drop("ids"), n_groups=1)
    sequences = packing.assemble(packed, pieces).collect()
    total = sum(len(x) for x in tokens_of([prose(40 * i, i) for i in range(20)]))
    assert sum(s.n_tokens for s in sequences) == total
    assert all(len(s.ids) == 4 * (s.n_tokens if s.n_tokens & (s.n_tokens - 1) == 0 else packing.SEQUENCE) for s in sequences)


# --- quality --------------------------------------------------------------------------------


def test_quality_held_out(spark, odd_documents, no_documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    judged = quality.scored(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in judged)
    assert np.mean([r.predicted == r.quality for r in judged]) > 0.95
    good, poor = ([r.score for r in judged if r.quality == q] for q in (1, 0))
    assert np.mean([[g > p for p in poor] for g in good]) > 0.97
    rows = quality.scored(odd_documents, model).collect()
    assert len(rows) == odd_documents.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= quality.CUT) for r in rows)
    assert quality.scored(no_documents, model).count() == 0
    assert quality.train(no_documents, labels).score(np.zeros((1, quality.N_FEATURES)))[0] == pytest.approx(quality.CUT)


def plain_features(text: str) -> list[float]:
    """The features counted one byte, word and line at a time."""
    raw = text.encode()
    if not raw:
        return [0.0] * quality.N_FEATURES
    groups = [sum(b in chars for b in raw) / len(raw) for chars in quality.CLASSES.values()] + [sum(b >= 128 for b in raw) / len(raw)]
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    entropy = -sum(raw.count(b) / len(raw) * math.log(raw.count(b) / len(raw)) for b in set(raw))
    rest = [math.log1p(len(raw)), math.log1p(len(words)), len(raw) / n / 10, max(1, len(set(words))) / n if words else 0.0, len(set(lines)) / len(lines), math.log1p(len(raw) / len(lines)), entropy, sum(w.isupper() for w in words) / n, float(not words)]
    return groups + [math.sqrt(g) for g in groups] + rest


def plain_fit(rows: list[list[float]], good: list[bool], seed: int = 5) -> tuple[list[float], float]:
    """Weights by gradient descent on the penalised logistic loss of the same pairs, and the quantile of the worths."""
    n, size = len(rows), len(rows[0])
    mean = [sum(r[i] for r in rows) / n for i in range(size)]
    scale = [math.sqrt(sum((r[i] - mean[i]) ** 2 for r in rows) / n) for i in range(size)]
    z = [[(r[i] - mean[i]) / (scale[i] if scale[i] >= 1e-9 else 1) for i in range(size)] for r in rows]
    poor, fine = [i for i in range(n) if not good[i]], [i for i in range(n) if good[i]]
    chosen = np.random.default_rng(seed).choice(np.array(fine), len(poor) * quality.PAIRS_A_POOR).tolist()
    pairs = [[z[f][i] - z[p][i] for i in range(size)] for f, p in zip(chosen, [p for p in poor for _ in range(quality.PAIRS_A_POOR)], strict=True)]
    w, step = [0.0] * size, 1 / (quality.RIDGE + sum(sum(x * x for x in d) for d in pairs) / 4)
    for _ in range(20_000):
        gradient = [-quality.RIDGE * x for x in w]
        for d in pairs:
            miss = 1 / (1 + math.exp(sum(a * b for a, b in zip(d, w, strict=True))))
            gradient = [g + miss * x for g, x in zip(gradient, d, strict=True)]
        w = [x + step * g for x, g in zip(w, gradient, strict=True)]
        if max(map(abs, gradient)) < 1e-7:
            break
    worth = sorted(sum(a * b for a, b in zip(r, w, strict=True)) for r in z)
    place = len(poor) / n * (n - 1)
    lo, hi = worth[math.floor(place)], worth[math.ceil(place)]
    return w, lo + (hi - lo) * (place - math.floor(place))


def test_quality_features_match_brute_force(odd_documents):
    texts = [r.text or "" for r in odd_documents.collect() if len(r.text or "") < 6000] + ["A\tB  C! \u00a0 x", "\n\n", "UP up; (x) [y] 'q' ü"]
    assert np.allclose(quality.features(texts), [plain_features(t) for t in texts], atol=1e-9)


def test_quality_fit_matches_brute_force():
    r = np.random.default_rng(11)
    good = np.arange(24) % 3 > 0
    x = r.normal(size=(24, 3)) + good[:, None] * np.array([0.8, 0.0, -0.5])
    x[:, 2] = np.round(x[:, 2])  # ties
    model = quality.fit(x, good)
    weights, threshold = plain_fit(x.tolist(), good.tolist())
    assert np.allclose(model.weights, weights, atol=1e-6) and abs(model.threshold - threshold) < 1e-6
    scores = [1 / (1 + math.exp(-(sum((v - m) / s * w for v, m, s, w in zip(row, model.mean, model.scale, weights)) - threshold + math.log(quality.CUT / (1 - quality.CUT))))) for row in x.tolist()]
    assert np.allclose(model.score(x), scores, atol=1e-6)


def test_quality_of_odd_labels(spark):
    """Ids named twice, null qualities, other values, clashing columns and repeated rows change nothing."""
    docs = spark.createDataFrame([(i, prose(20 + i, i) if i % 3 else "JUNK!! " * (5 + i)) for i in range(60)], "doc_id long, text string")
    plain = [(i, int(i % 3 > 0)) for i in range(60)]
    labels = spark.createDataFrame(plain, "doc_id long, quality int")
    odd = spark.createDataFrame([*plain, *plain, (3, 1), (None, 1), (4, None), (5, 7), (900, 0)], "doc_id long, quality int").withColumns({"x": F.lit("x"), "text": F.lit("y"), "toxic": F.lit(1)})
    model, same = quality.train(docs, labels), quality.train(docs.unionByName(docs).withColumns({"x": F.lit(1), "quality": F.lit(9), "held_out": F.lit("h"), "score": F.lit("s")}), odd)
    assert np.allclose(model.weights, same.weights, atol=1e-9) and abs(model.threshold - same.threshold) < 1e-9
    twice = quality.scored(docs.unionByName(docs).withColumn("score", F.lit("clash")), model)
    assert twice.columns == ["doc_id", "held_out", "score", "predicted"] and twice.count() == 120
    assert twice.select("doc_id", F.round("score", 12)).distinct().count() == 60
    assert all(r.score == pytest.approx(quality.CUT) for r in quality.scored(docs, quality.train(docs, odd.filter("quality = 1"))).collect())


def test_quality_learns_from_every_label(spark):
    """Mean, pairs and threshold are those of all labelled documents outside the held-out fold, in one block or in many."""
    ids = [i for i in range(16_000) if zlib.crc32(str(i).encode()) % 5]
    text = lambda i: "A b, " * (i * 7 % 11) + "xyz" * (i % 5) + "!" * (i % 3)
    docs = spark.createDataFrame([(i, text(i)) for i in range(16_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(16_000)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    x, good = quality.features([text(i) for i in ids]), np.array([i % 4 > 0 for i in ids])
    assert len(ids) > 12_000 and np.allclose(model.mean, x.mean(0), atol=1e-12) and np.allclose(model.scale[x.std(0) > 1e-9], x.std(0)[x.std(0) > 1e-9])
    assert model.threshold == pytest.approx(np.quantile((x - model.mean) / model.scale @ model.weights, (~good).mean()), abs=1e-9)

    few = docs.filter("doc_id < 400")
    alone = quality.train(few, labels)  # one block: all pairs
    z, kind = (x[: sum(i < 400 for i in ids)] - alone.mean) / alone.scale, good[: sum(i < 400 for i in ids)]
    pairs = (z[kind][:, None, :] - z[~kind][None, :, :]).reshape(-1, z.shape[1])
    miss = 1 / (1 + np.exp(pairs @ alone.weights))
    assert np.abs(quality.PAIRS_A_POOR / kind.sum() * pairs.T @ miss - quality.RIDGE * alone.weights).max() < 1e-5

    rows = spark.createDataFrame([(i, [float(i)] * quality.N_FEATURES, i % 10 > 0) for i in range(500)], "doc_id long, x array<double>, good boolean")
    blocks = [m for r in quality._blocks(rows, 450, 50, 32).toPandas().to_dict("records") for m in quality._matrices({k: [v] for k, v in r.items()})]
    parts = {}
    for of_block, kinds, share in blocks:
        assert len(kinds) < 120 and kinds.any() and not kinds.all()
        for i, part in zip(of_block[:, 0], share, strict=True):
            parts[i] = parts.get(i, 0) + part
    assert len(blocks) == 15 and len(parts) == 500 and all(v == pytest.approx(1) for v in parts.values())


# --- decontamination ---------------------------------------------------------------------------


def edited(text: str, every: int) -> str:
    return " ".join(w if i % every else "swap" for i, w in enumerate(text.split(), start=1))


def test_decontamination(spark, odd_documents):
    items = {i: prose(25 + i, 800 + i) for i in range(6)}
    benchmark = spark.createDataFrame([*items.items(), (90, None), (91, "too short"), (92, "")], "item_id long, text string").withColumn("doc_id", F.lit(5))
    clean = {i: prose(200, 900 + i) for i in range(20)}
    planted = {100 + i: f"{prose(30, 40 + i)} {t.upper()} {prose(30, 60 + i)}" for i, t in items.items()}
    planted |= {200 + i: f"{prose(30, 70 + i)}\n{edited(t, 9)}, {prose(9, 90 + i)}" for i, t in items.items()}
    planted |= {300 + i: t for i, t in items.items()}
    docs = spark.createDataFrame([*clean.items(), *planted.items(), *planted.items()], "doc_id long, text string").withColumn("text_mark", F.lit(1))
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert found == {(100 * k + i, i) for k in (1, 2, 3) for i in items}
    left = decontaminate.decontaminate(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(clean)
    assert decontaminate.leaks(odd_documents, benchmark).count() == 0
    assert decontaminate.decontaminate(odd_documents, benchmark).count() == odd_documents.count()
    assert decontaminate.leaks(docs, benchmark.filter("false")).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    items = {i: prose(30, 800 + i) for i in range(8)}
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"start {t} end") for i, t in items.items()], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", 100)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()} == {(i, i) for i in items}


def test_masks_hit_every_placement_of_a_fifth_of_replaced_words():
    selected = [(len(m), sum(1 << i for i, bit in enumerate(m) if bit == "1")) for m in decontaminate.MASKS]
    for n in range(decontaminate.MIN_WORDS, 2 * decontaminate.MIN_WORDS):
        placed = [bits << at for span, bits in selected for at in range(n - span + 1)]
        for where in itertools.combinations(range(n), n // 5):
            replaced = sum(1 << i for i in where)
            assert any(not p & replaced for p in placed), (n, where)


def test_every_placement_of_replaced_words_is_found(spark):
    items, texts = {n: prose(n, 700 + n).split() for n in (13, 14, 15, 16)}, []
    for n, words in items.items():
        for where in itertools.combinations(range(n), n // 5):
            texts.append((n, len(where), " ".join(["before it", *("swap" if i in where else w for i, w in enumerate(words)), "after it"])))
    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.matched_words, r.overlap_words) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert {k: v[0] for k, v in found.items()} == {(i, n): n - k for i, (n, k, _) in enumerate(texts)}


def test_short_items_are_found_whole(spark):
    items = {n: prose(n, 500 + n) for n in range(5, 13)}
    docs = spark.createDataFrame([(i, f"before it {t} after it") for i, t in items.items()], "doc_id long, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.matched_words, r.overlap_words, r.first_word) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert found == {(n, n, n, n, 2) for n in items}


def test_overlaps_are_reported_in_full(spark):
    long = prose(300, 77)
    docs = spark.createDataFrame([(1, f"before it {long} after it")], "doc_id long, text string")
    (r,) = decontaminate.leaks(docs, spark.createDataFrame([(1, long)], "item_id long, text string")).collect()
    assert (r.matched_words, r.overlap_words, r.first_word) == (300, 300, 2)


def test_decontamination_matches_brute_force(spark, sf):
    """Random edits, cuts and shifts of items, and the given tables."""
    r = random.Random(17)
    items = [(i, prose(r.randrange(5, 45), 1200 + i)) for i in range(25)]
    docs = []
    for d in range(120):
        words = r.choice(items)[1].split()
        lo, hi = (0, len(words)) if len(words) < 13 else sorted(r.sample(range(len(words) + 1), 2))
        words = words[lo:hi]
        for _ in range(0 if len(words) < 13 else r.randrange(len(words) // 3 + 1)):
            words[r.randrange(len(words))] = "swap"
        docs.append((d, " ".join([prose(r.randrange(1, 30), 1500 + d), *words, prose(r.randrange(1, 30), 1700 + d)])))
    found = lambda docs, items: {tuple(x) for x in decontaminate.leaks(docs, items).drop("text_mark").collect()}
    want = brute.leaks(docs, items)
    assert 30 < len(want) < 115
    assert found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")) == want
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda df, key: [(x[key], x.text) for x in df.collect()]
    assert found(docs, items) == brute.leaks(plain(docs, "doc_id"), plain(items, "item_id"))


# --- language ID -----------------------------------------------------------------------------------


def test_language_id(spark, sf, odd_documents, no_documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 10 == 0, F.lit("de")).otherwise(F.col("lang")))
    got = {r.id: r for r in language_id.identify(language_id.document_evidence(wrong)).collect()}
    truth = {r.doc_id: (r.lang, r.n_chars) for r in docs.collect()}
    long = [d for d, (_, n) in truth.items() if n > 300]
    assert np.mean([got[d].lang == truth[d][0] for d in long]) > 0.98
    pages = language_id.identify(language_id.page_evidence(spark.read.parquet(f"{sf}/pages.parquet")))
    assert pages.filter("accepted").count() == 50
    assert language_id.identify(language_id.document_evidence(odd_documents)).count() == odd_documents.count()
    assert language_id.keep_identified(no_documents).count() == 0


@pytest.mark.parametrize("table", ["documents", "pages"])
def test_language_id_matches_brute_force(spark, sf, odd_documents, table):
    rows = spark.read.parquet(f"{sf}/{table}.parquet")
    if table == "documents":
        evidence = language_id.document_evidence(rows).unionByName(language_id.document_evidence(odd_documents.filter("doc_id > 3")).withColumn("id", F.col("id") + 10**6))
    else:
        odd = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "", ""), (10**6 + 2, "http://a.example.de/x", None), (10**6 + 3, None, "<p>words without an address</p>")], "page_id long, url string, html string")
        evidence = language_id.page_evidence(rows.select("page_id", "url", "html").unionByName(odd))
    own = [r.asDict() for r in evidence.collect()]
    want = {r["id"]: x for r, x in zip(own, brute.languages(own), strict=True)}
    got = {r.id: (r.lang, r.confidence) for r in language_id.identify(evidence).collect()}
    assert got.keys() == want.keys() and len(got) == len(own)
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-4 for k in want)


def test_language_priors_and_declared_language_decide_unclear_texts(spark):
    rows = [(i, "the river and the stone of the morning light " * 5, "en", f"h{i % 3}") for i in range(60)]
    rows += [(100 + i, "der fluss und das licht am morgen ist nicht der stein " * 5, "de", f"g{i % 3}") for i in range(60)]
    rows += [(200, "der and", "de", "g1"), (201, "der and", "en", "h1"), (202, "12345 !!", "en", "h1"), (203, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.id: r for r in language_id.identify(language_id.document_evidence(docs)).collect()}
    assert (got[200].lang, got[201].lang) == ("de", "en")
    assert not got[202].accepted and not got[203].accepted


GREEK, DUTCH, GERMAN = "το ποτάμι και η πέτρα στο φως του πρωινού ", "de rivier en het licht van de ochtend zijn niet de steen ", "der fluss und das licht am morgen ist nicht der stein "


def test_rare_languages_have_models_whatever_the_size_of_the_table(spark):
    rows = [(i, "the river and the stone of the morning light " * 5, "en", "h") for i in range(900)]
    rows += [(1000 + i, GERMAN * 5, "de", "h") for i in range(300)]
    rare = [(2000 + i, t * 5, lang, "h") for i, (t, lang) in enumerate([(GREEK, "el"), (DUTCH, "nl")] * 3)]
    docs = spark.createDataFrame(rows + rare, "doc_id long, text string, lang string, source string")
    got = {r.id: r.lang for r in language_id.identify(language_id.document_evidence(docs), sample=20).collect()}
    assert got == {r[0]: r[2] for r in rows + rare}


def test_languages_beyond_the_largest_are_identified_and_short_ones_are_not_rejected(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    rows = [(1000 * j + i, t * 5, lang, lang) for j, (t, lang, n) in enumerate([("the river and the stone of the morning light ", "en", 40), (GERMAN, "de", 40), (DUTCH, "nl", 9), (GREEK, "el", 9)]) for i in range(n)]
    docs = spark.createDataFrame([*rows, (9000, GREEK * 5, None, None), (9001, "მდინარე და ქვა", "ka", None), (9002, "123", "ka", None)], "doc_id long, text string, lang string, source string")
    got = {r.id: r.lang for r in language_id.identify(language_id.document_evidence(docs)).collect()}
    assert got == {r[0]: r[2] for r in rows} | {9000: "el", 9001: "ka", 9002: "und"}
    alone = language_id.identify(language_id.document_evidence(docs.filter("doc_id > 9000"))).collect()
    assert {r.id: (r.lang, r.accepted) for r in alone} == {9001: ("ka", True), 9002: ("und", False)}


# --- URL rules --------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [
        (1, "https://a.example.com/en/7x", "example.com/en/7", "allow"),
        (2, "https://other.com/en/", "com/en/", "block"),
        (3, "http://EXAMPLE.NET/de/8?x", "example.net/de/8", "block"),
        (4, "http://x.net/de/9#t", "net/de/", "allow"),
        (5, "ftp://q.org/es/1", "org/es/", "block"),
        (6, "http://notexample.com/fr/7", None, "allow"),
        (7, "http://m.casino-win.example.org/de/1", None, "block"),
        (8, "http://casinos.example.org/casino/1", None, "allow"),
        (9, None, None, "allow"),
        (10, "no scheme.com/en/", None, "allow"),
        (11, "http://com/en/", "com/en/", "block"),
        (12, "http://x.com?/en/", None, "allow"),
        (13, "http://xcom/en/", None, "allow"),
        (14, "http://x.com/EN/", None, "allow"),
        (14, "http://x.com/EN/", None, "allow"),
    ]
    pages = spark.createDataFrame([u[:2] for u in urls], "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = url_rules.judge(pages, url_rules.CONTRACT_RULES + url_rules.CATEGORY_RULES)
    assert sorted((r.page_id, r.rule or "", r.verdict) for r in got.collect()) == sorted((u[0], u[2] or "", u[3]) for u in urls)
    assert url_rules.judge(pages.filter("false"), url_rules.CONTRACT_RULES).count() == 0


def test_rules_beyond_the_map(spark, monkeypatch):
    """A table of rules gives what the map gives, other columns pass."""
    r = random.Random(4)
    hosts = ["a.example.com", "example.net", "casino.x.org", "free-bets.net", "b.org", "my.adult.com", "com"]
    urls = [(i, f"http://{r.choice(hosts)}/{r.choice(['en', 'de', 'es'])}/{r.randrange(10)}?q", "clash") for i in range(400)] + [(900, None, "x"), (901, "", "x")]
    pages = spark.createDataFrame(urls, "page_id long, url string, subject string")
    rules = url_rules.CONTRACT_RULES + url_rules.CATEGORY_RULES
    want = url_rules.judge(pages, rules)
    rows = list(map(tuple, want.collect()))
    monkeypatch.setattr(url_rules, "MAX_RULES", 3)
    got = url_rules.judge(pages, rules)
    assert got.columns == want.columns and sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(rows, key=str)


def test_rules_are_filed_under_their_rarest_literal():
    filed = url_rules.index_by_rarest(url_rules.CONTRACT_RULES, {"com": 9, "en": 3, "example": 1, "net": 5, "de": 6, "org": 1, "es": 2})
    assert {t: sorted(r.label for r in rules) for t, rules in filed.items()} == {"en": ["com/en/"], "example": ["example.com/en/7", "example.net/de/8"], "net": ["net/de/"], "org": ["org/es/"]}


# --- pipeline -----------------------------------------------------------------------------------------


def test_pipeline_equals_its_stages_and_keeps_clean_documents(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {0: {r.doc_id for r in docs.select("doc_id").collect()}}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES, start=1):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert n == len(corpus_pipeline.STAGES) or docs.columns == columns
        ids[n] = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        assert ids[n] <= ids[n - 1]
    assert len(ids[1]) >= 0.99 * len(ids[0]) and len(ids[4]) > 0.7 * len(ids[0])
    assert ids[5] == ids[4]
    key = lambda df: sorted((r.doc_id, r.start, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(docs)


def test_pipeline_matches_brute_force(spark, sf, tmp_path):
    """Every stage's rows, from plain versions of the operators."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept: dict[int, str | None] = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            own = [r.asDict() for r in language_id.document_evidence(docs).collect()]
            want = {r["id"]: r["text"] for r, (lang, _) in zip(own, brute.languages(own), strict=True) if lang != language_id.UNKNOWN}
        elif name == "line_dedup":
            lines = brute_lines([(d, t or "") for d, t in kept.items()])
            want = {d: t for (d, _), (t, gone) in lines.items() if not gone or t.strip(" \t\n\x0b\f\r")}
        elif name == "near_dedup":
            classes = brute_classes(kept)
            want = {d: t for d, t in kept.items() if classes[d] == d}
        elif name == "decontaminate":
            bad = {d for d, *_ in brute.leaks(list(kept.items()), items)}
            want = {d: t for d, t in kept.items() if d not in bad}
        else:
            check_packing(before, stage(spark, docs, sf).collect())
            break
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept = {r.doc_id: r.text for r in docs.collect()}
        assert kept == want, name
        assert docs.count() == len(kept)


def test_stages_with_every_helper_name_as_a_column(spark, sf):
    """Columns of the documents may bear any name that the operators use inside."""
    import corpus_pipeline

    names = "d m h n id mark covered kept_id kept_mark nth_copy text_mark text_mark_of_row found_lang n_lines n_removed node band label class row a b x w did place places spans subject found declared host parent suffix seed words s group _group key bands".split()
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    docs = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        got, want = stage(spark, docs, sf), stage(spark, plain, sf)
        if name != "packing":
            assert got.columns == docs.columns
        assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in want.select("doc_id").collect())
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(120)], "vec_id long, embedding array<float>").select("*", *(F.lit(i).alias(n) for i, n in enumerate([*names, "q", "rank", "score"])))
    assert cover_tree.top_k(cover_tree.quantized(vectors), is_query=F.col("vec_id") % 100 == 0).count() == 20


def test_documents_of_which_only_breaks_are_left_go(spark):
    import corpus_pipeline

    lines = "one line\nanother line\na third line"
    docs = spark.createDataFrame([(1, lines), (2, f"{lines}\n\n \t"), (3, f"{lines}\nmore"), (4, " \n\n"), (5, None)], "doc_id long, text string")
    left = {r.doc_id: r.text for r in corpus_pipeline.strip_repeated_lines(spark, docs, "").collect()}
    assert left == {1: lines, 3: "more", 4: " \n\n", 5: ""}


def test_pipeline_on_odd_rows(spark, sf, odd_documents, no_documents):
    import corpus_pipeline

    from millrace.llm.common import reliable_checkpoint

    for docs in (odd_documents, no_documents):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES, start=1):
            docs = reliable_checkpoint(stage(spark, docs, sf))
            assert n == len(corpus_pipeline.STAGES) or docs.columns == odd_documents.columns
