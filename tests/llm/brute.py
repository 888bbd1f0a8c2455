"""Slow, plain versions of operators that SQL cannot express."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import regex

from millrace.llm import language_id


def words_of(text: str | None) -> list[str]:
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def leak(doc: list[str], item: list[str]) -> tuple[int, int, int] | None:
    """matched words, overlap words and first word of the best leak of ``item`` in ``doc``; every diagonal, every passage."""
    best = None
    for shift in range(1 - len(item), len(doc)):
        lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
        same = [item[p] == doc[p + shift] for p in range(lo, hi)]
        if sum(same) < min(5, len(item)):
            continue
        passages = [(i, j) for i in range(len(same)) if same[i] for j in range(i + 13, len(same) + 1) if same[j - 1]]
        if len(same) == len(item):
            passages.append((0, len(same)))
        for i, j in passages:
            m = sum(same[i:j])
            # passages between runs of agreeing words: one that could grow by an agreeing word does
            if 10 * m >= 8 * (j - i) and ((i, j) == (0, len(item)) or not ((i and same[i - 1]) or (j < len(same) and same[j]))):
                found = (m, j - i, -(lo + i + shift))
                best = max(best, found) if best else found
    return best and (best[0], best[1], -best[2])


def leaks(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    found = set()
    for d, text in docs:
        doc = words_of(text)
        known = set(doc)
        for i, t in items:
            item = words_of(t)
            if len(item) >= 5 and sum(w in known for w in item) >= 5 and (b := leak(doc, item)):
                found.add((d, i, *b))
    return found


def _trigrams(text: str | None) -> list[int]:
    """Hashed trigrams of the bytes of lower-cased letters and single gaps, none with a gap in the middle."""
    symbols, gap = [32], False
    for b in (text or "").lower().encode() + b"\0":
        if 97 <= b <= 122 or b >= 128:
            symbols.append(b)
            gap = True
        elif gap or b == 0:
            symbols.append(32)
            gap = False
    code = lambda a, b, c: ((a * 65599 + b * 257 + c) * 0x9E3779B1 >> 12) & (language_id.BUCKETS - 1)
    return [code(*symbols[i : i + 3]) for i in range(len(symbols) - 2) if symbols[i + 1] != 32]


def languages(rows: list[dict]) -> list[tuple[str, float]]:
    """lang and confidence of rows (text, declared, suffix, host, parent), no more than the sample and the largest languages."""
    tri = [_trigrams(r["text"]) for r in rows]
    tags = [m[1] if (m := re.match(r"\s*([a-z]{2,3})(?:[-_].*)?\s*$", (r["declared"] or "").lower(), re.S)) else None for r in rows]
    counts: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for t, tag in zip(tri, tags, strict=True):
        if tag:
            for x in t:
                counts[tag][x] += 1
    known = sorted(lang for lang, c in counts.items() if sum(c.values()) >= language_id.MIN_TRIGRAMS)
    log_p, own = [], []
    for lang in known:
        total = sum(counts[lang].values()) + 0.05 * language_id.BUCKETS
        p = np.full(language_id.BUCKETS, 0.05 / total)
        for x, c in counts[lang].items():
            p[x] = (c + 0.05) / total
        log_p.append(np.log(p))
        own.append(float((p * np.log(p)).sum()))
    mean = [[float(np.mean([lp[x] for x in t])) if t else 0.0 for lp in log_p] for t in tri]
    loud = [[m * min(len(t), language_id.MOST_TRIGRAMS) * language_id.TEMPER for m in ms] for ms, t in zip(mean, tri, strict=True)]

    def softmax(v):
        top = max(v)
        e = [math.exp(x - top) for x in v]
        return [x / sum(e) for x in e]

    soft, n = [softmax(v) for v in loud], len(known)
    whole = [1.0 + sum(s[i] for s, t in zip(soft, tri, strict=True) if t) for i in range(n)]
    base = [w / sum(whole) for w in whole]

    def summed(key):
        out: dict[str, list[float]] = defaultdict(lambda: [0.0] * n)
        for r, s, t, tag in zip(rows, soft, tri, tags, strict=True):
            k = tag if key == "declared" else r[key]
            if t and k:
                out[k] = [a + b for a, b in zip(out[k], s, strict=True)]
        return out

    smoothed = lambda c, towards, weight: [(x + weight * t) / (sum(c) + weight) for x, t in zip(c, towards, strict=True)]
    evidence = {}
    for key in ("declared", "suffix"):
        c = summed(key)
        out_of = [sum(v[i] for v in c.values()) + len(c) * language_id.EVIDENCE_WEIGHT for i in range(n)]
        evidence[key] = {k: [math.log((x + language_id.EVIDENCE_WEIGHT) / t) for x, t in zip(v, out_of, strict=True)] for k, v in c.items()}
    by_host, by_parent = summed("host"), summed("parent")
    result = []
    for r, v, t, ms, tag in zip(rows, loud, tri, mean, tags, strict=True):
        score = list(v)
        for key, k in (("declared", tag), ("suffix", r["suffix"])):
            if k in evidence[key]:
                score = [a + b for a, b in zip(score, evidence[key][k], strict=True)]
        prior = base
        if r["host"]:
            up = smoothed(by_parent[r["parent"]], base, language_id.PARENT_WEIGHT) if r["parent"] and r["parent"] in by_parent else base
            prior = smoothed(by_host[r["host"]] if r["host"] in by_host else [0.0] * n, up, language_id.HOST_WEIGHT)
        post = softmax([a + math.log(p) for a, p in zip(score, prior, strict=True)])
        confidence, spread = max(post), language_id.SPREAD / math.sqrt(max(len(t), 1))
        best = max(range(n), key=ms.__getitem__)
        fit = ms[best] - own[best] if t else 0.0
        unmodelled = tag is not None and tag not in known
        if t and unmodelled and fit <= -spread:
            result.append((tag, 0.0))
        elif t and (unmodelled or fit > -(language_id.MISFIT + spread)):
            result.append((known[post.index(confidence)], confidence))
        else:
            result.append((language_id.UNKNOWN, confidence))
    return result
