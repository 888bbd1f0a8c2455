"""Quality classifier: Bradley-Terry pairwise ranking over text features.

The model gives every document a worth; the probability that a good document
beats a poor one is the logistic function of the difference of their worths.
The worth is linear in features of the text, so fitting it is a logistic
regression on feature differences of (good, poor) pairs. The threshold is the
quantile of the training worths at the share of poor labels, and the score is a
logistic curve that passes ``CUT`` there.

Labels are read only for the fit, from every labelled document outside the
held-out fold. Each poor document counts as ``PAIRS_A_POOR`` pairs. Where the
pairs of all (``fit``) would fit no machine, documents are dealt by a hash into
blocks of about ``BLOCK`` good and ``BLOCK`` poor ones; in a block every poor one
meets every good one, with weights that sum to those pairs. The scarcer kind is
in as many blocks as the other needs, so no labelled document is left out.
Features are computed once and kept in the shared folder; a Newton step sums
one gradient and one curvature a partition, which is all that the driver sees
beside the model. The threshold is an exact quantile of all training worths.
Scoring is one pass over the whole texts without a shuffle.

Defined results: null text counts as empty, empty texts get the score of an
all-zero feature row; null doc_ids are not held out; repeated rows are scored
alike; without labels of both kinds every worth is zero and every score is
``CUT``; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import reliable_checkpoint
from millrace.operators.selection import exact_quantile

BLOCK = 1024
PAIRS_A_POOR = 24
STEPS = 40
RIDGE = 1.0
CUT = 0.3
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t",
    "line": b"\n",
    "stop": b".",
    "comma": b",;:",
    "shout": b"!?",
    "bar": b"|",
    "symbol": b"#$%&*@^~+=<>/\\_",
    "bracket": b"()[]{}",
    "quote": b"\"'`-",
}
_MASKS = np.zeros((256, len(CLASSES) + 1))
for _i, _chars in enumerate(CLASSES.values()):
    _MASKS[list(_chars), _i] = 1
_MASKS[128:, -1] = 1
N_FEATURES = 2 * (len(CLASSES) + 1) + 9


def features(texts: list[str]) -> np.ndarray:
    """One row of N_FEATURES numbers for each whole text."""
    out = np.zeros((len(texts), N_FEATURES))
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
        share = counts @ _MASKS / len(raw)
        words, lines = text.split(), text.split("\n")
        n_words, distinct = max(1, len(words)), len(set(words))
        filled = counts[counts > 0] / len(raw)
        capital = sum(map(str.isupper, words)) / n_words
        n = len(share)
        row[:n] = share
        row[n : 2 * n] = np.sqrt(share)
        row[2 * n :] = (
            np.log1p(len(raw)),
            np.log1p(len(words)),
            len(raw) / n_words / 10,
            distinct / n_words,
            len(set(lines)) / len(lines),
            np.log1p(len(raw) / len(lines)),
            -(filled * np.log(filled)).sum(),
            capital,
            float(len(words) == 0),
        )
    return out


def held_out(doc: Column) -> Column:
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class BradleyTerry:
    """Weights over standardised features, and the worth at which the score is CUT."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float):
        self.mean, self.scale, self.weights, self.threshold = mean, scale, weights, threshold

    def score(self, x: np.ndarray) -> np.ndarray:
        worth = ((x - self.mean) / self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(worth + np.log(CUT / (1 - CUT)), -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, seed: int = 5) -> BradleyTerry:
    if not len(x) or good.all() or not good.any():
        return BradleyTerry(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    poor, fine = np.flatnonzero(~good), np.flatnonzero(good)
    difference = z[rng.choice(fine, len(poor) * PAIRS_A_POOR)] - z[np.repeat(poor, PAIRS_A_POOR)]
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps on the ridge-penalised logistic loss of the differences
        p = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
        gradient = difference.T @ p - RIDGE * w
        hessian = (difference * (p * (1 - p))[:, None]).T @ difference + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    worth = z @ w
    return BradleyTerry(mean, scale, w, float(np.quantile(worth, (~good).mean())))


def _with_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": list(features([t or "" for t in pdf["text"]]))})


def _blocks(rows: DataFrame, n_good: int, n_poor: int, block: int) -> DataFrame:
    """A row a block: its documents' features, kinds, and shares (1 / the number of blocks a document is in)."""
    groups = [max(1, -(-n // block)) for n in (n_good, n_poor)]
    n_blocks = max(groups)
    group = F.when(F.col("good"), groups[0]).otherwise(groups[1])
    met = F.sequence(F.pmod(F.xxhash64(F.lit(29), "doc_id"), group), F.lit(n_blocks - 1).cast("long"), group.cast("long"))
    dealt = rows.withColumn("met", met).select(F.explode("met").alias("block"), "x", "good", (1 / F.size("met")).alias("share"))
    one = F.array_sort(F.collect_list(F.struct("good", "x", "share")))  # sums do not depend on the order of arrival
    return dealt.groupBy("block").agg(one.alias("rows")).select("rows").mapInPandas(_packed, "x binary, good binary, share binary")


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for rows in pdf["rows"]:
            x, good, share = np.array([r["x"] for r in rows]), np.array([r["good"] for r in rows], bool), np.array([r["share"] for r in rows])
            yield pd.DataFrame({"x": [x.tobytes()], "good": [good.tobytes()], "share": [share.tobytes()]})


def _matrices(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for x, good, share in zip(pdf["x"], pdf["good"], pdf["share"], strict=True):
        yield np.frombuffer(x).reshape(-1, N_FEATURES), np.frombuffer(good, bool), np.frombuffer(share)


def _summed(blocks: DataFrame, size: int, of_block) -> np.ndarray:
    """The sum of ``of_block`` (features, kinds, shares) over all blocks, a row a partition, added in the partitions' order."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, met = np.zeros(size), False
        for pdf in batches:
            for block in _matrices(pdf):
                total, met = total + of_block(*block), True
        if met:
            yield pd.DataFrame({"sums": [total]})

    found = blocks.mapInPandas(sums, "sums array<double>").collect()
    return np.sum([r["sums"] for r in found], axis=0) if found else np.zeros(size)


def _step(z: np.ndarray, good: np.ndarray, share: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of all pairs of a block, each poor one's pairs weighing ``PAIRS_A_POOR`` times its share."""
    fine, poor, n = z[good], z[~good], z.shape[1]
    if not len(fine) or not len(poor):
        return np.zeros(1 + n + n * n)
    margin = (fine @ w)[:, None] - (poor @ w)[None, :]
    weight = share[good][:, None] * (PAIRS_A_POOR * share[~good] / share[good].sum())[None, :]
    p = 1 / (1 + np.exp(np.clip(margin, -30, 30)))
    loss = (weight * np.logaddexp(0, -margin)).sum()
    first, second = weight * p, weight * p * (1 - p)
    gradient = fine.T @ first.sum(1) - poor.T @ first.sum(0)
    cross = fine.T @ second @ poor
    curvature = (fine * second.sum(1)[:, None]).T @ fine + (poor * second.sum(0)[:, None]).T @ poor - cross - cross.T
    return np.concatenate(([loss], gradient, curvature.ravel()))


def fit_blocks(blocks: DataFrame, rows: DataFrame, n_good: int, n_poor: int) -> BradleyTerry:
    """``fit`` over blocks: Newton steps, halved where the loss would grow."""
    n, k = n_good + n_poor, N_FEATURES
    mean = _summed(blocks, k, lambda x, good, share: share @ x) / n
    scale = np.sqrt(_summed(blocks, k, lambda x, good, share: share @ (x - mean) ** 2) / n)
    scale[scale < 1e-9] = 1

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = _summed(blocks, 1 + k + k * k, lambda x, good, share: _step((x - mean) / scale, good, share, w))
        return s[0] + RIDGE * w @ w / 2, s[1 : 1 + k] - RIDGE * w, s[1 + k :].reshape(k, k) + RIDGE * np.eye(k)

    w = np.zeros(k)
    loss, gradient, curvature = sums(w)
    step = np.linalg.solve(curvature, gradient)
    for _ in range(STEPS):
        new_loss, new_gradient, new_curvature = sums(w + step)
        if new_loss > loss * (1 + 1e-12):
            step = step / 2
            continue
        w, loss = w + step, new_loss
        step = np.linalg.solve(new_curvature, new_gradient)
        if np.abs(step).max() < 1e-8:
            break
    model = BradleyTerry(mean, scale, w, 0.0)
    worth = F.pandas_udf(lambda x: pd.Series(((np.stack(x.to_list()) - mean) / scale) @ w), "double")
    worths = rows.select(F.lit(0).alias("all"), worth("x").alias("worth"))
    model.threshold = float(exact_quantile(worths, ["all"], "worth", n_poor / n).first()["quantile"])
    return model


def train(docs: DataFrame, labels: DataFrame, *, block: int = BLOCK) -> BradleyTerry:
    """Fit on all labelled rows outside the held-out fold."""
    usable = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    featured = known.mapInPandas(_with_features, "doc_id long, x array<double>")  # before the join: no text is shuffled
    labelled = featured.join(usable.select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id")
    rows = reliable_checkpoint(labelled.groupBy("doc_id").agg(F.min(F.struct("x", "good")).alias("r")).select("doc_id", "r.*"))  # one row an id, however often it repeats
    n, n_good = rows.agg(F.count(F.lit(1)), F.count_if("good")).first()
    if n_good in (0, n):
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0, bool))
    return fit_blocks(reliable_checkpoint(_blocks(rows, n_good, n - n_good, block)), rows, n_good, n - n_good)


def scored(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(features([t or "" for t in texts])))

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.pandas_udf(score, "double")("text").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def query(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
