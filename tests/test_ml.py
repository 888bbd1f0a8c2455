"""Feature names of explanations, and the halving of trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans import ml


def rows(spark, n=240):
    return spark.range(n).select((F.col("id") % 7).cast("string").alias("supplier"), (F.col("id") % 11).cast("double").alias("quantity"), (F.xxhash64("id") % 50).cast("double").alias("price"), F.when(F.col("id") % 3 == 0, "A").otherwise("R").alias("flag"), F.lit("O").alias("status"), (F.col("id") % 11 * 2.0 + F.when(F.col("id") % 3 == 0, 9.0).otherwise(0.0)).alias("discount"))


def test_explanations_name_their_features(spark):
    model = ml.pipeline().fit(rows(spark))
    assert ml.feature_names(model) == ["quantity", "price", "flag=A", "flag=R", "status=O"]
    top = {f["feature"] for r in ml.explain(model, rows(spark), 2).collect() for f in r.top_features}
    assert top <= {"quantity", "flag=A", "flag=R"} and "quantity" in top


def test_trials_are_halved_on_growing_shares(spark):
    train, valid = ml.split(rows(spark))
    trials = [(0.0, 0.0), (50.0, 0.0), (0.0, 0.1), (0.0, 100.0)]
    done = ml.successive_halving(train, valid, trials)
    rungs = [[(l1, l2) for r, l1, l2, _ in done if r == n] for n in range(3)]
    assert [len(r) for r in rungs] == [4, 2, 1] and set(rungs[2]) <= set(rungs[1]) <= set(trials)
    assert rungs[2] == [(0.0, 0.0)]
    first = {(l1, l2): mae for r, l1, l2, mae in done if r == 0}
    assert max(first[t] for t in rungs[1]) <= min(first[t] for t in trials if t not in rungs[1])
