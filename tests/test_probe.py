"""The probe against a plain TF-IDF of all n-grams."""

import random

import numpy as np
from pyspark.sql import functions as F

from tallyloom.operators import heads, probe


def test_auc_equals_a_plain_probe(spark):
    rng = random.Random(1)
    words = [["saban", "merta", "lokin", "fadu"], ["merta", "lokin", "vexor", "fadu"]]
    rows = [(n, " ".join(rng.choice(words[n % 2]) for _ in range(3)), n % 2) for n in range(180)]
    df = spark.createDataFrame(rows, "id long, text string, label int").repartition(3)
    got = probe.generator_probe(df, folds=3).collect()[0]
    fold = {r["id"]: r["fold"] for r in heads.folded(df, "id", 3).collect()}
    grams = [[t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)] for _, t, _ in rows]
    names = {g: k for k, g in enumerate(sorted({g for own in grams for g in own}))}
    tf = np.zeros((len(rows), len(names)))
    for k, own in enumerate(grams):
        for g in own:
            tf[k, names[g]] += 1
    y, f, score = np.array([r[2] for r in rows]), np.array([fold[r[0]] for r in rows]), np.zeros(len(rows))
    for k in range(3):
        seen = f != k
        df_ = (tf[seen] > 0).sum(0)
        x = tf * np.where(df_ > 0, np.log((seen.sum() + 1) / (df_ + 1)), 0)
        x /= np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-12)
        a, w = np.concatenate([x, np.ones((len(x), 1))], 1), np.zeros(len(names) + 1)
        ridge = np.append(np.full(len(names), probe.RIDGE * seen.sum()), 1e-9)
        for _ in range(25):
            p = 1 / (1 + np.exp(-a[seen] @ w))
            w -= np.linalg.solve((a[seen] * (p * (1 - p))[:, None]).T @ a[seen] + np.diag(ridge), a[seen].T @ (p - y[seen]) + ridge * w)
        score[~seen] = a[~seen] @ w
    p, q = score[y == 1], score[y == 0]
    want = np.mean((p[:, None] > q) + 0.5 * (p[:, None] == q))
    assert got["n"] == 180 and 0.8 < want < 0.999 and abs(got["auc"] - want) < 0.01


def test_texts_without_a_difference_and_without_letters(spark):
    df = spark.createDataFrame([(n, t, n % 2) for n, t in enumerate(["", None, "same", "same", "x", "x"] * 10)], "id long, text string, label int")
    assert abs(probe.generator_probe(df.withColumn("label", F.col("id") % 2)).collect()[0]["auc"] - 0.5) < 0.2
    assert probe.probe_scores(df.withColumn("label", F.lit(1))).where("score is not null").count() == 0
    assert probe.probe_scores(df.limit(0)).count() == 0
