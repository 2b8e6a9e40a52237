"""Heads, folds and curves against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import heads

SCHEMA = "id long, grp long, x array<double>, y array<int>"


def fit(x, t, by, c, prior=None):
    """Weights of one head by plain Newton steps over all rows."""
    a = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, ridge = np.zeros(a.shape[1]), np.append(np.full(x.shape[1], 1 / c), 1e-12)
    for _ in range(40):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (by * p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (by * (p - t)) + ridge * w)
    return w


def plain(x, y, fold, folds, c):
    n, k = y.shape
    margin, score = np.full((n, k), np.nan), np.full((n, k), np.nan)
    for f in range(folds):
        for h in range(k):
            use = (fold != f) & ~np.isnan(y[:, h])
            t = y[use, h]
            if 0 < t.sum() < len(t):
                by = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (len(t) - t.sum())))
                w = fit(x[use], t, by, c)
                margin[fold == f, h] = x[fold == f] @ w[:-1] + w[-1]
    for f in range(folds):
        for h in range(k):
            use = (fold != f) & ~np.isnan(y[:, h]) & ~np.isnan(margin[:, h])
            pos = (y[(fold != f), h] == 1).sum()
            neg = (y[(fold != f), h] == 0).sum()
            z, t = margin[use, h], np.where(y[use, h] == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
            a = np.stack([z, np.ones(len(z))], 1)
            v = np.array([1.0, 0.0])
            for _ in range(60):
                p = 1 / (1 + np.exp(-a @ v))
                v -= np.clip(np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(2), a.T @ (p - t)), -4, 4)
            score[fold == f, h] = 1 / (1 + np.exp(-(v[0] * margin[fold == f, h] + v[1])))
    return score


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4))
    y = np.stack([(x[:, 0] + 0.7 * rng.normal(size=300) > 0), (x[:, 1] - x[:, 2] + rng.normal(size=300) > 1), rng.random(300) < 0.3, np.zeros(300, bool)], 1).astype(int)
    told = [(n, n // 3, list(map(float, a)), [int(v) if rng.random() < 0.95 else None for v in b]) for n, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame([*told, (900, 1, None, [1, 0, 0, 0]), (901, 1, [1.0] * 4, None)], SCHEMA).repartition(5)


def test_scores_and_auc_equal_numpy(spark, rows):
    got = heads.out_of_fold_scores(rows, group="grp", folds=4, steps=30).collect()
    own = heads.folded(rows.where("x is not null and y is not null"), "grp", 4).orderBy("id").collect()
    assert len(got) == 4 * len(own) == 1200
    x, fold = np.array([r["x"] for r in own]), np.array([r["fold"] for r in own])
    y = np.array([[np.nan if v is None else v for v in r["y"]] for r in own], float)
    groups = {}
    for r in own:
        groups.setdefault(r["grp"], set()).add(r["fold"])
    assert all(len(f) == 1 for f in groups.values()) and len(set(fold.tolist())) == 4
    want = plain(x, y, fold, 4, heads.C)
    for r in got:
        w = want[r["id"], r["head"]]
        assert (r["score"] is None and np.isnan(w)) or abs(r["score"] - w) < 1e-4
        assert r["fold"] == fold[r["id"]]
    auc = {r["head"]: r["auc"] for r in heads.cv_auc(heads.out_of_fold_scores(rows, group="grp", folds=4)).collect()}
    for h in range(3):
        use = ~np.isnan(y[:, h])
        p, q = want[use & (y[:, h] == 1), h], want[use & (y[:, h] == 0), h]
        assert auc[h] == pytest.approx(np.mean((p[:, None] > q) + 0.5 * (p[:, None] == q)), abs=2e-3)
    assert auc.get(3) is None and auc[0] > 0.85 and auc[1] > 0.8 and 0.35 < auc[2] < 0.65


def test_no_rows_and_ties(spark, rows):
    assert heads.out_of_fold_scores(rows.limit(0), group="grp").count() == 0
    told = spark.createDataFrame([(0, 0.5, 1.0), (0, 0.5, 0.0), (0, 0.9, 1.0), (0, 0.1, None), (1, 0.4, 1.0), (2, None, 1.0)], "head int, score double, label double")
    assert {r["head"]: (r["n"], r["auc"]) for r in heads.cv_auc(told).collect()} == {0: (3, 0.75), 1: (1, None)}
