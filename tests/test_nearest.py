"""Nearest rows, block by block."""

import math
import random

import pytest

from tallyloom.operators import vectors


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ASKED", 4)
    monkeypatch.setattr(vectors, "ROWS", 16)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(70)]
    rows += [(100 + i, rows[i % 10][1]) for i in range(30)] + [(200, [0.0] * 8), (201, None), (202, [1.0, None] * 4), (203, [1.0] * 3), (204, [float("nan")] * 8), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = vectors.nearest(df, df.where("vec_id % 10 = 0"))
    got = {}
    for r in found.collect():
        got[(r["query_id"], r["rank"])] = (r["id"], r["score"])

    def score(q, v):
        if q is None or v is None or None in q or None in v or len(q) != len(v):
            return None
        dot = norm = size = 0.0
        for x, y in zip(q, v):
            dot, norm, size = dot + x * y, norm + x * x, size + y * y
        return dot / (max(math.sqrt(size), 1e-12) * max(math.sqrt(norm), 1e-12)) if not math.isnan(dot) else math.nan

    have = dict(r for r in rows if r[0] is not None)
    for q in [i for i in have if i % 10 == 0]:
        all_ = [(i, score(have[q], v)) for i, v in have.items() if i != q]
        all_.sort(key=lambda t: (2, 0, t[0]) if t[1] is None else (0, 0, t[0]) if math.isnan(t[1]) else (1, -t[1], t[0]))
        for rank, (i, s) in enumerate(all_[:5], 1):
            told, value = got[(q, rank)]
            assert told == i and (value is None if s is None else value == pytest.approx(s, nan_ok=True))
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()
