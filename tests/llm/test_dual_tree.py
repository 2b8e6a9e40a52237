import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException

from tallyloom.llm import dual_tree

DIM = 4


def plain(rows, k, rounds, seed=2):
    """Lloyd's rounds in whole numbers, row by row."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == DIM and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, g in groups.items():
            cents[n] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    return sorted(((i, *near(v)[::-1]) for i, v in kept), key=str)


@pytest.mark.parametrize("kind", ["clumps", "ties", "wide"])
def test_equals_plain_rounds(spark, kind):
    rng = np.random.default_rng(5)
    n = 300
    points = {"clumps": rng.normal(size=(6, DIM))[rng.integers(6, size=n)] * 9 + rng.normal(size=(n, DIM)) * 0.1, "ties": rng.integers(-2, 3, size=(n, DIM)) / 64, "wide": rng.normal(size=(n, DIM)) * 1e4}[kind]
    rows = [(i, v) for i, v in enumerate(points.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = dual_tree.clustered(df, k=7, rounds=3, dim=DIM).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == plain(rows, 7, 3)
    by = {}
    for r in got:
        by[r["cluster"]] = by.get(r["cluster"], 0) + r["distance"]
    assert all(r["cluster_inertia"] == by[r["cluster"]] and r["inertia"] == sum(by.values()) for r in got)


def test_hot_copies_bad_vectors_and_repeated_ids(spark):
    rows = [(i, [0.25, 0.5, -0.25, 1.0]) for i in range(150)] + [(7, [float(i), 0.0, 0.0, 0.0]) for i in range(20)]
    rows += [(None, [1.0, 1.0, 1.0, 1.0]), (900, None), (901, [1.0]), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan"), 0.0, 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as cluster", "1 as V")
    got = dual_tree.clustered(df, k=5, rounds=2, dim=DIM).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == plain(rows, 5, 2)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert dual_tree.clustered(spark.createDataFrame([], schema), dim=DIM).count() == 0
    got = dual_tree.clustered(spark.createDataFrame([(3, [1.0, 2.0, 3.0, 4.0])], schema), dim=DIM).collect()
    assert [(r["vec_id"], r["cluster"], r["distance"]) for r in got] == [(3, 0, 0)]
    with pytest.raises(PySparkException):
        dual_tree.clustered(spark.createDataFrame([(3, [1e9, 2.0, 3.0, 4.0])], schema), dim=DIM)


def test_tree_covers_and_prunes():
    rng = np.random.default_rng(1)
    points = (rng.normal(size=(8, 6))[rng.integers(8, size=2000)] * 1000 + rng.normal(size=(2000, 6)) * 9).astype(np.int64)
    tree = dual_tree.CoverTree(points)
    for (centre, lo, hi, first, n), radius in zip(tree.nodes, tree.radius, strict=True):
        away = np.sqrt(dual_tree.squared(tree.points[lo:hi], tree.points[centre : centre + 1]))
        assert away.max() <= radius and (n == 0 or [tree.nodes[first, 1], tree.nodes[first + n - 1, 2]] == [lo, hi])
        if n:
            apart = dual_tree.squared(tree.points[tree.nodes[first : first + n, 0]], tree.points[tree.nodes[first : first + n, 0]])
            assert 4 * apart[~np.eye(n, dtype=bool)].min() > (radius * (1 - 1e-6)) ** 2 * 0.999
    cents = points[:40]
    walk = dual_tree.Walk(tree.points, tree.nodes, tree.radius, dual_tree.CoverTree(cents, leaf=1))
    assert (walk.owner == dual_tree.squared(tree.points, cents).argmin(1)).all()
    assert walk.compared < 0.5 * 2000 * 40


def test_op13_equals_its_sql(spark):
    where = "/root/testdata/sf0.001"
    got = sorted(map(tuple, dual_tree.op13_dual_tree(spark, where).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{where}/embeddings.parquet'")
    assert got == sorted(con.execute(dual_tree.SQL).fetchall())
