"""Density clusters against a plain version that knows all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import density, linking


def plain(ids, x, least):
    """The tree of all merges, from all distances, condensed from above; equal weights in order of ids."""
    x = np.asarray(x, float)
    n = len(x)
    least = max(2, min(least, n))
    d = density.distances(x, x)
    core = np.sort(d, axis=1)[:, min(least, n - 1)]
    edges = sorted((max(d[i, j], core[i], core[j]), *sorted((ids[i], ids[j]))) for i in range(n) for j in range(i))
    group = {i: ("leaf", i) for i in ids}
    for w, a, b in edges:
        if group[a] is not group[b]:
            tree = ("node", w, group[a], group[b])
            for i in leaves(tree):
                group[i] = tree
    return condensed(group[ids[0]], least, ids)


def leaves(tree):
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        if t[0] == "leaf":
            out.append(t[1])
        else:
            todo += t[2:]
    return out


def condensed(tree, least, ids):
    def best(t, birth, root):
        """Worth and clusters of a subtree: follows the side that stays large, and divides where both do."""
        own, size = 0.0, len(leaves(t))
        at, left = t, size
        while True:
            if at[0] == "leaf":
                return own, [leaves(t)]
            lam = 1 / max(at[1], density.LEAST)
            sizes = [len(leaves(s)) for s in at[2:]]
            large = [s for s, k in zip(at[2:], sizes, strict=True) if k >= least]
            if len(large) == 2:
                own += left * (lam - birth)
                parts = [best(s, lam, False) for s in large]
                worth = sum(p[0] for p in parts)
                if root or worth > own:
                    return worth, parts[0][1] + parts[1][1]
                return own, [leaves(t)]
            if not large:
                own += left * (lam - birth)
                return (own, []) if root else (own, [leaves(t)])
            gone = min(sizes)
            own += gone * (lam - birth)
            left -= gone
            at = large[0]

    found = best(tree, 0.0, True)[1]
    label = dict.fromkeys(ids, -1)
    for k, members in enumerate(sorted(found, key=min)):
        label.update(dict.fromkeys(members, k))
    return label


def run(spark, ids, x, **more):
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    return {r["id"]: r["cluster"] for r in density.clusters(df, **more).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_hierarchy(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, size=(n, 2)) for c, s, n in (((0, 0), 0.3, 30), ((4, 0), 0.5, 25), ((4, 2), 0.2, 12), ((0, 9), 1.5, 20), ((5, 5), 4, 12))])
    ids = rng.permutation(len(x)).tolist()
    want = plain(ids, x, 5)
    assert len(set(want.values())) > 3
    assert run(spark, ids, x, least=5, neighbours=len(x)) == want
    if seed:
        assert run(spark, ids, x, least=5, neighbours=len(x), most=30) == want  # several slices


def test_embeddings_equal_plain_hierarchy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 150").orderBy("vec_id").collect()
    ids, x = [r["vec_id"] for r in rows], [r["embedding"] for r in rows]
    for least in (3,):
        assert run(spark, ids, x, least=least, neighbours=len(x)) == plain(ids, x, least)


def test_parts_copies_and_rows_without_vectors(spark):
    rng = np.random.default_rng(9)
    x = [*rng.normal(0, 0.1, size=(12, 3)), *rng.normal(50, 0.1, size=(12, 3)), *[[7.0, 7.0, 7.0]] * 20]
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (3, [50.0, 50.0, 50.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as cluster", "1 as node")
    got = density.clusters(df, least=4, neighbours=4).collect()
    label = {r["id"]: r["cluster"] for r in got}
    assert len(got) == len(rows)
    assert len({label[i] for i in range(4, 12)} | {label[0]}) == 1 and len({label[i] for i in range(12, 24)}) == 1 and len({label[i] for i in range(24, 44)}) == 1
    assert len({label[0], label[12], label[24]}) == 3 and min(label[i] for i in (0, 12, 24)) >= 0
    assert all(label[i] == -1 for i in (100, 101, 102, 103)) and label[3] == label[0]


def test_few_rows(spark):
    assert run(spark, [], np.zeros((0, 2))) == {}
    assert run(spark, [5], [[1.0, 2.0]]) == {5: -1}
    assert run(spark, [5, 6], [[1.0, 2.0], [1.0, 3.0]]) == {5: -1, 6: -1}


def test_leaves_find_near_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 8))
    points = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "node long, v array<double>")
    found = {(r["a"], r["b"]) for r in density.near_graph(points, 5, leaf=200).collect()}
    d = density.distances(x, x)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:5]}
    assert len(found & want) > 0.9 * len(want) and len(found) == len(want)


@pytest.mark.parametrize("kind", ["plain", "grid", "far", "few"])
def test_nearest_within_equals_all_distances(kind):
    """Candidates by a product of matrices: the same neighbours, ties and distances to the last bit, also where the product tells nothing."""
    rng = np.random.default_rng(6)
    x = {"plain": rng.normal(size=(400, 64)), "grid": rng.integers(0, 3, size=(400, 4)).astype(float), "far": 1e9 + rng.normal(size=(300, 5)), "few": rng.normal(size=(9, 3))}[kind]
    d = density.distances(x, x)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :12][:, : len(x) - 1]
    near, got = density.nearest_within(x, 12)
    assert (near == want).all() and (got == np.take_along_axis(d, want, 1)).all()


def test_leaves_stream_through_partitions(spark):
    """A partition has a few leaves; no task gathers groups, and no row is made for a pair that a nearer one of another leaf displaces."""
    points = spark.createDataFrame([(i, [float(i % 37), float(i)]) for i in range(900)], "node long, v array<double>")
    graph = density.near_graph(points, 3, leaf=50)
    plan = graph._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "FlatMapGroups" not in plan and graph.rdd.getNumPartitions() == -(-900 * density.TREES // (density.LEAVES * 50))
    rows = graph.collect()
    assert len(rows) == len({(r["a"], r["b"]) for r in rows}) == 2700


def test_overlay_takes_density_clusters(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.1, size=(10, 2)) + 1, rng.normal(9, 0.1, size=(30, 2))])
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    label = df.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("component"))
    got = {r["id"]: r["component"] for r in linking.merge_overlay(label, density.clusters(df, least=5)).collect()}
    assert {got[i] for i in range(10)} == {0} and [got[i] for i in range(10, 40)] == list(range(10, 40))  # more than half of all rows join nothing
