"""Clusters of vectors by density: a hierarchy of what stays together as distances grow, of which the most stable clusters are taken.

Distances are mutual reachabilities over a graph of near neighbours: at least the distance to each end's k-th neighbour. Borůvka's rounds give the graph's minimum spanning forest. Its edges, in order of
weight, are cut into slices of a bounded number; a slice merges the groups that the lighter ones left, which are known by a few sums each, so no task holds more than a slice, whatever the
shape of the forest. Copies of one vector are a node with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.linking import aside, components
from tallyloom.operators.places import with_place
from tallyloom.sources.shared import drop_but, written, written_tables

#: Rows of a leaf, in which all distances are computed, and how many ways the rows are dealt to leaves.
LEAF, TREES = 1024, 12
#: Leaves of a partition, about.
LEAVES = 8
#: Edges that one task merges.
SLICE = 200_000
#: Distances below this count as this.
LEAST = 1e-12


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of each row of x to each of y; the same whichever way round."""
    return np.stack([np.sqrt(((y - row) ** 2).sum(1)) for row in x]) if len(x) else np.zeros((0, len(y)))


def nearest_within(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest other rows of each row of x, ties to the earlier, and their distances().

    A product of matrices tells a few more than k that may be nearest; their distances decide, where the product's error can't have left out any other row, and else those of all rows.
    """
    n, few = len(x), min(k, len(x) - 1) + 8
    k = min(k, n - 1)
    if k < 1 or few >= n - 1:
        d = distances(x, x)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        return near, np.take_along_axis(d, near, 1)
    with np.errstate(all="ignore"):
        sq = (x * x).sum(1)
        about = sq[:, None] + sq - 2 * (x @ x.T)
        np.fill_diagonal(about, np.inf)
        near = np.argpartition(about, few - 1, axis=1)[:, :few]
        least = np.take_along_axis(about, near[:, -1:], 1)[:, 0] - 4 * (x.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(sq) + np.sqrt(sq.max())) ** 2  # of the squares of all other rows
        near.sort(axis=1)
        d = np.sqrt(((x[near] - x[:, None]) ** 2).sum(2))
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
        unsure = np.flatnonzero(~(least > d[:, -1] ** 2 * (1 + 1e-12)))
    for i in unsure:
        every = distances(x[i : i + 1], x)[0]
        every[i] = np.inf
        near[i] = np.argsort(every, kind="stable")[:k]
        d[i] = every[near[i]]
    return near, d


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def near_graph(points: DataFrame, k: int, leaf: int = LEAF, trees: int = TREES, seed: int = 1) -> DataFrame:
    """a, b, d: the k nearest nodes b of each node a of points (node: a whole number, v), ties to the smaller.

    Exact where all points fit into one leaf. Else points are dealt to leaves several times, each time by the side of random planes through their mean on which they lie; a bucket that is
    too large is cut along one more direction. The nearest of all leaves of a point are taken. Sorted rows stream through tasks, in partitions of a few leaves each: first leaf by leaf, then node by node.
    """
    n = points.count()
    bits = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
    wide = len((points.select("v").first() or [[]])[0])
    rows = points.select(F.col("node").cast("long").alias("node"), "v")
    if bits:
        means = points.select(F.posexplode("v").alias("j", "x")).groupBy("j").agg(F.avg("x").alias("m")).orderBy("j").collect()
        mean = np.array([r["m"] for r in means])
        planes = np.random.default_rng(seed).normal(size=(trees, bits + 1, len(mean)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _vectors(batch.column(1), wide) - mean
                for t in range(trees):
                    side = v @ planes[t].T
                    code = ((side[:, :bits] > 0) << np.arange(bits)).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t)), pa.array(code.astype(np.int64)), pa.array(side[:, bits]), batch.column(0), batch.column(1)], names=["tree", "code", "at", "node", "v"])

        dealt = rows.mapInArrow(deal, "tree long, code long, at double, node long, v array<double>")
    else:
        dealt = rows.select(F.lit(0).cast("long").alias("tree"), F.lit(0).cast("long").alias("code"), F.lit(0.0).alias("at"), "node", "v")

    def met(nodes: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(nodes)
        nodes = nodes[order]
        near, d = nearest_within(x[order], k)
        ends = pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * near.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.ListArray.from_arrays(ends, pa.array(nodes[near].ravel())), pa.ListArray.from_arrays(ends, pa.array(d.ravel()))], names=["a", "b", "d"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, nodes, x = None, np.zeros(0, np.int64), np.zeros((0, wide))
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, code, own = (batch.column(c).to_numpy() for c in range(3))
            v = _vectors(batch.column(3), wide)
            cuts = [0, *(np.flatnonzero((np.diff(tree) != 0) | (np.diff(code) != 0)) + 1).tolist(), len(own)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if of is not None and of != (tree[i], code[i]):
                    yield met(nodes, x)
                    nodes, x = nodes[:0], x[:0]
                of = tree[i], code[i]
                nodes, x = np.concatenate([nodes, own[i:j]]), np.concatenate([x, v[i:j]])
                while len(nodes) > leaf:
                    yield met(nodes[:leaf], x[:leaf])
                    nodes, x = nodes[leaf:], x[leaf:]
        if of is not None:
            yield met(nodes, x)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, d = held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            if not batch.num_rows:
                continue
            own, (b, d) = batch.column(0).to_numpy(), (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
            more = np.repeat(own, np.diff(batch.column(1).offsets.to_numpy())), b, d
            a, b, d = (np.concatenate(c) for c in zip(held, more, strict=True))
            last = a == own[-1]  # may go on in the next batch
            held = [c[last] for c in (a, b, d)]
            yield first(*(c[~last] for c in (a, b, d)))
        yield first(*held)

    def first(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((b, d, a))
        a, b, d = a[order], b[order], d[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, d = a[new], b[new], d[new]
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        return pa.RecordBatch.from_arrays([pa.array(c[nth < k]) for c in (a, b, d)], names=["a", "b", "d"])

    parts = max(1, math.ceil(n * (trees if bits else 1) / (LEAVES * leaf)))
    found = dealt.repartition(parts, "tree", "code").sortWithinPartitions("tree", "code", "at", "node").select("tree", "code", "node", "v").mapInArrow(meet, "a long, b array<long>, d array<double>")
    return found.repartition(parts, "a").sortWithinPartitions("a").mapInArrow(best, "a long, b long, d double")


def reachable(points: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """a, b (a < b), w: the graph's edges by mutual reachability. points: node, weight. A node's own copies count as neighbours."""
    n = points.count()
    weight, own = (aside(points.select(F.col("node").alias(c), F.col("weight").alias(f"w{c}")), n) for c in "ba")
    met = near.join(weight, "b").join(own, "a")
    before = F.sum("wb").over(Window.partitionBy("a").orderBy("d", "b").rowsBetween(Window.unboundedPreceding, 0)) + F.col("wa") - 1
    enough = met.withColumn("held", before).groupBy("a").agg(F.min(F.when(F.col("held") >= k, F.col("d"))).alias("kth"), F.max("d").alias("far"), F.first("wa").alias("wa"))
    core = enough.select(F.col("a").alias("node"), F.when(F.col("wa") > k, F.lit(0.0)).otherwise(F.coalesce("kth", "far")).alias("core"))
    edges = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").dropDuplicates(["a", "b"])
    core = written(core, "core")
    ends = [aside(core.select(F.col("node").alias(c), F.col("core").alias(f"core_{c}")), n) for c in "ab"]
    return edges.join(ends[0], "a").join(ends[1], "b").select("a", "b", F.greatest("d", "core_a", "core_b").alias("w"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b, w) of the minimum spanning forest, equal weights in order of a and b. By Borůvka: each round every group takes its lightest edge, so at least half of the groups go."""
    before, taken = written_tables(), []
    now = written(edges.select(F.col("a").alias("ga"), F.col("b").alias("gb"), F.struct("w", "a", "b").alias("e")), "forest-edges")
    while not now.isEmpty():
        both = [now.select(F.col(end).alias("g"), F.struct("e", "ga", "gb").alias("m")) for end in ("ga", "gb")]
        light = both[0].unionByName(both[1]).groupBy("g").agg(F.min("m").alias("m"))
        chosen = written(light.select("m.ga", "m.gb", "m.e").dropDuplicates(), "forest-chosen")
        taken.append(chosen)
        label = components(chosen.select(F.col("ga").alias("a"), F.col("gb").alias("b")))
        n = label.count()
        ends = [aside(label.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")), n) for c in ("ga", "gb")]
        moved = now.join(ends[0], "ga").join(ends[1], "gb").where("c_ga <> c_gb")
        pair = moved.select(F.least("c_ga", "c_gb").alias("ga"), F.greatest("c_ga", "c_gb").alias("gb"), "e")
        now = written(pair.groupBy("ga", "gb").agg(F.min("e").alias("e")), "forest-edges")
    if not taken:
        return edges.limit(0)
    whole = taken[0]
    for more in taken[1:]:
        whole = whole.unionByName(more)
    found = written(whole.select("e.a", "e.b", "e.w"), "forest")
    drop_but(edges.sparkSession, before, found)
    return found


class Merging:
    """Groups of a slice and what is known of each: size, sum of its points' densities when they leave, what its parts are worth, and its cluster if it is large enough to be one."""

    def __init__(self, least: int) -> None:
        self.least = least
        self.up: dict[int, int] = {}
        self.state: dict[int, tuple[int, float, float, str | None]] = {}
        self.small: dict[int, list[int]] = {}  # what the groups that are no cluster were at the slice's start
        self.left: list[tuple[int, str]] = []  # such a group, and the cluster that it became a part of
        self.ended: list[tuple[str, str, bool]] = []  # cluster, the one that it became a part of, and whether it is worth as much as its own parts

    def know(self, group: int, size: int, total: float, parts: float, cluster: str | None) -> None:
        if group not in self.up:
            self.up[group], self.state[group] = group, (size, total, parts, cluster)
            if cluster is None:
                self.small[group] = [group]

    def find(self, group: int) -> int:
        while self.up[group] != group:
            self.up[group] = group = self.up[self.up[group]]
        return group

    def _end(self, state: tuple[int, float, float, str | None], density: float, parent: str) -> float:
        size, total, parts, cluster = state
        own = total - size * density
        self.ended.append((cluster, parent, own >= parts))
        return max(own, parts)

    def merge(self, a: int, b: int, w: float, name: str) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        density = 1 / max(w, LEAST)
        x, y = self.state.pop(a), self.state.pop(b)
        size, members = x[0] + y[0], self.small.pop(a, []) + self.small.pop(b, [])
        if x[3] and y[3]:  # both end, and one that holds them begins
            new = (size, size * density, self._end(x, density, name) + self._end(y, density, name), name)
        elif x[3] or y[3]:
            old, more = (x, y) if x[3] else (y, x)
            new = (size, old[1] + more[0] * density, old[2], old[3])
        else:
            new = (size, size * density, 0.0, name) if size >= self.least else (size, 0.0, 0.0, None)
        if new[3]:
            self.left += [(g, new[3]) for g in members]
        else:
            self.small[a] = members
        self.up[b], self.state[a] = a, new


DONE = "kind string, g long, to long, size long, total double, parts double, cluster string, parent string, worth boolean"


def _merged(part: DataFrame, state: DataFrame, least: int) -> DataFrame:
    """What the edges of a slice (a, b: groups, w, place) do, in one task: groups and where they go, states of those that are left, groups that came into a cluster, and clusters that ended."""
    columns = ("size", "total", "parts", "cluster")
    ends = [state.select(F.col("g").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)) for end in "ab"]
    rows = part.join(ends[0], "a").join(ends[1], "b").select("a", "b", "w", "place", *(f"{c}_{end}" for end in "ab" for c in columns))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Merging(least)
        for batch in batches:
            for a, b, w, place, *s in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                held.know(a, *s[:4])
                held.know(b, *s[4:])
                held.merge(a, b, w, f"c{place}")
        out: list[tuple] = [("group", g, held.find(g), None, None, None, None, None, None) for g in held.up]
        out += [("state", g, None, *s, None, None) for g, s in held.state.items()]
        out += [("left", g, None, None, None, None, c, None, None) for g, c in held.left]
        out += [("ended", None, None, None, None, None, c, p, f) for c, p, f in held.ended]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DONE.split(", ")]).convert_dtypes()

    return rows.repartition(1).sortWithinPartitions("place").mapInPandas(merge, DONE)


def _chosen(clusters: DataFrame) -> DataFrame:
    """cluster, chosen: the largest cluster around each one (cluster, parent, worth) that is worth as much as its parts. By doubling, so the steps grow with the logarithm of the depth."""
    now = written(clusters.select("cluster", F.col("parent").alias("jump"), F.when(F.col("worth"), F.col("cluster")).alias("best")), "chosen")
    while not now.where("jump is not null").isEmpty():
        onward = now.select(F.col("cluster").alias("jump"), F.col("jump").alias("to"), F.col("best").alias("higher"))
        now = written(now.join(onward, "jump", "left").select("cluster", F.col("to").alias("jump"), F.coalesce("higher", "best").alias("best")), "chosen")
    return now.select("cluster", F.col("best").alias("chosen"))


def clusters(rows: DataFrame, row_id: str = "vec_id", vector: str = "embedding", least: int = 8, neighbours: int = 24, leaf: int = LEAF, trees: int = TREES, most: int = SLICE) -> DataFrame:
    """id, cluster of each row: clusters from 0 in order of their smallest id, -1 for rows in none. Ids are whole numbers.

    As the hierarchical method has it: of clusters of at least `least` rows those are taken whose points stay longest, measured by density, against those that they fall into; all rows as one are no
    cluster, unless the graph of neighbours is in parts, which count as infinitely far apart. Null vectors, zero ones and those with null or non-finite components are in none. Equal vectors go together; an id with
    several vectors is in the first of their clusters.
    """
    before = written_tables()
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    usable = rows.select(F.col(row_id).cast("long").alias("id"), x.alias("v")).where(~bad & F.exists("v", lambda e: e != 0) & F.col("id").isNotNull())
    different = usable.groupBy("v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("weight"))
    points = written(with_place(different, "first", "v", out="node"), "density-points")
    total = points.agg(F.sum("weight")).collect()[0][0] or 0
    least = max(2, min(least, total))
    near = written(near_graph(points, max(neighbours, least), leaf, trees), "near")
    placed = written(with_place(spanning_forest(reachable(points, near, min(least, max(1, total - 1)))), "w", "a", "b"), "forest-placed")
    slices = -(-placed.count() // most)
    large = F.col("weight") >= least
    state = points.select(F.col("node").alias("g"), F.col("weight").alias("size"), F.when(large, F.col("weight") / LEAST).otherwise(0.0).alias("total"), F.lit(0.0).alias("parts"), F.when(large, F.concat(F.lit("p"), "node")).alias("cluster"))
    home = points.where(~large).select("node", F.col("node").alias("g"))
    settled = points.where(large).select("node", F.concat(F.lit("p"), "node").alias("cluster"))
    ended = None
    for number in range(slices):
        done = written(_merged(placed.where(F.floor(F.col("place") / most) == number), state, least), "merged")
        moves = done.where("kind = 'group'").select("g", "to")
        left = done.where("kind = 'left'").select("g", "cluster")
        over = done.where("kind = 'ended'").select("cluster", "parent", "worth")
        ended = over if ended is None else ended.unionByName(over)
        settled = settled.unionByName(home.join(left, "g").select("node", "cluster"))
        rest = home.join(left, "g", "left_anti").join(moves, "g", "left")
        home = written(rest.select("node", F.coalesce("to", "g").alias("g")), "home")
        own = done.where("kind = 'state'").select("g", "size", "total", "parts", "cluster")
        state = written(state.join(moves, "g", "left_anti").unionByName(own), "state")
        if number + 1 < slices:
            ends = [moves.select(F.col("g").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab"]
            later = placed.where(F.floor(F.col("place") / most) > number).join(ends[0], "a", "left").join(ends[1], "b", "left")
            placed = written(later.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"), "w", "place"), "forest-placed")
    tops = state.where("cluster is not null")
    several = tops.limit(2).count() > 1
    tops = tops.select("cluster", F.lit(None).cast("string").alias("parent"), (F.lit(several) & (F.col("total") >= F.col("parts"))).alias("worth"))
    chosen = _chosen(tops if ended is None else tops.unionByName(ended))
    of = settled.join(chosen, "cluster").where("chosen is not null").select("node", "chosen")
    names = with_place(of.groupBy("chosen").agg(F.min("node").alias("n")), "n", out="number")
    of = of.join(names, "chosen").select("node", "number")
    met = usable.join(points.select("v", "node"), "v").join(of, "node").groupBy(F.col("id").alias("i")).agg(F.min("number").alias("number"))
    found = written(rows.select(F.col(row_id).alias("id")).join(met, F.col("id") == F.col("i"), "left").select("id", F.coalesce("number", F.lit(-1)).cast("long").alias("cluster")), "density")
    drop_but(rows.sparkSession, before, found)
    return found
