"""k-means of integer vectors by Lloyd's rounds over two trees: exact, whatever the sharding.

Vectors are dealt to shards of a bounded size, and each shard's cover tree is built once: a node's points lie within its radius of its centre,
which is one of them; its children's centres are further apart than half of that radius, and each child covers its points within that half (a node of points that are nearly all that far apart
stays a leaf). Each round builds such a tree over the centroids too and walks both at once. A pair of nodes is pruned when no centroid of the one can be as near to any vector of
the other as the nearest one known; what is left at a leaf is compared exactly, in integers. A node of vectors with one
centroid left counts as a whole, by prefix sums. Only k x dimensions sums reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_but, give_back, table, written, written_tables

DIM, SCALE, K, ROUNDS = 64, 256, 40, 5
#: Vectors of a shard, and of a node that isn't divided.
SHARD, LEAF = 2048, 16
#: Components must be smaller than this, so that squared distances fit 64 bits.
LARGEST = 1 << 27
#: Share by which bounds are widened for rounding.
SLACK = 1e-9


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, a x b."""
    largest = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)), 1)
    kind = np.float64 if 4 * a.shape[1] * largest * largest < 1 << 53 else np.int64
    x, y = a.astype(kind), b.astype(kind)
    return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)).astype(np.int64)


class CoverTree:
    """points in tree order, and for each node its centre (a place in that order), radius, first and last + 1 point, and its children."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(points))
        rows: list[list[float]] = []  # centre, radius, from, to, first child, children
        todo = [(0, 0, len(points), None)] if len(points) else []
        if todo:
            rows.append([0, 0, 0, 0, 0, 0])
        while todo:
            node, lo, hi, centre = todo.pop()
            part = self.order[lo:hi].copy()
            here = points[part]
            first = 0 if centre is None else int(np.flatnonzero(part == centre)[0])
            away = squared(here, here[first : first + 1])[:, 0]
            radius = float(np.sqrt(away.max())) * (1 + SLACK)
            rows[node] = [part[first], radius, lo, hi, 0, 0]
            if hi - lo <= leaf or radius == 0:
                continue
            centres, owner, near = [first], np.zeros(hi - lo, np.int64), away
            while 4 * near.max() > radius * radius and 2 * len(centres) <= hi - lo:
                far = int(near.argmax())
                d = squared(here, here[far : far + 1])[:, 0]
                closer = d < near
                owner[closer], near = len(centres), np.where(closer, d, near)
                owner[far] = len(centres)
                centres.append(far)
            if 2 * len(centres) > hi - lo:  # points this far apart are no smaller a problem below: they stay one leaf
                continue
            by = np.argsort(owner, kind="stable")
            self.order[lo:hi] = part[by]
            rows[node][4:] = [len(rows), len(centres)]
            at = lo
            for c, size in zip(centres, np.bincount(owner, minlength=len(centres)), strict=True):
                todo.append((len(rows), at, at + int(size), int(part[c])))
                rows.append([0, 0, 0, 0, 0, 0])
                at += int(size)
        place = np.empty(len(points), np.int64)
        place[self.order] = np.arange(len(points))
        got = np.array(rows, np.float64).reshape(-1, 6)
        self.radius = got[:, 1].copy()
        self.nodes = got[:, [0, 2, 3, 4, 5]].astype(np.int64)
        self.nodes[:, 0] = place[self.nodes[:, 0]]
        self.points = points[self.order]


class Walk:
    """Both trees walked at once: owner of each vector (in tree order), or sums and counts of each centroid."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray, radius: np.ndarray, centroids: CoverTree) -> None:
        self.points, self.nodes, self.radius, self.to = points, nodes, radius, centroids
        self.owner = np.zeros(len(points), np.int64)
        self.compared = 0
        if len(nodes):
            self._go()

    def _go(self) -> None:
        q_centre = self.points[self.nodes[:, 0]].astype(np.float64)
        c_centre = self.to.points[self.to.nodes[:, 0]].astype(np.float64)
        c_radius, c_nodes = self.to.radius, self.to.nodes
        todo = [(0, np.zeros(1, np.int64))]
        while todo:
            q, cand = todo.pop()
            r = self.radius[q]
            while True:
                gap = c_centre[cand] - q_centre[q]
                d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                # each candidate's centre is a centroid, so every vector of q has one within d + r
                known = ((d + r).min()) * (1 + SLACK)
                cand = cand[(d - r - c_radius[cand]) * (1 - SLACK) <= known]
                wide = (c_nodes[cand, 4] > 0) & ((c_radius[cand] >= r) | (self.nodes[q, 4] == 0))
                if not wide.any():
                    break
                grown = [np.arange(c_nodes[c, 3], c_nodes[c, 3] + c_nodes[c, 4]) for c in cand[wide]]
                cand = np.concatenate([cand[~wide], *grown])
            lo, hi = self.nodes[q, 1], self.nodes[q, 2]
            left = np.concatenate([self.to.order[c_nodes[c, 1] : c_nodes[c, 2]] for c in cand])
            if len(left) == 1:
                self.owner[lo:hi] = left[0]
            elif self.nodes[q, 4] == 0:
                left.sort()  # the first of equally near ones is the smallest number
                places = self._places[left]
                self.compared += (hi - lo) * len(left)
                self.owner[lo:hi] = left[squared(self.points[lo:hi], self.to.points[places]).argmin(1)]
            else:
                todo.extend((q2, cand) for q2 in range(self.nodes[q, 3], self.nodes[q, 3] + self.nodes[q, 4]))

    @property
    def _places(self) -> np.ndarray:
        found = np.empty(len(self.to.order), np.int64)
        found[self.to.order] = np.arange(len(self.to.order))
        return found


SHARDS = "ids binary, has_id binary, points binary, nodes binary, radius binary"


def whole_numbers(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and the vector as integers (v), of those with dim finite components. Components of LARGEST or more are an error."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    fine = (F.size(vector) == dim) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    large = F.exists("x", lambda e: F.abs(e * scale) >= LARGEST)
    found = df.where(F.col(vector).isNotNull()).where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))
    v = F.transform("x", lambda e: F.floor(e * scale).cast("long"))
    return found.select("vec_id", F.when(large, F.raise_error(F.lit("a component is too large for squared distances of 64 bits"))).otherwise(v).alias("v"))


def shards(vectors: DataFrame, dim: int = DIM, size: int = SHARD) -> DataFrame:
    """A row for each shard of at most size vectors: ids, points in tree order, nodes and their radii, as flat little-endian arrays."""

    def row(ids: np.ndarray, known: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        tree = CoverTree(points)
        flat = (ids[tree.order].astype("<i8"), known[tree.order].astype("u1"), tree.points.astype("<i4"), tree.nodes.astype("<i4"), tree.radius.astype("<f8"))
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in flat], names=["ids", "has_id", "points", "nodes", "radius"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, size - rows)
                held.append(take)
                rows += take.num_rows
                batch = batch.slice(take.num_rows)
                if rows == size:
                    yield row(*arrays(held))
                    held, rows = [], 0
        if rows:
            yield row(*arrays(held))
        give_back()

    def arrays(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = pa.Table.from_batches(held)
        ids = found.column("vec_id").combine_chunks()
        points = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in held]).reshape(-1, dim)
        return ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), points

    return vectors.select("vec_id", "v").mapInArrow(build, SHARDS)


def _opened(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, ...]]:
    kinds = ("<i8", "u1", "<i4", "<i4", "<f8")
    for batch in batches:
        for n in range(batch.num_rows):
            ids, known, points, nodes, radius = (np.frombuffer(batch.column(c)[n].as_py(), k) for c, k in enumerate(kinds))
            yield ids, known, points.reshape(-1, dim).astype(np.int64), nodes.reshape(-1, 5).astype(np.int64), radius


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: each non-empty one is the floor of the mean of the vectors nearest to it."""
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = CoverTree(centroids, leaf=1)
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, _, points, nodes, radius in _opened(batches, dim):
            owner = Walk(points, nodes, radius, to).owner
            # points of a node mostly go together: sums over runs of one owner, from prefix sums
            prefix = np.concatenate([np.zeros((1, dim), np.int64), np.cumsum(points, 0)])
            cut = np.flatnonzero(np.diff(owner, prepend=-1))
            end = np.append(cut[1:], len(owner))
            np.add.at(total, owner[cut], prefix[end] - prefix[cut])
            np.add.at(count, owner[cut], end - cut)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(count[seen], pa.int64()), pa.array(total[seen].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    part = trees.mapInArrow(sums, "cluster long, n long, total array<long>")
    each = part.select("cluster", "n", F.posexplode("total").alias("j", "x")).groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = centroids.copy()
    for cluster, j, n, x in each.collect():  # k x dim rows at most
        out[cluster, j] = x // n
    return out


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of each vector."""
    dim = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = CoverTree(centroids, leaf=1)
        for ids, known, points, nodes, radius in _opened(batches, dim):
            owner = Walk(points, nodes, radius, to).owner
            gap = points - centroids[owner]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=known == 0), pa.array(owner, pa.int32()), pa.array((gap * gap).sum(1), pa.int64())], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(assign, "vec_id long, cluster int, distance long")


def starts(vectors: DataFrame, k: int = K, seed: int = 2) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:<vec_id>`, in that order (equal ids: by components)."""
    named = vectors.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return np.array([r["v"] for r in named.orderBy("h", "v").limit(k).collect()], np.int64)


def clustered(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 2) -> DataFrame:
    """A row for each vector with dim components, all of them finite: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another size, or that hold null or non-finite components have no row; nor has anything if no vector with an id is left to start from. Fewer than k
    vectors are as many centroids. Rows with one vec_id have a row each; rows without one are clustered, but start no centroid. Ties go to the smaller number. Other columns are left out.
    A component of LARGEST / scale or more is an error. The trees' table stays in the shared folder until the session drops it.
    """
    spark, known = df.sparkSession, written_tables()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    vectors = whole_numbers(df, vec_id, vector, dim, scale)
    centroids = starts(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    trees = written(shards(vectors, dim), "cover-trees")
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    found = written(assigned(trees, centroids), "clusters")
    drop_but(spark, known, found)
    each = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, s, sum(each.values()), sha[c]) for c, s in sorted(each.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows are broadcast


def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> str:
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings"
        f" WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM v WHERE vec_id IS NOT NULL) ORDER BY h, v LIMIT {k})",
    ]
    near = "SELECT r, min(struct_pack(d := CAST(list_dot_product(v.v, v.v) + list_dot_product(c.v, c.v) - 2 * list_dot_product(v.v, c.v) AS BIGINT), c := c.c)) AS m FROM v, c{n} c GROUP BY r"
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({near.format(n=n)})")
        steps.append(
            f"c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(g.v, o.v) AS v FROM c{n} o LEFT JOIN (SELECT c, list(x ORDER BY j) AS v FROM (SELECT c, j, floor(sum(x) / count(*)) AS x FROM"
            f" (SELECT a.m.c AS c, unnest(v.v) AS x, unnest(range({dim})) AS j FROM a{n} a JOIN v USING (r)) GROUP BY c, j) GROUP BY c) g ON g.c = o.c)"
        )
    steps.append(f"a{rounds} AS MATERIALIZED ({near.format(n=rounds)})")
    return (
        f"WITH {', '.join(steps)} SELECT v.vec_id, a.m.c AS cluster, a.m.d AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(list_transform(c.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.c = a.m.c"
    )


#: Sums and products are of integers below 2^53 in these tables, so doubles hold them exactly.
SQL = _sql()
