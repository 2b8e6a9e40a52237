"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard, as flat neighbour arrays.

Rows are dealt to shards of about SHARD by a hash of their id. A shard keeps each different vector once, with the KEEP smallest ids that have it, and
builds its graph in batches: each batch is searched at once in the graph so far, is linked to a diverse choice of what it finds and of its own members, and is
linked back. Queries go to every shard in blocks, and the shards' nearest are merged by the exact cosine in double precision.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import table, written

SHARD = 8192
#: Links of a node above the ground level, and at it.
LINKS, GROUND = 16, 32
#: Nodes held in a search while building, and while answering.
BUILD, SEARCH = 64, 96
BATCH = 256
#: Nodes expanded in one step of a search.
WIDTH = 4
#: Queries searched in step.
BLOCK = 512
#: Queries that one task answers for a shard, about; the shard is sent to as many tasks as they need.
QUERIES_A_TASK = 20_000


def _search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, hold: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the nodes held at the end, best first (-1: none), and their similarity. All rows are searched in step."""
    rows, n = len(q), len(x)
    every = np.arange(rows)[:, None]
    met = np.zeros((rows, n + 1), bool)
    node, sim, done = np.full((rows, hold), -1), np.full((rows, hold), -np.inf, np.float32), np.ones((rows, hold), bool)
    first = entry[:, None] if entry.ndim == 1 else entry
    node[:, : first.shape[1]], sim[:, : first.shape[1]] = first, np.einsum("qmd,qd->qm", x[first], q)
    done[:, : first.shape[1]] = False
    met[every, first] = True
    while True:
        open_sim = np.where(done, -np.inf, sim)
        pick = np.argsort(-open_sim, 1, kind="stable")[:, :WIDTH]
        able = np.take_along_axis(open_sim, pick, 1) > -np.inf
        live = able.any(1)
        if not live.any():
            break
        go, pick, able = np.flatnonzero(live), pick[live], able[live]
        here = np.arange(len(go))[:, None]
        done[go[:, None], pick] = True
        near = np.where(able[:, :, None], links[np.where(able, node[go[:, None], pick], 0)], -1).reshape(len(go), -1)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[met[go[:, None], near]] = -1  # the last column of met is for -1
        met[go[:, None], near] = True
        met[:, n] = False
        got = np.einsum("qmd,qd->qm", x[near], q[go], optimize=False)
        got[near < 0] = -np.inf
        all_node, all_sim = np.concatenate([node[go], near], 1), np.concatenate([sim[go], got], 1)
        all_done = np.concatenate([done[go], near < 0], 1)
        best = np.argpartition(-all_sim, hold - 1, 1)[:, :hold]
        node[go], sim[go], done[go] = all_node[here, best], all_sim[here, best], all_done[here, best]
    order = np.argsort(-sim, 1, kind="stable")
    node, sim = np.take_along_axis(node, order, 1), np.take_along_axis(sim, order, 1)
    return np.where(sim > -np.inf, node, -1), sim


def _diverse(x: np.ndarray, node: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Of candidates, best first (-1: none), those nearer to their row than to any chosen before; then the nearest of the rest. most columns, -1 at the end."""
    rows, width = node.shape
    v = x[node]
    between = v @ v.transpose(0, 2, 1)
    chosen, count = np.zeros((rows, width), bool), np.zeros(rows, int)
    closest = np.full((rows, width), -np.inf, np.float32)
    for k in range(width):
        take = (node[:, k] >= 0) & (sim[:, k] > closest[:, k]) & (count < most)
        chosen[:, k] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, between[:, k]), closest)
    rank = np.where(node < 0, 3 * width, np.where(chosen, 0, width) + np.arange(width))
    order = np.argsort(rank, 1, kind="stable")[:, :most]
    return np.take_along_axis(node, order, 1)


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Adds to each node the new nodes that chose it, and thins its links where they are too many."""
    most = links.shape[1]
    source, target = np.repeat(new, most), links[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    node, begin, count = np.unique(target, return_index=True, return_counts=True)
    for low in range(0, len(node), 512):
        part = slice(low, low + 512)
        own, width = node[part], int(count[part].max())
        more = np.full((len(own), width), -1)
        at = np.arange(width)[None, :]
        there = at < count[part, None]
        more[there] = source[(begin[part, None] + at)[there]]
        both = np.concatenate([links[own], more], 1)
        both.sort(1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        sim = np.einsum("qmd,qd->qm", x[both], x[own])
        sim[both < 0] = -np.inf
        best = np.argsort(-sim, 1, kind="stable")
        both, sim = np.take_along_axis(both, best, 1), np.take_along_axis(sim, best, 1)
        full = (both >= 0).sum(1) > most
        out = both[:, :most].copy()
        if full.any():
            out[full] = _diverse(x, both[full], sim[full], most)
        links[own] = out


class Graph:
    """x: unit vectors (float32); nodes are in order of falling level, so level k has the first sizes[k] nodes and links[k] their neighbours."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray]) -> None:
        self.x, self.links = x, links

    @classmethod
    def build(cls, x: np.ndarray, levels: np.ndarray) -> Graph:
        """levels must not rise from row to row."""
        graph = cls(x, [])
        top = int(levels[0]) if len(levels) else 0
        for level in range(top, -1, -1):
            size = int((levels >= level).sum())
            graph.links.insert(0, graph._level(size, GROUND if level == 0 else LINKS))
        return graph

    def _level(self, size: int, most: int) -> np.ndarray:
        x, links = self.x, np.full((size, most), -1)
        at = 1
        while at < size:
            new = np.arange(at, min(size, at + min(BATCH, max(1, at))))
            entry = self._entry(x[new], np.zeros(len(new), int), at)
            node, sim = _search(x[:at], links[:at], x[new], entry, BUILD)
            own = x[new] @ x[new].T
            np.fill_diagonal(own, -np.inf)
            near = np.argsort(-own, 1, kind="stable")[:, : min(most, len(new) - 1)]
            node = np.concatenate([node, new[near]], 1)
            sim = np.concatenate([sim, np.take_along_axis(own, near, 1)], 1)
            order = np.argsort(-sim, 1, kind="stable")[:, :BUILD]
            node, sim = np.take_along_axis(node, order, 1), np.take_along_axis(sim, order, 1)
            found = _diverse(x, node, sim, most)
            links[new, : found.shape[1]] = found
            _link_back(x, links, new)
            at = int(new[-1]) + 1
        return links

    def _entry(self, q: np.ndarray, entry: np.ndarray, limit: int) -> np.ndarray:
        """The nearest node of the levels above, by greedy descent. limit: nodes there are."""
        for links in self.links[::-1]:
            size = min(limit, len(links))
            node, _ = _search(self.x[:size], np.where(links[:size] < size, links[:size], -1), q, entry, 2)
            entry = node[:, 0]
        return entry

    def nearest(self, q: np.ndarray, hold: int = SEARCH) -> np.ndarray:
        """The nodes held at the end of a search for each row of q (unit vectors), best first; -1: none."""
        above = Graph(self.x, self.links[1:])
        entry = above._entry(q, np.zeros(len(q), int), len(self.x))
        return _search(self.x, self.links[0], q, entry, hold)[0]

    def pack(self) -> bytes:
        head = struct.pack("<QQQ", *self.x.shape, len(self.links))
        parts = [struct.pack("<QQ", *k.shape) + k.astype("<i4").tobytes() for k in self.links]
        return head + self.x.astype("<f4").tobytes() + b"".join(parts)

    @classmethod
    def unpack(cls, blob: bytes) -> Graph:
        n, d, levels = struct.unpack_from("<QQQ", blob)
        at = 24 + 4 * n * d
        x, links = np.frombuffer(blob, "<f4", n * d, 24).reshape(n, d), []
        for _ in range(levels):
            a, b = struct.unpack_from("<QQ", blob, at)
            links.append(np.frombuffer(blob, "<i4", a * b, at + 16).reshape(a, b).astype(np.int64))
            at += 16 + 4 * a * b
        return cls(x, links)


def build_shard(ids: np.ndarray, vectors: np.ndarray, keep: int, seed: int = 0) -> tuple[bytes, bytes, bytes]:
    """The packed graph of a shard's different vectors, the vectors (float64), and of each a row of 64-bit numbers: how many ids follow, and its keep smallest ids."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
    _, first, which = np.unique(vectors.view([("", vectors.dtype)] * vectors.shape[1]).ravel(), return_index=True, return_inverse=True)
    level = np.floor(-np.log(np.random.default_rng(seed).random(len(first)) + 1e-12) / np.log(LINKS)).astype(int)
    place = np.argsort(-level, kind="stable")
    back = np.empty(len(place), int)
    back[place] = np.arange(len(place))
    own, which = vectors[first][place], back[which]
    members = np.full((len(own), keep + 1), -1)
    members[:, 0] = 0
    for row, node in zip(ids.tolist(), which.tolist(), strict=True):
        if (n := members[node, 0]) < keep:
            members[node, n + 1] = row
            members[node, 0] += 1
    unit = (own / np.linalg.norm(own, axis=1)[:, None]).astype(np.float32)
    return Graph.build(unit, level[place]).pack(), own.astype("<f8").tobytes(), members.astype("<i8").tobytes()


def unpack_shard(graph: bytes, vectors: bytes, members: bytes) -> tuple[Graph, np.ndarray, np.ndarray]:
    built = Graph.unpack(graph)
    return built, np.frombuffer(vectors, "<f8").reshape(built.x.shape), np.frombuffer(members, "<i8").reshape(len(built.x), -1)


def answer(shard: tuple[Graph, np.ndarray, np.ndarray], ids: list[int], vectors: list[np.ndarray], k: int, hold: int = SEARCH) -> pa.RecordBatch:
    """query_id, vec_id, score of the k nearest in a shard of each query but itself."""
    graph, own, members = shard
    q = np.stack(vectors)
    found = graph.nearest((q / np.linalg.norm(q, axis=1)[:, None]).astype(np.float32), min(hold, max(2, len(own))))
    size, out = np.sqrt(np.einsum("ij,ij->i", own, own)), ([], [], [])
    for query, name, node in zip(q, ids, found, strict=True):
        node = node[node >= 0][: 4 * k + 4]
        score = np.einsum("ij,j->i", own[node], query) / (size[node] * np.sqrt(np.einsum("i,i->", query, query)))
        near = sorted((-s, m) for s, n in zip(score.tolist(), node.tolist(), strict=True) for m in members[n, 1 : 1 + members[n, 0]].tolist() if m != name)
        for s, m in near[:k]:
            for to, x in zip(out, (name, m, -s), strict=True):
                to.append(x)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, v (doubles) and d of the rows that take part: those with an id and a vector that isn't null, empty, zero and has finite components only."""
    v = F.col("v")
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(sound & F.exists(v, lambda c: c != 0)).withColumn("d", F.size("v"))


SHARDS = "shard long, d int, rows long, graph binary, vectors binary, members binary"


def index(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", keep: int = 6, shard: int = SHARD) -> DataFrame:
    """A row for each shard, of vectors of one length each. keep: how many ids of equal vectors; k + 1 for the k nearest of rows in the index."""
    rows = usable(df, vec_id, vector)
    shards = max(1, round(df.count() / shard))

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        packed = build_shard(part["id"].to_numpy(), np.stack(part["v"].to_numpy()).astype(np.float64), keep, int(key[0]))
        return pd.DataFrame([(int(key[0]), int(key[1]), len(part), *packed)], columns=["shard", "d", "rows", "graph", "vectors", "members"])

    return rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).groupBy("shard", "d").applyInPandas(build, SHARDS)


def nearest(queries: DataFrame, shards: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", hold: int = SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows of the index but itself, ties to the smaller id.

    Queries that can't take part (see usable) and those of a length that no indexed vector has get no rows; queries with the same id are ranked together, and rows of their id are
    none of their nearest.
    """
    asked = usable(queries, vec_id, vector)
    every = shards.select("shard", F.col("d").alias("_d"))
    salts = max(1, -(-asked.count() // QUERIES_A_TASK))
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    sent = asked.join(every, F.col("d") == F.col("_d")).select("shard", "d", salt.alias("salt"), "id", "v")
    packed = ["graph", "vectors", "members"]
    held = shards.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("shard", "d", "salt", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"), *packed)
    rows = held.unionByName(sent.select("*", *(F.lit(None).cast("binary").alias(c) for c in packed)))
    # each shard's graph, and then its queries
    rows = rows.repartition("shard", "d", "salt").sortWithinPartitions("shard", "d", "salt", F.col("id").asc_nulls_first())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors = None, [], []
        for batch in batches:
            for row, name in enumerate(batch.column(3).to_pylist()):
                if name is None:
                    if ids:
                        yield answer(now, ids, vectors, k, hold)
                    now, ids, vectors = unpack_shard(*(batch.column(c)[row].as_py() for c in (5, 6, 7))), [], []
                    continue
                ids.append(name)
                vectors.append(np.asarray(batch.column(4)[row].values))
                if len(ids) == BLOCK:
                    yield answer(now, ids, vectors, k, hold)
                    ids, vectors = [], []
        if ids:
            yield answer(now, ids, vectors, k, hold)

    found = rows.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_hnsw_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows.where("vec_id % 50 = 0"), written(index(rows), "hnsw"))
