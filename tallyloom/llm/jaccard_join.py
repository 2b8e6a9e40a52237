"""N-gram Jaccard join with signature trees: which documents share four fifths of their word shingles, and the groups that such links make.

1. Which documents can have a link at all, exactly. Of a set's shingles in order of their hashes, a prefix must hold a known number of shingles that are also in
   its partner's prefix. Batches of documents send their prefixes, each different shingle once, to the parts of the hash space, and get back how many another document has too.
2. The different sets of those documents are classes, told by a digest of 128 bits. Most groups are settled at little cost where classes agree in a smallest hash.
3. What is left is found exactly. Each class has a prefix of shingles, rare ones first, in which any partner must share one, and a longer one in which it must share
   more: classes that share too few with other groups go. The others meet at the shingles of their prefixes; shingles that have the same class first (by a hash) are one place.

Where classes meet, a signature tree (nodes with OR-combined bitmaps, size ranges and the most collisions) is traversed against itself or another: node pairs
whose largest possible overlap is too small are left out, and so are those already in one group. What remains is compared in full.

A place of more than MEETING classes, or of very long ones, is cut into blocks, all pairs of which meet but those within the place's largest group. No pair that could have a link is left out
anywhere; only the first step over smallest hashes splits large places at random, since whatever it misses is found afterwards.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import Aside, drop_but, give_back, in_slices, shuffle_partitions, table, text_or_empty, written, written_tables
from tallyloom.llm.shingles import WIDTH, mixed, shingle_sets
from tallyloom.operators.linking import components

#: Smallest hashes by which groups are settled first.
KEYS = 2
MEETING, LEAF, BITS = 1500, 8, 1024
#: Shingles of a place that stay together in one task, and sets of a node that are compared at once in blocks.
TOGETHER, NODE = 4_000_000, 64
#: Shingles that are put last in prefixes because many classes have them, at most. Any order gives the same links; this one keeps common shingles out of prefixes.
COMMON = 65_536
BATCH = 2000
#: In blocks of a large place: shingles with a column of bits, and pairs of sets, at a time.
COLUMNS, PAIRS = 4096, 1 << 20
#: Documents that can have a link, up to which their ids are broadcast.
BROADCAST_IDS = 2_000_000
#: Documents for each part of the hash space, about.
PART_ROWS = 4000


def least_overlap(n: int) -> int:
    """Shingles that a set of n must share with a partner."""
    return (4 * n + 4) // 5


def prefix_of(n: int) -> tuple[int, int]:
    """How many of a set's smallest hashes to look at, and how many of them must be in a partner's prefix. The partner may have a fifth less shingles, and a shorter extension."""
    return n - least_overlap(n) + 1 + n // 10, 1 + least_overlap(n) // 10


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two ascending sets is 0.8 or more."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 5 * len(small) < 4 * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 5 * both >= 4 * (len(x) + len(y) - both)


class Tree:
    """A binary signature tree over sets in order of their size and smallest hashes: for each node its members, OR-combined bitmap, size range and most collisions."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]).bit_length(), int(mixed(sets[i] ^ np.uint64(0xABCD)).min()), len(sets[i]), i))
        bits = np.zeros((len(sets), BITS // 8), np.uint8)
        self.clash = np.zeros(len(sets), int)
        for row, i in enumerate(self.order):
            flag = np.zeros(BITS, bool)
            flag[(mixed(sets[i]) % np.uint64(BITS)).astype(int)] = True
            bits[row] = np.packbits(flag)
            self.clash[row] = len(sets[i]) - int(flag.sum())
        self.size = np.array([len(sets[i]) for i in self.order])
        self.bits = bits
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, int, int, int]] = {}

    def node(self, a: int, b: int) -> tuple[np.ndarray, int, int, int]:
        if (found := self.nodes.get((a, b))) is None:
            found = self.nodes[a, b] = (np.bitwise_or.reduce(self.bits[a:b], 0), int(self.size[a:b].min()), int(self.size[a:b].max()), int(self.clash[a:b].max()))
        return found


def too_far(x: tuple[np.ndarray, int, int, int], y: tuple[np.ndarray, int, int, int]) -> bool:
    """Whether no set of one node can have a link to one of the other: by their sizes, or by the largest overlap that their bitmaps allow."""
    if 5 * x[2] < 4 * y[1] or 5 * y[2] < 4 * x[1]:
        return True
    return 9 * (int(np.bitwise_count(x[0] & y[0]).sum()) + min(x[3], y[3])) < 4 * (x[1] + y[1])


def links(sets: list[np.ndarray], groups: list[int] | None = None) -> list[int]:
    """For each set the place of the first set of its group, by a dual traversal of the signature tree. Sets of equal groups are together from the start."""
    first_of: dict[int, int] = {}
    parent = list(range(len(sets))) if groups is None else [first_of.setdefault(g, i) for i, g in enumerate(groups)]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree = Tree(sets)
    order = tree.order
    todo = [(0, len(sets), 0, len(sets))]
    while todo:
        a, b, c, d = todo.pop()
        same = (a, b) == (c, d)
        if b - a > LEAF or d - c > LEAF or not same:
            if not same and too_far(tree.node(a, b), tree.node(c, d)):
                continue
            first = root(order[a])
            if all(root(order[k]) == first for k in range(a, b)) and all(root(order[k]) == first for k in range(c, d)):
                continue
        if b - a <= LEAF and d - c <= LEAF:
            for i in range(a, b):
                for j in range(max(c, i + 1) if same else c, d):
                    p, q = root(order[i]), root(order[j])
                    if p != q and 9 * (int(np.bitwise_count(tree.bits[i] & tree.bits[j]).sum()) + min(tree.clash[i], tree.clash[j])) >= 4 * (tree.size[i] + tree.size[j]) and linked(sets[order[i]], sets[order[j]]):
                        parent[max(p, q)] = min(p, q)
            continue
        left = [(a, b)] if b - a <= LEAF else [(a, (a + b) // 2), ((a + b) // 2, b)]
        right = [(c, d)] if d - c <= LEAF else [(c, (c + d) // 2), ((c + d) // 2, d)]
        if same:
            (p, q), (r, s) = left
            todo += [(p, q, r, s), (r, s, r, s), (p, q, p, q)]  # the last is taken first
        else:
            todo += [(*x, *y) for x in left for y in right]
    return [root(i) for i in range(len(sets))]


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of left and each of right share, exactly: rows of bits for shingles that many sets hold, lists of pairs for others."""
    flat = [np.concatenate(x) for x in (left, right)]
    known = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.int32)
    if not len(known):
        return out
    held = []
    for sets, tokens in zip((left, right), flat, strict=True):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        there = known[at] == tokens
        at, owner = at[there], owner[there]
        order = np.argsort(at, kind="stable")
        held.append((at[order], owner[order], np.bincount(at, minlength=len(known))))
    (at_l, own_l, n_l), (at_r, own_r, n_r) = held
    often = n_l * n_r * 64 > len(left) * len(right)
    column = np.cumsum(often) - 1
    for first in range(0, int(often.sum()), COLUMNS):
        rows = []
        for sets, at, own in ((left, at_l, own_l), (right, at_r, own_r)):
            flag = np.zeros((len(sets), COLUMNS), bool)
            some = often[at] & (column[at] >= first) & (column[at] < first + COLUMNS)
            flag[own[some], column[at[some]] - first] = True
            rows.append(np.packbits(flag, 1).view(np.uint64))
        for i, row in enumerate(rows[0]):
            out[i] += np.bitwise_count(rows[1] & row).sum(1, dtype=np.int32)
    begin_l, begin_r = np.cumsum(n_l) - n_l, np.cumsum(n_r) - n_r
    seldom = np.flatnonzero(~often)
    pairs = np.cumsum(n_l[seldom] * n_r[seldom])
    at = 0
    while at < len(seldom):
        stop = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + PAIRS, "right")))
        some = seldom[at:stop]
        each = n_l[some] * n_r[some]
        nth = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        wide = np.repeat(n_r[some], each)
        i, j = own_l[np.repeat(begin_l[some], each) + nth // wide], own_r[np.repeat(begin_r[some], each) + nth % wide]
        np.add.at(out, (i, j), 1)
        at = stop
    return out


def cross_links(sets: list[np.ndarray], groups: list[int], blocks: list[int]) -> list[tuple[int, int]]:
    """Links, as places of two sets, that join the groups of two blocks, or of one if there is only one: nodes of both blocks' trees that may hold a link are compared in full."""
    parent: dict[int, int] = {}

    def root(g: int) -> int:
        while (up := parent.get(g, g)) != g:
            g = up
        return g

    low = min(blocks)
    one = [i for i, b in enumerate(blocks) if b == low]
    two = [i for i, b in enumerate(blocks) if b != low] or one
    size = np.array([len(s) for s in sets])
    of = np.unique(groups, return_inverse=True)[1]
    trees = [Tree([sets[i] for i in side]) for side in (one, two)]
    found = []
    todo = [(0, len(one), 0, len(two))]
    while todo:
        a, b, c, d = todo.pop()
        if too_far(trees[0].node(a, b), trees[1].node(c, d)):
            continue
        if b - a > NODE or d - c > NODE:
            left = [(a, b)] if b - a <= NODE else [(a, (a + b) // 2), ((a + b) // 2, b)]
            right = [(c, d)] if d - c <= NODE else [(c, (c + d) // 2), ((c + d) // 2, d)]
            todo += [(*x, *y) for x in left for y in right]
            continue
        some, others = [one[i] for i in trees[0].order[a:b]], [two[j] for j in trees[1].order[c:d]]
        apart = of[some][:, None] != of[others][None, :]
        if not apart.any():
            continue
        both = overlaps([sets[i] for i in some], [sets[j] for j in others])
        near = (9 * both.astype(np.int64) >= 4 * (size[some][:, None] + size[others][None, :])) & apart
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            p, q = root(groups[some[i]]), root(groups[others[j]])
            if p != q:
                parent[max(p, q)] = min(p, q)
                found.append((some[i], others[j]))
    return found


def digest(s: np.ndarray) -> bytes:
    """128 bits that tell a set."""
    return hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()


def sizes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Batches of docs (_id, _whole) as rows for the parts of the hash space that they ask: see candidates()."""
    parts = max(shuffle_partitions(docs.sparkSession), docs.count() // PART_ROWS)
    docs = docs.select("_id", "_whole", F.spark_partition_id().cast("long").alias("_task"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some = batch.slice(at, BATCH)
                sets = shingle_sets(some.column(1).to_pylist(), width)
                name = (some.column(2)[0].as_py() << 32) + number
                number += 1
                cut = [s[: prefix_of(len(s))[0]] if len(s) else s for s in sets]
                tokens = np.concatenate(cut)
                owner = np.repeat(np.arange(len(sets)), [len(c) for c in cut])
                order = np.argsort(tokens, kind="stable")
                tokens, owner = tokens[order], owner[order]
                new = np.concatenate([[True], tokens[1:] != tokens[:-1]])[: len(tokens)]
                many = np.bincount(np.cumsum(new) - 1, minlength=int(new.sum())) > 1
                here = np.bincount(owner, many[np.cumsum(new) - 1], len(sets)).astype(np.int64)  # shared within the batch
                tokens, owner = tokens[new], np.where(many, 65535, owner[new]).astype("<u2")
                part = ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)]).tolist()
                rows = [(int(part[a]), name, struct.pack("<Q", b - a) + tokens[a:b].astype("<u8").tobytes() + owner[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(part)], strict=True)]
                ids = some.column(0)
                own = struct.pack("<Q", len(sets)) + np.array([len(s) for s in sets], "<i8").tobytes() + here.astype("<i8").tobytes() + b"".join(map(digest, sets))
                own += np.packbits(np.array([not x for x in ids.is_valid().to_pylist()], bool)).tobytes() + np.asarray(ids.fill_null(0)).astype("<i8").tobytes()
                rows.append((-1, name, own))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "batch", "payload"])
        batch = some = sets = cut = tokens = owner = order = rows = own = None
        give_back()

    return docs.mapInArrow(ask, "part long, batch long, payload binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that are sorted by their first columns, group by group; the rest of each row."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, held
    batch = held = row = None
    give_back()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part: of each batch's documents, how many of the shingles that they alone have in their batch another batch has."""
    for _, rows in _groups(batches, 1):
        names, tokens, owners, at = [], [], [], []
        for name, payload in rows:
            (n,) = struct.unpack_from("<Q", payload)
            names.append(name)
            tokens.append(np.frombuffer(payload, "<u8", n, 8))
            owners.append(np.frombuffer(payload, "<u2", n, 8 + 8 * n))
            at.append(n)
        flat = np.concatenate(tokens)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        equal = np.zeros(len(flat), bool)
        equal[1:] = ranked[1:] == ranked[:-1]
        equal[:-1] |= ranked[1:] == ranked[:-1]
        there = np.empty(len(flat), bool)
        there[order] = equal
        out, begin = [], 0
        for n, owner in zip(at, owners, strict=True):
            own = owner[there[begin : begin + n]]
            out.append(np.bincount(own[own < 65535], minlength=1).astype("<u2").tobytes())
            begin += n
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], names=["batch", "payload"])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch: its documents' ids, sizes, digests, and whether they can have a link."""
    for _, rows in _groups(batches, 1):
        ((own,),) = ((p,) for kind, p in rows if kind)
        (n,) = struct.unpack_from("<Q", own)
        size, here = (np.frombuffer(own, "<i8", n, 8 + 8 * n * k) for k in range(2))
        told = [own[8 + 16 * n + 16 * k : 24 + 16 * n + 16 * k] for k in range(n)]
        null = np.unpackbits(np.frombuffer(own, np.uint8, -(-n // 8), 8 + 32 * n), count=n).astype(bool)
        ids = np.frombuffer(own, "<i8", n, 8 + 32 * n + -(-n // 8))
        count = here.copy()
        for kind, payload in rows:
            if not kind:
                got = np.frombuffer(payload, "<u2")
                count[: len(got)] += got
        need = np.array([prefix_of(int(k))[1] for k in size])
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(size), pa.array(told, pa.binary()), pa.array((count >= need) & (size > 0))], names=["_id", "_n", "_digest", "_can"])


def candidates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """_id, _n (shingles), _digest (of the set) and _can (whether a document can have a link, or a copy) of each row of docs (_id, _whole)."""
    asked = written(sizes(docs, width), "prefixes")
    told = asked.where("part >= 0").repartition("part").sortWithinPartitions("part").mapInArrow(_shared, "batch long, payload binary")
    own = asked.where("part < 0").select("batch", F.lit(True).alias("own"), "payload")
    both = told.select("batch", F.lit(False).alias("own"), "payload").unionByName(own).repartition("batch").sortWithinPartitions("batch")
    return both.mapInArrow(_decide, "_id long, _n long, _digest binary, _can boolean")


def _with_sets(docs: DataFrame, width: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in in_slices(batches):
            if some.num_rows:
                sets = shingle_sets(some.column(1).to_pylist(), width)
                least = [[int(mixed(s ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).min().astype(np.int64)) for k in range(KEYS)] if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(map(digest, sets), pa.binary()), pa.array(least, pa.list_(pa.int64())), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["_id", "_digest", "_keys", "_set"])

    return docs.select("_id", "_whole").mapInArrow(make, "_id long, _digest binary, _keys array<long>, _set binary").where(F.size("_keys") > 0)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes that meet at a smallest hash: links between the first of each group and its others."""
    for _, rows in _groups(batches, 3):
        if len(rows) > 1:
            rows.sort(key=lambda r: r[0])
            first = links([np.frombuffer(s, "<u8") for _, s in rows])
            found = [(rows[f][0], rows[i][0]) for i, f in enumerate(first) if f != i]
            if found:
                yield _edges(found)


def _meet_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of a place, or of two blocks of a large one: links that join their groups."""
    for (_, cut, x, y), rows in _groups(batches, 4):
        if x != y and len({r[0] for r in rows}) < 2:
            continue
        rows.sort(key=lambda r: r[1])
        sets, groups = [np.frombuffer(r[3], "<u8") for r in rows], [r[2] for r in rows]
        if cut:
            found = cross_links(sets, groups, [r[0] for r in rows])
        else:
            first = links(sets, groups)
            firsts = {g: i for i, g in reversed([*enumerate(groups)])}
            found = [(first[i], i) for i in firsts.values() if first[i] != i]
        if found:
            yield _edges([(rows[i][1], rows[j][1]) for i, j in found])


def _aside(df: DataFrame) -> DataFrame:
    """df, broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _settling(classes: DataFrame) -> DataFrame:
    """Links of classes that agree in a smallest hash; where more than MEETING do, of those in one part of the place."""
    zipped = F.arrays_zip(F.array(*map(F.lit, range(KEYS))).alias("k"), F.col("_keys").alias("v"))
    rows = classes.select("_class", F.explode(zipped).alias("z")).select("_class", F.col("z.k").alias("_k"), F.col("z.v").alias("_v"))
    places = rows.groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
    met = rows.join(places, ["_k", "_v"]).withColumn("_salt", F.pmod(F.xxhash64("_class", "_k"), F.ceil(F.col("_m") / MEETING)))
    met = met.select("_class", "_k", "_v", "_salt").join(classes.select("_class", "_set"), "_class")
    met = met.select("_k", "_v", "_salt", "_class", "_set").repartition("_k", "_v", "_salt").sortWithinPartitions("_k", "_v", "_salt")
    return written(met.mapInArrow(_meet, "a long, b long"), "links")


def common_shingles(classes: DataFrame, most: int = COMMON) -> np.ndarray:
    """Shingles that a hundredth of a batch's sets have, in order of how many sets have them: at most so many, to put them last in prefixes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in in_slices(batches, BATCH):
            flat = np.concatenate([np.frombuffer(s, "<u8") for s in some.column(0).to_pylist()]) if some.num_rows else np.zeros(0, "<u8")
            known, n = np.unique(flat, return_counts=True)
            often = (n > 8) & (n * 100 >= some.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(known[often].view("<i8")), pa.array(n[often].astype(np.int64))], names=["token", "n"])

    rows = classes.select("_set").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(most)
    return np.array([r["token"] for r in rows.collect()][::-1], np.int64).view(np.uint64)


def prefix(s: np.ndarray, common: np.ndarray, rank: np.ndarray, size: int) -> np.ndarray:
    """The first shingles of a set, by hash, common ones last. common is ascending, and rank the place of each of them in their order."""
    if not len(common):
        return s[:size]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    last = common[at] == s
    rest = s[~last]
    if len(rest) >= size:
        return rest[:size]
    return np.concatenate([rest, s[last][np.argsort(rank[at[last]], kind="stable")][: size - len(rest)]])


def _prefixes(grouped: DataFrame, common: np.ndarray) -> DataFrame:
    """_class, _group, _n (shingles), _token, _basic of grouped (_class, _group, _set): the longer prefix of each class. A partner shares one of the basic part, and _need of all."""
    order = np.argsort(common, kind="stable")
    known, rank = common[order], order

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in in_slices(batches):
            if not some.num_rows:
                continue
            sets = [np.frombuffer(s, "<u8") for s in some.column(2).to_pylist()]
            rows = [prefix(s, known, rank, prefix_of(len(s))[0]) for s in sets]
            long = [len(r) for r in rows]
            basic = np.concatenate([np.arange(len(r)) < len(s) - least_overlap(len(s)) + 1 for r, s in zip(rows, sets, strict=True)])
            owner, total = np.repeat(np.arange(len(sets)), long), np.array([len(s) for s in sets], np.int64)
            need = np.array([prefix_of(int(n))[1] for n in total], np.int64)
            own = [pa.array(np.asarray(some.column(k))[owner]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(total[owner]), pa.array(need[owner]), pa.array(np.concatenate(rows).astype("<u8").view("<i8")), pa.array(basic)], names=["_class", "_group", "_n", "_need", "_token", "_basic"])

    return grouped.select("_class", "_group", "_set").mapInArrow(cut, "_class long, _group long, _n long, _need long, _token long, _basic boolean")


def exact_links(classes: DataFrame, label: DataFrame | None) -> DataFrame | None:
    """All links between different groups that are needed to join them; None if no two groups meet. label: node, component, of the classes that are in a group already."""
    slim = classes.select("_class", "_set")
    grouped = slim.withColumn("_group", F.col("_class"))
    if label is not None:
        grouped = slim.join(_aside(label), F.col("_class") == F.col("node"), "left").select("_class", "_set", F.coalesce("component", "_class").alias("_group"))
    rows = written(_prefixes(grouped, common_shingles(classes)), "prefix-tokens")
    for _ in range(2):  # classes that go take shingles with them, so that others can go as well
        apart = rows.groupBy("_token").agg(F.min("_group").alias("_lo"), F.max("_group").alias("_hi")).where("_lo < _hi").select("_token")
        able = rows.join(apart, "_token").groupBy("_class", "_need").agg(F.count(F.lit(1)).alias("_shared")).where("_shared >= _need").select("_class")
        rows = written(rows.join(_aside(written(able, "able")), "_class", "left_semi"), "prefix-tokens")
    rows = rows.where("_basic").select("_token", "_class", "_group", "_n")
    least = F.min(F.struct(F.xxhash64("_class").alias("h"), F.col("_class").alias("c")))
    places = rows.groupBy("_token").agg(F.min("_group").alias("_lo"), F.max("_group").alias("_hi"), least.alias("_least")).where("_lo < _hi").select("_token", F.col("_least.c").alias("_cell"))
    # shingles with the same first class make one place, so that a class isn't sent to one for each of its shingles
    rows = rows.join(places, "_token").groupBy("_cell", "_class").agg(F.first("_group").alias("_group"), F.first("_n").alias("_n"))
    rows = written(rows, "cells")
    places = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_m"), F.sum("_n").alias("_all"))
    if rows.isEmpty():
        return None
    large = (F.col("_m") > MEETING) | (F.col("_all") > TOGETHER)
    rows = rows.join(_aside(written(places, "places")), "_cell").withColumn("_cut", large)
    zero = F.lit(0).cast("long")
    whole = rows.where("not _cut").select("_cell", "_cut", zero.alias("_x"), zero.alias("_y"), zero.alias("_block"), "_class", "_group")
    split = rows.where("_cut")
    if not split.isEmpty():
        whole = whole.unionByName(_block_pairs(split))
    met = whole.join(slim, "_class").select("_cell", "_cut", "_x", "_y", "_block", "_class", "_group", "_set")
    met = met.repartition("_cell", "_x", "_y").sortWithinPartitions("_cell", "_cut", "_x", "_y")
    return written(met.mapInArrow(_meet_blocks, "a long, b long"), "links")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Rows of large places once for each pair of blocks (_x, _y) that they meet in.

    A place's largest group is cut into blocks, and so are its other classes. All pairs of blocks meet, but for those within the largest group.
    """
    groups = rows.groupBy("_cell", "_m", "_all", "_group").agg(F.count(F.lit(1)).alias("_count"))
    most = groups.groupBy("_cell", "_m", "_all").agg(F.max(F.struct("_count", "_group")).alias("_most"))
    half = F.greatest(F.lit(1), F.least(F.lit(MEETING // 2), F.floor(F.col("_m") * (TOGETHER // 2) / F.col("_all"))))
    cut = most.withColumn("_half", half).select("_cell", F.col("_most._group").alias("_largest"), F.ceil((F.col("_m") - F.col("_most._count")) / F.col("_half")).alias("_r"), F.ceil(F.col("_most._count") / F.col("_half")).alias("_b"))
    rows = rows.join(cut, "_cell")
    largest, salt = F.col("_group") == F.col("_largest"), F.xxhash64("_class", "_cell")
    rows = rows.withColumn("_block", F.when(largest, F.col("_r") + F.pmod(salt, "_b")).otherwise(F.pmod(salt, "_r")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(largest, F.col("_r") - 1).otherwise(F.col("_r") + F.col("_b") - 1))))
    return rows.select("_cell", "_cut", F.least("_block", "_other").alias("_x"), F.greatest("_block", "_other").alias("_y"), "_block", "_class", "_group")


def class_links(classes: DataFrame) -> DataFrame | None:
    """node, component of classes (_class, _keys, _set: different sets) that have a link; None if no two have."""
    settled = _settling(classes)
    label = None if settled.isEmpty() else components(settled)
    rest = exact_links(classes, label)
    if rest is None or rest.isEmpty():
        return label
    return components(settled.unionByName(rest))


def _grouped(df: DataFrame, text: str, row_id: str, width: int) -> DataFrame:
    """_id, _n (shingles), _digest, _first (smallest id that links reach) and _class (the group that links make; null where no other row is in it for certain) of each row."""
    before = written_tables()
    docs = df.select(F.col(row_id).cast("long").alias("_id"), text_or_empty(text).alias("_whole"))
    sized = written(candidates(docs, width), "sizes")
    able = _aside(sized.where("_can and _id is not null").select("_id").dropDuplicates())
    sets = _with_sets(docs.join(able, "_id", "left_semi").unionByName(docs.where("_id is null")), width)
    merged = sets.groupBy("_digest").agg(F.min("_id").alias("_id"), F.first("_keys").alias("_keys"), F.first("_set").alias("_set"))
    classes = written(merged.withColumn("_class", F.monotonically_increasing_id()), "classes")
    label = class_links(classes)
    named = classes.select(F.col("_digest").alias("_d"), "_class", F.col("_id").alias("_least"))
    if label is not None:
        named = named.join(_aside(label), F.col("_class") == F.col("node"), "left").select("_d", F.coalesce("component", "_class").alias("_class"), "_least")
        least = written(named.groupBy("_class").agg(F.min("_least").alias("_least")), "named")
        named = named.drop("_least").join(_aside(least), "_class")
    named = written(named.select("_d", "_least", "_class"), "named")
    drop_but(df.sparkSession, before, sized, named)
    # most documents can have no link; they take no part in the join
    met = sized.where("_can").join(_aside(named), F.col("_digest") == F.col("_d"), "left").select("_id", "_n", "_digest", F.coalesce("_least", "_id").alias("_first"), "_class")
    return met.unionByName(sized.where("not _can").select("_id", "_n", "_digest", F.col("_id").alias("_first"), F.lit(None).cast("long").alias("_class")))


def near_copies(df: DataFrame, text: str = "text", row_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) of each row of df, and its columns otherwise not.

    Null and empty texts, and those without words, have no shingles and are linked with nothing. Rows of one id are linked as different documents are. Rows
    without an id are linked too, and link others, but never name a component: theirs is null if no row of it has an id.
    """
    return _grouped(df, text, row_id, width).select(F.col("_id").alias(row_id), F.col("_n").alias("n_shingles"), F.col("_first").alias("component_id"))


def _with_digest(aside: Aside, text: str, width: int) -> DataFrame:
    """The rows with _n and _digest of their shingles."""
    at = [n.lower() for n in aside.names].index(text.lower())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in in_slices(batches):
            sets = shingle_sets([t or "" for t in some.column(at).to_pylist()], width) if some.num_rows else []
            more = [pa.array([len(s) for s in sets], pa.int64()), pa.array(map(digest, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays([*some.columns, *more], names=[*some.schema.names, "_n", "_digest"])

    return aside.rows.mapInArrow(add, T.StructType([*aside.rows.schema.fields, T.StructField("_n", T.LongType()), T.StructField("_digest", T.BinaryType())]))


def drop_near_copies(df: DataFrame, text: str = "text", row_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """Of the rows of df that links make a group, the one with the smallest id (rows without an id come last; ties: by a digest of the shingles). All others stay as they are.

    Rows are told apart by their id; where several rows have the same one, or none, by their shingles as well. Rows without shingles are in no group.
    """
    before = written_tables()
    rows = written(_grouped(df, text, row_id, width), "near-rows")
    order = F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("y"), F.col("_digest").alias("z"))
    linked = rows.where("_class is not null")
    first = linked.groupBy("_class").agg(F.min(order).alias("_w"))
    gone = written(linked.join(first, "_class").where(order > F.col("_w")).select("_id", "_digest").dropDuplicates(), "gone")
    many = written(rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1 or _id is null").select("_id"), "repeated-ids")
    drop_but(df.sparkSession, before, gone, many)
    aside = Aside(df)
    key = aside[row_id].cast("long")
    out = _aside(gone.select("_id").unionByName(many).where("_id is not null").dropDuplicates())
    plain = aside.rows.where(key.isNotNull()).join(out, key == F.col("_id"), "left_anti")
    if many.isEmpty():
        return plain.select(*aside.back())
    repeated = _with_digest(aside, text, width).join(_aside(many.withColumnRenamed("_id", "_r")), key.eqNullSafe(F.col("_r")), "left_semi")
    repeated = repeated.join(_aside(gone.toDF("_g", "_h")), key.eqNullSafe(F.col("_g")) & (F.col("_digest") == F.col("_h")), "left_anti").withColumn("_key", key)
    one = repeated.where("_n > 0").dropDuplicates(["_key", "_digest"]).unionByName(repeated.where("_n = 0"))
    return plain.select(*aside.back()).unionByName(one.select(*aside.back()))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
