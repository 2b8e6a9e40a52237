"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Counts of ORDER-grams are gathered from all trusted rows (but for a fold that sets the thresholds), and the lower orders' counts of different
continuations, the contexts' sums and the interpolated probabilities follow by joins. Probabilities are parted into shards by an n-gram's two characters before the last, so
that a shard has all that an n-gram's back-off needs; the two lowest orders, whose size the alphabet bounds, are in each.

Documents aren't moved to be scored: chunks of them send each shard their different n-grams, with how often each document has them, and
get sums of log-probabilities back, which are added up per document. A document is kept if its perplexity isn't above its language's
threshold: a high quantile of the trusted rows that the model has not seen, with a margin.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import Aside, drop_but, give_back, in_slices, table, text_or_empty, written, written_tables

ORDER, BITS = 4, 12
ALPHABET = 1 << BITS
#: Code points up to which characters are told apart; those above share the rest of the alphabet.
OWN = 0x250
START, END = 1, 2
FOLDS = 5
QUANTILE, MARGIN = 0.995, 1.05
#: Held-out trusted rows that a language needs for a threshold of its own alone; others have the higher one of their own and that of all rows, so that no small language is judged by large ones.
ENOUGH = 50
#: Code points and rows of a chunk, and rows of the model in a shard, about.
CHUNK_CHARS, CHUNK_ROWS, SHARD_ROWS = 1_000_000, 2000, 20_000
#: Documents whose requests one task answers for a shard, about.
DOCS_A_TASK = 25_000
#: Trusted rows up to which their ids are broadcast.
BROADCAST_IDS = 2_000_000


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(points < OWN, points, OWN + points % (ALPHABET - OWN))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-grams of texts, of each character and the end, as numbers, and the place of the text each is of."""
    parts = [np.concatenate([np.full(ORDER - 1, START), symbols(t), [END]]) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    keys = np.zeros(max(0, len(flat) - ORDER + 1), np.int64)
    for k in range(ORDER):
        keys = (keys << BITS) | flat[k : len(flat) - ORDER + 1 + k]
    begin = np.cumsum(sizes) - sizes
    inside = np.ones(len(flat), bool)
    for k in range(1, ORDER):
        inside[(begin + sizes - k)] = False
    inside = inside[: len(keys)]
    return keys[inside], np.repeat(np.arange(len(texts)), sizes)[: len(keys)][inside]


def _chunks(ids: list, hashes: list, texts: list[str]) -> Iterator[tuple[list, list, list[str]]]:
    at, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_CHARS or k + 1 - at >= CHUNK_ROWS or k + 1 == len(texts):
            yield ids[at : k + 1], hashes[at : k + 1], texts[at : k + 1]
            at, size = k + 1, 0


def count_grams(texts: DataFrame) -> DataFrame:
    """key, n of the one column of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in in_slices(batches, CHUNK_ROWS // 4):
            rows = batch.column(0).to_pylist()
            for _, _, some in _chunks(rows, rows, rows):
                keys, n = np.unique(grams(some)[0], return_counts=True)
                both, where = np.unique(np.concatenate([held[0], keys]), return_inverse=True)
                held = both, np.bincount(where, np.concatenate([held[1], n])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["key", "n"])

    return texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def discounts(rows: DataFrame) -> list[float]:
    """What modified Kneser-Ney takes from counts of 1, 2, and 3 and more, from how many n-grams have counts of 1 to 4."""
    seen = {r["n"]: r["c"] for r in rows.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    t = [seen.get(k, 0) for k in (1, 2, 3, 4)]
    y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0.5
    return [float(min(max(k - (k + 1) * y * t[k] / t[k - 1] if t[k - 1] else 0.5, 0.05), 0.95 * k)) for k in (1, 2, 3)]


def model_rows(counts: DataFrame) -> DataFrame:
    """order, context (whether key is one), key, value: probabilities of n-grams, and what contexts leave to lower orders."""
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy(F.col("key").bitwiseAND((1 << BITS * k) - 1).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    out, lower = [], None
    for k in range(1, ORDER + 1):
        d = discounts(tables[k])
        taken = F.when(F.col("n") == 1, F.lit(d[0])).when(F.col("n") == 2, F.lit(d[1])).otherwise(F.lit(d[2]))
        rows = tables[k].withColumn("ctx", F.shiftright("key", BITS)).withColumn("d", taken)
        contexts = rows.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        rows = rows.join(contexts, "ctx").withColumn("low", F.col("key").bitwiseAND((1 << BITS * (k - 1)) - 1))
        if lower is None:
            rows = rows.withColumn("q", F.lit(1.0 / ALPHABET))
        else:
            rows = rows.join(lower.select(F.col("key").alias("low"), F.col("value").alias("q")), "low")
        lower = written(rows.select("key", ((F.col("n") - F.col("d")) / F.col("total") + F.col("left") / F.col("total") * F.col("q")).alias("value")), f"kn-{k}")
        out.append(lower.select(F.lit(k).alias("level"), F.lit(False).alias("context"), "key", "value"))
        out.append(contexts.select(F.lit(k).alias("level"), F.lit(True).alias("context"), F.col("ctx").alias("key"), (F.col("left") / F.col("total")).alias("value")))
    whole = out[0]
    for rows in out[1:]:
        whole = whole.unionByName(rows)
    return whole


def _shard(pair: Column, shards: int) -> Column:
    return F.pmod(F.shiftright(pair * F.lit(2654435761), 16), F.lit(shards))


def in_shards(rows: DataFrame, shards: int) -> DataFrame:
    """shard, and the model's rows for it as arrays."""
    pairs = F.when(F.col("level") == ORDER, F.when(F.col("context"), F.col("key")).otherwise(F.shiftright("key", BITS)).bitwiseAND(ALPHABET**2 - 1))
    pairs = pairs.otherwise(F.when(F.col("context"), F.col("key")).otherwise(F.shiftright("key", BITS)))  # of level ORDER - 1
    low = F.col("level") < ORDER - 1
    placed = rows.withColumn("shard", F.explode(F.when(low, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(_shard(pairs, shards).cast("int")))))
    every = placed.groupBy("shard").agg(F.collect_list(F.struct("level", "context", "key", "value")).alias("r"))
    return every.select("shard", *(F.col(f"r.{c}").alias(c) for c in ("level", "context", "key", "value")))


class ShardModel:
    def __init__(self, level: np.ndarray, context: np.ndarray, key: np.ndarray, value: np.ndarray) -> None:
        self.tables = {}
        for k in range(1, ORDER + 1):
            for c in (False, True):
                own = (level == k) & (context == c)
                order = np.argsort(key[own], kind="stable")
                self.tables[k, c] = key[own][order], value[own][order]

    def _get(self, k: int, context: bool, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, value = self.tables[k, context]
        if not len(known):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return known[at] == keys, value[at]

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """Of ORDER-grams of this shard: from the highest order that has seen them, times what the contexts above leave."""
        p, left, todo = np.zeros(len(keys)), np.ones(len(keys)), np.ones(len(keys), bool)
        for k in range(ORDER, 0, -1):
            gram = keys & ((1 << BITS * k) - 1)
            hit, value = self._get(k, False, gram)
            hit &= todo
            p[hit] = value[hit] * left[hit]
            todo &= ~hit
            seen, rest = self._get(k, True, gram >> BITS)
            left = np.where(todo & seen, left * rest, left)
        p[todo] = left[todo] / ALPHABET
        return np.log(p)


def _pack(docs: int, names: bytes, keys: np.ndarray, place: np.ndarray, n: np.ndarray) -> bytes:
    """Entries in order of keys and then places, compressed: keys and places as steps, a place step of 255 and more apart."""
    different, each = np.unique(keys, return_counts=True)
    steps = np.diff(place, prepend=0)
    first = np.cumsum(each)[:-1]
    steps[first] = place[first]
    far = steps[steps >= 255].astype("<u2").tobytes()
    planes = np.diff(different, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    body = planes + each.astype("<u4").tobytes() + np.minimum(steps, 255).astype(np.uint8).tobytes() + n.astype(np.uint8).tobytes() + far
    return struct.pack("<QQQ", docs, len(different), len(keys)) + names + zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(payload: bytes) -> tuple[int, list[np.ndarray]]:
    """Documents, and: nulls among ids, ids, hashes, keys, entries of each key, places and counts of entries."""
    docs, different, entries = struct.unpack_from("<QQQ", payload)
    at, parts = 24, []
    for kind, n in ((np.uint8, -(-docs // 8)), ("<i8", docs), ("<i8", docs)):
        parts.append(np.frombuffer(payload, kind, n, at))
        at += parts[-1].nbytes
    body = zstandard.ZstdDecompressor().decompress(payload[at:])
    keys = np.cumsum(np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * different).reshape(8, -1).T).view("<i8").ravel())
    at = 8 * different
    each = np.frombuffer(body, "<u4", different, at).astype(np.int64)
    steps = np.frombuffer(body, np.uint8, entries, at + 4 * different).astype(np.int64)
    n = np.frombuffer(body, np.uint8, entries, at + 4 * different + entries)
    steps[steps == 255] = np.frombuffer(body, "<u2", -1, at + 4 * different + 2 * entries)
    total = np.cumsum(steps)
    first = np.cumsum(each) - each
    place = total - np.repeat(total[first] - steps[first], each)
    return docs, [*parts, keys, each, place, n]


def requests(docs: DataFrame, shards: int) -> DataFrame:
    """From _id, _hash, _whole: rows of shard, chunk and payload for each shard that a chunk of documents asks."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = 0
        for batch in in_slices(batches, CHUNK_ROWS // 4):
            for ids, hashes, texts in _chunks(*(batch.column(c).to_pylist() for c in range(3))):
                keys, place = grams(texts)
                both, n = np.unique((keys << 11) | place, return_counts=True)
                times = -(-n // 255)  # a count above 255 takes several entries
                last = np.cumsum(times) - 1
                both, rest = np.repeat(both, times), n - 255 * (times - 1)
                n = np.full(len(both), 255)
                n[last] = rest
                keys, place = both >> 11, both & 2047
                shard = (((keys >> BITS) & (ALPHABET**2 - 1)) * 2654435761 >> 16) % shards
                names = np.packbits(np.array([i is None for i in ids], bool)).tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes() + np.array(hashes, "<i8").tobytes()
                found = []
                for s in np.unique(shard).tolist():
                    own = shard == s
                    found.append((s, _pack(len(ids), names, keys[own], place[own], n[own])))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([chunk] * len(found), pa.int64()), pa.array([p for _, p in found], pa.binary())], names=["shard", "chunk", "payload"])
                chunk += 1

    return docs.select("_id", "_hash", "_whole").mapInArrow(ask, "shard int, chunk long, payload binary")


def _answer(model: ShardModel, payload: bytes) -> pa.RecordBatch:
    docs, parts = _unpack(payload)
    null, ids, hashes, keys, each, place, n = parts
    n = n.astype(np.float64)
    total = np.bincount(place, np.repeat(model.log_probability(keys), each) * n, docs)
    size = np.bincount(place, n, docs).astype(np.int64)
    there = np.flatnonzero(size)
    null = np.unpackbits(null, count=docs).astype(bool)
    return pa.RecordBatch.from_arrays([pa.array(ids[there], mask=null[there]), pa.array(hashes[there]), pa.array(total[there]), pa.array(size[there])], names=["_id", "_hash", "lp", "n"])


def scores(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """_id, _hash and perplexity of each different document in docs (_id, _hash, _whole) under a model (see model_rows)."""
    shards = max(8, -(-rows.count() // SHARD_ROWS))
    salts = max(1, docs.count() // DOCS_A_TASK)
    held = in_shards(rows, shards).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = requests(docs, shards).withColumn("salt", F.pmod(F.xxhash64("payload"), F.lit(salts)).cast("int"))
    kinds = (("level", "array<int>"), ("context", "array<boolean>"), ("key", "array<bigint>"), ("value", "array<double>"))
    asked = asked.select("shard", "salt", "payload", *(F.lit(None).cast(t).alias(c) for c, t in kinds))
    held = held.select("shard", "salt", F.lit(None).cast("binary").alias("payload"), "level", "context", "key", "value")
    # each shard's model, and then what it is asked
    both = held.unionByName(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("payload").isNotNull())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            for row in range(batch.num_rows):
                payload = batch.column(2)[row].as_py()
                if payload is None:
                    model = ShardModel(*(np.array(batch.column(c)[row].values.to_pylist(), t) for c, t in ((3, int), (4, bool), (5, np.int64), (6, float))))
                else:
                    yield _answer(model, payload)
        model = payload = batch = None
        give_back()

    sums = both.mapInArrow(answer, "_id long, _hash long, lp double, n long").groupBy("_id", "_hash").agg(F.sum("lp").alias("lp"), F.sum("n").alias("n"))
    return sums.select("_id", "_hash", F.exp(-F.col("lp") / F.col("n")).alias("perplexity"))


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """docs with perplexity, threshold and kept; columns of these names are replaced.

    Trusted are rows whose every label of quality is 1. Null counts as the empty text; empty texts have no perplexity and are kept, as is all if no row is trusted. A null language is one of
    its own. Rows with the same id and text have the same result.
    """
    aside, before = Aside(docs, "perplexity", "threshold", "kept"), written_tables()
    trusted = labels.where("quality is not null").groupBy(F.col(row_id).alias("_id")).agg(F.min("quality").alias("_q")).where("_q = 1").select("_id")
    keyed = aside.rows.withColumn("_whole", text_or_empty(aside[text])).withColumn("_id", aside[row_id].cast("long")).withColumn("_hash", F.xxhash64("_whole")).withColumn("_lang", F.coalesce(aside[lang], F.lit("")))
    if trusted.count() <= BROADCAST_IDS:
        trusted = F.broadcast(trusted)
    fold = F.pmod(F.xxhash64("_id"), F.lit(FOLDS)) == 0
    counts = written(count_grams(keyed.join(trusted, "_id", "left_semi").where(~fold).select("_whole")), "kn-counts")
    if counts.isEmpty():
        return aside.rows.select(*aside.back(), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    rows = written(model_rows(counts), "kn-model")
    found = written(scores(keyed.where("_whole <> ''"), rows), "kn-scores")
    drop_but(docs.sparkSession, before, found)
    unseen = keyed.where(fold & (F.col("_whole") != "")).select("_id", "_hash", "_lang").join(trusted, "_id", "left_semi").join(found, ["_id", "_hash"])
    limit = F.percentile_approx("perplexity", F.lit(QUANTILE), F.lit(10_000)) * MARGIN
    every = unseen.agg(limit.alias("t")).collect()[0]["t"]
    own = unseen.groupBy("_lang").agg(limit.alias("_own"), F.count(F.lit(1)).alias("_n"))
    own = own.select("_lang", F.when(F.col("_n") >= ENOUGH, F.col("_own")).otherwise(F.greatest("_own", F.lit(every).cast("double"))).alias("_own"))
    result = keyed.drop("_whole").join(found.withColumnRenamed("_id", "_i").withColumnRenamed("_hash", "_h"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left").join(own, "_lang", "left")
    result = result.withColumn("threshold", F.coalesce("_own", F.lit(every).cast("double"), F.lit(float("inf"))))
    return result.withColumn("kept", F.col("perplexity").isNull() | (F.col("perplexity") <= F.col("threshold"))).select(*aside.back(), "perplexity", "threshold", "kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judged(docs, table(spark, sf_dir, "labels")).select("doc_id", "lang", "perplexity", "threshold", "kept")
