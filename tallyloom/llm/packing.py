"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A document longer than a sequence is cut into pieces of that length; shorter ones stay whole. Pieces that fill a sequence are one. The others are dealt at random
(by hash) to groups of about GROUP pieces, and each group is packed alone: some thousand pieces fill sequences almost
without gaps, and a group leaves at most one poorly filled sequence.

Within a group, a sequence starts with the longest unpacked piece and takes the longest that fits until none does. If a gap
is left, its smallest piece is exchanged for the two unpacked pieces whose sum fits the widened gap best, if
that fills more. Only lengths are held, in a histogram, so a step costs the sequence length at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import in_slices, table, text_or_empty, written
from tallyloom.llm.word_bpe import END, default_path, encoder

LENGTH = 4096
GROUP = 8192


def pack(lengths: np.ndarray, room: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Lengths are 1 to room; equal lengths are interchangeable and taken in order."""
    lengths = np.asarray(lengths, np.int64)
    if lengths.size and (lengths.min() < 1 or lengths.max() > room):
        raise ValueError("lengths must be between 1 and the room of a sequence")
    left = np.bincount(lengths, minlength=room + 1)
    best = np.maximum.accumulate(np.where(left > 0, np.arange(room + 1), 0))  # longest unpacked length up to x
    bins: list[list[int]] = []

    def take(x: int) -> None:
        left[x] -= 1
        if left[x] == 0:
            end = x + int(np.argmax(best[x:] != x)) if best[-1] != x else room + 1
            best[x:end] = best[x - 1]

    def give(x: int) -> None:
        left[x] += 1
        if left[x] == 1:
            end = x + int(np.argmax(best[x:] > x)) if best[-1] > x else room + 1
            best[x:end] = x

    while best[room]:
        found, gap = [], room
        while gap and (x := int(best[gap])):
            take(x)
            found.append(x)
            gap -= x
        if gap and len(found) > 1:
            small = found[-1]
            wide = gap + small
            first = np.arange(1, wide // 2 + 1)
            first = first[left[first] > 0]
            if first.size:
                second = best[wide - first]
                ok = (second > first) | ((second == first) & (left[first] > 1))
                total = np.where(ok, first + second, 0)
                k = int(np.argmax(total))
                if total[k] > small:
                    a, b = int(first[k]), int(second[k])
                    take(a)
                    take(b)
                    give(small)
                    found[-1:] = [b, a]
        bins.append(found)
    order = np.argsort(-lengths, kind="stable")
    starts = np.zeros(room + 2, np.int64)  # where each length begins in that order
    counts = np.bincount(lengths, minlength=room + 1)
    starts[:-1] = len(lengths) - np.cumsum(counts)
    bin_of, offset_of = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for number, found in enumerate(bins):
        at = 0
        for x in found:
            row = order[starts[x]]
            starts[x] += 1
            bin_of[row], offset_of[row] = number, at
            at += x
    return bin_of, offset_of


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def pieces(df: DataFrame, text: str = "text", row_id: str = "doc_id", path: str | None = None, room: int = LENGTH, end: int = END) -> DataFrame:
    """A row for each piece of each document's ids, the end id included: doc_id, piece, start, length, ids_crc32 and ids (packed)."""
    path = path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(path).ids, np.array([end], "<u4").tobytes()
        for batch in in_slices(batches):
            rows = [[], [], [], [], []]
            for doc, whole in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(whole.as_py()) + last
                for n, at in enumerate(range(0, len(ids), room * 4)):
                    part = ids[at : at + room * 4]
                    for to, x in zip(rows, (doc, n, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(row_id).cast("long"), text_or_empty(text)).mapInArrow(cut, PIECES)


def best_two_fit(found: DataFrame, room: int = LENGTH, group: int = GROUP) -> DataFrame:
    """found (see pieces) with sequence_id and offset.

    Pieces as long as a sequence are one each. The others are numbered in a written table and dealt by the number's hash, so that equal rows go to different groups like others, and a task
    that runs again deals them alike; a group has about as many pieces as it should, whatever they are.
    """
    numbered = written(found, "pieces").withColumn("_n", F.monotonically_increasing_id())
    whole = numbered.where(F.col("length") == room).select(*PIECES_NAMES, (-1 - F.col("_n")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = numbered.where(F.col("length") < room)
    groups = max(1, round(rest.count() / group))
    schema = PIECES + ", sequence_id long, offset long"

    def fill(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece", "_n"], kind="stable", ignore_index=True)
        number, offset = pack(part["length"].to_numpy(), room)
        out = part[PIECES_NAMES].copy()
        out["sequence_id"], out["offset"] = number + (int(key[0]) << 32), offset
        return out

    packed = rest.withColumn("_group", F.pmod(F.xxhash64("_n"), F.lit(groups))).groupBy("_group").applyInPandas(fill, schema)
    return whole.unionByName(packed)


def packed(df: DataFrame, text: str = "text", row_id: str = "doc_id", path: str | None = None, room: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Every document of df in sequences of at most room tokens.

    Null and empty texts are a document of the end id alone. Documents with the same id, or without one, are packed like others and
    each has its own rows. An empty table gives no rows. The table of pieces stays in the shared folder until the session drops it.
    """
    return best_two_fit(pieces(df, text, row_id, path, room), room, group)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
