"""Wavelet matrices of token ids: a succinct file per shard that is read without being unpacked into ids.

Plane by plane from the highest bit, each id gives a bit, and the ids are dealt stably into those with 0 and those with 1. With a count of ones
at each block of BLOCK bits, every plane answers rank and select, and those give the id at a place (access), the
number of an id up to a place (count), and the place of its k-th occurrence (locate).

The most frequent ids have a matrix of their own, so that most ids are 9 planes deep.

File, little-endian: b"WM01"; as unsigned 64-bit numbers: documents, ids, planes of the root, planes of the frequent ids' matrix, rare ids and planes of
their matrix; then as (64-bit length, zstd frame): document ids (64-bit, with a mask of nulls before them), their lengths (64-bit), the ids
that occur (32-bit, most frequent first) and each plane of the three (bits, high bit first, and the counts of ones, 32-bit).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import shared_folder, table, text_or_empty, written
from tallyloom.llm.word_bpe import END, default_path, encoder

MAGIC = b"WM01"
BLOCK = 512
#: Ids from which on a shard is closed; it ends with a whole document.
SHARD = 1_000_000
#: Ids that have 8 planes, under a plane that parts them from the others.
FREQUENT = 256


def _ones_before(bits: np.ndarray) -> np.ndarray:
    """Ones before each block of packed bits, and in all."""
    per = np.bitwise_count(np.pad(bits, (0, -len(bits) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
    return np.concatenate([np.zeros(1, np.uint32), np.cumsum(per, dtype=np.uint32)])


class WaveletMatrix:
    def __init__(self, size: int, planes: list[np.ndarray], ones: list[np.ndarray]) -> None:
        self.size, self.planes, self.ones = size, planes, ones
        self.zeros = [size - int(x[-1]) for x in ones]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        """ids: unsigned integers, below 2 ** 32."""
        most = int(ids.max()) if ids.size else 0
        kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
        now, planes, ones = ids.astype(kind), [], []
        for level in range(max(1, most.bit_length()))[::-1]:
            bit = (now & kind(1 << level)).astype(bool)
            planes.append(np.packbits(bit))
            ones.append(_ones_before(planes[-1]))
            zeros, dealt = len(now) - int(ones[-1][-1]), np.empty_like(now)
            np.compress(bit, now, out=dealt[zeros:])
            np.compress(~bit, now, out=dealt[:zeros])
            now = dealt
        return cls(len(ids), planes, ones)

    def _rank(self, level: int, place: int) -> int:
        """Ones among the first place bits of a plane."""
        block = place // BLOCK
        at, plane = block * BLOCK // 8, self.planes[level]
        whole = int(np.bitwise_count(plane[at : place // 8]).sum(dtype=np.int64))
        rest = int(plane[place // 8]) >> (8 - place % 8) if place % 8 else 0
        return int(self.ones[level][block]) + whole + rest.bit_count()

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value in a plane."""
        low, high = 0, self.size
        while low < high:
            mid = (low + high) // 2
            ones = self._rank(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, place: int) -> int:
        if not 0 <= place < self.size:
            raise IndexError(place)
        found = 0
        for level, plane in enumerate(self.planes):
            bit = plane[place // 8] >> (7 - place % 8) & 1
            ones = self._rank(level, place)
            place = self.zeros[level] + ones if bit else place - ones
            found = found << 1 | int(bit)
        return found

    def _range(self, token: int, end: int) -> tuple[int, int]:
        low, high, top = 0, end, len(self.planes) - 1
        if token >> (top + 1):
            return 0, 0
        for level in range(top + 1):
            a, b = self._rank(level, low), self._rank(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if token >> (top - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of token among the first end ids (all, if None)."""
        low, high = self._range(token, self.size if end is None else end)
        return high - low

    def locate(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of token."""
        low, high = self._range(token, self.size)
        if not 0 <= k < high - low:
            raise IndexError(k)
        place, top = low + k, len(self.planes) - 1
        for level in range(top + 1)[::-1]:
            bit = token >> (top - level) & 1
            place = self._select(level, bit, place - self.zeros[level] if bit else place)
        return place

    def ids(self) -> np.ndarray:
        """All ids in order."""
        now = np.zeros(self.size, np.uint8 if len(self.planes) <= 8 else np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes))[::-1]:
            bit = np.unpackbits(self.planes[level], count=self.size).view(bool)
            zeros, above = self.zeros[level], np.empty_like(now)
            now[zeros:] |= now.dtype.type(1 << (len(self.planes) - 1 - level))
            above[np.flatnonzero(bit)], above[np.flatnonzero(~bit)] = now[zeros:], now[:zeros]
            now = above
        return now

    def parts(self) -> list[bytes]:
        return [p.tobytes() + o.astype("<u4").tobytes() for p, o in zip(self.planes, self.ones, strict=True)]


class TokenStore:
    """A sequence of ids in two wavelet matrices under a root plane: one of the FREQUENT most frequent ids, 8 planes deep, and one of all others.

    symbols are the ids that occur, most frequent first (ties: smaller id); the matrices hold places in it.
    """

    def __init__(self, symbols: np.ndarray, root: WaveletMatrix, often: WaveletMatrix, rare: WaveletMatrix) -> None:
        self.symbols, self.root, self.child, self.size = symbols, root, (often, rare), root.size
        self.place = {int(s): n for n, s in enumerate(symbols)}

    @classmethod
    def build(cls, ids: np.ndarray) -> TokenStore:
        count = np.bincount(ids)
        symbols = np.flatnonzero(count)
        symbols = symbols[np.argsort(-count[symbols], kind="stable")]
        code = np.zeros(len(count), np.uint16 if len(symbols) <= 1 << 16 else np.uint32)
        code[symbols] = np.arange(len(symbols))
        coded = code[ids]
        rare = coded >= FREQUENT
        return cls(symbols, WaveletMatrix.build(rare.astype(np.uint8)), WaveletMatrix.build(np.compress(~rare, coded).astype(np.uint8)), WaveletMatrix.build(np.compress(rare, coded) - code.dtype.type(FREQUENT)))

    def access(self, place: int) -> int:
        bit = self.root.access(place)
        return int(self.symbols[self.child[bit].access(self.root.count(bit, place)) + bit * FREQUENT])

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of token among the first end ids (all, if None)."""
        if (n := self.place.get(token)) is None:
            return 0
        bit = int(n >= FREQUENT)
        return self.child[bit].count(n - bit * FREQUENT, self.root.count(bit, self.size if end is None else end))

    def locate(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of token."""
        if (n := self.place.get(token)) is None:
            raise IndexError(k)
        bit = int(n >= FREQUENT)
        return self.root.locate(bit, self.child[bit].locate(n - bit * FREQUENT, k))

    def ids(self) -> np.ndarray:
        """All ids in order, unsigned 32-bit."""
        rare = self.root.ids().astype(bool)
        found = np.empty(self.size, np.uint32)
        symbols = self.symbols.astype(np.uint32)
        found[np.flatnonzero(~rare)] = symbols[self.child[0].ids()]
        found[np.flatnonzero(rare)] = symbols[FREQUENT:][self.child[1].ids()]
        return found


def to_file(docs: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    store, pack = TokenStore.build(ids), zstandard.ZstdCompressor(level=1).compress
    names = np.packbits(np.array([d is None for d in docs], bool)).tobytes() + np.array([d or 0 for d in docs], "<i8").tobytes()
    parts = [names, np.asarray(lengths, "<i8").tobytes(), store.symbols.astype("<u4").tobytes()]
    matrices = (store.root, *store.child)
    head = struct.pack("<QQQQQQ", len(docs), *(x for m in matrices[:1] for x in (m.size, len(m.planes))), len(store.child[0].planes), store.child[1].size, len(store.child[1].planes))
    return MAGIC + head + b"".join(struct.pack("<Q", len(x)) + x for x in map(pack, parts + [p for m in matrices for p in m.parts()]))


def from_file(blob: bytes) -> tuple[list[int | None], np.ndarray, TokenStore]:
    """Documents' ids, their lengths, and the store of all their token ids."""
    if blob[:4] != MAGIC:
        raise ValueError("not a file of this format")
    docs, size, top, often, rare, deep = struct.unpack_from("<QQQQQQ", blob, 4)
    at, parts = 52, []
    for _ in range(3 + top + often + deep):
        (n,) = struct.unpack_from("<Q", blob, at)
        parts.append(zstandard.ZstdDecompressor().decompress(blob[at + 8 : at + 8 + n]))
        at += 8 + n
    mask = -(-docs // 8)
    null = np.unpackbits(np.frombuffer(parts[0][:mask], np.uint8), count=docs)
    names = [None if x else int(d) for x, d in zip(null, np.frombuffer(parts[0][mask:], "<i8"), strict=True)]

    def matrix(n: int, planes: list[bytes]) -> WaveletMatrix:
        bits = -(-n // 8)
        return WaveletMatrix(n, [np.frombuffer(x[:bits], np.uint8) for x in planes], [np.frombuffer(x[bits:], "<u4") for x in planes])

    cut = (3, 3 + top, 3 + top + often, len(parts))
    held = [matrix(n, parts[a:b]) for n, a, b in zip((size, size - rare, rare), cut, cut[1:], strict=False)]
    return names, np.frombuffer(parts[1], "<i8"), TokenStore(np.frombuffer(parts[2], "<u4"), *held)


FILES = "first_id long, part long, n_docs long, n_tokens long, file binary"


def encode_files(df: DataFrame, text: str = "text", row_id: str = "doc_id", path: str | None = None, end: int = END, shard: int = SHARD) -> DataFrame:
    """Files of the documents in ascending order of their ids, a row each: first_id, part (order of files), n_docs, n_tokens, file.

    Null and empty texts are a document of the end id alone; documents without an id come first; documents of one id are next
    to each other, in no set order. A document is never split, so a file has SHARD ids and one document at most.
    """
    path = path or default_path()
    ordered = df.select(F.col(row_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered = ordered.withColumn("_part", F.spark_partition_id().cast("long"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(path).ids, np.array([end], "<u4").tobytes()
        docs, sizes, ids, total, files = [], [], [], 0, 0

        def close(part: int) -> pa.RecordBatch:
            blob = to_file(docs, np.array(sizes), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([docs[0]], pa.int64()), pa.array([(part << 32) + files], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([total], pa.int64()), pa.array([blob], pa.binary())], names=["first_id", "part", "n_docs", "n_tokens", "file"])

        part = 0
        for batch in batches:
            for doc, whole, number in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                part = number.as_py()
                found = np.frombuffer(encode(whole.as_py()) + last, "<u4").astype(np.uint16 if end < 1 << 16 and encoder(path).small else np.uint32)
                docs.append(doc.as_py())
                sizes.append(len(found))
                ids.append(found)
                total += len(found)
                if total >= shard:
                    yield close(part)
                    docs, sizes, ids, total, files = [], [], [], 0, files + 1
        if docs:
            yield close(part)

    return ordered.mapInArrow(build, FILES)


def read_files(files: DataFrame) -> DataFrame:
    """The documents in files (see encode_files): part, doc_id, start (within its file), n_tokens, ids_crc32, read by way of the matrix."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, lengths, matrix = from_file(blob.as_py())
                ids = matrix.ids().astype("<u4", copy=False)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[b - n : b]) for n, b in zip(lengths.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "file").mapInArrow(read, "part long, doc_id long, start long, n_tokens long, ids_crc32 long")


def with_global_start(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """start as the number of ids of all documents before it. sizes: part and n_tokens of each file. Files of one range of ids are added up first, so one task only orders the ranges."""
    ranged = sizes.withColumn("_range", F.shiftright("part", 32))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("_range").agg(F.sum("n_tokens").alias("_all")).withColumn("_first", F.coalesce(F.sum("_all").over(before.orderBy("_range")), F.lit(0)))
    within = F.coalesce(F.sum("n_tokens").over(before.partitionBy("_range").orderBy("part")), F.lit(0))
    base = ranged.withColumn("_within", within).join(ranges, "_range").select("part", (F.col("_first") + F.col("_within")).alias("_base"))
    return rows.join(base, "part").select("doc_id", (F.col("start") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each of files (see encode_files) as part-<part>.wm into folder, which all executors reach by pyarrow; its other columns come back, when all are written.

    A file is written under another name and then renamed, so that a task that is run again, or twice at once, leaves whole files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("file"), strict=True):
                aside = f"{root}/.{uuid.uuid4().hex}"
                with system.open_output_stream(aside) as to:
                    to.write(blob.as_buffer())
                system.move(aside, f"{root}/part-{part:020d}.wm")
            yield batch.drop_columns(["file"])

    system, root = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(root)
    return written(files.mapInArrow(write, FILES.removesuffix(", file binary")), "wavelet-sizes")


def found_files(spark: SparkSession, folder: str) -> DataFrame:
    """part and file of the files in folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.wm").load(folder)
    return found.select(F.regexp_extract("path", r"part-(\d+)\.wm$", 1).cast("long").alias("part"), F.col("content").alias("file"))


def op9_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/wavelet-{uuid.uuid4().hex}"
    if "://" not in folder and ":/" not in folder:
        folder = "file://" + folder
    sizes = write_files(encode_files(table(spark, sf_dir, "documents")), folder)
    return with_global_start(read_files(found_files(spark, folder)), sizes)
