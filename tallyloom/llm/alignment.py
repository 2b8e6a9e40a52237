"""Which tokens of two tokenizers cover the same bytes, and how often each pair of ids is linked in the corpus.

A batch's texts are one run of bytes. Each token ends at a byte offset in it; the ends of both tokenizers are counted by bincount, and the bytes are cut into groups where both have one. Each
token's group is a prefix sum of the cuts, and prefix sums over groups give each document's counts.

Both tokenizers work on words in practice, so a worker keeps the ids of the words it has seen. Counts of pairs are added up over a chunk of documents
before they are shuffled, and a chunk gets the counts of its different pairs back: what a pair costs doesn't depend on how often it occurs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm.common import drop_but, give_back, in_slices, table, text_or_empty, written, written_tables
from tallyloom.llm.word_bpe import byte_letters, packed

MODEL_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bits of B's ids in a pair's code, a << BITS | b; and bits of a pair's documents in a chunk.
BITS, COUNT = 24, 20
#: Code points and rows of a chunk, and code points of a batch that is aligned at once, about.
CHUNK, CHUNK_ROWS, AT_ONCE = 4_000_000, 50_000, 500_000
#: Words whose ids a worker keeps.
WORDS = 250_000
#: Groups with more links than this are counted by different ids.
WIDE = 4096
SPACE = "▁"


class Pair:
    """Both tokenizers: ids and bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: b for b, c in byte_letters().items()}
        size_a = self.a.get_vocab_size()
        self.bytes_a = [bytes(byte_of[c] for c in t) if t and all(c in byte_of for c in t) else (t or "").encode() for t in map(self.a.id_to_token, range(size_a))]
        pieces = [self.b.id_to_piece(n) for n in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace(SPACE, " ").encode() for n, p in enumerate(pieces)]
        self.size_a, self.size_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        self.names = [b"%d%s" % (n, mark) for n in range(max(size_a, len(pieces))) for mark in (b",", b"|", b";")]
        # words may be encoded apart if no piece goes on from one to the next, and the model changes no character
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.apart = not inner and self.b.normalize("ﬁ\tＡ") == SPACE + "ﬁ\tＡ"
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.ranked = self._by_rank(path_a)
        if len(self.bytes_b) >= 1 << BITS or size_a >= 1 << (63 - BITS - COUNT):
            raise ValueError("more ids than a pair's code has room for")

    def _by_rank(self, path: str) -> tiktoken.Encoding | None:
        """The same merges by rank, which is faster; none if the file's model isn't a plain byte-level one whose merges are in the order of their ids."""
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, pre = told["model"], told.get("pre_tokenizer") or {}
        made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model.get("merges", [])]
        plain = model["type"] == "BPE" and not told.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        special = {t["id"] for t in told.get("added_tokens", [])}
        ranks = {token: n for n, token in enumerate(self.bytes_a) if n not in special}
        if not plain or made != sorted(set(made)) or sorted(made + [ranks.get(bytes([b]), -1) for b in range(256)]) != sorted(ranks.values()):
            return None
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _library(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of texts as the libraries give them, as 32-bit numbers."""
        spaced = [" " + t for t in texts]
        ids_a = map(self.ranked.encode_ordinary, spaced) if self.ranked else (x.ids for x in self.a.encode_batch_fast(spaced, add_special_tokens=False))
        for a, b in zip(ids_a, self.b.encode(texts, num_threads=1), strict=True):
            yield packed(a), packed(b)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of A for space + text and of B for text."""
        if len(self.known) > WORDS:
            self.known.clear()
        known = self.known
        parts = [t.split(" ") if self.apart and "  " not in t and t[:1] != " " and t[-1:] != " " and SPACE not in t else [t] for t in texts]
        missing = list({w for words in parts if len(words) > 1 for w in words if w not in known})
        for at in range(0, len(missing), 4096):
            some = missing[at : at + 4096]
            known.update(zip(some, self._library(some), strict=True))
        whole = [n for n, words in enumerate(parts) if len(words) == 1]
        alone = dict(zip(whole, self._library([texts[n] for n in whole]), strict=True))
        out = []
        for n, words in enumerate(parts):
            if n in alone:
                out.append(alone[n])
            else:
                found = [known[w] for w in words]
                out.append((b"".join([x[0] for x in found]), b"".join([x[1] for x in found])))
        return out


@lru_cache(maxsize=1)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def linked(pair: Pair, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each text (n_a, n_b, n_groups, n_links), its groups' digest, and for each text and linked pair of ids: text, code, links."""
    none = np.zeros((len(texts), 4), np.int64), [""] * len(texts), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, ids_a, ids_b = [], [], []
    full = [n for n, t in enumerate(texts) if t]
    for n, (a, b) in zip(full, pair.encode([texts[n] for n in full]), strict=True):
        whole = b" " + texts[n].encode()
        a, b = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
        if b"".join([pair.bytes_b[x] for x in b.tolist()]) == whole and int(pair.size_a[a].sum()) == len(whole):
            rows.append(n)
            ids_a.append(a)
            ids_b.append(b)
    if not rows:
        return none
    counts, digests = none[0], none[1]
    per_a, per_b = np.array(list(map(len, ids_a))), np.array(list(map(len, ids_b)))
    a, b = np.concatenate(ids_a).astype(np.int64), np.concatenate(ids_b).astype(np.int64)
    ends_a, ends_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
    total = int(ends_a[-1]) + 1
    cut = (np.bincount(ends_a, minlength=total) > 0) & (np.bincount(ends_b, minlength=total) > 0)
    before = np.cumsum(cut)
    group_a, group_b = before[ends_a - 1], before[ends_b - 1]  # the end itself may be a cut, and belongs to the group before it
    groups = int(before[-1])
    in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    sum_a, sum_b, sum_links = (np.concatenate([[0], np.cumsum(x)]) for x in (in_a, in_b, in_a * in_b))
    last = group_a[np.cumsum(per_a) - 1] + 1  # groups before each document's end
    first = np.concatenate([[0], last[:-1]])
    counts[rows] = np.stack([per_a, per_b, last - first, sum_links[last] - sum_links[first]], 1)

    # the digest: A's ids, then B's, group by group
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + sum_b[group_a]] = 3 * a + np.where(np.append(group_a[1:] != group_a[:-1], True), 1, 0)
    order[np.arange(len(b)) + sum_a[group_b + 1]] = 3 * b + np.where(np.append(group_b[1:] != group_b[:-1], True), 2, 0)
    at = 0
    for n, size in zip(rows, (per_a + per_b).tolist(), strict=True):
        digests[n] = hashlib.sha256(b"".join([pair.names[x] for x in order[at : at + size].tolist()])[:-1]).hexdigest()
        at += size

    # pairs of each group
    row_of = np.repeat(np.array(rows), last - first)
    wide = in_a * in_b > WIDE
    narrow = ~wide[group_a]
    size = in_b[group_a[narrow]]
    codes = [np.repeat(a[narrow] << BITS, size) | b[_ranges(sum_b[group_a[narrow]], size)]]
    texts_of, times = [np.repeat(row_of[group_a[narrow]], size)], [np.ones(len(codes[0]), np.int64)]
    for g in np.flatnonzero(wide):
        x, nx = np.unique(a[sum_a[g] : sum_a[g + 1]], return_counts=True)
        y, ny = np.unique(b[sum_b[g] : sum_b[g + 1]], return_counts=True)
        codes.append((x[:, None] << BITS | y).ravel())
        times.append((nx[:, None] * ny).ravel())
        texts_of.append(np.full(len(codes[-1]), row_of[g]))
    code, text_of, links = np.concatenate(codes), np.concatenate(texts_of), np.concatenate(times)
    by = np.lexsort((code, text_of))
    code, text_of, links = code[by], text_of[by], links[by]
    new = np.flatnonzero(np.diff(text_of, prepend=-1).astype(bool) | np.diff(code, prepend=-1).astype(bool))
    return counts, digests, text_of[new], code[new], np.add.reduceat(links, new)


ALIGNED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, links array<long>, counts array<long>"
_LIST = pa.list_(pa.int64())


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int64()))


def alignments(df: DataFrame, text: str = "text", row_id: str = "doc_id", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """A row for each document with its counts, digest and linked pairs (codes, and how many links each has), and a row for each chunk with its pairs' documents (counts)."""
    path_a, path_b = path_a or public_tokenizers.path(MODEL_A), path_b or public_tokenizers.path(MODEL_B)
    names = [c.split()[0] for c in ALIGNED.split(", ")]

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, n = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.argsort(code, kind="stable")
        code, n = code[by], n[by]
        new = np.flatnonzero(np.diff(code, prepend=-1))
        return code[new], np.add.reduceat(n, new)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        chunk, chars, rows = TaskContext.get().partitionId() << 32, 0, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def closed() -> pa.RecordBatch:
            code, n = summed(held)
            null = [pa.nulls(1, t) for t in (pa.int64(),) * 5 + (pa.string(), _LIST, _LIST)]
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *null, _lists(code << COUNT | n, np.array([len(code)]))], names=names)

        for batch in in_slices(batches):
            ids, whole, at = batch.column(0), batch.column(1), 0
            while at < batch.num_rows:
                texts: list[str] = []
                size = 0
                while at + len(texts) < batch.num_rows and size < AT_ONCE:
                    texts.append(whole[at + len(texts)].as_py())
                    size += len(texts[-1])
                counts, digests, text_of, code, links = linked(pair, texts)
                sizes = np.bincount(text_of, minlength=len(texts))
                arrays = [pa.array(counts[:, n], pa.int64()) for n in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), chunk), pa.int64()), ids.slice(at, len(texts)), *arrays, pa.array(digests, pa.string()), _lists(code, sizes), _lists(links, sizes), pa.nulls(len(texts), _LIST)], names=names)
                held = [summed([*held, (code, np.ones(len(code), np.int64))])]
                at, chars, rows = at + len(texts), chars + size, rows + len(texts)
                if chars >= CHUNK or rows >= CHUNK_ROWS:
                    yield closed()
                    chunk, chars, rows, held = chunk + 1, 0, 0, []
        if held:
            yield closed()
        give_back()

    return df.select(F.col(row_id).cast("long"), text_or_empty(text)).mapInArrow(work, ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """code, documents that hold the pair linked, and whether no other pair of its A id has more."""
    each = found.where("counts is not null").select(F.explode("counts").alias("x"))
    counts = each.select(F.shiftright("x", COUNT).alias("code"), F.expr(f"x & {(1 << COUNT) - 1}").alias("n")).groupBy("code").agg(F.sum("n").alias("n"))
    most = counts.groupBy(F.shiftright("code", BITS).alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", F.shiftright("code", BITS)).join(most, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(df: DataFrame, text: str = "text", row_id: str = "doc_id", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """A row for each row of df: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts whose bytes a tokenizer doesn't give back, have zeros and '' and link nothing. Each row counts as a document of its own, rows with the same id or without one
    too. Other columns are left out. An empty table gives no rows. The table of alignments stays in the shared folder until the session drops it.
    """
    known = written_tables()
    found = written(alignments(df, text, row_id, path_a, path_b), "aligned")
    counts = written(pair_counts(found), "pair-counts")
    drop_but(df.sparkSession, known, found, counts)
    wanted = found.where("counts is not null").select("chunk", F.explode("counts").alias("x")).select("chunk", F.shiftright("x", COUNT).alias("code"))
    answers = wanted.join(counts, "code").select(F.col("chunk").alias("of"), "code", "n", "best")

    def summed(docs: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("code")
        code, n, best = (answers.column(c).to_numpy() for c in ("code", "n", "best"))
        wanted, links = (docs.column(c).combine_chunks() for c in ("codes", "links"))
        sizes = np.diff(wanted.offsets.to_numpy())
        at = np.searchsorted(code, wanted.flatten().to_numpy())
        links, row = links.flatten().to_numpy(), np.repeat(np.arange(docs.num_rows), sizes)
        total, good = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
        np.add.at(total, row, links * n[at])
        np.add.at(good, row, links * best[at])
        columns = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.Table.from_arrays([*columns, pa.array(good), pa.array(total), docs.column("groups_sha256")], names=[c.split()[0] for c in RESULT.split(", ")])

    docs = found.where("counts is null").drop("counts")
    return docs.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(summed, RESULT)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
