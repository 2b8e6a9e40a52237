"""SentencePiece encoding and decoding for merge-type models with byte fallback, without the library's own encoder.

Encoding fills a table over a text's prefixes: the last token of each prefix. A token that ends there (an automaton
finds all of them in one pass) is the one if the prefix before it has a last token that is compatible with it: merging that pair's
letters alone would give these two tokens again. Exactly one token fits each prefix, so the ids are read off the table from its end.

Merges never cross two neighbouring characters that no piece holds side by side, so texts are split there; the parts' ids are kept in a table
of bounded size, since words recur. Runs of spaces are pieces of one priority, for which ties count; they are merged by an agenda.
"""

from __future__ import annotations

import codecs
import heapq
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import free_name, table, text_or_empty

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Words and parts in a worker's tables.
WORDS = 600_000
#: Pairs of tokens in a worker's table.
PAIRS = 500_000
#: Ids decoded at once.
AT_ONCE = 100_000
#: Rows of a batch that are coded at once.
ROWS_AT_ONCE = 512
FIRST = float("-inf")  # when single characters were there
NEVER = float("inf")


def packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit ids."""
    found = array("i", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class PieceModel:
    """Pieces of a merge-type model. encode() has no options: a space before the text, no sampling, and the end id last."""

    def __init__(self, path: str, words: int = WORDS) -> None:
        with open(path, "rb") as file:
            model = sentencepiece.SentencePieceProcessor(model_proto=file.read())
        every = range(model.vocab_size())
        plain = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.end, self.limit = model.eos_id(), words
        self.piece = [model.id_to_piece(i) for i in every]
        self.id = {self.piece[i]: i for i in plain}
        #: When a piece is made: the higher its score, the earlier.
        self.time = [-model.get_score(i) if len(self.piece[i]) > 1 else FIRST for i in every]
        self.byte = {int(self.piece[i][1:-1], 16): i for i in every if model.is_byte(i)}
        if any(p[:2] == SPACE * 2 and p.strip(SPACE) or SPACE in p[1:].lstrip(SPACE) for p in self.id):
            raise ValueError("pieces that hold spaces between or beside other characters aren't supported")
        self.parts: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        self.beside: set[str] = set()
        for piece, i in self.id.items():
            if len(piece) > 1 and not piece.strip(SPACE):
                continue
            if self.agenda(piece, remember=True) == [i]:
                self.automaton.add_word(piece, i)
                self.beside.update(piece[k : k + 2] for k in range(len(piece) - 1))
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.piece]
        self.fits: dict[int, bool] = {}
        self.part: dict[str, bytes] = {}
        self.word: dict[str, bytes] = {}
        self.bytes_of = [b"" if model.is_control(i) else b" \xe2\x81\x87 " if model.is_unknown(i) else bytes([int(self.piece[i][1:-1], 16)]) if model.is_byte(i) else self.piece[i].replace(SPACE, " ").encode() for i in every]
        self.spaced = np.array([self.piece[i][:1] == SPACE for i in every])
        self.silent = np.array([model.is_control(i) for i in every])
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.start = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.size)])[:-1]
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def agenda(self, text: str, remember: bool = False) -> list[int]:
        """Ids by merging the earliest pair first, of equal ones the leftmost. text holds known characters only. remember: how pieces were made."""
        token = [self.id[c] for c in text]
        after, before, alive = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1)), [True] * len(token)
        todo: list[tuple[float, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(token) and (made := self.id.get(self.piece[token[a]] + self.piece[token[b]])) is not None:
                heapq.heappush(todo, (self.time[made], a, token[a], token[b], made))

        for k in range(len(token) - 1):
            offer(k, k + 1)
        while todo:
            _, a, left, right, made = heapq.heappop(todo)
            b = after[a]
            if not alive[a] or token[a] != left or b >= len(token) or token[b] != right:
                continue
            if remember:
                self.parts.setdefault(made, (left, right))
            token[a], alive[b], after[a] = made, False, after[b]
            if after[b] < len(token):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [t for t, there in zip(token, alive, strict=True) if there]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of a and b, side by side, gives a and b: going back in time from the two, no pair across the border would have been merged sooner than what was."""
        x, y, until, inner = a, b, NEVER, True
        while True:
            made = self.id.get(self.piece[x] + self.piece[y])
            if made is not None and (self.time[made] < until or self.time[made] == until and not inner):
                return False
            if self.time[x] > self.time[y]:
                until, inner, x = self.time[x], True, self.parts[x][1]  # of equal merges the left one came first, and that is a's
            elif y in self.parts and self.time[y] > FIRST:
                until, inner, y = self.time[y], False, self.parts[y][0]
            else:
                return True

    def by_prefixes(self, text: str) -> list[int]:
        """Ids of a text of known characters, without runs of spaces."""
        last, fits, length, span = [-1] * (len(text) + 1), self.fits, self.length, len(self.piece)
        for stop, token in self.automaton.iter(text):
            stop += 1
            if last[stop] < 0:
                start = stop - length[token]
                if start:
                    left = last[start]
                    if left < 0:
                        continue
                    key = left * span + token
                    fit = fits.get(key)
                    if fit is None:
                        fit = fits[key] = self.compatible(left, token)
                    if not fit:
                        continue
                last[stop] = token
        found, at = [], len(text)
        while at:
            found.append(last[at])
            at -= length[last[at]]
        found.reverse()
        return found

    def of_part(self, part: str) -> bytes:
        if (found := self.part.get(part)) is None:
            if len(self.part) >= self.limit:
                self.part.clear()
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            found = self.part[part] = packed(self.by_prefixes(part) if part[0] in self.id else [self.byte[b] for b in part.encode()])
        return found

    def of_word(self, word: str) -> bytes:
        """Packed ids of a space and what follows up to the next one."""
        whole, cut, found = SPACE + word, 0, []
        beside = self.beside
        for k in range(1, len(whole)):
            if whole[k - 1 : k + 1] not in beside:
                found.append(self.of_part(whole[cut:k]))
                cut = k
        if not found:
            return self.of_part(whole)
        found.append(self.of_part(whole[cut:]))
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids, the end id last."""
        end = packed([self.end])
        if not text:
            return end
        words, known = text.replace(SPACE, " ").split(" "), self.word
        if "" in words:
            return self._with_runs(words) + end
        try:
            return b"".join(map(known.__getitem__, words)) + end
        except KeyError:
            if len(known) >= self.limit:
                known.clear()
        for word in words:
            if word not in known:
                known[word] = self.of_word(word)
        return b"".join(map(known.__getitem__, words)) + end

    def _with_runs(self, words: list[str]) -> bytes:
        found: list[bytes] = []
        run, space = 0, packed([self.id[SPACE]])
        for word in [*words, None]:
            if word == "":
                run += 1
                continue
            ids = self.of_word(word) if word is not None else b""
            if run:
                alone = ids[:4] == space
                found.append(packed(self.agenda(SPACE * (run + alone))))
                ids = ids[4 * alone :]
            found.append(ids)
            run = 0
        return b"".join(found)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of rows of ids that lie one after the other; ends: where each row ends. Bytes that aren't UTF-8 become U+FFFD each."""
        texts, row = [], 0
        while row < len(ends):  # some rows at a time
            begin = int(ends[row - 1]) if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, begin + AT_ONCE, "right")))
            texts += self._decode(ids[begin : int(ends[stop - 1])], ends[row:stop] - begin)
            row = stop
        return texts

    def _decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        size = self.size[ids]
        to = np.cumsum(size)
        flat = self.flat[np.repeat(self.start[ids] - (to - size), size) + np.arange(int(to[-1]) if len(to) else 0)].tobytes()
        border = np.concatenate([np.zeros(1, np.int64), to])[np.concatenate([np.zeros(1, np.int64), ends])]
        texts = []
        for row in range(len(ends)):
            a, b = int(ends[row - 1]) if row else 0, int(ends[row])
            while a < b and self.silent[ids[a]]:
                a += 1
            skip = int(a < b and self.spaced[ids[a]])
            texts.append(flat[border[row] + skip : border[row + 1]].decode("utf-8", "tallyloom_each"))
        return texts


codecs.register_error("tallyloom_each", lambda e: ("�" * (e.end - e.start), e.end))


@lru_cache(maxsize=2)
def model_of(path: str) -> PieceModel:
    """One per worker and path."""
    return PieceModel(path)


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """df with the ids of each whole text (null and empty: the end id alone) as array<int>. A column of that name is replaced."""
    path = path or public_tokenizers.path(MODEL)
    kept = df.drop(out)
    columns = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = model_of(path).encode
        for batch in batches:
            found = [one(x or "") for x in batch.column(len(columns)).to_pylist()]
            ends = np.cumsum([0, *map(len, found)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*columns, out])

    return kept.withColumn(free_name(kept, "_whole"), text_or_empty(text)).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the text of each array of ids (null: null). A column of that name is replaced."""
    path = path or public_tokenizers.path(MODEL)
    kept = df.drop(out)
    columns = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            lists = batch.column(columns.index(ids))
            flat = np.asarray(lists.flatten())
            texts = model.decode(flat, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t if there else None for t, there in zip(texts, lists.is_valid().to_pylist(), strict=True)], pa.string())], names=[*columns, out])

    return kept.mapInArrow(run, schema)


def round_trip(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """df without its text column, encoded and then decoded in one pass over the rows."""
    path = path or public_tokenizers.path(MODEL)
    kept = df.drop(ids, decoded, text)
    name = free_name(df, "_whole")
    whole_rows = df.withColumn(name, text_or_empty(text)).select(*kept.columns, name)
    columns = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                found = [model.encode(x or "") for x in batch.column(len(columns)).to_pylist()]
                ends = np.cumsum([0, *map(len, found)]) // 4
                flat = np.frombuffer(b"".join(found), "<i4")
                texts = model.decode(flat, ends[1:])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array(texts, pa.string())], names=[*columns, ids, decoded])

    return whole_rows.mapInArrow(run, schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
