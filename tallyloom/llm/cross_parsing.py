"""Language of a text by cross-parsing: the language whose labelled text it can be put together from with the fewest phrases.

A language's labelled text becomes a suffix automaton, which follows a text as long as what it has read since the last cut occurs in the labelled text; where it doesn't, a new phrase
begins. These longest matches are counted per language and normalised by the size of the labelled text: phrases x log2(bytes), the bits of pointing at each phrase. The fewest win.

Texts are lower-cased UTF-8 bytes; bytes of ASCII that are no letters are one space. They are parsed in blocks of BLOCK bytes, each of which begins
a phrase, in every language alike. A batch's blocks advance together, a byte at a time, through all automata.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import Aside, in_slices, table

BLOCK = 256
#: Bytes of labelled text in all automata together, so that the model's size is bounded; each language has an equal part. Texts are sampled in pieces of so many code points.
SAMPLE, PIECE = 1 << 18, 1024
#: Bytes of a batch that are parsed together, about.
AT_ONCE = 1 << 20
#: Rows whose remainder this is aren't learned from.
HELD_OUT, FOLDS = 2, 4
#: Languages up to which their shares are broadcast.
BROADCAST_LANGUAGES = 100_000
NONE = "und"
_SPACES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def normal(text: str) -> bytes:
    """What is parsed: runs of what is no letter in ASCII are one space, none at the ends."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACES).split())


class Automaton:
    """A suffix automaton of pieces: edges (state, byte, state). State 0 is the start."""

    def __init__(self, pieces: list[bytes]) -> None:
        nexts: list[dict[int, int]] = [{}]
        link, length = [-1], [0]

        def split(state: int, c: int) -> int:
            """The state after c, which is divided if longer strings end there too."""
            to = nexts[state][c]
            if length[to] == length[state] + 1:
                return to
            copy = len(nexts)
            nexts.append(dict(nexts[to]))
            link.append(link[to])
            length.append(length[state] + 1)
            link[to] = copy
            while state >= 0 and nexts[state].get(c) == to:
                nexts[state][c] = copy
                state = link[state]
            return copy

        for piece in pieces:
            last = 0
            for c in piece:
                if c in nexts[last]:  # an earlier piece has this already
                    last = split(last, c)
                    continue
                now = len(nexts)
                nexts.append({})
                link.append(0)
                length.append(length[last] + 1)
                at = last
                while at >= 0 and c not in nexts[at]:
                    nexts[at][c] = now
                    at = link[at]
                if at >= 0:
                    link[now] = split(at, c)
                last = now
        self.states = len(nexts)
        self.edges = np.array([(s, c, t) for s, d in enumerate(nexts) for c, t in d.items()], np.int32).reshape(-1, 3)


class Parser:
    """All languages' automata as one table: the state after a byte, 0 where there is none. States are held times the number of columns."""

    def __init__(self, model: list[tuple[str, int, int, bytes]]) -> None:
        self.names = [name for name, *_ in model]
        self.bits = np.array([np.log2(max(size, 2)) for _, size, _, _ in model])
        edges = [np.frombuffer(e, "<i4").reshape(-1, 3) for *_, e in model]
        seen = np.zeros(256, bool)
        for e in edges:
            seen[e[:, 1]] = True
        self.column = np.where(seen, np.cumsum(seen), 0).astype(np.int32)  # bytes of no language share column 0
        self.columns = int(seen.sum()) + 1
        first = np.cumsum([0, *(states for _, _, states, _ in model)])
        self.start = (first[:-1] * self.columns).astype(np.int32)
        self.table = np.zeros(int(first[-1]) * self.columns, np.int32)
        for e, at in zip(edges, first, strict=False):
            self.table[(e[:, 0] + at) * self.columns + self.column[e[:, 1]]] = (e[:, 2] + at) * self.columns

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text in each language."""
        out = np.zeros((len(texts), len(self.names)), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        blocks = -(-sizes // BLOCK)
        if not len(self.names) or not blocks.sum():
            return out
        flat = self.column[np.frombuffer(b"".join(texts), np.uint8)]
        text_of = np.repeat(np.arange(len(texts)), blocks)
        number = np.arange(len(text_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = np.repeat(np.cumsum(sizes) - sizes, blocks) + number * BLOCK
        length = np.minimum(BLOCK, np.repeat(sizes, blocks) - number * BLOCK)
        by = np.argsort(-length, kind="stable")
        at, length, text_of = at[by], length[by], text_of[by]
        active = len(length) - np.searchsorted(length[::-1], np.arange(BLOCK), side="right")  # blocks longer than each step
        found = np.empty((len(self.names), len(length)), np.int64)
        for n, root in enumerate(self.start):
            fresh = self.table[root : root + self.columns]
            state, count = np.full(len(length), root, np.int32), np.zeros(len(length), np.int32)
            for step in range(int(length[0])):
                m = active[step]
                byte = flat[at[:m] + step]
                to = self.table[state[:m] + byte]
                cut = to == 0
                count[:m] += cut | (state[:m] == root)
                to[cut] = fresh[byte[cut]]
                to[to == 0] = root  # a byte that the language doesn't have is a phrase of its own
                state[:m] = to
            found[n] = count
        for n in range(len(self.names)):
            out[:, n] = np.bincount(text_of, found[n], len(texts)).astype(np.int64)
        return out


MODEL = "lang string, bytes long, states int, edges binary"


def learned(docs: DataFrame, text: str = "text", lang: str = "lang", row_id: str = "doc_id", sample: int = SAMPLE, piece: int = PIECE) -> DataFrame:
    """A row for each language: its name, the size of its labelled text and its automaton.

    From rows with a text, a language and an id whose crc32 doesn't hold them out. What is sampled are pieces of whole texts, by a hash of text and place: sample bytes in all, in equal
    parts for all languages, so the model is bounded whatever the number of rows or languages. Equal texts count once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(row_id).cast("string").alias("id"), F.col(text).alias("t"), F.col(lang).alias("lang")).where("t != '' and lang is not null").where(F.crc32("id") % FOLDS != HELD_OUT)
    sizes = rows.groupBy("lang").agg(F.sum(F.ceil(F.length("t") / piece)).alias("pieces"))
    languages = sizes.count()
    part = sample // max(languages, 1)
    # about four times the pieces that are needed pass by their hash; the smallest hashes among them are taken
    chance = sizes.select("lang", (F.lit(4.0 * (part / piece + 8)) / F.col("pieces")).alias("chance"))
    chance = F.broadcast(chance) if languages <= BROADCAST_LANGUAGES else chance
    cut = rows.join(chance, "lang").select("lang", "chance", "t", F.xxhash64("t").alias("of"), F.explode(F.sequence(F.lit(0), F.ceil(F.length("t") / piece).cast("int") - 1)).alias("n"))
    few = cut.withColumn("h", F.xxhash64("of", "n")).where(F.col("h") / F.lit(2.0**64) + 0.5 < F.col("chance")).select("lang", "h", F.substring("t", F.col("n") * piece + 1, F.lit(piece)).alias("t"))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        taken, held = [], 0
        for t in rows.sort_values(["h", "t"])["t"]:
            whole = normal(t)[: part - held]
            if whole:
                taken.append(whole)
                held += len(whole)
            if held >= part:
                break
        found = Automaton(taken)
        return pd.DataFrame({"lang": [key[0]], "bytes": [held], "states": [found.states], "edges": [found.edges.astype("<i4").tobytes()]})

    return few.dropDuplicates().groupBy("lang").applyInPandas(build, MODEL).where("bytes > 0").orderBy("lang")


def with_language(docs: DataFrame, model: DataFrame, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the language that needs the fewest normalised phrases (ties: the first by name) and a score from 0 to 1.

    The score is the language's share when each language counts 2 to the power of minus its bits. A text that is null or has no letter is `und`, with score
    0; so is every text if no language was learned. Columns of the same names are replaced.
    """
    spark = docs.sparkSession
    rows = [tuple(r) for r in model.collect()]  # bounded by SAMPLE
    shipped = spark.sparkContext.broadcast([(name, size, states, bytes(edges)) for name, size, states, edges in rows])
    names = [r[0] for r in rows]

    def judge(texts: list[str | None], parser: Parser) -> tuple[list[str], list[float]]:
        whole = [normal(t) if t is not None else b"" for t in texts]
        bits = parser.phrases(whole) * parser.bits
        langs, scores = [], []
        for t, b in zip(texts, bits, strict=True):
            if not names or t is None or not any(map(str.isalpha, t)):
                langs.append(NONE)
                scores.append(0.0)
                continue
            best = int(b.argmin())
            langs.append(names[best])
            scores.append(float(1 / np.exp2(-np.minimum(b - b[best], 60)).sum()))
        return langs, scores

    aside = Aside(docs, lang_out, score_out)
    texts = [n.lower() for n in aside.names].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(shipped.value)
        for batch in in_slices(batches, 4096):
            column = batch.column(texts)
            at = 0
            while at < batch.num_rows:
                part, size = [], 0
                while at + len(part) < batch.num_rows and size < AT_ONCE:
                    part.append(column[at + len(part)].as_py())
                    size += len(part[-1] or "")
                langs, scores = judge(part, parser)
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(part)).columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "l", "s"])
                at += len(part)

    schema = T.StructType([*aside.rows.schema.fields, T.StructField("l", T.StringType()), T.StructField("s", T.DoubleType())])
    out = aside.rows.mapInArrow(run, schema)
    return out.select(*aside.back(), F.col("l").alias(lang_out), F.col("s").alias(score_out))


def op12_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return with_language(rows, learned(docs)).drop("text")
