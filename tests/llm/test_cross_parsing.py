import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import cross_parsing as cp

SCHEMA = "doc_id long, text string, lang string"


def pieces_of(rng, n, letters="abc"):
    return [bytes(rng.choice(list(letters.encode()), size=rng.integers(1, 40)).tolist()) for _ in range(n)]


def follows(auto, word):
    edges = {(s, c): t for s, c, t in auto.edges.tolist()}
    state = 0
    for c in word:
        state = edges.get((state, c))
        if state is None:
            return False
    return True


def test_automaton_knows_all_substrings_and_no_others():
    rng = np.random.default_rng(3)
    for _ in range(20):
        pieces = pieces_of(rng, 4)
        pieces.append(pieces[0])
        auto = cp.Automaton(pieces)
        inside = {p[a:b] for p in pieces for a in range(len(p)) for b in range(a, len(p) + 1)}
        assert all(follows(auto, w) for w in inside)
        assert all(follows(auto, w) == (w in inside) for w in pieces_of(rng, 200))


def greedy(text, pieces):
    """Phrases of a text in blocks, by looking for each longest match in the pieces."""
    count = 0
    for at in range(0, len(text), cp.BLOCK):
        block, i = text[at : at + cp.BLOCK], 0
        while i < len(block):
            n = 1
            while i + n <= len(block) and any(block[i : i + n] in p for p in pieces):
                n += 1
            i += max(n - 1, 1)
            count += 1
    return count


def test_phrases_equal_a_plain_search():
    rng = np.random.default_rng(4)
    known = [pieces_of(rng, 5, "abcd"), pieces_of(rng, 5, "cdef"), [b"x"]]
    model = []
    for n, pieces in enumerate(known):
        auto = cp.Automaton(pieces)
        model.append((str(n), sum(map(len, pieces)), auto.states, auto.edges.astype("<i4").tobytes()))
    texts = [b"", b"z", b"abc", *pieces_of(rng, 30, "abcdefz"), bytes(rng.choice(list(b"abcdefx"), size=3000).tolist())]
    assert cp.Parser(model).phrases(texts).tolist() == [[greedy(t, p) for p in known] for t in texts]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = cp.op12_cross_parsing(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


@pytest.fixture(scope="module")
def small(spark):
    rows = [(n, "the cat sat on the mat and the dog ran off", "en") for n in range(8)] + [(n, "der hund und die katze sind nicht hier gewesen", "de") for n in range(8, 16)]
    return spark.createDataFrame(rows, SCHEMA)


def test_odd_texts(spark, small):
    rows = [(1, None, "en"), (2, "", None), (3, "123 ... \U0001f600", "de"), (4, "THE Cat!", None), (None, "der Hund", None), (5, "日本語", "en"), (6, "the cat " * 100_000, None), (7, "½ ²", None), (6, "the dog", None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as Score", "'y' as lang_pred", "0 as l")
    got = {(r["doc_id"], (r["text"] or "")[:8]): (r["lang_pred"], r["score"]) for r in cp.with_language(docs, cp.learned(small)).collect()}
    assert len(got) == 9
    assert {k: v[0] for k, v in got.items()} == {(1, ""): "und", (2, ""): "und", (3, "123 ... "): "und", (4, "THE Cat!"): "en", (None, "der Hund"): "de", (5, "日本語"): "en", (6, "the cat "): "en", (7, "½ ²"): "und", (6, "the dog"): "en"}
    assert got[(1, "")][1] == 0.0 and 0.0 < got[(5, "日本語")][1] < 1.0  # the language with the smaller labelled text


def test_held_out_rows_null_languages_and_empty_tables_teach_nothing(spark, small):
    held = small.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    none = small.withColumn("lang", F.lit(None).cast("string"))
    for docs in (held, none, small.limit(0), small.withColumn("text", F.lit(""))):
        assert cp.learned(docs).count() == 0
    assert {r["lang_pred"] for r in cp.with_language(small, cp.learned(none)).collect()} == {"und"}


def test_model_is_bounded_and_doesnt_depend_on_partitions(spark, small):
    rows = [(n, f"word{n} " * 400, f"l{n % 5}") for n in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    one, other = (sorted(map(tuple, cp.learned(docs.repartition(n), sample=20_000).collect())) for n in (1, 7))
    assert one == other and len(one) == 5 and all(0 < r[1] <= 4000 for r in one)
