import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyloom.llm import alignment
from tallyloom.llm.word_bpe import byte_letters

SCHEMA = "doc_id long, text string"
PATHS = [public_tokenizers.path(n) for n in (alignment.MODEL_A, alignment.MODEL_B)]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain(libraries, texts):
    """Token by token: groups as lists of ids, links as a Counter of id pairs, then the contract's columns."""
    a, b = libraries
    back = {c: n for n, c in byte_letters().items()}
    docs = []
    for text in texts:
        groups, links, nothing = [], Counter(), ([], Counter(), 0, 0)
        if not text:
            docs.append(nothing)
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(back[c] for c in a.id_to_token(x)) for x in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            docs.append(nothing)
            continue
        ends = [set(np.cumsum(list(map(len, x))).tolist()) for x in (bytes_a, bytes_b)]
        cuts = sorted(ends[0] & ends[1])
        at = [0, 0]
        pos = [0, 0]
        for cut in cuts:
            group = ([], [])
            for k, (ids, parts) in enumerate(((ids_a, bytes_a), (ids_b, bytes_b))):
                while pos[k] < cut:
                    group[k].append(ids[at[k]])
                    pos[k] += len(parts[at[k]])
                    at[k] += 1
            groups.append(group)
            links.update((x, y) for x in group[0] for y in group[1])
        docs.append((groups, links, len(ids_a), len(ids_b)))
    count = Counter(p for d in docs for p in d[1])
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for groups, links, n_a, n_b in docs:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in links.items()), hashlib.sha256(told.encode()).hexdigest() if n_a else ""))
    return out


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b\n\n c\t d", "<|endoftext|> </s> <s>", "it's we'll \n\n\n x", "▁", "a▁b c", "naïve café 日本語 \U0001f600\U0001f468‍\U0001f469", " x 　y", "ﬁ Ａ ²",
    "a" * 5000, " " * 300 + "x", "ab" * 3000 + " " + "é" * 2000, "\r\n" * 40, "x" * 3 + "\x00\x01", "1234567890 12,345.67", "the cat sat", "the cat sat", "The cat's hat!!! ???",
]


def columns(rows):
    return [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in rows]


def test_equals_plain_alignment(spark, libraries):
    texts = ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).selectExpr("*", "'z' as chunk", "1 as codes").repartition(5)
    got = sorted(alignment.aligned(df).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in got] == list(range(len(texts))) and columns(got) == plain(libraries, texts)


def test_chunks_wide_groups_and_repeated_ids(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "WIDE", 1)
    monkeypatch.setattr(alignment, "AT_ONCE", 50)
    pair = alignment.Pair(*PATHS)
    counts, digests, text_of, code, links = alignment.linked(pair, [t or "" for t in ODD])
    want = plain(libraries, ODD)
    assert [tuple(c) for c in counts.tolist()] == [w[:4] for w in want] and digests == [w[6] for w in want]
    assert np.bincount(text_of, links, len(ODD)).astype(int).tolist() == [w[3] for w in want]
    assert len(set(zip(text_of.tolist(), code.tolist(), strict=True))) == len(code)
    texts = ["same words here"] * 30 + ["other words there"] * 7
    df = spark.createDataFrame([(None if n % 3 else 7, t) for n, t in enumerate(texts)], SCHEMA).repartition(3)
    assert sorted(columns(alignment.aligned(df).collect())) == sorted(plain(libraries, texts))


def test_words_are_encoded_as_the_libraries_do(libraries):
    rng = np.random.default_rng(8)
    pair = alignment.Pair(*PATHS)
    assert pair.ranked and pair.apart
    parts = [" ", " ", " ", "\n", "'s", "the", "Haus", "é", "12", ".", "…", "\t", "中", " ", "ing", "▁", "<s>", "\U0001f600"]
    texts = ["".join(rng.choice(parts, size=rng.integers(1, 14))) for _ in range(1500)]
    for text, (a, b) in zip(texts, pair.encode(texts), strict=True):
        assert np.frombuffer(a, "<u4").tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids
        assert np.frombuffer(b, "<u4").tolist() == libraries[1].encode(text)


def test_empty_tables(spark):
    assert alignment.aligned(spark.createDataFrame([], SCHEMA)).count() == 0
    assert columns(alignment.aligned(spark.createDataFrame([(1, None), (2, "")], SCHEMA)).collect()) == [(0,) * 6 + ("",)] * 2
