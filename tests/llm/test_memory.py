"""What Python workers hold at once."""

import tracemalloc

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from tallyloom.llm import shingles, word_bpe


def test_words_are_hashed_a_few_texts_at_a_time():
    texts = [f"Wort{n} über {n % 7} " * 150 for n in range(1000)]
    tracemalloc.start()
    words, count = shingles.word_hashes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    for at_once in (1, 5000):
        some = shingles.word_hashes([*texts[:20], "", " ", "a"], at_once)
        assert np.array_equal(some[0][:-1], words[: len(some[0]) - 1]) and some[1].tolist() == [*count[:20].tolist(), 0, 0, 1]
    assert [len(x) for x in shingles.word_hashes([])] == [0, 0]


def test_words_seen_once_do_not_stay():
    e, t = word_bpe.WordEncoder(word_bpe.default_path(), once=100), Tokenizer.from_file(word_bpe.default_path())
    for n in range(500):
        text = f"haus haus baum{n}x über{n}"
        ids = np.frombuffer(e.ids(text), "<u4").tolist()
        assert ids == t.encode(text, add_special_tokens=False).ids
    assert set(e) == {"", "haus"} and len(e.once) <= 100


def test_stages_set_their_rows_and_honour_fewer(spark):
    name, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stages, before = dict(corpus_pipeline.STAGES), spark.conf.get(name)
    kept = "tallyloom.pipeline.ownRows"
    try:
        for own, few, many in ((10000, 128, 1000), (50, 50, 50), (0, 128, 1000)):
            spark.conf.unset(kept)
            spark.conf.set(name, own)
            for stage, most in (("packing", few), ("near_dedup", many), ("packing", few)):
                stages[stage](spark, docs.limit(5), "")
                assert int(spark.conf.get(name)) == most
    finally:
        spark.conf.unset(kept)
        spark.conf.set(name, before)
