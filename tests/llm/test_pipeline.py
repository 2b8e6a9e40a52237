"""The pipeline's stages one after the other, each held against what it states."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import registry, toxicity, word_bpe
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    for name, work in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.written(work(spark, docs, SF), f"t-{name}")
        assert docs.columns == columns and 0 < docs.count() <= before
        clean = labels.where("quality = 1 and toxic = 0")
        if name == "quality":
            assert docs.join(clean, "doc_id").count() >= 0.95 * spark.read.parquet(f"{SF}/documents.parquet").join(clean, "doc_id").count()
        if name == "exact_dedup":
            assert docs.groupBy(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")).count().where("count > 1").isEmpty()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == docs.count()
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").isEmpty()


def test_copies_stages_against_brute_force(spark):
    """Each on all that the stage before kept: exact copies by a dictionary, near copies by all pairs, toxicity and packing row by row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    first = {}
    for i, t in sorted(text.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    got = {r["doc_id"] for r in stages["exact_dedup"](spark, docs, SF).collect()}
    assert got == set(first.values())
    ids = sorted(text)
    want = {c for _, c in brute_components([text[i] for i in ids], ids)}
    assert {r["doc_id"] for r in stages["near_dedup"](spark, docs, SF).collect()} == want
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = dict(zip(ids, model.scores([text[i] or "" for i in ids]), strict=True))
    assert {r["doc_id"] for r in stages["toxicity"](spark, docs, SF).collect()} == {i for i in ids if score[i] < toxicity.THRESHOLD}
    t = Tokenizer.from_file(word_bpe.default_path())
    size = {i: len(t.encode(text[i] or "", add_special_tokens=False).ids) + 1 for i in ids}
    rows = stages["packing"](spark, docs, SF).collect()
    assert {i: sum(r["length"] for r in rows if r["doc_id"] == i) for i in ids} == size


def test_chained_without_running_each_stage_first(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, work in corpus_pipeline.STAGES:
        docs = work(spark, docs, SF)
    rows, whole = docs.collect(), corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows} == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole}


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14))
