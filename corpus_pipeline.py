"""From raw documents to packed training sequences: toxicity, quality, exact copies, near copies, packing.

Each stage works on all rows that the one before kept. run() writes each stage's rows, and then deletes the tables that the stage has made in the shared folder
on its way; a stage that is called by itself leaves them. Stages lower the session's number of rows that go to a Python worker at once to BATCH_ROWS or FEW_ROWS, and leave it so: what
they return runs later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_but, table, written, written_tables
from tallyloom.llm.exact_dedup import drop_copies
from tallyloom.llm.jaccard_join import drop_near_copies
from tallyloom.llm.packing import packed
from tallyloom.llm.quality import judged
from tallyloom.llm.toxicity import THRESHOLD, learn, with_score

#: Rows that go to a Python worker at once, at most: whole texts can be long.
BATCH_ROWS = 1000
#: The same where texts are worked on one by one, so that the JVM's buffers for them, which the system doesn't get back, stay small.
FEW_ROWS = 128


def _few_rows(spark: SparkSession, most: int = BATCH_ROWS) -> None:
    name, kept = "spark.sql.execution.arrow.maxRecordsPerBatch", "tallyloom.pipeline.ownRows"
    own = int(spark.conf.get(kept, spark.conf.get(name)))  # the session's, before any stage
    spark.conf.set(kept, own)
    spark.conf.set(name, min(own, most) if own > 0 else most)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic. The model learns from labelled rows of docs that aren't held out."""
    _few_rows(spark, FEW_ROWS)
    scored = with_score(docs, learn(docs, table(spark, sf_dir, "labels")), out="_toxicity")
    return scored.where(F.col("_toxicity") < THRESHOLD).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity isn't above their language's threshold."""
    _few_rows(spark)
    return judged(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the row with the smallest doc_id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links make the row with the smallest doc_id, those without one last."""
    _few_rows(spark)
    return drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document and its place in a sequence."""
    _few_rows(spark, FEW_ROWS)
    return packed(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: Trained models and hashed sets can't be written in SQL; tests/llm holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        known = written_tables()
        docs = written(work(spark, docs, sf_dir), f"stage-{name}")
        drop_but(spark, known, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
