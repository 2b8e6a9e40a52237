"""Exact duplicates by content sort, in DataFrame operations alone.

Normalised texts are dealt by sampled splitters (a range partitioning), sorted outside memory where
they do not fit, and compared with their neighbours in full. The splitters are a short prefix and a hash
of the text, so that what the driver samples stays small however long the texts are; equal texts have equal
splitters. The sort itself and the comparison are by the whole normalised text.

A group of copies that is larger than a share of a partition is counted before the shuffle and salted, so that
no task gets a whole hot group. There are at most SHARE times as many such groups as partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import Aside, shuffle_partitions, table

#: A group is hot from this part of a mean partition's rows on: 1 / SHARE.
SHARE = 4
#: Code points of the text in the splitters.
PREFIX = 24


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def content_sort(df: DataFrame, text: str = "text", row_id: str = "doc_id", share: int = SHARE) -> DataFrame:
    """All rows and columns of df, with keep_id, group_size, kept and text_sha256 of the group of equal normalised texts.

    Of equal texts the row with the smallest id stays; of rows that share that id exactly one stays. Rows without an id
    count in their group and stay only if no row of it has an id. Null and empty texts are one group. Columns of
    df that have the names of results are replaced.
    """
    parts = shuffle_partitions(df.sparkSession)
    aside = Aside(df, "keep_id", "group_size", "kept", "text_sha256")
    norm, name, rows = normalised(aside[text]), aside[row_id], aside.rows
    share_of = max(8, rows.count() // (parts * share))
    hot = (
        rows.groupBy(F.sha2(norm, 256).alias("_hot_sha"))
        .agg(F.count(F.lit(1)).alias("_hot_size"), F.min(name).alias("_hot_id"))
        .where(F.col("_hot_size") > share_of)
    )
    keyed = rows.withColumn("_sha", F.sha2(norm, 256)).withColumn("_head", F.substring(norm, 1, PREFIX))
    # at most parts * share + 1 rows of fixed width
    keyed = keyed.join(F.broadcast(hot), F.col("_sha") == F.col("_hot_sha"), "left")
    # beside rows with ids, those without are never kept, and dealt by their input partition, which a task that is run again shares
    dealt_by = F.coalesce(name.cast("string"), F.spark_partition_id().cast("string"))
    salt = F.pmod(F.xxhash64(dealt_by), F.ceil(F.col("_hot_size") / F.lit(share_of)))
    # one row of a group without any id stays, so these must be together
    keyed = keyed.withColumn("_salt", F.when(F.col("_hot_id").isNotNull(), salt).otherwise(F.lit(0)))
    keyed = keyed.withColumn("_point", F.xxhash64("_sha", "_salt"))
    dealt = keyed.repartitionByRange("_head", "_point").withColumn("_norm", norm)
    equal = Window.partitionBy("_head", "_point", "_norm")
    first = equal.orderBy(name.asc_nulls_last())
    found = dealt.withColumn("_nth", F.row_number().over(first))
    found = found.withColumn("_keep", F.first(name).over(first)).withColumn("_size", F.count(F.lit(1)).over(equal))
    found = found.withColumn("_keep", F.when(F.col("_hot_size").isNull(), F.col("_keep")).otherwise(F.col("_hot_id")))
    kept = (F.col("_nth") == 1) & name.eqNullSafe(F.col("_keep"))
    size = F.coalesce("_hot_size", "_size").alias("group_size")
    return found.select(*aside.back(), F.col("_keep").alias("keep_id"), size, kept.alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_copies(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The rows of df that stay, with df's columns."""
    return content_sort(df, text, row_id).where("kept").select(*df.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
