"""Pairs of rows of which many are alike: what is told of two classes is told once, and their rows are paired in blocks of a bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.shared import written

#: Rows of a block of a class, and pairs of a task.
BLOCK, TASK = 1000, 4_000_000


def blocks(rows: DataFrame, on: list[str], row_id: str) -> DataFrame:
    """on, block, ids: the rows of each class (nulls are equal) in blocks of about BLOCK ids."""
    sizes = rows.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks")).select(*(F.col(c).alias("_" + c) for c in on), "_blocks")
    same = [F.col(c).eqNullSafe(F.col("_" + c)) for c in on]
    dealt = rows.join(sizes, same).withColumn("block", F.pmod(F.xxhash64(row_id), F.col("_blocks")))
    return dealt.groupBy(*on, "block").agg(F.collect_list(row_id).alias("ids"))


def paired(met: DataFrame, told: list[str], same: Column) -> DataFrame:
    """a, b (a < b), told of every id of ids_x with every id of ids_y; same: whether they are one block. Blocks are dealt to tasks by the number of pairs."""
    held = written(met.select("ids_x", "ids_y", same.alias("_same"), *told), "block-pairs")
    total = held.agg(F.sum(F.size("ids_x").cast("long") * F.size("ids_y"))).collect()[0][0] or 0
    tasks = max(held.sparkSession.sparkContext.defaultParallelism, -(-total // TASK))
    each = held.repartition(tasks).select("ids_y", "_same", *told, F.explode("ids_x").alias("x")).select("_same", *told, "x", F.explode("ids_y").alias("y"))
    return each.where(F.when(F.col("_same"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *told)
