"""Places of rows in an order of the whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.shared import written

_WITHIN = (1 << 33) - 1


def with_place(rows: DataFrame, *order: Column | str, out: str = "place") -> DataFrame:
    """rows with their place from 0 in the order. Rows are range-partitioned and sorted; only the partitions' sizes, a row each, are added up in one task."""
    numbered = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_start")))
    return numbered.withColumn("_part", part).join(starts, "_part").withColumn(out, F.col("_start") + F.col("_at").bitwiseAND(_WITHIN)).drop("_part", "_start", "_at")
