"""Activity over time, and profiles of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def activity_series(rows: DataFrame, today: str, days: int, ts: str = "ts") -> DataFrame:
    """day, n for the days that end with today, those without rows as 0."""
    if days <= 0:
        raise ValueError("days must be positive")
    spark = rows.sparkSession
    every = spark.range(days).select(F.date_sub(F.lit(today).cast("date"), F.col("id").cast("int")).alias("day"))
    counted = rows.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def weekly_trend(rows: DataFrame, now: str, days: int = 7, ts: str = "ts") -> DataFrame:
    """Rows after now - days (open to the future), those in the time before that, and the change in percent; null if there were none before."""
    at, span = F.lit(now).cast("timestamp"), F.expr(f"INTERVAL {days} DAYS")
    this = F.sum(F.when(F.col(ts) > at - span, 1).otherwise(0))
    last = F.sum(F.when((F.col(ts) > at - span - span) & (F.col(ts) <= at - span), 1).otherwise(0))
    return rows.agg(this.alias("this_week"), last.alias("last_week")).withColumn(
        "pct", F.when(F.col("last_week") > 0, F.round(100.0 * (F.col("this_week") - F.col("last_week")) / F.col("last_week"), 6))
    )


def activity_by_day(rows: DataFrame, group: str, ts: str = "ts") -> DataFrame:
    """group, day, n; rows without a time are left out."""
    return rows.where(F.col(ts).isNotNull()).groupBy(group, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def tactic_profile(rows: DataFrame, group: str, tactic: str, order: str) -> DataFrame:
    """group, tactic, n, place: most frequent first, ties by first seen."""
    counted = rows.groupBy(group, tactic).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "first"))).drop("first")


def distinguishing_tactic(profile: DataFrame, sizes: DataFrame, group: str, tactic: str) -> DataFrame:
    """For each group the tactic whose share most exceeds the largest share of it in any other group, if any does; ties by the profile's order.

    profile: group, tactic, n, place; sizes: group, size. The two largest shares of each tactic are enough to know the largest of the others.
    """
    share = profile.join(sizes, group).withColumn("share", F.col("n") / F.col("size"))
    order = Window.partitionBy(tactic).orderBy(F.desc("share"), group)
    top = share.withColumn("nth", F.row_number().over(order)).where("nth <= 2").groupBy(tactic).agg(
        F.max(F.when(F.col("nth") == 1, F.col(group))).alias("holder"),
        F.max(F.when(F.col("nth") == 1, F.col("share"))).alias("high"),
        F.max(F.when(F.col("nth") == 2, F.col("share"))).alias("second"),
    )
    rival = F.coalesce(F.when(F.col("holder") == F.col(group), F.col("second")).otherwise(F.col("high")), F.lit(0.0))
    gaps = share.join(top, tactic).withColumn("gap", F.col("share") - rival).where("gap > 0")
    best = Window.partitionBy(group).orderBy(F.desc("gap"), "place")
    return gaps.withColumn("nth", F.row_number().over(best)).where("nth = 1").select(group, tactic, F.round("gap", 6).alias("gap"))


def merge_islands(ranges: DataFrame, group: str, start: str = "start", end: str = "end") -> DataFrame:
    """Ranges of a group that touch or overlap, as one each."""
    by = Window.partitionBy(group).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(F.col(start) <= before, 0).otherwise(1))
    marked = marked.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")
