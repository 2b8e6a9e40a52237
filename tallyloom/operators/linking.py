"""Groups of records that share keys, and what is known of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.places import with_place
from tallyloom.sources.shared import drop_but, written, written_tables

#: Nodes up to which where they go (two of their names each) is broadcast, if names are numbers, and if they are anything else; with more, all joins are shuffles.
BROADCAST_NODES, BROADCAST_NAMES = 1_000_000, 50_000


def aside(df: DataFrame, rows: int) -> DataFrame:
    """df, which has so many rows, as a side of a join: broadcast if that is few enough."""
    numbers = all(isinstance(f.dataType, T.NumericType) for f in df.schema)
    return F.broadcast(df) if rows <= (BROADCAST_NODES if numbers else BROADCAST_NAMES) else df


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached) of all nodes in edges (a, b: of one type with an order). Loops and null ends are left out.

    By contraction: each node moves to the node within two steps that has the smallest hash of the round, and once more from there, and edges follow. Only the places
    moved to are left, at most a half of the nodes as expected in each round, whatever the shape: the rounds grow with the logarithm of a path's length, and a star
    takes one. The rounds' moves are followed backwards in the end. No node's neighbours are ever gathered.
    """
    spark, before = edges.sparkSession, written_tables()
    pairs = edges.select("a", "b").where("a <> b")
    now = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).dropDuplicates(), "edges")
    moves: list[tuple[DataFrame, int]] = []
    while not now.isEmpty():
        turn = F.lit(len(moves))
        near = now.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", turn).alias("h"), F.col("b").alias("n"))).alias("m"))
        least = near.select(F.col("a").alias("b"), F.least("m", F.struct(F.xxhash64("a", turn).alias("h"), F.col("a").alias("n"))).alias("m"))
        step = now.join(least, "b").groupBy("a").agg(F.min("m").alias("m")).select(F.col("a").alias("node"), F.col("m.n").alias("up"))
        onward = step.select(F.col("node").alias("up"), F.col("up").alias("to"))
        moved = written(step.join(onward, "up").select("node", "to"), "moves")
        rows = moved.count()
        moves.append((moved, rows))
        ends = [aside(moved.select(F.col("node").alias(c), F.col("to").alias(c + "_to")), rows) for c in "ab"]
        met = now.join(ends[0], "a").join(ends[1], "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        now = written(met.where("a <> b").dropDuplicates(), "edges")
    if not moves:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = moves[-1][0]
    for (moved, _), (_, rows) in zip(moves[-2::-1], moves[:0:-1], strict=True):
        on = label.select(F.col("node").alias("to"), F.col("to").alias("last"))
        label = moved.join(aside(on, rows), "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    label = written(label, "labels")
    first = label.groupBy("to").agg(F.min("node").alias("component"))
    named = written(label.join(aside(first, moves[0][1]), "to").select("node", "component"), "components")
    drop_but(spark, before, named)
    return named


def link_by_shared_keys(keys: DataFrame, record: str = "id", key: str = "key") -> DataFrame:
    """record, component: the smallest record that is reached by shared keys, transitively.

    keys has a row for each record and key; a record without keys has a row with a null key and is a component of its own. A key stands for its smallest record; only records of
    several keys tie such records, so the graph has no nodes for all others, and a key that many records have costs no more than its rows. Rows without a record are left out.
    """
    rows = keys.select(F.col(record).alias("r"), F.col(key).alias("k")).where("r is not null")
    low = rows.where("k is not null").groupBy("k").agg(F.min("r").alias("m"))
    found = written(rows.join(low, "k", "left").select("r", "m").dropDuplicates(), "keyed")
    least = found.groupBy("r").agg(F.min("m").alias("m"), F.max("m").alias("o"))
    several = least.where("m <> o").select("r", F.col("m").alias("a"))
    label = components(found.join(several, "r").select("a", F.col("m").alias("b")))
    return least.join(label, F.col("m") == F.col("node"), "left").select(F.col("r").alias(record), F.coalesce("component", "m", "r").alias("component"))


def merge_overlay(label: DataFrame, overlay: DataFrame, most_share: float = 0.5) -> DataFrame:
    """Components joined further by a second grouping (id, cluster): a cluster only counts if it isn't noise (negative) and holds most_share of all records at most."""
    total = label.count()
    able = overlay.where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_share * total)
    sized = overlay.join(able, "cluster")
    keys = label.select("id", F.concat(F.lit("c"), "component").alias("key")).unionByName(sized.select("id", F.concat(F.lit("t"), "cluster").alias("key")))
    return link_by_shared_keys(keys)


def organizations(members: DataFrame) -> DataFrame:
    """org_id, component, size, first_member of each component; ids are org_0, org_1... by falling size, then by smallest member. members: id, component."""
    sized = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first_member"))
    placed = with_place(sized, F.desc("size"), "first_member")
    return placed.withColumn("org_id", F.concat(F.lit("org_"), F.col("place"))).select("org_id", "component", "size", "first_member")


def group_numbers(members: DataFrame, number: str = "number") -> DataFrame:
    """component, numbers: the sorted different numbers of each group."""
    return members.groupBy("component").agg(F.array_sort(F.collect_set(number)).alias("numbers"))


def mode_text(members: DataFrame, text: str = "text") -> DataFrame:
    """component, mode: the most frequent text that isn't blank, of equally frequent ones the one that comes first by id; null if all are blank."""
    counted = members.where(F.trim(F.coalesce(text, F.lit(""))) != "").groupBy("component", text).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    best = Window.partitionBy("component").orderBy(F.desc("n"), "first")
    mode = counted.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("component", F.col(text).alias("mode"))
    return members.select("component").dropDuplicates().join(mode, "component", "left")


def recency(last: Column, now: Column, days: float = 30.0) -> Column:
    """1 for now and later, falling to 0 at days before; 0 without a time."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / F.lit(86_400_000_000.0)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age / days)), F.lit(0.0))


def growth(recent: Column, total: Column) -> Column:
    return F.when(total > 0, recent / total).otherwise(0.0)


def priority(size: Column, recent: Column, grown: Column, full: float = 50.0) -> Column:
    """Size (logarithmic, full at 50), recency and growth at weights 0.4, 0.35 and 0.25."""
    return 0.4 * F.least(F.lit(1.0), F.log1p(size.cast("double")) / F.log1p(F.lit(full))) + 0.35 * recent + 0.25 * grown


def ranked(members: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Organizations with last time, counts and priority, most urgent first: queue_place from 1. members: id, component, ts. Times after now count as recent."""
    orgs = organizations(members)
    times = members.groupBy("component").agg(
        F.max("ts").alias("last_ts"),
        F.sum(F.when(F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS"), 1).otherwise(0)).alias("recent"),
        F.count("ts").alias("dated"),
    )
    scored = orgs.join(times, "component").withColumn("priority", F.round(priority(F.col("size"), recency(F.col("last_ts"), now), growth(F.col("recent"), F.col("dated"))), 6))
    placed = with_place(scored, F.desc("priority"), F.desc("size"), "first_member", out="queue_place")
    return placed.withColumn("queue_place", F.col("queue_place") + 1)
