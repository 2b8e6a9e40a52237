"""Retention, quotas, rates, forgetting, verdicts and the audit chain."""

from __future__ import annotations

import hashlib
import hmac
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anchor(received: Column, ts: Column, now: Column) -> Column:
    """When keeping begins: receipt, else the stated time unless it is over five minutes ahead; null if neither."""
    return F.coalesce(received, F.when(ts <= now + F.expr("INTERVAL 5 MINUTES"), ts))


def expired(received: Column, ts: Column, now: Column, days: int) -> Column:
    a = anchor(received, ts, now)
    return a.isNull() | (a < now - F.expr(f"INTERVAL {days} DAYS"))


def in_client_window(ts: Column, now: Column, days: int) -> Column:
    """From days ago to five minutes ahead, both ends included."""
    return ts.between(now - F.expr(f"INTERVAL {days} DAYS"), now + F.expr("INTERVAL 5 MINUTES"))


def quota_used(rows: DataFrame, partner: str, received: str, ts: str, since: Column, quota: int) -> DataFrame:
    """partner, used and left: rows since a time (included) by receipt, else stated time."""
    counted = rows.groupBy(partner).agg(F.sum(F.when(F.coalesce(received, ts) >= since, 1).otherwise(0)).alias("used"))
    return counted.withColumn("left", F.greatest(F.lit(quota) - F.col("used"), F.lit(0)))


def rate_limited(hits: DataFrame, key: str, row_id: str, seconds: str, window: float, most: int) -> DataFrame:
    """key, id, allowed: a hit is denied if most allowed hits are younger than window; denied hits don't count. Each key is one fold, in order of time and id.

    A long history is read in pieces: what is kept between them is most times at most. A key's hits depend on one another, so one key is one task.
    """
    schema = f"{key} {hits.schema[key].dataType.simpleString()}, {row_id} {hits.schema[row_id].dataType.simpleString()}, allowed boolean"
    ordered = hits.select(key, row_id, F.col(seconds).cast("double").alias("_s")).repartition(key).sortWithinPartitions(key, "_s", row_id)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = object(), deque()
        for part in parts:
            said = []
            for k, s in zip(part[key], part["_s"], strict=True):
                if k != now:
                    now, held = k, deque()
                while held and s - held[0] >= window:
                    held.popleft()
                said.append(len(held) < most)
                if said[-1]:
                    held.append(s)
            yield part[[key, row_id]].assign(allowed=said)

    return ordered.mapInPandas(run, schema)


def pending(reports: DataFrame, known: DataFrame, content_id: str, order: str) -> DataFrame:
    """Reports whose content is not known yet, each content once, the first by order."""
    fresh = reports.join(known.select(content_id).dropDuplicates(), content_id, "left_anti")
    first = fresh.groupBy(content_id).agg(F.min(order).alias(order))
    return fresh.join(first, [content_id, order], "left_semi")


def orphans(incidents: DataFrame, reports: DataFrame, row_id: str, prefix: str) -> DataFrame:
    """Incidents that came from reports (by the prefix of their id) of which no report is left."""
    return incidents.where(F.col(row_id).startswith(prefix)).join(reports.select(row_id), row_id, "left_anti")


def forget(tables: dict[str, DataFrame], gone: DataFrame, row_id: str, number: str | None = None) -> dict[str, DataFrame]:
    """Each table without the rows of gone (row_id); where a table has arrays of members and numbers, those lose what no row that is left has. Repeating it changes nothing."""
    out = {}
    for name, rows in tables.items():
        if row_id in rows.columns:
            out[name] = rows.join(gone.select(row_id).dropDuplicates(), row_id, "left_anti")
    base = out.get("incidents")
    for name, rows in tables.items():
        if "members" in rows.columns and base is not None:
            cols = [row_id, *([number] if number else [])]
            left = rows.select("org", F.explode("members").alias(row_id)).join(base.select(*cols), row_id)
            aggs = [F.array_sort(F.collect_set(row_id)).alias("members")] + ([F.array_sort(F.collect_set(number)).alias("numbers")] if number else [])
            out[name] = rows.drop("members", "numbers").join(left.groupBy("org").agg(*aggs), "org")
    return out


def feedback_overlay(orgs: DataFrame, events: DataFrame) -> DataFrame:
    """orgs (org, priority, is_novel) with the last verdict of each: a dismissal leaves a fifth of the base priority and nothing novel, a confirmation the base."""
    last = events.where(F.col("action").isin("confirm", "dismiss")).groupBy("org").agg(F.max_by("action", F.struct("ts", "event_id")).alias("feedback"))
    rows = orgs.join(last, "org", "left")
    gone = F.coalesce(F.col("feedback") == "dismiss", F.lit(False))
    return rows.withColumn("priority", F.when(gone, F.col("priority") * 0.2).otherwise(F.col("priority"))).withColumn("is_novel", F.col("is_novel") & ~gone)


def merge_sets(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def match_verdict(events: DataFrame, orgs: DataFrame, least: float = 0.5) -> DataFrame:
    """event_id, org: of the organizations that share a number with the event's snapshot the first by place, else the one with the largest part of its members, if least or more."""
    def met(own: str, other: str) -> DataFrame:
        """Pairs that share a value, and how many."""
        asked = events.select("event_id", F.explode(F.array_distinct(own)).alias("v"))
        return asked.join(orgs.select("org", F.explode(F.array_distinct(other)).alias("v")), "v").groupBy("event_id", "org").agg(F.count(F.lit(1)).alias(f"n_{other}"))

    places = orgs.select("org", "place").dropDuplicates(["org"])
    sizes = events.select("event_id", F.size("snapshot_members").alias("size")).dropDuplicates(["event_id"])
    pairs = met("snapshot_numbers", "numbers").join(met("snapshot_members", "members"), ["event_id", "org"], "full").join(places, "org").join(sizes, "event_id")
    share = F.coalesce("n_members", F.lit(0)) / F.col("size")
    rows = pairs.select("event_id", "org", "place", F.col("n_numbers").isNotNull().alias("by_number"), share.alias("share")).where(F.col("by_number") | (F.col("share") >= least))
    order = Window.partitionBy("event_id").orderBy(F.desc("by_number"), F.when(F.col("by_number"), F.lit(0.0)).otherwise(-F.col("share")), "place")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("event_id", "org")


def chain_breaks(log: DataFrame, seq: str = "seq", prev: str = "prev", mac: str = "mac", expected: Column | None = None) -> DataFrame:
    """first_break: the smallest seq whose prev isn't the mac before it, that leaves a gap, or whose mac isn't the expected one; null for an intact chain.

    Neighbours meet by an equi-join on seq, so no task holds the whole log.
    """
    before = log.select((F.col(seq) + 1).alias(seq), F.col(mac).alias("_before"))
    rows = log.join(before, seq, "left")
    bad = F.when(F.col(seq) == 0, F.col(prev).isNotNull() & (F.col(prev) != "")).otherwise(~F.col("_before").eqNullSafe(F.col(prev)))
    if expected is not None:
        bad = bad | (F.col(mac) != expected)
    return rows.agg(F.min(F.when(bad, F.col(seq))).alias("first_break"))


def sealed(entries: list[tuple[str, ...]], key: bytes) -> list[tuple]:
    """Entries with seq, prev and mac: a log has one writer, so this is a fold on the driver."""
    out, prev = [], ""
    for n, entry in enumerate(entries):
        mac = hmac.new(key, "\x1f".join([str(n), prev, *entry]).encode(), hashlib.sha256).hexdigest()
        out.append((n, *entry, prev, mac))
        prev = mac
    return out
