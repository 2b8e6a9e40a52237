"""An audit log that many writers add to: entries are chained within segments of a bounded size, and a hash tree is over the segments' heads.

Each entry's code covers the one before it, each segment's head its number of entries, and the tree's root all heads, so an entry or segment that was changed, moved, added or left out is found,
and where. Segments are sealed apart from each other, in parallel.
"""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.places import with_place

#: Entries of a segment, and heads under a node of the tree, at most.
SEGMENT, FAN = 1000, 64
_ENTRY, _HEAD, _NODE, _START = b"entry\x00", b"head\x00", b"node\x00", "0" * 64


def _keys(key: bytes) -> tuple[Column, Column]:
    if not key:
        raise ValueError("a key is needed")
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return tuple(F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))


def code(key: bytes, kind: bytes, *parts: Column) -> Column:
    """HMAC-SHA256 of the kind and the parts (strings without a zero byte), in hexadecimal digits."""
    inner, outer = _keys(key)
    told = F.concat(F.lit(kind), *(F.concat(p.cast("string"), F.lit("\x00")).cast("binary") for p in parts))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, told), 256))), 256)


def _canonical(columns: list[str]) -> Column:
    """The columns as JSON, by name, nulls left out; lengths come from JSON's quotes."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))))


def sealed(entries: DataFrame, key: bytes, batch: str, *order: str, size: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """entries with segment, seq and mac, and their segments' heads (segment, n, head). batch: a name that no other call to this has used with the log; segments are batch/0, batch/1..."""
    _keys(key)
    columns = entries.columns
    placed = with_place(entries, *(order or columns)).withColumn("_told", _canonical(columns))
    rows = placed.withColumn("segment", F.concat(F.lit(f"{batch}/"), F.floor(F.col("place") / size).cast("string"))).withColumn("seq", F.col("place") % size).drop("place")
    fields = [*(f"`{c}` {entries.schema[c].dataType.simpleString()}" for c in columns), "segment string", "seq long", "mac string"]

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        part, last, macs = part.sort_values("seq"), _START, []
        for segment, seq, told in zip(part["segment"], part["seq"], part["_told"], strict=True):
            last = hmac.new(key, _ENTRY + b"".join(f"{x}\x00".encode() for x in (segment, seq, last, told)), hashlib.sha256).hexdigest()
            macs.append(last)
        return part.assign(mac=macs)[[*columns, "segment", "seq", "mac"]]

    done = rows.groupBy("segment").applyInPandas(chain, ", ".join(fields))
    return done, heads(done, key)


def heads(log: DataFrame, key: bytes) -> DataFrame:
    """segment, n, head of a sealed log's segments, from its last entries."""
    last = log.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.max_by("mac", "seq").alias("mac"))
    return last.select("segment", "n", code(key, _HEAD, F.col("segment"), F.col("n"), F.col("mac")).alias("head"))


def root(heads: DataFrame, key: bytes) -> str | None:
    """The code of the tree over heads, in order of segments; None without any. Each level is one shuffle by groups of FAN, and has a FAN-th of the rows of the one below."""
    level = with_place(heads.select("segment", "head"), "segment").select("place", "head")
    rows, depth = level.count(), 0
    while rows > 1 or rows and not depth:
        depth += 1
        each = level.groupBy(F.floor(F.col("place") / FAN).alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", "head"))).alias("h"))
        level = each.select("place", code(key, _NODE, F.lit(depth), F.array_join(F.transform("h", lambda h: h["head"]), ",")).alias("head"))
        rows = -(-rows // FAN)
    found = level.collect() if rows else []
    return found[0]["head"] if found else None


def breaks(log: DataFrame, told_heads: DataFrame, key: bytes) -> DataFrame:
    """segment, seq, reason of all that is wrong with a log (as sealed() gave it) against its heads: the entry where a chain first breaks in a segment, gaps, segments that are cut short, unknown or gone, and
    heads that are not this key's. No rows if all is well. The heads themselves are covered by the root."""
    columns = [c for c in log.columns if c not in ("segment", "seq", "mac")]
    order = Window.partitionBy("segment").orderBy("seq", "mac")
    rows = log.select("segment", "seq", "mac", _canonical(columns).alias("_told")).withColumn("_before", F.coalesce(F.lag("mac").over(order), F.lit(_START))).withColumn("_at", F.row_number().over(order) - 1)
    gap = F.col("seq").isNull() | (F.col("seq") != F.col("_at"))
    wrong = F.coalesce(F.col("mac") != code(key, _ENTRY, F.col("segment"), F.col("seq"), F.col("_before"), F.col("_told")), F.lit(True))
    found = rows.select("segment", "seq", F.when(gap, "gap").when(wrong, "changed").alias("reason")).where("reason is not null")
    first = found.groupBy("segment").agg(F.min(F.struct("seq", "reason")).alias("f")).select("segment", "f.seq", "f.reason")
    named = told_heads.groupBy("segment").agg(F.max("n").alias("n"), F.max("head").alias("head"), F.count(F.lit(1)).alias("times"))
    own = log.groupBy("segment").agg(F.count(F.lit(1)).alias("have"), F.max_by("mac", "seq").alias("mac"))
    met = named.join(own, "segment", "full")
    state = (
        F.when(F.col("n").isNull(), "unknown segment").when(F.col("have").isNull(), "segment gone").when(F.col("times") > 1, "two heads").when(F.col("have") < F.col("n"), "cut short").when(F.col("have") > F.col("n"), "entries added")
        .when(F.col("head") != code(key, _HEAD, F.col("segment"), F.col("n"), F.col("mac")), "head differs")
    )
    return first.unionByName(met.select("segment", F.lit(None).cast("long").alias("seq"), state.alias("reason")).where("reason is not null"))


def audit_head(log: DataFrame) -> DataFrame:
    """segment, seq, mac of each segment's newest entry: what to note elsewhere."""
    return log.groupBy("segment").agg(F.max("seq").alias("seq"), F.max_by("mac", "seq").alias("mac"))
