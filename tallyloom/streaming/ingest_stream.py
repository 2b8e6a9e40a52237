"""Reports that come as a stream and become incidents with organizations, batch by batch, in a store of versions.

A batch's commit carries its number and is seen whole or not at all, so a batch that runs again changes nothing; and each report's content counts once, so it doesn't matter how the stream
is cut. Organizations grow: only those that share a number with a new incident are linked again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import governance, intake
from tallyloom.sources.shared import drop_but, written, written_tables
from tallyloom.sources.versions import Version, Versions, checked_embeddings


def ingest_batch(store: Versions, reports: DataFrame, token: str | None = None, embed: Callable[[DataFrame], DataFrame] | None = None) -> Version:
    """Adds the incidents of reports (content_id, number, ts, order) that the store doesn't have: its tables are incidents (id, number, ts), label (id, component) and, with embed (from id, number, ts
    to id and embedding), embeddings. Reports without a time are left out until their content comes with one."""
    spark, known, before = reports.sparkSession, written_tables(), store.latest()
    if token is not None and before and token in before.tokens:
        return before
    slim = reports.select("content_id", "number", "ts", "order")
    if before:
        incidents, label = before.read(spark, "incidents"), before.read(spark, "label")
    else:
        incidents = spark.createDataFrame([], f"id string, number {reports.schema['number'].dataType.simpleString()}, ts timestamp")
        label = spark.createDataFrame([], "id string, component string")
    ids = incidents.where(F.col("id").startswith(intake.PREFIX)).select(F.substring("id", len(intake.PREFIX) + 1, 1 << 20).alias("content_id"))
    ready = governance.pending(slim.where("ts is not null"), ids, "content_id", "order")
    new = written(ready.select(F.concat(F.lit(intake.PREFIX), "content_id").alias("id"), "number", "ts"), "new-incidents")
    every = incidents.unionByName(new)
    keys, more = (rows.select("id", F.col("number").alias("key")) for rows in (incidents, new))
    tables = {"incidents": every, "label": intake.grown(label, keys, more)}
    if embed:
        empty = spark.createDataFrame([], "id string, embedding array<double>")
        cached = before.read(spark, "embeddings") if before and "embeddings" in before.tables else empty
        tables["embeddings"] = checked_embeddings(written(intake.extended(cached, every, new, embed), "embeddings"))
    done = store.commit(tables, token, before)
    drop_but(spark, known)
    return done


def start(reports: DataFrame, store: Versions, checkpoint: str, name: str = "ingest", embed: Callable[[DataFrame], DataFrame] | None = None, **trigger: object):
    """Starts to ingest a stream of reports; a batch's token is name and number."""
    return reports.writeStream.foreachBatch(lambda batch, number: ingest_batch(store, batch, f"{name}:{number}", embed) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
