"""Queries of structures: density, spans of several recognisers, stress, audits, manifests, heads out of fold, probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import audit, density, grid, heads, intake, linking, probe, span_vote, stress
from tallyloom.plans.base import incidents, load, query
from tallyloom.plans.review_queries import EVERY, _known, _reports

KEY = b"the key of the log"


@query("density_clusters")
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster by density of each vector."""
    return density.clusters(load(spark, sf_dir, "embeddings"))


@query("density_overlay")
def density_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of vectors that share a label and a parity, joined further by clusters of density."""
    rows = load(spark, sf_dir, "embeddings")
    label = linking.link_by_shared_keys(rows.select(F.col("vec_id").alias("id"), F.concat_ws(":", "label", F.col("vec_id") % 2).alias("key")))
    return linking.merge_overlay(label, density.clusters(rows))


def _heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls as two recognisers hear them: each hears every turn's words at their places, the second a tenth of a second later; how sure each is follows from the word's letters."""
    rows = load(spark, sf_dir, "conversations").where("text is not null")
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    begun = rows.withColumn("at", F.coalesce(F.sum(F.length("text") + 10).over(by), F.lit(0)))
    words = begun.select("conv_id", "at", F.posexplode(F.split("text", r"\s+")).alias("n", "word")).where("word <> ''")
    inside = Window.partitionBy("conv_id", "at").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumn("start", (F.col("at") + F.coalesce(F.sum(F.length("word") + 1).over(inside), F.lit(0))) / 10.0).withColumn("end", F.col("start") + F.length("word") / 10.0)
    sure = (F.pmod(F.crc32("word"), F.lit(97)) + 1) / 100.0
    each = [("a", 0.0, sure), ("b", 0.1, 1 - sure)]
    parts = [words.select(F.col("conv_id").alias("call"), F.lit(lang).alias("lang"), "word", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"), p.alias("p")) for lang, shift, p in each]
    return parts[0].unionByName(parts[1])


@query("span_vote")
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each stretch of each call."""
    return span_vote.labelled(_heard(spark, sf_dir), ["a", "b"], switch=0.5, missing=-1.0, pause=0.9).select("call", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "lang")


def _stressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents(spark, sf_dir).select("id", F.col("number").alias("key"), F.col("tactic").alias("truth"))


@query("stress_conditions")
def stress_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well organizations by numbers hold with all, half and a fifth of the numbers."""
    return stress.stress_conditions(_stressed(spark, sf_dir), {"all": 1.0, "half": 0.5, "a fifth": 0.2}, resamples=8)


@query("stress_base", """WITH c AS (SELECT user_id AS g, event_type AS t, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT g, sum(n) AS m, max(n) AS top, sum(n * (n - 1) / 2.0::DOUBLE) AS same FROM c GROUP BY g),
t AS (SELECT sum(x * (x - 1) / 2.0::DOUBLE) AS truths FROM (SELECT t, sum(n)::DOUBLE AS x FROM c GROUP BY t)), s AS (SELECT sum(m)::DOUBLE AS n, count(*) AS groups, sum(top) AS top, sum(same) AS same, sum(m * (m - 1) / 2.0::DOUBLE) AS pairs, sum(m) FILTER (m > 1) AS several FROM g)
SELECT CAST(n AS BIGINT) AS n, groups, round(top / n, 9) AS purity, round((same - pairs * truths / (n * (n - 1) / 2)) / ((pairs + truths) / 2 - pairs * truths / (n * (n - 1) / 2)), 9) AS ari, round(coalesce(several, 0) / n, 9) AS multi_member_share FROM s, t""")
def stress_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condition in which no number is lost."""
    found = stress.stress_conditions(_stressed(spark, sf_dir), {"all": 1.0}, resamples=1)
    return found.select("n", "groups", *(F.round(c, 9).alias(c) for c in ("purity", "ari", "multi_member_share")))


@query("audit_breaks", """SELECT 'events/' || (n // 1000) AS segment, min(n % 1000) AS seq, 'changed' AS reason FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events) WHERE event_id % 701 = 5 GROUP BY n // 1000""")
def audit_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of all events is sealed; some values are changed afterwards; where each segment's chain first breaks."""
    log, heads_ = audit.sealed(load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), KEY, "events", "event_id")
    touched = log.withColumn("value", F.when(F.col("event_id") % 701 == 5, F.coalesce("value", F.lit(0.0)) + 1).otherwise(F.col("value")))
    return audit.breaks(touched, heads_, KEY)


@query("grid_cells")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of as many cells as there are customers: classes as frequent as market segments, axes as order priorities and states."""
    size = load(spark, sf_dir, "customer").count()
    weights = {c: {r[0]: float(r["count"]) for r in rows.groupBy(c).count().orderBy(c).collect()} for rows, c in ((load(spark, sf_dir, "customer"), "c_mktsegment"), *((load(spark, sf_dir, "orders"), c) for c in ("o_orderpriority", "o_orderstatus")))}
    tactics = load(spark, sf_dir, "events").groupBy("event_type").count().orderBy("event_type").collect()
    optional = spark.createDataFrame([(k, t["event_type"], float(t["count"])) for k in weights["c_mktsegment"] for t in tactics], "class string, tactic string, weight double")
    return grid.grid_manifest(spark, size, weights.pop("c_mktsegment"), weights, optional, 1, 3)


@query("out_of_fold_auc")
def out_of_fold_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well heads out of fold tell each label of the vectors from the others."""
    rows = load(spark, sf_dir, "embeddings").where("label is not null")
    labels = [r[0] for r in rows.select("label").distinct().orderBy("label").limit(32).collect()]
    multi = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.array(*((F.col("label") == k).cast("int") for k in labels)).alias("y"))
    return heads.cv_auc(heads.out_of_fold_scores(multi, folds=3)).select("head", "n", F.round("auc", 4).alias("auc"))


@query("generator_probe")
def generator_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Can it be told from a turn who wrote it? Whole calls are in one fold."""
    rows = load(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "conv_id", "text", (F.col("role") == "user").cast("int").alias("label"))
    return probe.generator_probe(rows, group="conv_id").select("n", F.round("auc", 3).alias("auc"))


@query("ingest_in_batches", f"SELECT id, min(id) OVER (PARTITION BY number) AS component FROM ({EVERY})")
def ingest_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organizations that have grown by the pending reports are those of all incidents at once."""
    known = _known(spark, sf_dir)
    label = linking.link_by_shared_keys(known.select("id", F.col("number").alias("key")))
    every, _ = intake.ingest(_reports(spark, sf_dir), known)
    new = every.join(known.select("id"), "id", "left_anti")
    return intake.grown(label, known.select("id", F.col("number").alias("key")), new.select("id", F.col("number").alias("key")))
