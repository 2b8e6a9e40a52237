"""How queries read their tables, and the registry they are put in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed times that stand for now.
NOW = "2024-01-31 00:00:00"
ORDERS_NOW = "2001-08-01 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query, and its SQL where SQL can express it."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as incidents: id, number (the user), ts, tactic, weight and code (from props)."""
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("number"),
        "ts",
        F.col("event_type").alias("tactic"),
        F.col("value").alias("weight"),
        F.get_json_object("props", "$.k").cast("int").alias("code"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with the component that shared numbers make."""
    rows = incidents(spark, sf_dir)
    low = rows.groupBy("number").agg(F.min("id").alias("component"))
    return rows.join(low, "number")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a stated risk, confidence and hard signals for each turn: functions of its length and text."""
    rows = load(spark, sf_dir, "conversations")
    n = F.length("text")
    ids = F.filter(F.array(F.when(n % 37 == 0, "otp_request"), F.when(n % 53 == 0, "remote_access")), lambda x: x.isNotNull())
    return rows.select("conv_id", "turn", "role", "text", (n % 101 / 100.0).alias("risk"), (0.5 + n % 6 / 10.0).alias("conf"), ids.alias("ids"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a stated score: id, lang, source, truth, score."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(load(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("id"), "lang", "source", F.col("toxic").alias("truth"), ((F.col("n_chars") * 7 + F.col("doc_id") * 13) % 101 / 100.0).alias("score"))


INCIDENTS = "SELECT event_id AS id, user_id AS number, ts, event_type AS tactic, value AS weight, CAST(json_extract(props, '$.k') AS INTEGER) AS code FROM events"
MEMBERS = f"SELECT i.*, min(id) OVER (PARTITION BY number) AS component FROM ({INCIDENTS}) i"
TURNS = "SELECT conv_id, turn, role, text, (length(text) % 101) / 100.0::DOUBLE AS risk, 0.5::DOUBLE + (length(text) % 6) / 10.0::DOUBLE AS conf, list_filter([CASE WHEN length(text) % 37 = 0 THEN 'otp_request' END, CASE WHEN length(text) % 53 = 0 THEN 'remote_access' END], lambda x: x IS NOT NULL) AS ids FROM conversations"
SCORED = "SELECT doc_id AS id, lang, source, toxic AS truth, ((n_chars * 7 + doc_id * 13) % 101) / 100.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id)"
RATES = "round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6)::DOUBLE AS fpr, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6)::DOUBLE AS recall, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6)::DOUBLE AS precision, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6)::DOUBLE AS f1"


def counts_sql(truth: str, said: str) -> str:
    """The four counts of a confusion table as BIGINT."""
    return ", ".join(f"count(*) FILTER ({truth} = {t} AND {said} = {s}) AS {n}" for t, s, n in ((1, 1, "tp"), (0, 1, "fp"), (0, 0, "tn"), (1, 0, "fn")))
