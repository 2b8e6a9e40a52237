"""Queries over reports, quotas, rates and logs: orders stand for reports, customers for partners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import corpus, governance, rules
from tallyloom.plans.base import NOW, ORDERS_NOW, load, query

_NOW = f"TIMESTAMP '{ORDERS_NOW}'"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders")


def _now() -> object:
    return F.lit(ORDERS_NOW).cast("timestamp")


@query("retention_expired", f"SELECT count(*) AS n, count(*) FILTER (o_orderdate < {_NOW} - INTERVAL 365 DAYS) AS expired, count(*) FILTER (o_orderstatus = 'P' AND o_orderdate > {_NOW} + INTERVAL 5 MINUTES) AS unanchored FROM orders")
def retention_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("o_orderdate")
    return _orders(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(governance.expired(ts, ts, _now(), 365), 1)).alias("expired"),
        F.count(F.when((F.col("o_orderstatus") == "P") & governance.anchor(F.lit(None).cast("timestamp"), ts, _now()).isNull(), 1)).alias("unanchored"),
    )


@query("client_window", f"SELECT count(*) AS n FROM orders WHERE o_orderdate BETWEEN {_NOW} - INTERVAL 90 DAYS AND {_NOW} + INTERVAL 5 MINUTES")
def client_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).where(governance.in_client_window(F.col("o_orderdate"), _now(), 90)).agg(F.count(F.lit(1)).alias("n"))


@query("quota_used", f"SELECT o_custkey, used, greatest(5 - used, 0) AS \"left\" FROM (SELECT o_custkey, count(*) FILTER (o_orderdate >= {_NOW} - INTERVAL 365 DAYS) AS used FROM orders GROUP BY 1)")
def quota_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.quota_used(_orders(spark, sf_dir), "o_custkey", "o_orderdate", "o_orderdate", _now() - F.expr("INTERVAL 365 DAYS"), 5)


@query("rate_limit_allow")
def rate_limit_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hits an hour for each user: denied ones don't count."""
    hits = load(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return governance.rate_limited(hits, "user_id", "event_id", "s", 3600.0, 2)


@query("largest_remainder", """WITH w AS (SELECT o_orderpriority AS key, count(*) AS weight FROM orders GROUP BY 1), x AS (SELECT key, 1000::DOUBLE * weight / sum(weight) OVER () AS x FROM w),
f AS (SELECT key, x, floor(x) AS f, 1000 - sum(floor(x)) OVER () AS rest, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, key) AS n FROM x) SELECT key, (f + CASE WHEN n <= rest THEN 1 ELSE 0 END)::BIGINT AS share FROM f""")
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = _orders(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("key")).agg(F.count(F.lit(1)).alias("weight"))
    return corpus.largest_remainder(weights, 1000)


@query("round_robin_chunks", "SELECT chunk::INTEGER AS chunk, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) % ceil(count(*) OVER () / 150) AS chunk FROM part) GROUP BY 1")
def round_robin_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.round_robin(load(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 150)
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


@query("lock_allocation", "SELECT allocation, kind, count(*) AS n, max(o_orderkey) AS last FROM (SELECT o_orderkey, kind, CASE WHEN row_number() OVER (PARTITION BY kind ORDER BY o_orderkey) <= CASE WHEN kind = 'neg' THEN 60 ELSE 40 END THEN 'locked' ELSE 'train' END AS allocation FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'neg' ELSE 'pos' END AS kind FROM orders)) GROUP BY ALL")
def lock_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "neg").otherwise("pos").alias("kind"))
    locked = corpus.lock_first(rows, "o_orderkey", "kind", {"neg": 60, "pos": 40})
    return locked.groupBy("allocation", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))


SCHEMES = (
    ("takeover", {"all": [{"tactic": "error"}, {"any": [{"tactic": "signup"}, {"role": "admin"}]}, {"any_tactic": ["purchase"]}]}),
    ("probing", {"all": [{"tactic": "error"}, {"tactic": "click"}]}),
    ("browsing", {"any_tactic": ["view", "click"]}),
)


@query("scheme_rules", """SELECT user_id, day, CASE WHEN list_contains(t, 'error') AND list_contains(t, 'signup') AND list_contains(t, 'purchase') THEN 'takeover' WHEN list_contains(t, 'error') AND list_contains(t, 'click') THEN 'probing' WHEN list_contains(t, 'view') OR list_contains(t, 'click') THEN 'browsing' END AS scheme
FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list(DISTINCT event_type) AS t FROM events GROUP BY ALL)""")
def scheme_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = load(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_set("event_type").alias("t"))
    return days.select("user_id", "day", rules.scheme(list(SCHEMES), F.col("t")).alias("scheme"))


@query("anti_join_pending", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def anti_join_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    return governance.pending(rows, rows.where("o_orderstatus = 'P'"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query("forget_cascade", """WITH gone AS (SELECT event_id FROM events WHERE value < 5), left_ AS (SELECT * FROM events WHERE event_id NOT IN (SELECT event_id FROM gone))
SELECT user_id AS org, count(*) AS members, list_aggregate(list_sort(list(DISTINCT event_type)), 'string_agg', ',') AS numbers FROM left_ GROUP BY user_id""")
def forget_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    orgs = rows.groupBy(F.col("user_id").alias("org")).agg(F.collect_list("event_id").alias("members"), F.collect_set("event_type").alias("numbers"))
    left = governance.forget({"incidents": rows, "organizations": orgs}, rows.where("value < 5"), "event_id", "event_type")
    return left["organizations"].select("org", F.size("members").cast("long").alias("members"), F.array_join("numbers", ",").alias("numbers"))


@query("feedback_overlay", """WITH o AS (SELECT c_custkey AS org, c_acctbal AS priority, c_custkey % 2 = 0 AS is_novel FROM customer), e AS (SELECT o_custkey AS org, o_orderkey AS event_id, o_orderdate AS ts, CASE WHEN o_orderstatus = 'F' THEN 'dismiss' WHEN o_orderstatus = 'O' THEN 'confirm' ELSE 'merge' END AS action FROM orders),
l AS (SELECT org, arg_max(action, (ts, event_id)) AS feedback FROM e WHERE action <> 'merge' GROUP BY org)
SELECT o.org, round(CASE WHEN feedback = 'dismiss' THEN priority * 0.2::DOUBLE ELSE priority END, 6) AS priority, is_novel AND coalesce(feedback <> 'dismiss', true) AS is_novel, feedback FROM o LEFT JOIN l USING (org)""")
def feedback_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    orgs = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("org"), F.col("c_acctbal").alias("priority"), (F.col("c_custkey") % 2 == 0).alias("is_novel"))
    action = F.when(F.col("o_orderstatus") == "F", "dismiss").when(F.col("o_orderstatus") == "O", "confirm").otherwise("merge")
    events = _orders(spark, sf_dir).select(F.col("o_custkey").alias("org"), F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("ts"), action.alias("action"))
    return governance.feedback_overlay(orgs, events).select("org", F.round("priority", 6).alias("priority"), "is_novel", "feedback")


@query("audit_chain_break", """WITH l AS (SELECT event_id AS seq, sha256(event_id || '|' || event_type) AS mac FROM events), c AS (SELECT seq, mac, CASE WHEN seq = 777 THEN 'edited' ELSE lag(mac) OVER (ORDER BY seq) END AS prev FROM l)
SELECT min(seq) AS first_break FROM (SELECT seq, prev, lag(mac) OVER (ORDER BY seq) AS before FROM c) WHERE prev IS DISTINCT FROM before""")
def audit_chain_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of hashes over events with one link edited; each entry meets the one before it by its number."""
    rows = load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256).alias("mac"))
    before = rows.select((F.col("seq") + 1).alias("seq"), F.col("mac").alias("prev"))
    log = rows.join(before, "seq", "left").withColumn("prev", F.when(F.col("seq") == 777, "edited").otherwise(F.col("prev")))
    return governance.chain_breaks(log)


@query("upsert_missing", "SELECT count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM (SELECT p_partkey FROM part WHERE p_size < 25 UNION ALL SELECT p_partkey FROM part WHERE p_size >= 20 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25))")
def upsert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_size")
    return corpus.upsert_missing(rows.where("p_size < 25"), rows.where("p_size >= 20"), "p_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"))


@query("stratified_sample", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY sha256('7:' || event_id)) AS n FROM events) WHERE n <= 20")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty events of each type, by hash: a sampling operator."""
    return corpus.stratified(load(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", 20, 7)


@query("recent_partners", f"SELECT count(DISTINCT user_id) AS users, max(event_id) AS last FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY")
def recent_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").where(F.col("ts") >= F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 1 DAY"))
    return rows.agg(F.countDistinct("user_id").alias("users"), F.max("event_id").alias("last"))
