"""Queries over incidents, groups, vectors and activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import linking, metrics, rules, trends, vectors
from tallyloom.plans.base import INCIDENTS, MEMBERS, NOW, incidents, load, members, query

ORG_SQL = f"""
m AS ({MEMBERS}),
orgs AS (SELECT component, count(*) AS size, min(id) AS first_member, max(ts) AS last_ts, count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS) AS recent, count(ts) AS dated FROM m GROUP BY component),
named AS (SELECT *, 'org_' || (row_number() OVER (ORDER BY size DESC, first_member) - 1) AS org_id FROM orgs)
"""
RANKED_SQL = f"""WITH {ORG_SQL},
scored AS (SELECT *, round(0.4::DOUBLE * least(1, ln(1 + size::DOUBLE) / ln(51::DOUBLE)) + 0.35::DOUBLE * greatest(0, least(1, 1 - epoch_us(TIMESTAMP '{NOW}')::DOUBLE / 86400000000 / 30 + epoch_us(last_ts)::DOUBLE / 86400000000 / 30)) + 0.25::DOUBLE * recent / dated, 6) AS priority FROM named)
"""


@query("org_queue", RANKED_SQL + "SELECT org_id, size, first_member, recent, priority FROM scored")
def org_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incidents(spark, sf_dir)
    label = linking.link_by_shared_keys(rows.select("id", F.col("number").alias("key")))
    found = linking.ranked(rows.join(label, "id"), F.lit(NOW).cast("timestamp"))
    return found.select("org_id", "size", "first_member", "recent", "priority")


@query("top_organizations", f"WITH {ORG_SQL} SELECT org_id, size FROM named ORDER BY size DESC, first_member LIMIT 6")
def top_organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.organizations(members(spark, sf_dir)).orderBy(F.desc("size"), "first_member").limit(6).select("org_id", "size")


KEYS = f"SELECT id, 'd' || number || '/' || strftime(ts, '%Y-%m-%d') AS key FROM ({INCIDENTS}) UNION ALL SELECT id, 'c' || code || '/' || strftime(ts, '%Y-%m-%d %H:%M') FROM ({INCIDENTS})"


@query("components_multi", f"""WITH RECURSIVE k AS MATERIALIZED ({KEYS}), g AS MATERIALIZED (SELECT DISTINCT a.key AS a, b.key AS b FROM k a JOIN k b USING (id)),
reach AS (SELECT DISTINCT key AS a, key AS b FROM k UNION SELECT r.a, g.b FROM reach r JOIN g ON r.b = g.a),
low AS (SELECT a AS key, min(id) AS m FROM reach JOIN k ON reach.b = k.key GROUP BY a)
SELECT k.id, min(m) AS component FROM k JOIN low USING (key) GROUP BY k.id""")
def components_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incidents(spark, sf_dir)
    day = rows.select("id", F.concat(F.lit("d"), "number", F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("key"))
    code = rows.select("id", F.concat(F.lit("c"), "code", F.lit("/"), F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("key"))
    return linking.link_by_shared_keys(day.unionByName(code))


OVERLAY = f"SELECT id, 'c' || component AS key FROM ({MEMBERS}) UNION ALL SELECT id, 't' || code FROM ({INCIDENTS}) WHERE code >= 90 AND code IN (SELECT code FROM ({INCIDENTS}) GROUP BY code HAVING count(*) <= 0.5 * (SELECT count(*) FROM events))"


@query("component_overlay", f"""WITH RECURSIVE k AS MATERIALIZED ({OVERLAY}), g AS MATERIALIZED (SELECT DISTINCT a.key AS a, b.key AS b FROM k a JOIN k b USING (id)),
reach AS (SELECT DISTINCT key AS a, key AS b FROM k UNION SELECT r.a, g.b FROM reach r JOIN g ON r.b = g.a),
low AS (SELECT a AS key, min(id) AS m FROM reach JOIN k ON reach.b = k.key GROUP BY a)
SELECT k.id, min(m) AS component FROM k JOIN low USING (key) GROUP BY k.id""")
def component_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of users joined by a second grouping (the code, from 90 on), where that is small enough."""
    rows = members(spark, sf_dir)
    overlay = rows.select("id", F.when(F.col("code") >= 90, F.col("code")).otherwise(-1).alias("cluster"))
    return linking.merge_overlay(rows.select("id", "component"), overlay)


@query("org_numbers", f"SELECT component, list_aggregate(list_sort(list_distinct(list(code))), 'string_agg', ',') AS numbers FROM ({MEMBERS}) GROUP BY component")
def org_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = members(spark, sf_dir).drop("number").withColumnRenamed("code", "number")
    return linking.group_numbers(rows).select("component", F.array_join(F.col("numbers").cast("array<string>"), ",").alias("numbers"))


@query("org_mode_script", f"""SELECT component, tactic AS mode FROM (SELECT component, tactic, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, min(id)) AS n
FROM ({MEMBERS}) GROUP BY component, tactic) WHERE n = 1""")
def org_mode_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.mode_text(members(spark, sf_dir), "tactic")


@query("activity_zero_filled", f"""SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(DATE '2024-01-31' - INTERVAL 44 DAYS, DATE '2024-01-31', INTERVAL 1 DAY)) AS d)
LEFT JOIN (SELECT date_trunc('day', ts) AS e, count(*) AS n FROM events GROUP BY 1) ON e = d""")
def activity_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.activity_series(load(spark, sf_dir, "events"), "2024-01-31", 45).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query("weekly_trend", f"""SELECT *, CASE WHEN last_week > 0 THEN round(100.0::DOUBLE * (this_week - last_week) / last_week, 6) END AS pct FROM
(SELECT count(*) FILTER (ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAYS) AS this_week, count(*) FILTER (ts > TIMESTAMP '{NOW}' - INTERVAL 14 DAYS AND ts <= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS) AS last_week FROM events)""")
def weekly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.weekly_trend(load(spark, sf_dir, "events"), NOW)


@query("org_activity_by_day", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def org_activity_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.activity_by_day(load(spark, sf_dir, "events"), "user_id").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


PROFILE = "SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS place FROM events GROUP BY user_id, event_type"


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.tactic_profile(load(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("tactic_profile", f"SELECT user_id, event_type, n, place::INTEGER AS place FROM ({PROFILE})")
def tactic_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir)


@query("distinguishing_tactic", f"""WITH p AS ({PROFILE}), z AS (SELECT user_id, count(*) AS size FROM events GROUP BY 1), s AS (SELECT p.*, n / size::DOUBLE AS share FROM p JOIN z USING (user_id)),
r AS (SELECT a.*, coalesce((SELECT max(b.share) FROM s b WHERE b.event_type = a.event_type AND b.user_id <> a.user_id), 0) AS rival FROM s a)
SELECT user_id, event_type, round(share - rival, 6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY share - rival DESC, place) AS nth FROM r WHERE share - rival > 0) WHERE nth = 1""")
def distinguishing_tactic(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))
    return trends.distinguishing_tactic(_profile(spark, sf_dir), sizes, "user_id", "event_type")


@query("display_names", f"SELECT user_id, string_agg(event_type, ' + ' ORDER BY place) AS name FROM ({PROFILE}) WHERE place <= 2 GROUP BY user_id")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = load(spark, sf_dir, "events").select("user_id").dropDuplicates().withColumn("family", F.lit(None).cast("string"))
    return rules.display_names(_profile(spark, sf_dir), families, "user_id", "event_type")


@query("kpis", f"""SELECT count(*) AS incidents, count(DISTINCT user_id) AS organizations, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAYS) AS recent,
round(sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c), 6)::DOUBLE AS multi_member_share FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, 1 AS one FROM events) e JOIN (SELECT user_id AS u, count(*) AS c0 FROM events GROUP BY 1) ON u = user_id CROSS JOIN LATERAL (SELECT CASE WHEN c0 > 1 THEN 1.0 ELSE 0.0 END AS d, 1 AS z), LATERAL (SELECT c0 AS c)""".replace("round(sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c), 6)", "round(avg(d), 6)"))
def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events")
    sizes = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("e"),
        F.sum(F.when(F.col("ts") > F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 7 DAYS"), 1).otherwise(0)).alias("r"),
    )
    return sizes.agg(
        F.sum("n").alias("incidents"),
        F.count(F.lit(1)).alias("organizations"),
        F.sum("e").alias("errors"),
        F.sum("r").alias("recent"),
        F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("multi_member_share"),
    )


PAIRS = "SELECT label AS truth, vec_id % 7 AS cluster FROM embeddings"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("label").alias("truth"), (F.col("vec_id") % 7).alias("cluster"))


@query("cluster_purity", f"SELECT round(sum(top) / sum(n), 6)::DOUBLE AS purity FROM (SELECT cluster, max(n) AS top, sum(n) AS n FROM (SELECT cluster, truth, count(*) AS n FROM ({PAIRS}) GROUP BY ALL) GROUP BY cluster)")
def cluster_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.purity(_pairs(spark, sf_dir))


@query("cluster_ari", f"""WITH c AS (SELECT truth, cluster, count(*) AS n FROM ({PAIRS}) GROUP BY ALL), ij AS (SELECT sum(n * (n - 1) / 2)::DOUBLE AS ij, sum(n)::DOUBLE AS n FROM c),
a AS (SELECT sum(s * (s - 1) / 2)::DOUBLE AS a FROM (SELECT sum(n) AS s FROM c GROUP BY truth)), b AS (SELECT sum(s * (s - 1) / 2)::DOUBLE AS b FROM (SELECT sum(n) AS s FROM c GROUP BY cluster))
SELECT round((ij - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6)::DOUBLE AS ari FROM ij, a, b""")
def cluster_ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.adjusted_rand(_pairs(spark, sf_dir))


CENTROIDS = "SELECT label, pos, avg(x) AS m, count(*) AS size FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos"


@query("centroids", f"SELECT label, pos::INTEGER - 1 AS pos, round(m, 6) AS x FROM ({CENTROIDS})")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.centroids(load(spark, sf_dir, "embeddings")).select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("novelty", f"""WITH c AS ({CENTROIDS}), v AS (SELECT label, list(m ORDER BY pos) AS v, any_value(size) AS size FROM c GROUP BY label),
d AS (SELECT s.label, min(1 - list_dot_product(s.v, l.v) / sqrt(list_dot_product(s.v, s.v)) / sqrt(list_dot_product(l.v, l.v))) AS nearest FROM v s, v l WHERE s.label >= 7 AND l.label < 7 GROUP BY s.label)
SELECT v.label AS org, round(nearest, 6) AS nearest, coalesce(nearest >= 0.06, false) AS is_novel FROM v LEFT JOIN d USING (label)""")
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from 7 on stand for small organizations: their size is taken as 5."""
    size = F.when(F.col("label") >= 7, 5).otherwise(100)
    orgs = vectors.centroids(load(spark, sf_dir, "embeddings")).select(F.col("label").alias("org"), size.alias("size"), "centroid", F.lit(True).alias("has_number"))
    return vectors.novelty(orgs).select("org", F.round("nearest", 6).alias("nearest"), "is_novel")


@query("knn_top5", """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT query_id, id, rank::INTEGER AS rank, round(score, 6) AS score FROM (SELECT query_id, id, list_dot_product(q, v) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(v, v)) AS score,
row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(q, v) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(v, v)) DESC, id) AS rank FROM q, e WHERE id <> query_id) WHERE rank <= 5""")
def knn_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    found = vectors.nearest(rows, rows.where("vec_id % 100 = 0"))
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("near_dup_cosine", """SELECT a.vec_id, round(max(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v))), 6) AS best
FROM (SELECT *, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT *, embedding::DOUBLE[] AS v FROM embeddings) b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id""")
def near_dup_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_in_group(load(spark, sf_dir, "embeddings")).withColumn("best", F.round("best", 6))


_HEAD = "[" + ", ".join(f"{(k % 7 - 3) / 10}" for k in range(64)) + "]::DOUBLE[]"


@query("linear_head", f"SELECT vec_id, round(1 / (1 + exp(-(list_dot_product(embedding::DOUBLE[], {_HEAD}) + 0.1::DOUBLE))), 6) AS p FROM embeddings")
def linear_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vectors.linear_head(F.col("embedding"), [(k % 7 - 3) / 10 for k in range(64)], 0.1)
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(p, 6).alias("p"))


@query("fused_head", f"SELECT vec_id, round((1 / (1 + exp(-1.5::DOUBLE * d + 0.2::DOUBLE)) + 1 / (1 + exp(-0.5::DOUBLE * (d + 0.3::DOUBLE)))) / 2, 6) AS p FROM (SELECT vec_id, list_dot_product(embedding::DOUBLE[], {_HEAD}) AS d FROM embeddings)")
def fused_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = [(k % 7 - 3) / 10 for k in range(64)]
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.fused_head(F.col("embedding"), [(w, 0.0, -1.5, 0.2), (w, 0.3, -0.5, 0.0)]), 6).alias("p"))


RANGES = "SELECT user_id, (epoch_us(ts) // 1000000)::BIGINT AS start, (epoch_us(ts) // 1000000)::BIGINT + floor(value * 100)::BIGINT AS \"end\" FROM events"


@query("merge_islands", f"""WITH r AS ({RANGES}), f AS (SELECT *, CASE WHEN start <= max("end") OVER w THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT user_id, min(start) AS start, max("end") AS "end", count(*) AS n FROM i GROUP BY user_id, island""")
def merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    rows = load(spark, sf_dir, "events").select("user_id", at.alias("start"), (at + F.floor(F.col("value") * 100).cast("long")).alias("end"))
    return trends.merge_islands(rows, "user_id")
