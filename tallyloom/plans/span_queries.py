"""Queries over spans, turns, labels and speech."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import masking
from tallyloom.operators import rules, spans, speech, vectors
from tallyloom.plans.base import SCORED, TURNS, load, query, scored, turns


@query("phrase_spans", """SELECT conv_id, turn, list_aggregate(list_transform(list_filter(['the', 'de', ' en'], lambda p: instr(text, p) > 0), lambda p: (instr(text, p) - 1)::VARCHAR || '-' || (instr(text, p) - 1 + length(p))::VARCHAR), 'string_agg', ',') AS spans FROM conversations WHERE len(list_filter(['the', 'de', ' en'], lambda p: instr(text, p) > 0)) > 0""")
def phrase_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.first_places(F.col("text"), F.array(F.lit("the"), F.lit("de"), F.lit(" en"), F.lit("  ")))
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text", found.alias("s")).where((F.size("s") > 0) & spans.verbatim(F.col("text"), F.col("s")))
    return rows.select("conv_id", "turn", F.array_join(F.transform("s", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


@query("split_turns", "SELECT conv_id, count(*) AS turns FROM (SELECT conv_id, unnest(regexp_split_to_array(text, '\\n+')) AS l FROM conversations) WHERE trim(l) <> '' GROUP BY conv_id")
def split_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.struct(F.when(F.col("role") == "user", "caller").otherwise("callee").alias("speaker"), F.col("text").alias("text"))
    rows = load(spark, sf_dir, "conversations").select("conv_id", F.size(spans.split_turns(F.array(turn))).alias("n"))
    return rows.groupBy("conv_id").agg(F.sum("n").alias("turns")).where("turns > 0")


@query("tag_migration", "SELECT user_id, list_aggregate(list_sort(list_distinct(list(CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'failure' ELSE 'fault' END ELSE event_type END))), 'string_agg', ',') AS tags FROM events GROUP BY user_id")
def tag_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An old tag becomes the successor among a group's roles, or its first one."""
    groups = load(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))
    role = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("failure"))).otherwise(F.array(F.lit("none")))
    return groups.select("user_id", F.array_join(F.array_sort(spans.migrate_tags(F.col("tags"), {"error": ["fault", "failure"]}, role)), ",").alias("tags"))


@query("first_reason", "SELECT CASE WHEN NOT length(text) >= 200 THEN 'length' WHEN NOT lang IN ('en', 'de') THEN 'language' WHEN NOT NOT regexp_matches(text, '\\|') THEN 'format' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def first_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = spans.first_reason([("length", F.length("text") >= 200), ("language", F.col("lang").isin("en", "de")), ("format", ~F.col("text").contains("|"))])
    return load(spark, sf_dir, "documents").groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("client_keys", "SELECT user_id, trim(l[-least(2, len(l))]) AS client FROM (SELECT DISTINCT user_id, string_split(CASE WHEN user_id % 3 = 0 THEN '10.0.0.' || user_id ELSE '10.0.0.' || user_id || ', 192.168.0.' || user_id || ' ,172.16.0.1' END, ',') AS l FROM events)")
def client_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id").cast("string")
    head = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("10.0.0."), u)).otherwise(F.concat(F.lit("10.0.0."), u, F.lit(", 192.168.0."), u, F.lit(" ,172.16.0.1")))
    return load(spark, sf_dir, "events").select("user_id", spans.client_key(head, 2).alias("client")).dropDuplicates()


@query("tune_thresholds", f"""WITH g AS (SELECT lang AS tactic, t, sum((score >= t AND truth = 1)::INTEGER) AS tp, sum((score >= t AND truth = 0)::INTEGER) AS fp, sum((score < t AND truth = 1)::INTEGER) AS fn FROM ({SCORED}), (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7])::DOUBLE AS t) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tactic ORDER BY round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 12) DESC, t) AS n FROM g) SELECT tactic, CASE WHEN tp + fn >= 8 THEN t ELSE 0.5 END::DOUBLE AS threshold FROM r WHERE n = 1""")
def tune_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.tune_thresholds(scored(spark, sf_dir).select(F.col("lang").alias("tactic"), F.col("score").alias("p"), "truth"))


@query("positive_weight", f"SELECT round(sum(1 - truth) / sum(truth), 6)::DOUBLE AS weight FROM ({SCORED})")
def positive_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.positive_weight(scored(spark, sf_dir)).select(F.round("weight", 6).alias("weight"))


@query("subsample_interval", """WITH d AS (SELECT draw, truth, cluster FROM (SELECT vec_id AS id, label AS truth, vec_id % 7 AS cluster FROM embeddings), range(20) r(draw) WHERE ('0x' || substr(sha256('0:' || draw || ':' || id), 1, 12))::BIGINT::DOUBLE / 281474976710656 < 0.8),
p AS (SELECT draw, sum(top) / sum(n)::DOUBLE AS purity FROM (SELECT draw, cluster, max(n) AS top, sum(n) AS n FROM (SELECT draw, cluster, truth, count(*) AS n FROM d GROUP BY ALL) GROUP BY ALL) GROUP BY draw)
SELECT round(quantile_cont(purity, 0.025), 6)::DOUBLE AS low, round(quantile_cont(purity, 0.975), 6)::DOUBLE AS high FROM p""")
def subsample_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("truth"), (F.col("vec_id") % 7).alias("cluster"))
    return spans.subsample_interval(pairs)


@query("strata", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((), (lang), (source))")
def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts along several axes in one pass (null: not that axis)."""
    return load(spark, sf_dir, "documents").groupingSets([[], [F.col("lang")], [F.col("source")]], F.col("lang"), F.col("source")).agg(F.count(F.lit(1)).alias("n"))


@query("decoded_tags", f"SELECT conv_id, turn, CASE WHEN risk >= 0.4 AND conf >= 0.7 THEN CASE WHEN risk > conf THEN 'otp,remote' WHEN risk = conf THEN 'otp,remote' ELSE 'remote,otp' END WHEN risk >= 0.4 THEN 'otp' WHEN conf >= 0.7 THEN 'remote' ELSE '' END AS tags FROM ({TURNS})")
def decoded_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.create_map(F.lit("otp"), F.col("risk"), F.lit("remote"), F.col("conf"))
    return turns(spark, sf_dir).select("conv_id", "turn", F.array_join(rules.decode_tags(p, {"otp": 0.4, "remote": 0.7}), ",").alias("tags"))


@query("commit_order", "SELECT conv_id, turn, max(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS emitted_at FROM conversations")
def commit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").withColumn("done_at", F.length("text").cast("long"))
    return speech.in_commit_order(rows, "conv_id", "turn").select("conv_id", "turn", "emitted_at")


@query("speech_segments")
def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases in the sound of calls. As there is none, a voice reads the turns out: each character is two frames of samples or more, whose levels and zero crossings are measured."""
    rows = load(spark, sf_dir, "conversations").where("text is not null")
    total = rows.agg(F.sum(2 * F.length("text"))).collect()[0][0] or 0
    return speech.segments_of_sound(rows, "conv_id", "turn", "text", read=speech.read_out, total=total)


@query("lock_decodes")
def lock_decodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select("conv_id", "turn", F.when(F.col("risk") > 0.3, "a").otherwise("b").alias("winner"), F.col("conf").alias("conf_a"), (1.5 - F.col("conf")).alias("conf_b"))
    return speech.lock_decodes(rows, key="conv_id")


@query("scrub_full")
def scrub_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mask, with the spoken ones."""
    rows = masking.scrub_full(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.sha2("masked", 256).alias("masked_hash"), (F.col("masked") != F.col("text")).alias("changed"))


@query("trained_head")
def trained_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balanced logistic head for label 0 over the vectors, trained and applied."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("truth"))
    w, b = spans.trained_head(rows, "embedding", "truth")
    return rows.select("vec_id", F.round(vectors.linear_head(F.col("embedding"), w, b), 4).alias("p"))
