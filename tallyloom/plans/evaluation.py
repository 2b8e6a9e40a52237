"""Queries over conversations turn by turn, and metrics of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import live, metrics, rules
from tallyloom.plans.base import RATES, SCORED, TURNS, counts_sql, load, query, scored, turns

BAND = "CASE WHEN {0} <= 30 THEN 'low' WHEN {0} <= 60 THEN 'medium' WHEN {0} <= 80 THEN 'high' ELSE 'critical' END"
#: The meter as a fold over a list, for any constants.
FOLD = """list_reduce(xs, lambda s, x: {{'t': s.t + 1, 'risk': 0::DOUBLE, 'conf': 0::DOUBLE, 'ids': list_distinct(list_concat(s.ids, x.ids)),
 'score': least(100, greatest(0, greatest(s.score + CASE WHEN 100 * x.risk > s.score THEN {up} * least(1, (s.t + 1) / 3.0::DOUBLE) ELSE {down} END * x.conf * (100 * x.risk - s.score),
   CASE WHEN len(list_distinct(list_concat(s.ids, x.ids))) >= 2 THEN 81 WHEN len(list_distinct(list_concat(s.ids, x.ids))) = 1 THEN 61 ELSE 0 END)))::DOUBLE,
 'latched': CASE WHEN s.latched THEN least(100, greatest(0, greatest(s.score + CASE WHEN 100 * x.risk > s.score THEN {up} * least(1, (s.t + 1) / 3.0::DOUBLE) ELSE {down} END * x.conf * (100 * x.risk - s.score),
   CASE WHEN len(list_distinct(list_concat(s.ids, x.ids))) >= 2 THEN 81 WHEN len(list_distinct(list_concat(s.ids, x.ids))) = 1 THEN 61 ELSE 0 END))) > {exit}
  ELSE (s.t + 1 >= 3 OR len(list_concat(s.ids, x.ids)) > 0) AND least(100, greatest(0, greatest(s.score + CASE WHEN 100 * x.risk > s.score THEN {up} * least(1, (s.t + 1) / 3.0::DOUBLE) ELSE {down} END * x.conf * (100 * x.risk - s.score),
   CASE WHEN len(list_distinct(list_concat(s.ids, x.ids))) >= 2 THEN 81 WHEN len(list_distinct(list_concat(s.ids, x.ids))) = 1 THEN 61 ELSE 0 END))) >= {enter} END}})"""
START = "{'t': 0, 'risk': 0::DOUBLE, 'conf': 0::DOUBLE, 'ids': []::VARCHAR[], 'score': 0::DOUBLE, 'latched': false}"
#: Every prefix of every call, from its first turn on.
STATES = f"""t AS ({TURNS}), p AS (SELECT a.conv_id, a.turn, list_prepend({START}, list({{'t': 0, 'risk': b.risk, 'conf': b.conf, 'ids': b.ids, 'score': 0::DOUBLE, 'latched': false}} ORDER BY b.turn)) AS xs
 FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn <= a.turn GROUP BY a.conv_id, a.turn),
s AS (SELECT conv_id, turn, {FOLD.format(up="0.5::DOUBLE", down="0.12::DOUBLE", enter="59", exit="49")} AS s FROM p)"""


@query("cumulative_windows", """SELECT conv_id, n::INTEGER AS end_turn, sha256(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS window_hash FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations) QUALIFY n % 2 = 0 OR n = m""")
def cumulative_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.prefixes(load(spark, sf_dir, "conversations"), step=2).select("conv_id", "end_turn", F.sha2("window_text", 256).alias("window_hash"))


@query("rolling_window_text", """WITH r AS (SELECT conv_id, turn, text, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, length(text) + 1 AS cost, sum(length(text) + 1) OVER (PARTITION BY conv_id) - 1 AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
h AS (SELECT *, sum(CASE WHEN k <= 2 THEN cost ELSE 0 END) OVER (PARTITION BY conv_id) AS head, sum(CASE WHEN k > 2 THEN cost ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS back FROM r)
SELECT conv_id, turn FROM h WHERE total <= 1500 OR k <= 2 OR k = n OR head + back - 1 <= 1500""")
def rolling_window_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.rolling_window(load(spark, sf_dir, "conversations"), room=1500, head=2).select("conv_id", "turn")


@query("hysteresis", f"SELECT conv_id, turn, coalesce(last_value(CASE WHEN risk >= 0.59 THEN true WHEN risk <= 0.49 THEN false END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), false) AS is_on FROM ({TURNS})")
def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.hysteresis(turns(spark, sf_dir), 0.59, 0.49, score="risk").select("conv_id", "turn", "is_on")


@query("meter_turns", f"WITH {STATES} SELECT conv_id, s.t::INTEGER AS turn, round(s.score, 6) AS score, s.latched AS latched, len(s.ids)::INTEGER AS hard FROM s")
def meter_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live.meter(turns(spark, sf_dir)).select("conv_id", F.explode("trace").alias("s"))
    return rows.select("conv_id", "s.turn", F.round("s.score", 6).alias("score"), "s.latched", F.size("s.ids").alias("hard"))


@query("turns_to_alert", f"WITH {STATES} SELECT conv_id, coalesce(min(CASE WHEN s.latched THEN s.t END), 0)::INTEGER AS turns_to_alert, round(max(s.score), 6) AS top, arg_max({BAND.format('s.score')}, turn) AS final_band FROM s GROUP BY conv_id")
def turns_to_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0: no alert."""
    return live.alerts(live.meter(turns(spark, sf_dir))).fillna(0, ["turns_to_alert"])


@query("stream_report", f"""WITH {STATES}, a AS (SELECT conv_id, conv_id % 3 = 0 AS positive, min(CASE WHEN s.latched THEN s.t END) AS hit FROM s GROUP BY conv_id)
SELECT count(*) FILTER (positive) AS positives, count(*) FILTER (NOT positive) AS negatives, round(count(*) FILTER (NOT positive AND hit IS NOT NULL) / count(*) FILTER (NOT positive), 6)::DOUBLE AS false_latch,
round(count(*) FILTER (positive AND hit IS NOT NULL) / count(*) FILTER (positive), 6)::DOUBLE AS alert_hit, round(quantile_cont(hit, 0.5) FILTER (positive AND hit IS NOT NULL), 6)::DOUBLE AS median_turns, round(quantile_cont(hit, 0.9) FILTER (positive AND hit IS NOT NULL), 6)::DOUBLE AS p90_turns FROM a""")
def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third call stands for a positive one."""
    rows = live.alerts(live.meter(turns(spark, sf_dir))).withColumn("positive", F.col("conv_id") % 3 == 0)
    hit, p = F.col("turns_to_alert"), F.col("positive")
    n, m = F.count(F.when(p, 1)), F.count(F.when(~p, 1))
    return rows.agg(
        n.alias("positives"),
        m.alias("negatives"),
        F.round(metrics.ratio(F.count(F.when(~p & hit.isNotNull(), 1)), m), 6).alias("false_latch"),
        F.round(metrics.ratio(F.count(F.when(p & hit.isNotNull(), 1)), n), 6).alias("alert_hit"),
        F.round(F.percentile(F.when(p, hit), F.lit(0.5)), 6).alias("median_turns"),
        F.round(F.percentile(F.when(p, hit), F.lit(0.9)), 6).alias("p90_turns"),
    )


VARIANTS = (("base", 0.5, 0.12, 59.0, 49.0), ("fast", 0.8, 0.12, 59.0, 49.0), ("strict", 0.5, 0.2, 75.0, 60.0))
_SWEEP = " UNION ALL ".join(f"SELECT '{v}' AS variant, conv_id, min(CASE WHEN f.latched THEN f.t END) AS hit FROM (SELECT conv_id, {FOLD.format(up=f'{u}::DOUBLE', down=f'{d}::DOUBLE', enter=e, exit=x)} AS f FROM p) GROUP BY conv_id" for v, u, d, e, x in VARIANTS)


@query("meter_sweep", f"""WITH {STATES}, v AS ({_SWEEP}) SELECT variant, count(*) AS calls, count(hit) AS latched, list_sort(list(hit) FILTER (hit IS NOT NULL))[round_even(0.9::DOUBLE * (count(hit) - 1), 0)::INTEGER + 1]::INTEGER AS p90_turns FROM v GROUP BY variant""")
def meter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 90th percentile is the nearest rank, half to even."""
    variants = spark.createDataFrame(list(VARIANTS), "variant string, up double, down double, enter double, exit double")
    rows = live.meter_variants(turns(spark, sf_dir), variants)
    hits = rows.groupBy("variant").agg(F.count(F.lit(1)).alias("calls"), F.count("first_latched").alias("latched"), F.array_sort(F.collect_list("first_latched")).alias("h"))
    place = F.bround(0.9 * (F.col("latched") - 1), 0).cast("int") + 1
    return hits.select("variant", "calls", "latched", F.when(F.col("latched") > 0, F.try_element_at("h", F.greatest(place, F.lit(1)))).alias("p90_turns"))


@query("new_evidence", "WITH w AS (SELECT DISTINCT conv_id, turn, word FROM (SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS word FROM conversations) WHERE length(word) > 6) SELECT conv_id, turn, count(*) AS n FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id, word) AS f FROM w) WHERE turn = f GROUP BY ALL")
def new_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split(F.lower("text"), " ")).alias("word")).where(F.length("word") > 6).dropDuplicates()
    return live.new_evidence(words, "conv_id", "turn", "word").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))


@query("top_utterances", f"""SELECT conv_id, turn, start::BIGINT AS start, "end"::BIGINT AS "end" FROM (SELECT conv_id, turn, risk, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, start + length(text) AS "end" FROM ({TURNS}))
WHERE risk >= 0.3 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY risk DESC, turn) <= 3""")
def top_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.top_utterances(turns(spark, sf_dir), 3, 0.3, score="risk").select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("role_runs", """WITH f AS (SELECT *, CASE WHEN lag(long) OVER w IS NOT DISTINCT FROM long THEN 0 ELSE 1 END AS new FROM (SELECT conv_id, turn, length(text) > 200 AS long FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT conv_id, run::BIGINT AS run, long, min(turn) AS first, max(turn) AS last, count(*) AS n FROM r GROUP BY ALL""")
def role_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.runs(load(spark, sf_dir, "conversations").withColumn("long", F.length("text") > 200), "conv_id", "turn", "long")


@query("confidence_bands", f"SELECT band, count(*) AS n FROM (SELECT CASE WHEN conf >= 0.8 THEN 'high' WHEN conf >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM ({TURNS})) GROUP BY band")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).groupBy(live.confidence_band(F.col("conf")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def _report(grouping: str) -> str:
    return f"SELECT *, {RATES} FROM (SELECT {grouping} {counts_sql('truth', 'said')} FROM (SELECT *, (score >= 0.5)::INTEGER AS said FROM ({SCORED}))"


@query("confusion_by_lang", f"{_report('lang,')} GROUP BY ROLLUP (lang))")
def confusion_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binary_report(scored(spark, sf_dir), 0.5, ["lang"])


@query("confusion_breakdown", f"{_report('source, lang,')} GROUP BY ROLLUP (source, lang))")
def confusion_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binary_report(scored(spark, sf_dir), 0.5, ["source", "lang"])


SWEEP = f"SELECT *, {RATES} FROM (SELECT round(k / 100.0::DOUBLE, 6) AS threshold, {counts_sql('truth', 'said')} FROM (SELECT k, truth, (round(score * 100, 9) >= k)::INTEGER AS said FROM ({SCORED}), range(101) r(k)) GROUP BY k)"


@query("threshold_sweep", SWEEP)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sweep(scored(spark, sf_dir))


@query("select_threshold", f"SELECT * FROM ({SWEEP}) ORDER BY fpr <= 0.05 DESC, CASE WHEN fpr <= 0.05 THEN -recall ELSE fpr END, CASE WHEN fpr <= 0.05 THEN fpr ELSE -recall END, threshold DESC LIMIT 1")
def select_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.select_threshold(metrics.sweep(scored(spark, sf_dir)))


@query("rule_threshold", f"SELECT min(threshold) AS threshold FROM ({SWEEP}) WHERE fp <= 25 AND threshold BETWEEN 0.01 AND 0.99")
def rule_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest threshold with 25 false alarms at most."""
    return metrics.sweep(scored(spark, sf_dir)).where("fp <= 25 and threshold between 0.01 and 0.99").agg(F.min("threshold").alias("threshold"))


@query("pr_auc", f"""WITH s AS (SELECT score, sum(truth) AS p, count(*) AS n FROM ({SCORED}) GROUP BY score), c AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM s WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT CASE WHEN sum(p) > 0 AND sum(p) < max(seen) THEN round(sum(p * tp / seen) / sum(p), 6) ELSE 0 END::DOUBLE AS pr_auc FROM c""")
def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(scored(spark, sf_dir))


@query("roc_auc", f"SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6)::DOUBLE AS roc_auc FROM ({SCORED}) a JOIN ({SCORED}) b ON a.truth = 1 AND b.truth = 0")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(scored(spark, sf_dir))


@query("per_label_f1", f"""WITH t AS (SELECT DISTINCT conv_id, unnest(ids) AS label FROM ({TURNS})), s AS (SELECT DISTINCT conv_id, CASE WHEN risk > 0.5 THEN 'otp_request' ELSE 'remote_access' END AS label FROM ({TURNS}) WHERE risk > 0.45),
b AS (SELECT label, t.conv_id IS NOT NULL AS t, s.conv_id IS NOT NULL AS s FROM t FULL JOIN s USING (conv_id, label)) SELECT *, round(2 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1 FROM (SELECT label, count(*) FILTER (t AND s) AS tp, count(*) FILTER (s AND NOT t) AS fp, count(*) FILTER (t AND NOT s) AS fn FROM b GROUP BY label)""")
def per_label_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("risk") > 0.5, "otp_request").when(F.col("risk") > 0.45, "remote_access")
    rows = turns(spark, sf_dir).groupBy(F.col("conv_id").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("truth"), F.collect_set(said).alias("said"))
    return metrics.per_label_f1(rows)


@query("clopper_pearson")
def clopper_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact intervals of the false-alarm rate, per language."""
    rows = metrics.binary_report(scored(spark, sf_dir), 0.5, ["lang"]).withColumn("negatives", F.col("fp") + F.col("tn"))
    return metrics.with_interval(rows, "fp", "negatives").select("lang", "fp", "negatives", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("bootstrap_pr_auc")
def bootstrap_pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bootstrap_average_precision(scored(spark, sf_dir), draws=50)


@query("temperature_fit")
def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("truth", (4 * F.col("score") - 2).alias("logit"))
    return spark.createDataFrame([(round(metrics.temperature(rows), 6),)], "temperature double")


@query("merged_tags", f"SELECT conv_id, tag, round(max(risk), 6) AS risk, min(turn) AS first_seen FROM (SELECT conv_id, turn, risk, unnest(ids) AS tag FROM ({TURNS})) GROUP BY ALL")
def merged_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select("conv_id", "turn", "risk", F.explode("ids").alias("tag"))
    return rules.merged_tags(rows, "conv_id", "tag", "risk", "turn").withColumn("risk", F.round("risk", 6))


@query("paired_recall", f"""SELECT lang, count(*) AS n, round(avg((score >= 0.5)::INTEGER), 6) AS recall_a, round(avg((other >= 0.5)::INTEGER), 6) AS recall_b, count(*) FILTER (score >= 0.5 AND other < 0.5) AS lost, count(*) FILTER (score < 0.5 AND other >= 0.5) AS won
FROM (SELECT *, ((id * 31) % 101) / 100.0::DOUBLE AS other FROM ({SCORED})) WHERE truth = 1 GROUP BY ROLLUP (lang)""")
def paired_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of two scores on the same positives, and how many decisions flip."""
    rows = scored(spark, sf_dir).where("truth = 1").withColumn("other", (F.col("id") * 31) % 101 / 100.0)
    a, b = F.col("score") >= 0.5, F.col("other") >= 0.5
    return rows.rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(a.cast("int")), 6).alias("recall_a"), F.round(F.avg(b.cast("int")), 6).alias("recall_b"), F.count(F.when(a & ~b, 1)).alias("lost"), F.count(F.when(~a & b, 1)).alias("won"))


@query("runtime_gate", f"""SELECT count(*) AS n, round(avg(((score >= 0.5) <> (other >= 0.5))::INTEGER), 6) AS flips, round(list_sort(list(abs(score - other)))[floor(0.95::DOUBLE * (count(*) - 1))::INTEGER + 1], 6) AS p95, round(max(abs(score - other)), 6) AS most
FROM (SELECT *, ((id * 31) % 101) / 100.0::DOUBLE AS other FROM ({SCORED}))""")
def runtime_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runtimes' scores: decisions that flip, the floor-index 95th percentile and the maximum of the gap. The percentile is found by rank, not by gathering rows."""
    from pyspark.sql import Window

    gap = F.abs(F.col("score") - F.col("other"))
    rows = scored(spark, sf_dir).withColumn("other", (F.col("id") * 31) % 101 / 100.0).select(((F.col("score") >= 0.5) != (F.col("other") >= 0.5)).cast("int").alias("flip"), gap.alias("gap"))
    hist = rows.groupBy("gap").agg(F.count(F.lit(1)).alias("n"), F.sum("flip").alias("f"))
    ranked = hist.withColumn("upto", F.sum("n").over(Window.orderBy("gap").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    p95 = F.min(F.when(F.col("upto") > F.floor(0.95 * (F.col("all") - 1)), F.col("gap")))
    return ranked.agg(F.sum("n").alias("n"), F.round(F.sum("f") / F.sum("n"), 6).alias("flips"), F.round(p95, 6).alias("p95"), F.round(F.max("gap"), 6).alias("most"))
