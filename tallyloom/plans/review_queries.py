"""Queries of the scorer, live sessions, roles, intake and corpus building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import build, intake, linking, live, metrics, roles, scoring
from tallyloom.plans.base import ORDERS_NOW, RATES, SCORED, TURNS, counts_sql, load, query, scored
from tallyloom.plans.evaluation import BAND, STATES
from tallyloom.plans.text_queries import HEX, NORM

#: Phrases that the conversations have, some seldom and some often.
TACTICS = [("urgent", False, ["ther the", "eanie", "der die"]), ("secret", True, ["ouwh", "einpf", "eauvi"]), ("payment", False, ["tion the", "ungen", "mentque"]), ("remote", True, ["blere nt", "keitpf", "oclla"])]


def _hit(name: str, hard: bool, phrases: list[str], text: str) -> str:
    cases = " ".join(f"WHEN instr(lower({text}), '{p}') > 0 THEN {{'tactic': '{name}', 'hard': {str(hard).lower()}, 'start': (instr(lower({text}), '{p}') - 1)::INTEGER, 'text': substr({text}, instr(lower({text}), '{p}'), {len(p)})}}" for p in phrases)
    return f"CASE {cases} END"


def hits_sql(text: str) -> str:
    return f"list_filter([{', '.join(_hit(*t, text) for t in TACTICS)}], lambda x: x IS NOT NULL)"


RISK = "CASE WHEN len(list_filter({0}, lambda x: x.hard)) > 0 THEN 0.9::DOUBLE WHEN len({0}) >= 2 THEN 0.6::DOUBLE WHEN len({0}) = 1 THEN 0.35::DOUBLE ELSE 0.05::DOUBLE END"
IDS = "list_transform(list_filter({0}, lambda x: x.hard), lambda x: x.tactic)"


@query("keyword_risk", f"SELECT conv_id, turn, {RISK.format('h')} AS risk, list_aggregate(list_transform(h, lambda x: x.tactic || '@' || x.start || '=' || x.text), 'string_agg', ',') AS said FROM (SELECT conv_id, turn, {hits_sql('text')} AS h FROM conversations) WHERE len(h) > 0")
def keyword_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").withColumn("h", scoring.hits(F.col("text"), TACTICS)).where(F.size("h") > 0)
    said = F.array_join(F.transform("h", lambda x: F.concat(x["tactic"], F.lit("@"), x["start"].cast("string"), F.lit("="), x["text"])), ",")
    return rows.select("conv_id", "turn", scoring.risk_of(F.col("h")).alias("risk"), said.alias("said"))


#: Each call up to each turn, as the scorer sees it.
WINDOWS = """SELECT conv_id, e AS turn, string_agg(text, chr(10) ORDER BY turn) AS text FROM (
 SELECT *, sum(cost) OVER (PARTITION BY conv_id, e) - 1 AS total, sum(CASE WHEN k <= 4 THEN cost ELSE 0 END) OVER (PARTITION BY conv_id, e) AS head,
  sum(CASE WHEN k > 4 THEN cost ELSE 0 END) OVER (PARTITION BY conv_id, e ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS back FROM (
  SELECT a.conv_id, a.turn AS e, b.turn, b.text, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn) AS k, count(*) OVER (PARTITION BY a.conv_id, a.turn) AS n, length(b.text) + 1 AS cost
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn <= a.turn)) WHERE total <= 6000 OR k <= 4 OR k = n OR head + back - 1 <= 6000 GROUP BY 1, 2"""
SCORED_TURNS = f"SELECT conv_id, turn, {RISK.format('h')} AS risk, 0.5::DOUBLE + turn % 4 / 10.0::DOUBLE AS conf, {IDS.format('h')} AS ids, h FROM (SELECT conv_id, turn, {hits_sql('text')} AS h FROM ({WINDOWS}))"
SESSIONS = STATES.replace(TURNS, SCORED_TURNS)


def _session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").withColumn("conf", 0.5 + F.col("turn") % 4 / 10.0)
    return live.session(rows, TACTICS)


@query("live_session", f"WITH {SESSIONS} SELECT s.conv_id, s.turn, t.risk AS risk, round(s.s.score, 6) AS score, s.s.latched AS latched, {BAND.format('s.s.score')} AS band, len(t.h)::INTEGER AS hits FROM s JOIN t USING (conv_id, turn)")
def live_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorer, meter and band of each turn, over the rolling window."""
    return _session(spark, sf_dir).select("conv_id", "turn", "risk", F.round("score", 6).alias("score"), "latched", "band", F.size("hits").alias("hits"))


@query("live_evidence", f"WITH t AS ({SCORED_TURNS}), e AS (SELECT DISTINCT conv_id, turn, x.text AS phrase FROM (SELECT conv_id, turn, unnest(h) AS x FROM t)) SELECT conv_id, min(turn) AS turn, phrase FROM e GROUP BY conv_id, phrase")
def live_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each phrase of a call where it first counts as evidence."""
    return _session(spark, sf_dir).select("conv_id", "turn", F.explode("new_evidence").alias("phrase"))


@query("session_alerts", f"WITH {SESSIONS} SELECT conv_id, coalesce(min(CASE WHEN s.latched THEN s.t END), 0)::INTEGER AS first_latched, count(*) FILTER ({BAND.format('s.score')} <> 'low') AS advised FROM s GROUP BY conv_id")
def session_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first latched turn (from 1; 0: none) and turns with advice of each call."""
    turn = F.row_number().over(live.Window.partitionBy("conv_id").orderBy("turn"))
    rows = _session(spark, sf_dir).withColumn("n", turn)
    return rows.groupBy("conv_id").agg(F.coalesce(F.min(F.when(F.col("latched"), F.col("n"))), F.lit(0)).alias("first_latched"), F.sum(F.col("advice").cast("int")).alias("advised"))


_ONE = "SELECT item_id, 'lang' || item_id % 3 AS lang, {risk} AS risk, len({ids}) AS hard FROM (SELECT item_id, {hits} AS h FROM benchmark)".format(risk=RISK.format("h"), ids=IDS.format("h"), hits=hits_sql("text"))


@query("quote_groups", f"""WITH q AS ({_ONE}), m AS (SELECT *, CASE WHEN hard >= 2 THEN greatest(81, 0.5::DOUBLE / 3 * 100 * risk) WHEN hard = 1 THEN greatest(61, 0.5::DOUBLE / 3 * 100 * risk) ELSE 0.5::DOUBLE / 3 * 100 * risk END AS score FROM q)
SELECT coalesce(lang, 'all') AS grp, count(*) AS n, count(*) FILTER (risk >= 0.59) AS alerts, count(*) FILTER (hard > 0) AS cued, count(*) FILTER (hard > 0 AND score >= 59) AS latched, round(median(risk), 6) AS median_risk FROM m GROUP BY GROUPING SETS ((), (lang))""")
def quote_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as sessions of one turn: how many alert, fire and latch, in all and by language."""
    quotes = load(spark, sf_dir, "benchmark").withColumn("lang", F.concat(F.lit("lang"), F.col("item_id") % 3)).withColumn("turn", F.lit(0)).withColumn("conf", F.lit(1.0))
    told = live.session(quotes, TACTICS, call="item_id").join(quotes.select("item_id", "lang"), "item_id")
    hard = F.exists("hits", lambda h: h["hard"])
    flags = told.select("lang", "risk", "latched", hard.alias("hard"))
    grouped = flags.rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("risk") >= 0.59).cast("int")).alias("alerts"), F.sum(F.col("hard").cast("int")).alias("cued"), F.sum(F.col("latched").cast("int")).alias("latched"), F.round(F.median("risk"), 6).alias("median_risk"))
    return grouped.select(F.coalesce("lang", F.lit("all")).alias("grp"), "n", "alerts", "cued", "latched", "median_risk")


@query("tag_evidence", f"""SELECT conv_id, turn, list_aggregate(list_transform(list_filter(list_concat([{{'id': 'urgent', 'w': CASE WHEN list_contains(list_transform(h, lambda x: x.tactic), 'urgent') THEN 1.0 ELSE 0.4 END}}], list_transform(list_filter(h, lambda x: x.tactic <> 'urgent'), lambda x: {{'id': x.tactic, 'w': 1.0}})), lambda t: true), lambda t: t.id || ':' || t.w), 'string_agg', ',') AS tags FROM (SELECT conv_id, turn, {hits_sql('text')} AS h FROM conversations)""")
def tag_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that a model gave, with what the phrases prove."""
    rows = load(spark, sf_dir, "conversations").withColumn("h", scoring.hits(F.col("text"), TACTICS))
    given = F.array(F.struct(F.lit("urgent").alias("id"), F.lit(0.4).alias("weight")))
    tags, _ = scoring.with_evidence(given, F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("text"))), lambda s: F.lit(False)), F.col("h"))
    return rows.select("conv_id", "turn", F.array_join(F.transform(tags, lambda t: F.concat(t["id"], F.lit(":"), t["weight"].cast("string"))), ",").alias("tags"))


@query("clean_labels", "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN least(greatest(0, least(1, value / 50)), 0.02::DOUBLE) ELSE greatest(0, least(1, value / 50)) END AS risk, CASE WHEN user_id % 7 <> 0 AND event_type IN ('click', 'error') THEN greatest(0, least(1, value / 30)) END AS weight FROM events")
def clean_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events")
    given = F.array(F.struct(F.col("event_type").alias("id"), (F.col("value") / 30).alias("weight")))
    risk, tags = scoring.clean_label(F.col("value") / 50, given, ["click", "error"], F.col("user_id") % 7 == 0)
    return rows.select("event_id", risk.alias("risk"), F.get(tags, F.lit(0))["weight"].alias("weight"))


@query("multi_hot", "SELECT user_id, list_contains(t, 'click')::INTEGER::DOUBLE AS click, list_contains(t, 'error')::INTEGER::DOUBLE AS error FROM (SELECT user_id, list(event_type) AS t FROM events GROUP BY 1)")
def multi_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    hot = rows.select("user_id", scoring.multi_hot(F.col("t"), ["click", "error"]).alias("v"))
    return hot.select("user_id", F.col("v")[0].alias("click"), F.col("v")[1].alias("error"))


@query("label_space", "SELECT event_type, min(event_id) AS first FROM events WHERE trim(event_type) <> '' GROUP BY 1")
def label_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.label_space(load(spark, sf_dir, "events"), "event_type", "event_id")


_NAMES = {"urgent": "Urgency", "secret": "A secret", "payment": "Payment", "remote": "Remote control"}
_WORDS = {"none": "Nothing.", "template": "Signs: {tags}. Said: {spans}.", "no_phrases": "-", "caveat": "May be wrong.", "suffix": " Not calibrated: {backend}."}
_NAME_SQL = "CASE x.tactic " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items()) + " END"


@query("explained", f"""SELECT conv_id, turn, CASE WHEN len(h) = 0 THEN 'Nothing.' ELSE 'Signs: ' || list_aggregate(list_transform(h, lambda x: {_NAME_SQL}), 'string_agg', ', ') || '. Said: ' || list_aggregate(list_transform(list_sort(list_transform(h, lambda x: {{'s': x.start, 't': x.text}})), lambda x: '«' || x.t || '»'), 'string_agg', ', ') || '.' END AS reason, 'unknown' AS confidence_label, 'May be wrong. Not calibrated: words.' AS caveat FROM (SELECT conv_id, turn, {hits_sql('text')} AS h FROM conversations WHERE trim(text) <> '')""")
def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.scored(load(spark, sf_dir, "conversations"), TACTICS).withColumn("confidence", F.lit(None).cast("double")).withColumn("backend", F.lit("words"))
    return scoring.explained(rows, _NAMES, _WORDS, ["model"]).select("conv_id", "turn", "reason", "confidence_label", "caveat")


ROLES = [roles.Role("clerk", cues=["nicht eine"], organisations=["der die", "tion the"]), roles.Role("officer", organisations=["que la", "of the"])]
INTRO = roles.Introduction(markers=["und", "and", "et"], window=2)


def _intro_sql(company: str) -> str:
    b, gap, word, marker = r"(?:^|[^\p{L}\p{N}])", r"[^\p{L}\p{N}.!?\n]+", r"[\p{L}\p{N}]+", "(?:and|und|et)"
    return rf"(?i){b}(?:{marker}(?:{gap}{word}){{0,2}}?{gap}{company}|{company}(?:{gap}{word}){{0,2}}?{gap}{marker})(?:$|[^\p{{L}}\p{{N}}])"


@query("introductions", rf"SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '{_intro_sql(r'(?:que[^\p{L}\p{N}.!?\n]+la|of[^\p{L}\p{N}.!?\n]+the)')}')")
def introductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in which somebody introduces themself as an officer."""
    rows = load(spark, sf_dir, "conversations")
    return rows.where(F.size(roles.claims(F.col("text"), ROLES[1:], INTRO)) > 0).select("conv_id", "turn")


@query("role_claims")
def role_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims of all turns, with their places; tests hold it against a plain search."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(roles.claims(F.col("text"), ROLES, INTRO)).alias("nth", "c"))
    return rows.select("conv_id", "turn", "nth", "c.role", "c.start", "c.end", "c.text")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events")
    return rows.where("event_id % 3 <> 0").select(F.concat(F.lit("r"), "event_id").alias("receipt_id"), F.concat("event_type", F.lit("-"), F.col("user_id") % 50, F.lit("-"), F.floor("value")).alias("content_id"), F.when(F.col("user_id") % 2 == 0, F.lit("web")).otherwise(F.lit("app")).alias("source"), F.when(F.col("user_id") % 4 == 0, F.lit("p1")).alias("partner_id"), (F.col("user_id") % 50).cast("string").alias("number"), F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("ts"), F.col("ts").alias("received"), F.col("event_id").alias("order"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").where("event_id % 3 = 0")
    content = F.concat(F.lit("live-"), "event_type", F.lit("-"), F.col("user_id") % 50, F.lit("-"), F.floor("value"))
    return rows.groupBy(content.alias("id")).agg(F.min((F.col("user_id") % 50).cast("string")).alias("number"), F.min("ts").alias("ts"))


REPORTS = "SELECT 'r' || event_id AS receipt_id, event_type || '-' || user_id % 50 || '-' || floor(value)::BIGINT AS content_id, CASE WHEN user_id % 2 = 0 THEN 'web' ELSE 'app' END AS source, CASE WHEN user_id % 4 = 0 THEN 'p1' END AS partner_id, (user_id % 50)::VARCHAR AS number, CASE WHEN event_id % 11 <> 0 THEN ts END AS ts, ts AS received, event_id AS \"order\" FROM events WHERE event_id % 3 <> 0"
KNOWN = "SELECT 'live-' || event_type || '-' || user_id % 50 || '-' || floor(value)::BIGINT AS id, min((user_id % 50)::VARCHAR) AS number, min(ts) AS ts FROM events WHERE event_id % 3 = 0 GROUP BY 1"
EVERY = f"SELECT id, number FROM ({KNOWN}) UNION ALL SELECT DISTINCT 'live-' || content_id, number FROM ({REPORTS}) WHERE ts IS NOT NULL AND 'live-' || content_id NOT IN (SELECT id FROM ({KNOWN}))"


@query("ingest_batch", f"SELECT id, min(id) OVER (PARTITION BY number) AS component FROM ({EVERY})")
def ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending reports become incidents, and every incident has its organization."""
    return intake.ingest(_reports(spark, sf_dir), _known(spark, sf_dir))[1]


@query("forget_full", f"""WITH r AS ({REPORTS}), n AS (SELECT DISTINCT source, partner_id, content_id FROM r WHERE "order" % 10 = 1), g AS (SELECT DISTINCT 'live-' || r.content_id AS id FROM r JOIN n ON r.source = n.source AND r.partner_id IS NOT DISTINCT FROM n.partner_id AND r.content_id = n.content_id),
i AS (SELECT id, number FROM ({EVERY}) WHERE id NOT IN (SELECT id FROM g)) SELECT id, min(id) OVER (PARTITION BY number) AS component FROM i""")
def forget_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all incidents and their organizations after some receipts were called back."""
    reports = _reports(spark, sf_dir)
    every, _ = intake.ingest(reports, _known(spark, sf_dir))
    return intake.forget_reports(reports, every, reports.where("order % 10 = 1").select("receipt_id"))["label"]


_CUT = "TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAYS"


@query("purge_run", f"""WITH r AS ({REPORTS}), e AS ({EVERY}), n AS (SELECT DISTINCT source, partner_id, content_id FROM r WHERE received < {_CUT}),
gone AS (SELECT r.receipt_id, 'live-' || r.content_id AS id FROM r JOIN n ON r.source = n.source AND r.partner_id IS NOT DISTINCT FROM n.partner_id AND r.content_id = n.content_id),
kept AS (SELECT DISTINCT 'live-' || content_id AS id FROM r WHERE receipt_id NOT IN (SELECT receipt_id FROM gone))
SELECT id, number FROM e WHERE id NOT IN (SELECT id FROM gone) AND id IN (SELECT id FROM kept)""")
def purge_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents that a purge leaves: of no expired report, and of a report that is still there."""
    reports = _reports(spark, sf_dir)
    every, _ = intake.ingest(reports, _known(spark, sf_dir))
    return intake.purge(reports, every, F.lit("2024-01-31 00:00:00").cast("timestamp"), 20)["incidents"].select("id", "number")


@query("feedback_merge")
def feedback_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with merges, event by event; tests hold it against a plain fold."""
    orgs = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("org"), F.col("c_acctbal").alias("priority"), (F.col("c_custkey") % 2 == 0).alias("is_novel"), F.array(F.concat(F.lit("m"), "c_custkey")).alias("members"), F.array(F.concat(F.lit("n"), F.col("c_custkey") % 9)).alias("numbers"))
    action = F.when(F.col("o_orderkey") % 9 == 0, "merge").when(F.col("o_orderstatus") == "F", "dismiss").otherwise("confirm")
    events = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("ts"), action.alias("action"), F.col("o_custkey").alias("org"), F.when(action == "merge", F.pmod(F.col("o_orderkey") * 7, F.lit(20)) + (F.col("o_custkey") / 20).cast("long") * 20).alias("target"))
    done = intake.verdicts_applied(orgs, events)
    return done.select("org", F.round("priority", 6).alias("priority"), "is_novel", F.array_join("members", ",").alias("members"), F.array_join("numbers", ",").alias("numbers"), "feedback")


_GEN = HEX.format("'gen:0:' || doc_id")


@query("generated_split", f"SELECT doc_id, CASE WHEN {_GEN} < 150000 THEN 'val' ELSE 'train' END AS split FROM documents")
def generated_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", build.generated_split(F.col("doc_id")).alias("split"))


@query("corpus_build")
def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each origin each split of a built corpus has; tests hold it against plain sets."""
    rows = load(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    quotes = load(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), "text", F.lit("en").alias("lang"))
    return build.built(rows, quotes).groupBy("split", "origin").agg(F.count(F.lit(1)).alias("n"))


@query("provenance", f"SELECT split, source AS generator, count(*) AS n, sum(toxic)::BIGINT AS positives, round(sum(toxic) / count(*), 4)::DOUBLE AS share FROM (SELECT source, toxic, CASE WHEN u < 700000 THEN 'train' WHEN u < 850000 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, {HEX.format(chr(39) + '0:' + chr(39) + ' || doc_id')} AS u FROM documents JOIN labels USING (doc_id))) GROUP BY ALL")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id").withColumn("split", tx.assign_split(F.col("doc_id"))).withColumn("generator", F.col("source"))
    return build.provenance(rows, "generator", F.col("toxic") == 1)


_TRY = "SELECT event_type, user_id, CASE WHEN value < 10 THEN 'length' WHEN value < 20 THEN 'language' END AS reason, event_id FROM events"


@query("attempt_stats", f"SELECT event_type, count(*) AS attempts, count(*) FILTER (reason IS NULL) AS accepted, count(DISTINCT CASE WHEN reason IS NULL THEN user_id END) AS slots, round(1 - count(*) FILTER (reason IS NULL) / count(*)::DOUBLE, 3) AS rejected FROM ({_TRY}) GROUP BY 1")
def attempt_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.attempts(_tried(spark, sf_dir), ["event_type"], "user_id", "reason")


def _tried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("reason", F.when(F.col("value") < 10, "length").when(F.col("value") < 20, "language"))


@query("chunk_verdicts", f"SELECT user_id, count(*) AS n, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NULL) / count(*)::DOUBLE >= 0.8 AS passes FROM ({_TRY}) GROUP BY 1")
def chunk_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.verdicts(_tried(spark, sf_dir), "user_id", "event_id", "reason")


@query("accepted_rows", f"SELECT event_id FROM ({_TRY}) WHERE reason IS NULL AND event_id % 5 <> 0")
def accepted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tried(spark, sf_dir)
    return build.accepted(rows, rows.where("reason is null"), rows.where("event_id % 5 = 0"), "event_id").select("event_id")


@query("run_states", f"SELECT user_id, CASE WHEN n IS NULL THEN 'missing' WHEN n < 8 THEN 'incomplete' WHEN user_id % 6 = 0 THEN 'written' WHEN share >= 0.8 THEN 'qc_pass' ELSE 'qc_fail' END AS state FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (reason IS NULL) / count(*)::DOUBLE AS share FROM ({_TRY}) WHERE user_id % 5 <> 0 GROUP BY 1) USING (user_id)")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tried(spark, sf_dir)
    done = build.verdicts(rows.where("user_id % 5 <> 0"), "user_id", "event_id", "reason").withColumn("passes", F.when(F.col("user_id") % 6 != 0, F.col("passes")))
    return build.run_states(rows.select("user_id").distinct().withColumn("wanted", F.lit(8)), done, "user_id")


@query("turn_spans", """SELECT conv_id, turn, phrase, (before + instr(text, phrase) - 1)::BIGINT AS start, (before + instr(text, phrase) - 1 + length(phrase))::BIGINT AS "end" FROM (SELECT conv_id, turn, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations), (SELECT unnest(['the', 'die', 'que']) AS phrase) WHERE instr(text, phrase) > 0""")
def turn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").withColumn("p", F.array(F.lit("the"), F.lit("die"), F.lit("que")))
    return build.turn_spans(rows, "p")


@query("prompt_echo", "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS ws FROM documents), g AS (SELECT DISTINCT doc_id, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)) SELECT DISTINCT a.doc_id FROM g a JOIN g b ON b.doc_id = a.doc_id + 1 AND a.g = b.g")
def prompt_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share eight words in a row with the next one."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("prompt"))
    return rows.join(after, "doc_id").where(build.echoes(F.col("text"), F.col("prompt"))).select("doc_id")


@query("lexicon_hash", "SELECT sha256(string_agg(x, chr(10) ORDER BY x)) AS hash FROM (SELECT DISTINCT n_name || chr(31) || n_regionkey AS x FROM nation)")
def lexicon_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.lexicon_hash(load(spark, sf_dir, "nation"), ["n_name", "n_regionkey"])


@query("false_positives", "SELECT id, score, source, lang FROM ({}) WHERE truth = 0 AND score >= 0.9".format("SELECT doc_id AS id, lang, source, toxic AS truth, ((n_chars * 7 + doc_id * 13) % 101) / 100.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id)"))
def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.false_positives(scored(spark, sf_dir), 0.9).select("id", "score", "source", "lang")


@query("word_errors")
def word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word errors of each turn against the one before it of the same call; tests hold it against a plain count."""
    rows = load(spark, sf_dir, "conversations")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said"))
    return build.word_errors(rows.join(after, ["conv_id", "turn"]), "text", "said", ["role"])


@query("subset_metrics", f"""WITH r AS (SELECT s.*, unnest(['all', CASE WHEN quality = 0 THEN 'inspected' ELSE 'clean' END]) AS subset FROM ({SCORED}) s JOIN labels ON doc_id = id),
c AS (SELECT subset, {counts_sql("truth", "(score >= 0.5)::INTEGER")} FROM r GROUP BY 1) SELECT *, {RATES} FROM c""")
def subset_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all rows, of those that somebody has inspected (of low quality) and of the others."""
    ledger = load(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    rows = metrics.by_ledger(scored(spark, sf_dir), ledger)
    return metrics.with_rates(rows.groupBy("subset").agg(*metrics.confusion(F.col("truth"), (F.col("score") >= 0.5).cast("int"))))


def _side(name: str, kind: int, column: str) -> str:
    return f"round(CASE WHEN count(*) FILTER (truth = {kind}) > 0 THEN count(*) FILTER (truth = {kind} AND {column} >= 0.5) / count(*) FILTER (truth = {kind}) ELSE 0 END, 6)::DOUBLE AS {name}_{column}"


@query("paired_split", f"""WITH h AS (SELECT turn, (role = 'user')::INTEGER AS truth, {hits_sql("text")} AS b, {hits_sql("replace(text, 'ei', 'i')")} AS a FROM conversations),
r AS (SELECT turn, truth, {RISK.format("b")} AS before, {RISK.format("a")} AS after FROM h)
SELECT turn, {", ".join(_side(n, k, c) for n, k in (("recall", 1), ("fpr", 0)) for c in ("before", "after"))}, count(*) FILTER (after >= 0.5 AND before < 0.5) AS raised, count(*) FILTER (before >= 0.5 AND after < 0.5) AS lowered FROM r GROUP BY turn""")
def paired_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer on turns as they are and as a recogniser may mishear them; the user's turns stand for positives."""
    risks = [scoring.risk_of(scoring.hits(text, TACTICS)).alias(name) for text, name in ((F.col("text"), "before"), (F.regexp_replace("text", "ei", "i"), "after"))]
    rows = load(spark, sf_dir, "conversations").select("turn", (F.col("role") == "user").cast("int").alias("truth"), *risks)
    return metrics.paired_split(rows, 0.5, groups=["turn"])


@query("cue_free", f"SELECT turn, count(*) AS positives, count(*) FILTER (len({hits_sql('text')}) = 0) AS cue_free, round(count(*) FILTER (len({hits_sql('text')}) = 0) / count(*), 6)::DOUBLE AS share FROM conversations WHERE role = 'user' GROUP BY turn")
def cue_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.cue_free(load(spark, sf_dir, "conversations"), ["turn"], F.col("role") == "user", scoring.hits(F.col("text"), TACTICS))


@query("grid_gaps", """WITH p AS (SELECT DISTINCT source, lang FROM documents WHERE lang <> 'de'), h AS (SELECT source, lang, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1, 2)
SELECT coalesce(p.source, h.source) AS source, coalesce(p.lang, h.lang) AS lang, coalesce(n, 0) AS n, CASE WHEN p.source IS NULL THEN 'unplanned' WHEN n IS NULL THEN 'missing' ELSE 'filled' END AS state FROM p FULL JOIN h ON p.source = h.source AND p.lang = h.lang""")
def grid_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic rows against a plan of a cell for each source and each language but one."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    rows = docs.join(load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id")
    return build.grid_gaps(rows, docs.where("lang <> 'de'"), ["source", "lang"])


@query("review_list", "SELECT doc_id, array_to_string(r, ',') AS reasons FROM (SELECT doc_id, list_sort(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN instr(text, '|') > 0 THEN 'bars' END, CASE WHEN instr(text, '@') > 0 THEN 'address' END], lambda x: x IS NOT NULL)) AS r FROM documents) WHERE len(r) > 0")
def review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [("short", F.col("n_chars") < 200), ("bars", F.col("text").contains("|")), ("address", F.col("text").contains("@"))]
    found = build.review_list(load(spark, sf_dir, "documents"), checks)
    return found.select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("table_lines", "SELECT '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation")
def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.table_lines(load(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"])
