"""Queries over texts: corpora, splits, masks, phrases, pages and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import corpus, pairs, rouge, rules
from tallyloom.plans.base import load, query
from tallyloom.sources import records
from tallyloom.sources.shared import written

NORM = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"
HEX = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256({0}), ''), lambda c: (instr('0123456789abcdef', c) - 1)::BIGINT)), lambda a, d: (a * 16 + d) % 1000000)"


@query("dedup_keep_first", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256({NORM})")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.keep_first(load(spark, sf_dir, "documents"), "doc_id").select("doc_id")


_SPLIT = f"CASE WHEN u < 700000 THEN 'train' WHEN u < 850000 THEN 'val' ELSE 'test' END"
_U = HEX.format("'0:' || doc_id")


@query("hash_split", f"SELECT doc_id, {_SPLIT} AS split FROM (SELECT doc_id, {_U} AS u FROM documents)")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", tx.assign_split(F.col("doc_id")).alias("split"))


@query("split_counts", f"""SELECT split, lang, count(*) AS total, sum(p)::BIGINT AS positives, sum(h)::BIGINT AS hard FROM (SELECT lang, {_SPLIT} AS split, (toxic = 1)::INTEGER AS p, (toxic = 0 AND quality = 0)::INTEGER AS h FROM (SELECT *, {_U} AS u FROM documents JOIN labels USING (doc_id))) GROUP BY GROUPING SETS ((split), (split, lang))""")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels"), "doc_id").withColumn("split", tx.assign_split(F.col("doc_id")))
    return corpus.split_counts(rows, "split", "lang", F.col("toxic") == 1, (F.col("toxic") == 0) & (F.col("quality") == 0))


@query("content_hash", """WITH h AS (SELECT sha256(concat_ws(chr(31), doc_id::VARCHAR, lang, text)) AS h FROM documents), s AS (SELECT k, sum(('0x' || substr(h, 1 + 4 * k, 4))::BIGINT)::BIGINT AS w, count(*) AS n FROM h, range(16) r(k) GROUP BY k)
SELECT sha256(any_value(n)::VARCHAR || ',' || string_agg(w::VARCHAR, ',' ORDER BY k)) AS content_hash, any_value(n) AS n FROM s""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.content_hash(load(spark, sf_dir, "documents"), "doc_id", ["lang", "text"])


@query("contamination_exact", f"SELECT DISTINCT doc_id FROM documents WHERE sha256({NORM}) IN (SELECT sha256({NORM}) FROM benchmark UNION ALL SELECT sha256({NORM}) FROM documents WHERE doc_id % 50 = 0)")
def contamination_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text is in the benchmark or among those held back (every fiftieth)."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = load(spark, sf_dir, "benchmark").select("text").unionByName(docs.where("doc_id % 50 = 0").select("text"))
    return corpus.seen_in(docs, held).select("doc_id").dropDuplicates()


@query("contamination_jaccard")
def contamination_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the benchmark item that is nearest by its 5-character runs, if its Jaccard similarity is 0.7 or more."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    near = corpus.gram_contamination(docs, "doc_id", load(spark, sf_dir, "benchmark"), "item_id")
    best = near.groupBy("doc_id").agg(F.max(F.struct(F.round("jaccard", 6).alias("jaccard"), "item_id")).alias("b"))
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", "b.item_id", "b.jaccard", F.col("b").isNotNull().alias("contaminated"))


@query("phrase_jaccard", r"""WITH s AS (SELECT p_partkey AS id, list_distinct(list_transform(range(1, length(n) - 3), lambda i: substr(n, i, 5))) AS g FROM (SELECT p_partkey, lower(p_name || ' ' || p_type || ' ' || p_brand) AS n FROM part)),
t AS (SELECT id, len(g) AS m, unnest(g) AS t FROM s), u AS (SELECT a.id AS a, b.id AS b, count(*) AS i, any_value(a.m) AS ma, any_value(b.m) AS mb FROM t a JOIN t b ON a.t = b.t AND a.id < b.id GROUP BY ALL)
SELECT a, b, round(i / (ma + mb - i), 6) AS jaccard FROM u WHERE i / (ma + mb - i) >= 0.95""")
def phrase_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    return corpus.gram_overlap(rows, "p_partkey", least=0.95).withColumn("jaccard", F.round("jaccard", 6))


@query("degenerate_calls", f"SELECT DISTINCT o_custkey FROM (SELECT o_custkey, {NORM} AS t, count(*) AS n FROM (SELECT o_custkey, o_orderpriority AS text FROM orders) GROUP BY ALL) WHERE n > 2")
def degenerate_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders repeat a priority, normalised, more than twice."""
    return corpus.degenerate(load(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("scrub_regex")
def scrub_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked texts' hashes, and whether masking them again changes anything (it must not)."""
    masked = load(spark, sf_dir, "documents").select("doc_id", "text", tx.scrub(F.col("text")).alias("m"))
    return masked.select("doc_id", F.sha2("m", 256).alias("masked_hash"), (F.col("m") != F.col("text")).alias("changed"), tx.residual(F.col("m")).alias("unstable"))


@query("phone_normalise", r"""WITH d AS (SELECT o_orderkey AS id, regexp_replace(n, '\D', '', 'g') AS d FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '8 (701) ' ELSE '701-' END || lpad((o_orderkey * 7919 % 10000000)::VARCHAR, 7, '0') AS n FROM orders)),
f AS (SELECT id, CASE WHEN length(d) < 7 THEN NULL WHEN length(d) = 10 THEN '7' || d WHEN length(d) = 11 AND d[1] = '8' THEN '7' || substr(d, 2) ELSE d END AS digits FROM d) SELECT id, digits, '+' || digits[1] || ' ' || substr(digits, 2, 3) || ' ***' AS prefix FROM f""")
def phone_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "8 (701) ").otherwise("701-"), F.lpad((F.col("o_orderkey") * 7919 % 10_000_000).cast("string"), 7, "0"))
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("n"))
    return rows.select("id", tx.phone_digits(F.col("n")).alias("digits"), tx.phone_prefix(F.col("n")).alias("prefix"))


@query("keyed_hash")
def keyed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed hashes of numbers; the key here is a stand-in."""
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 10, "7").alias("n"))
    return rows.select("c_custkey", tx.keyed_hash(F.col("n"), b"example key").alias("hash"))


@query("fingerprint", "SELECT user_id, translate(substr(sha256(string_agg(event_type, chr(10) ORDER BY event_type)), 1, 16), '0123456789abcdef', 'ghijklmnopqrstuv') AS fingerprint FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = load(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("m"))
    return groups.select("user_id", tx.fingerprint(F.col("m")).alias("fingerprint"))


@query("fold_share", f"SELECT lang, count(*) AS n FROM documents WHERE ('0x' || substr(sha256(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496 < 0.25 GROUP BY lang")
def fold_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").where(tx.fold_share(F.col("doc_id"), 0.25)).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("letter_share", "SELECT doc_id, round(CASE WHEN n > 0 THEN length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / n ELSE 0 END, 6)::DOUBLE AS share FROM (SELECT doc_id, text, length(regexp_replace(text, '\\P{L}', '', 'g')) AS n FROM documents)")
def letter_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.round(tx.letter_share(F.col("text"), "a-zA-Z"), 6).alias("share"))


PHRASES = (("greeting", "the and"), ("greeting", "thank you"), ("ending", "all rights reserved"), ("licence", "licensed under the apache license"))


@query("match_phrases")
def match_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.match_phrases(load(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), list(PHRASES))
    return rows.select("conv_id", "turn", F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["tactic"], h["start"].cast("string"), h["end"].cast("string"))), ",").alias("hits"))


@query("reassurance", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(?:license|rights)[^.!?\n]{0,70}(?:version|reserved)|(?:version|reserved)[^.!?\n]{0,70}(?:license|rights)')")
def reassurance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").where(rules.reassurance(F.col("text"), ["license", "rights"], ["version", "reserved"])).select("doc_id")


@query("rouge_neighbours")
def rouge_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-L of each turn and the next one of its call."""
    from pyspark.sql import Window

    rows = load(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.where("next is not null").select("conv_id", "turn", F.round(tx.rouge_l("text", "next"), 6).alias("rouge_l"))


@query("max_rouge_l")
def max_rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest ROUGE-L of each benchmark text with any other, where it is 0.7 or more: all count as one language."""
    rows = load(spark, sf_dir, "benchmark").withColumn("lang", F.lit(None).cast("string"))
    return rouge.max_rouge_l(rows, "item_id").withColumn("rouge_l", F.round("rouge_l", 6))


@query("name_similarity", "SELECT a.p_partkey, b.p_partkey AS other, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6)::DOUBLE AS similarity FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are compared once for all parts of one name, brand, size and type."""
    kinds = ["p_brand", "p_size", "p_type"]
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_name", *kinds).dropna(subset=kinds)
    parts = written(pairs.blocks(rows, [*kinds, "p_name"], "p_partkey"), "name-blocks")
    ends = [parts.select(*kinds, F.col("p_name").alias("name_" + c), F.struct("p_name", "block").alias("at_" + c), F.col("ids").alias("ids_" + c)) for c in "xy"]
    met = ends[0].join(ends[1], kinds).where("at_x <= at_y")
    met = met.withColumn("similarity", F.when(F.col("name_x").isNotNull() & F.col("name_y").isNotNull(), F.round(tx.similarity(F.col("name_x"), F.col("name_y")), 6)))
    return pairs.paired(met, ["similarity"], F.col("at_x") == F.col("at_y")).select(F.col("a").alias("p_partkey"), F.col("b").alias("other"), "similarity")


@query("html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = records.html_text(F.col("html"))
    return load(spark, sf_dir, "pages").select("page_id", F.sha2(t, 256).alias("text_hash"), F.length(t).alias("n_chars"))


@query("transcripts", "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS transcript_hash, count(*) AS turns FROM conversations GROUP BY conv_id")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return calls.select("conv_id", F.sha2(F.array_join(F.transform("t", lambda x: x["text"]), "\n"), 256).alias("transcript_hash"), F.size("t").cast("long").alias("turns"))


@query("spoken_lines", "SELECT conv_id, turn, count(*) AS lines FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l FROM conversations) WHERE trim(l) <> '' GROUP BY ALL")
def spoken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(records.spoken_lines(F.col("text"))).cast("long").alias("lines"))
    return rows.where("lines > 0")


@query("excerpts", "SELECT conv_id, turn, sha256(substr(text, 1, least(200, length(text) // 2)) || '…') AS excerpt_hash FROM conversations")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.least(F.lit(200), F.floor(F.length("text") / 2)).cast("int")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.concat(F.substring("text", F.lit(1), cut), F.lit("…")), 256).alias("excerpt_hash"))


@query("content_ids", "SELECT event_id, 'report-' || substr(sha1(event_type || '|' || user_id || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S')), 1, 10) AS report_id FROM events")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id for each report that follows from its content."""
    whole = F.concat_ws("|", "event_type", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("report-"), F.substring(F.sha1(whole), 1, 10)).alias("report_id"))
