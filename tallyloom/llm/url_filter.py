"""Judges URLs by rules, and where no rule fits by two character models of the URLs that rules accept and reject.

Each model is a Markov model of variable order: a character's probability after its last ORDER - 1 characters is mixed with that after fewer, by how many
different ones were seen there (Witten and Bell). Counts of all n-grams are exact, gathered and looked up by joins, over whole urls. The score is the difference of the two log-likelihoods, divided by the length. Rows that aren't counted (a part, by hash)
calibrate it: the threshold is where the mean of both classes' error rates is smallest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import Aside, drop_but, in_slices, table, written, written_tables

#: host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
ORDER = 5
#: Of the rows that rules judge, one in so many calibrates and isn't counted.
CALIBRATES = 5
#: Scores are calibrated in steps of 1 / STEPS, between -RANGE and RANGE.
STEPS, RANGE = 500, 4
START = 2
VERDICTS = ("allow", "block")
#: Log-likelihoods are added up in steps of 1 / UNIT.
UNIT = 1_000_000_000


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its text, and its verdict; null if none does."""
    named, judged = [], []
    for where, start, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r)):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(start)
        named.append(F.when(fits, F.lit(where + start)))
        judged.append(F.when(fits, F.lit(verdict)))
    return F.coalesce(*named, F.lit(None).cast("string")), F.coalesce(*judged, F.lit(None).cast("string"))


def _grams(texts: DataFrame, column: str) -> DataFrame:
    """column, gram, n: for the characters of text in rows of texts (column, text), the last ORDER - 1 before each (START before the first) and itself, and how many there are."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            keys, grams, n = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                padded = chr(START) * (ORDER - 1) + text
                held = Counter(padded[i : i + ORDER] for i in range(len(text)))
                keys += [key] * len(held)
                grams += held.keys()
                n += held.values()
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(grams, pa.string()), pa.array(n, pa.int64())], names=[column, "gram", "n"])

    schema = T.StructType([texts.schema[column], T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])
    return texts.select(column, "text").mapInArrow(cut, schema)


def _counts(labelled: DataFrame) -> DataFrame:
    """gram, allow, block: how often each class of labelled (text, verdict) has each n-gram of ORDER characters."""
    return _grams(labelled, "verdict").groupBy("gram").agg(*(F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in VERDICTS))


def _gaps(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, gap: for each n-gram of asked its log-probability when allowed less that when blocked, in steps of 1 / UNIT. All counts are exact, by joins."""
    rows = asked.select("gram", *(F.lit(1 / 256).alias("p_" + v) for v in VERDICTS))
    for k in range(ORDER):
        pair, context = F.substring("gram", ORDER - k, k + 1), F.substring("gram", ORDER - k, k)
        pairs = counts.groupBy(pair.alias("pair")).agg(*(F.sum(v).alias("n_" + v) for v in VERDICTS))
        of = F.substring("pair", 1, k)
        contexts = pairs.groupBy(of.alias("context")).agg(*(F.sum("n_" + v).alias("seen_" + v) for v in VERDICTS), *(F.count(F.when(F.col("n_" + v) > 0, 1)).alias("kinds_" + v) for v in VERDICTS))
        rows = rows.withColumn("pair", pair).withColumn("context", context).join(pairs, "pair", "left").join(contexts, "context", "left")
        mixed = (F.when(F.col("seen_" + v) > 0, (F.coalesce("n_" + v, F.lit(0)) + F.col("kinds_" + v) * F.col("p_" + v)) / (F.col("seen_" + v) + F.col("kinds_" + v))).otherwise(F.col("p_" + v)).alias("p_" + v) for v in VERDICTS)
        rows = rows.select("gram", *mixed)
    return rows.select("gram", F.round((F.log("p_allow") - F.log("p_block")) * UNIT).cast("long").alias("gap"))


def text_scores(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """text, score of each different text that isn't empty: the length-normalised difference of log-likelihoods, allow less block. Sums are of whole numbers, so no partitioning changes them."""
    named = written(texts.where("text <> ''").select("text").dropDuplicates().withColumn("_text", F.monotonically_increasing_id()), "urls")
    held = written(_grams(named, "_text"), "url-grams")
    gaps = _gaps(held.select("gram").dropDuplicates(), counts)
    sums = held.join(gaps, "gram").groupBy("_text").agg(F.sum(F.col("gap") * F.col("n")).alias("gap"))
    return named.join(sums, "_text").select("text", (F.col("gap") / UNIT / F.length("text")).alias("score"))


def threshold(scored: DataFrame) -> float:
    """Where the mean of the error rates of both verdicts is smallest, of equal places the nearest to 0. scored: score and verdict."""
    step = F.round(F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), F.col("score"))) * STEPS).cast("long")
    rows = scored.groupBy(step.alias("step"), "verdict").count().toPandas()  # at most 2 * (2 * RANGE * STEPS + 1) rows
    grid = np.arange(-RANGE * STEPS, RANGE * STEPS + 1)
    count = {v: np.bincount(rows[rows.verdict == v].step + RANGE * STEPS, rows[rows.verdict == v]["count"], len(grid)) for v in ("allow", "block")}
    if not all(c.sum() for c in count.values()):
        return 0.0
    missed = np.concatenate([[0], np.cumsum(count["allow"])])[:-1] / count["allow"].sum()  # allowed ones below
    passed = 1 - np.concatenate([[0], np.cumsum(count["block"])])[:-1] / count["block"].sum()
    error = missed + passed
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(grid[best[np.argmin(np.abs(grid[best]))]] - 0.5) / STEPS


def whole_of(url: Column, host: Column) -> Column:
    """The url with its scheme and host in lower case, so that only the rest's case counts; a null one is empty."""
    text = F.coalesce(url, F.lit(""))
    scheme = F.translate(F.regexp_extract(text, r"(?s)^(.*?)://", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rest = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(text.contains("://"), F.concat(scheme, F.lit("://"), host, rest)).otherwise(text)


def judge(pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """pages with host, path, rule, verdict and score (of the models). Columns of these names are replaced.

    The models see whole urls, query and fragment too. Null and empty urls score 0 and so have the models' verdict at 0; those without "://" have an empty host
    and path. If rules judge no url, or none of one verdict, every other url scores 0 and is allowed.
    """
    aside, before = Aside(pages, "host", "path", "rule", "verdict", "score"), written_tables()
    parted = aside.rows.withColumn("host", host_of(aside[url])).withColumn("path", path_of(aside[url]))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parted = parted.withColumn("rule", rule).withColumn("_ruled", verdict).withColumn("_whole", whole_of(aside[url], F.col("host")))
    ruled = parted.where("_ruled is not null").select(F.col("_whole").alias("text"), F.col("_ruled").alias("verdict"))
    calibrates = F.pmod(F.xxhash64("text"), F.lit(CALIBRATES)) == 0
    counts = written(_counts(ruled.where(~calibrates)), "url-counts")
    totals = counts.agg(*(F.sum(v).alias(v) for v in VERDICTS)).collect()[0]
    if all(totals[v] for v in VERDICTS):
        scores = written(text_scores(parted.select(F.col("_whole").alias("text")), counts), "url-scores")
        drop_but(pages.sparkSession, before, scores)
        cut = threshold(ruled.where(calibrates).join(scores, "text", "left").select(F.coalesce("score", F.lit(0.0)).alias("score"), "verdict"))
        # empty ones take no part in the join, where they would all be in one place
        scored = parted.where("_whole <> ''").join(scores, F.col("_whole") == F.col("text"), "left").drop("text")
        scored = scored.withColumn("score", F.coalesce("score", F.lit(0.0))).unionByName(parted.where("_whole = ''").withColumn("score", F.lit(0.0)))
    else:
        cut, scored = 0.0, parted.withColumn("score", F.lit(0.0))
    verdict = F.coalesce("_ruled", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return scored.withColumn("verdict", verdict).select(*aside.back(), "host", "path", "rule", "verdict", "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
