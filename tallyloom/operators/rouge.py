"""Texts that have a long common subsequence of words with another text of their language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import rouge_l
from tallyloom.sources.shared import written


def words(text: Column) -> Column:
    """The runs of letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def max_rouge_l(rows: DataFrame, row_id: str, lang: str = "lang", text: str = "text", least: float = 0.7) -> DataFrame:
    """row_id, rouge_l: the highest ROUGE-L of each row's text with any other row's of its language, if it is least or more; else null.

    Null and empty texts have null; rows without a language are compared with each other. Rows of equal words are one class, so copies
    make no pairs and have 1. Two texts only reach least if the words they share in any order do, so that each one's rarest words must
    meet: pairs come from an equi-join on those, and all of them are compared. Where many different texts
    share their rarest words, work grows with the square of their number.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    joined = F.array_join(words(F.col(text)), " ")
    spoken = F.coalesce(F.col(lang).cast("string"), F.lit(""))
    keyed = rows.select(F.col(row_id).alias("i"), spoken.alias("l"), joined.alias("w"))
    keyed = keyed.withColumn("c", F.when(F.col("w") != "", F.sha2(F.concat_ws("\n", "l", "w"), 256)))
    classes = written(keyed.where("c is not null").groupBy("c").agg(F.first("l").alias("l"), F.first("w").alias("w"), F.count(F.lit(1)).alias("n")), "rouge_classes")

    # the k-th time that a text has a word is an element of its own, so that sets of elements count repeats
    split = classes.select("c", "l", F.split("w", " ").alias("ws")).select("c", "l", F.size("ws").alias("m"), F.explode("ws").alias("x"))
    times = split.groupBy("c", "l", "m", "x").agg(F.count(F.lit(1)).alias("t"))
    elements = written(times.select("c", "l", "m", "x", F.explode(F.sequence(F.lit(1), F.col("t"))).alias("k")), "rouge_elements")
    common = elements.groupBy("l", "x", "k").agg(F.count(F.lit(1)).alias("df"))
    placed = elements.join(common, ["l", "x", "k"]).withColumn("at", F.row_number().over(Window.partitionBy("c").orderBy("df", "x", "k")))
    prefix = F.col("m") - F.ceil(F.col("m") * (least / (2 - least)) - 1e-9) + 1
    heads = placed.where((F.col("at") <= prefix) & (F.col("df") > 1))
    a, b = (heads.select("l", "x", "k", F.col("c").alias(s), F.col("m").alias("m" + s)) for s in ("a", "b"))
    possible = 2 * F.least("ma", "mb") >= least * (F.col("ma") + F.col("mb")) - 1e-9
    pairs = a.join(b, ["l", "x", "k"]).where((F.col("a") < F.col("b")) & possible).select("a", "b").dropDuplicates()

    left, right = (classes.select(F.col("c").alias(s), F.col("w").alias("w" + s)) for s in ("a", "b"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", rouge_l("wa", "wb").alias("r")).where(F.col("r") >= least - 1e-12)
    best = scored.select(F.explode(F.array("a", "b")).alias("c"), "r").groupBy("c").agg(F.max("r").alias("r"))
    told = classes.select("c", "n").join(best, "c", "left").select("c", F.greatest(F.when(F.col("n") > 1, 1.0), F.col("r")).alias("rouge_l")).where("rouge_l is not null")
    return keyed.select("i", "c").join(told, "c", "left").select(F.col("i").alias(row_id), "rouge_l")
