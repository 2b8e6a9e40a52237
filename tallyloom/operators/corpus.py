"""Reproducible corpora: first copies, splits, manifests, allotments and checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import char_grams, normal_form, text_hash
from tallyloom.operators import pairs
from tallyloom.operators.places import with_place
from tallyloom.sources.shared import written


def keep_first(rows: DataFrame, order: str, text: str = "text", own: Column | None = None) -> DataFrame:
    """The first row of each normalised text, a null text being an empty one; of rows that share an order and a text all stay. What is grouped is the hash, and each side is combined before the shuffle. own: the hash, if there is one."""
    own = text_hash(F.coalesce(F.col(text), F.lit(""))) if own is None else own
    first = rows.groupBy(own.alias("_own")).agg(F.min(order).alias("_first"))
    return rows.join(first, (own == F.col("_own")) & (F.col(order) == F.col("_first")), "left_semi")


def split_counts(rows: DataFrame, split: str, language: str, positive: Column, hard: Column) -> DataFrame:
    """Totals for each split and, within it, each language (null: all)."""
    made = rows.withColumn("_p", positive.cast("int")).withColumn("_h", hard.cast("int"))
    return made.rollup(split, language).agg(F.count(F.lit(1)).alias("total"), F.sum("_p").alias("positives"), F.sum("_h").alias("hard")).where(F.col(split).isNotNull())


def content_hash(rows: DataFrame, row_id: str, parts: list[str]) -> DataFrame:
    """A hash of all rows that doesn't depend on their order: row hashes, added up in 16 columns of 4 digits each, are hashed again."""
    h = rows.select(F.sha2(F.concat_ws("\x1f", row_id, *parts), 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 1 + 4 * k, 4), 16, 10).cast("long")).alias(f"w{k}") for k in range(16)]
    summed = h.agg(*words, F.count(F.lit(1)).alias("n"))
    return summed.select(F.sha2(F.concat_ws(",", "n", *(f"w{k}" for k in range(16))), 256).alias("content_hash"), "n")


def lock_first(rows: DataFrame, order: str, kind: str, targets: dict[str, int]) -> DataFrame:
    """rows with allocation: locked for the first targets[kind] rows of each kind, train for the rest."""
    n = F.row_number().over(Window.partitionBy(kind).orderBy(order))
    room = F.coalesce(*(F.when(F.col(kind) == k, F.lit(v)) for k, v in targets.items()), F.lit(0))
    return rows.withColumn("allocation", F.when(n <= room, "locked").otherwise("train"))


def largest_remainder(weights: DataFrame, total: int, key: str = "key", weight: str = "weight") -> DataFrame:
    """key, share: total dealt in proportion; what is left goes to the largest fractions, ties by key."""
    every = Window.partitionBy()
    exact = F.lit(float(total)) * F.col(weight) / F.sum(weight).over(every)
    rows = weights.select(key, exact.alias("_x")).withColumn("_f", F.floor("_x"))
    rows = rows.withColumn("_left", F.lit(total) - F.sum("_f").over(every)).withColumn("_n", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_x") - F.col("_f"), 9)), key)))
    return rows.select(key, (F.col("_f") + F.when(F.col("_n") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("share"))


def round_robin(rows: DataFrame, order: str, size: int) -> DataFrame:
    """rows with chunk: dealt in turn to as many chunks as are needed for size rows each at most."""
    chunks = max(1, -(-rows.count() // size))
    return with_place(rows, order, out="_place").withColumn("chunk", F.pmod("_place", F.lit(chunks)).cast("int")).drop("_place")


def stratified(rows: DataFrame, stratum: str, row_id: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each stratum, those whose hash with the seed comes first."""
    order = Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")), 256))
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def seen_in(rows: DataFrame, other: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose normalised text is in other too."""
    return rows.join(other.select(text_hash(F.col(text)).alias("_o")).dropDuplicates(), text_hash(F.col(text)) == F.col("_o"), "left_semi")


def gram_overlap(rows: DataFrame, row_id: str, text: str = "text", n: int = 5, least: float = 0.7) -> DataFrame:
    """a, b, jaccard of pairs of short texts whose sets of n-character runs are that similar. Pairs come from an equi-join on the rarest runs that a pair must share; texts of one normal form are compared as one."""
    held = rows.select(F.col(row_id).alias("id"), normal_form(F.col(text)).alias("text"))
    sets = written(held.select("text").dropDuplicates().select("text", char_grams(F.col("text"), n).alias("g")).where(F.size("g") > 0), "gram-sets")
    grams = sets.select(F.col("text").alias("id"), F.size("g").alias("m"), F.explode("g").alias("t"))
    df = grams.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("id").orderBy("df", "t")
    head = grams.join(df, "t").withColumn("k", F.row_number().over(order)).where((F.col("k") <= F.col("m") - F.ceil(F.lit(least) * F.col("m")) + 1) & (F.col("df") > 1))
    a, b = (head.select(F.col("id").alias(x), F.col("m").alias("m" + x), "t") for x in ("x", "y"))
    near = a.join(b, "t").where((F.col("x") < F.col("y")) & (F.col("mx") >= least * F.col("my")) & (F.col("my") >= least * F.col("mx"))).select("x", "y").dropDuplicates()
    full = near.join(sets.select(F.col("text").alias("x"), F.col("g").alias("gx")), "x").join(sets.select(F.col("text").alias("y"), F.col("g").alias("gy")), "y")
    both = F.size(F.array_intersect("gx", "gy"))
    alike = full.select("x", "y", (both / (F.size("gx") + F.size("gy") - both)).alias("jaccard")).where(F.col("jaccard") >= least)
    alike = alike.unionByName(sets.select(F.col("text").alias("x"), F.col("text").alias("y"), F.lit(1.0).alias("jaccard")))
    parts = written(pairs.blocks(held.where(F.col("text").isNotNull()), ["text"], "id"), "gram-blocks")
    ends = [parts.select(F.col("text").alias(c), F.col("block").alias("block_" + c), F.col("ids").alias("ids_" + c)) for c in "xy"]
    met = alike.join(ends[0], "x").join(ends[1], "y").where((F.col("x") != F.col("y")) | (F.col("block_x") <= F.col("block_y")))
    return pairs.paired(met, ["jaccard"], (F.col("x") == F.col("y")) & (F.col("block_x") == F.col("block_y")))


def gram_contamination(rows: DataFrame, row_id: str, other: DataFrame, other_id: str, text: str = "text", n: int = 5, least: float = 0.7) -> DataFrame:
    """row_id, other_id, jaccard of each row and row of other whose sets of n-character runs are that similar; ids are unique. Rows whose sets are too small or large for any of other take no part."""
    held = other.select(F.col(other_id).alias("o"), char_grams(normal_form(F.col(text)), n).alias("g")).where(F.size("g") > 0)
    ends = held.agg(F.min(F.size("g")).alias("low"), F.max(F.size("g")).alias("high")).collect()[0]
    low, high = ends["low"] or 0, ends["high"] or 0

    @F.pandas_udf("array<string>")
    def grams(texts: pd.Series) -> pd.Series:
        sets = ({t[i : i + n] for i in range(len(t or "") - n + 1)} for t in texts)
        return pd.Series([sorted(g) if g and len(g) >= least * low - 1e-9 and least * len(g) <= high + 1e-9 else None for g in sets], dtype=object)

    sets = rows.select(F.col(row_id).alias("r"), grams(normal_form(F.col(text))).alias("g")).where("g is not null")
    a, b = (s.select(x, F.size("g").alias("m" + x), F.explode("g").alias("t")) for s, x in ((sets, "r"), (held, "o")))
    both = a.join(b, "t").where((F.col("mr") >= least * F.col("mo") - 1e-9) & (F.col("mo") >= least * F.col("mr") - 1e-9)).groupBy("r", "o", "mr", "mo").agg(F.count(F.lit(1)).alias("i"))
    return both.select(F.col("r").alias(row_id), F.col("o").alias(other_id), (F.col("i") / (F.col("mr") + F.col("mo") - F.col("i"))).alias("jaccard")).where(F.col("jaccard") >= least)


def degenerate(turns: DataFrame, call: str, text: str, most: int = 2) -> DataFrame:
    """Calls in which a normalised turn is repeated more than most times."""
    return turns.groupBy(call, normal_form(F.col(text)).alias("t")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(call).dropDuplicates()


def upsert_missing(existing: DataFrame, new: DataFrame, row_id: str) -> DataFrame:
    """existing, and of new the rows whose id it lacks."""
    return existing.unionByName(new.join(existing.select(row_id), row_id, "left_anti"))
