"""Metrics of scores and of groupings, false alarms first. A ratio without a denominator is 0."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(truth: Column, said: Column) -> list[Column]:
    def count(t: int, s: int, name: str) -> Column:
        return F.sum(F.when((truth == t) & (said == s), 1).otherwise(0)).alias(name)

    return [count(1, 1, "tp"), count(0, 1, "fp"), count(0, 0, "tn"), count(1, 0, "fn")]


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        "*",
        F.round(ratio(fp, fp + tn), 6).alias("fpr"),
        F.round(ratio(tp, tp + fn), 6).alias("recall"),
        F.round(ratio(tp, tp + fp), 6).alias("precision"),
        F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
    )


def binary_report(rows: DataFrame, threshold: float, groups: list[str] | None = None) -> DataFrame:
    """Counts and rates at score >= threshold over all rows and, in the same pass, for each value of groups (grouping sets: null means all)."""
    said = (F.col("score") >= threshold).cast("int")
    counts = confusion(F.col("truth"), said)
    return with_rates(rows.rollup(*groups).agg(*counts) if groups else rows.agg(*counts))


def sweep(rows: DataFrame, steps: int = 101) -> DataFrame:
    """Counts and rates at thresholds 0 to 1 in steps, from a cumulative histogram: rows are read once, whatever the number of steps."""
    last = steps - 1
    cell = F.greatest(F.lit(-1), F.least(F.lit(last), F.floor(F.round(F.col("score") * last, 9)).cast("int")))
    hist = rows.groupBy(cell.alias("cell")).agg(F.sum("truth").alias("p"), F.sum(1 - F.col("truth")).alias("n"))
    grid = rows.sparkSession.range(-1, steps).select(F.col("id").cast("int").alias("cell"))
    at = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    full = grid.join(hist, "cell", "left").fillna(0, ["p", "n"])
    counts = full.select("cell", F.sum("p").over(at).alias("tp"), F.sum("n").over(at).alias("fp"), F.coalesce(F.sum("n").over(below), F.lit(0)).alias("tn"), F.coalesce(F.sum("p").over(below), F.lit(0)).alias("fn"))
    return with_rates(counts.where("cell >= 0")).withColumn("threshold", F.round(F.col("cell") / last, 6)).drop("cell")


def select_threshold(table: DataFrame, most_fpr: float = 0.05, least_recall: float = 0.0) -> DataFrame:
    """The row with most recall (then fewest false alarms, then the higher threshold) of those within the limits; if none is, the one with fewest false alarms."""
    fits = (F.col("fpr") <= most_fpr) & (F.col("recall") >= least_recall)
    order = Window.orderBy(F.desc(fits), F.when(fits, -F.col("recall")).otherwise(F.col("fpr")), F.when(fits, F.col("fpr")).otherwise(-F.col("recall")), F.desc("threshold"))
    return table.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def average_precision(rows: DataFrame) -> DataFrame:
    """pr_auc: the sum over falling different scores of the recall gained times the precision; 0 with one class only."""
    at = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    steps = rows.groupBy("score").agg(F.sum("truth").alias("p"), F.count(F.lit(1)).alias("n"))
    steps = steps.select("p", F.sum("p").over(at).alias("tp"), F.sum("n").over(at).alias("seen"))
    whole = steps.agg(F.sum("p").alias("all_p"), F.max("seen").alias("all_n"), F.sum(F.col("p") * F.col("tp") / F.col("seen")).alias("s"))
    return whole.select(F.when((F.col("all_p") > 0) & (F.col("all_p") < F.col("all_n")), F.round(F.col("s") / F.col("all_p"), 6)).otherwise(0.0).alias("pr_auc"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """roc_auc by ranks, ties counted half; null with one class only."""
    steps = rows.groupBy("score").agg(F.sum("truth").alias("p"), F.sum(1 - F.col("truth")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = steps.select("p", "n", (F.col("p") * (below + 0.5 * F.col("n"))).alias("u")).agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("u").alias("u"))
    return whole.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.round(F.col("u") / (F.col("p") * F.col("n")), 6)).alias("roc_auc"))


def purity(pairs: DataFrame) -> DataFrame:
    """The part of rows in their cluster's largest class. pairs: truth, cluster."""
    cells = pairs.groupBy("cluster", "truth").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return cells.agg(F.coalesce(F.round(F.sum("top") / F.sum("n"), 6), F.lit(0.0)).alias("purity"))


def _pairs(n: Column) -> Column:
    return F.floor(n * (n - 1) / 2).cast("long")


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """The adjusted Rand index; 0 for no rows, 1 where both groupings are trivial in the same way."""
    cells = pairs.groupBy("truth", "cluster").agg(F.count(F.lit(1)).alias("n"))
    both = cells.agg(F.sum(_pairs(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    a = cells.groupBy("truth").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("a"))
    b = cells.groupBy("cluster").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("b"))
    whole = both.join(a, F.lit(True)).join(b, F.lit(True))
    total = _pairs(F.col("n"))
    chance = F.when(total > 0, F.col("a") * F.col("b") / total.cast("double")).otherwise(0.0)
    most = (F.col("a") + F.col("b")) / 2
    return whole.select(F.when(F.col("n").isNull() | (F.col("n") == 0), 0.0).when(most == chance, 1.0).otherwise(F.round((F.col("ij") - chance) / (most - chance), 6)).alias("ari"))


def per_label_f1(rows: DataFrame) -> DataFrame:
    """label, tp, fp, fn, f1 over sets of labels. rows: id, truth and said (arrays)."""
    t = rows.select("id", F.explode(F.array_distinct("truth")).alias("label")).withColumn("t", F.lit(1))
    s = rows.select("id", F.explode(F.array_distinct("said")).alias("label")).withColumn("s", F.lit(1))
    both = t.join(s, ["id", "label"], "full").fillna(0, ["t", "s"])
    counts = both.groupBy("label").agg(F.sum(F.col("t") * F.col("s")).alias("tp"), F.sum((1 - F.col("t")) * F.col("s")).alias("fp"), F.sum(F.col("t") * (1 - F.col("s"))).alias("fn"))
    return counts.withColumn("f1", F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + up * d, 1 + up / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def clopper_pearson(k: int | None, n: int | None, confidence: float = 0.95) -> tuple[float, float] | None:
    """The exact binomial interval; None without trials."""
    if not n or k is None:
        return None
    tail = (1 - confidence) / 2
    return (0.0 if k == 0 else beta_quantile(tail, k, n - k + 1)), (1.0 if k == n else beta_quantile(1 - tail, k + 1, n - k))


def upper_bound(k: int, n: int, confidence: float = 0.95) -> float | None:
    """The one-sided exact upper bound."""
    return None if not n else 1.0 if k == n else beta_quantile(confidence, k + 1, n - k)


def with_interval(rows: DataFrame, k: str, n: str, confidence: float = 0.95) -> DataFrame:
    """rows with low and high of the exact interval, each different pair of k and n of a batch computed once."""

    @F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
    def bounds(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        known = {}
        for pair in set(zip(a.astype(object).where(a.notna(), None), b.astype(object).where(b.notna(), None), strict=True)):
            known[pair] = clopper_pearson(*(None if x is None else int(x) for x in pair), confidence) or (None, None)
        found = [known[pair] for pair in zip(a.astype(object).where(a.notna(), None), b.astype(object).where(b.notna(), None), strict=True)]
        return pd.DataFrame(found, columns=["low", "high"], dtype=float)

    return rows.withColumn("_i", bounds(F.col(k), F.col(n))).select("*", F.col("_i.low").alias("low"), F.col("_i.high").alias("high")).drop("_i")


def bootstrap_average_precision(rows: DataFrame, draws: int = 200, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """low, high: percentiles of the average precision over Poisson resamples. A row's weight in a draw follows from a hash of seed, draw and id, so it doesn't depend on order."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "draw", "id"), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    # the number of Poisson(1) events, from the inverse of its distribution
    cuts, total = [], 0.0
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        cuts.append(total)
    weight = sum([F.when(u > c, 1).otherwise(0) for c in cuts[1:]], F.when(u > cuts[0], 1).otherwise(0))
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("w", weight).where("w > 0")
    steps = drawn.groupBy("draw", "score").agg(F.sum(F.col("w") * F.col("truth")).alias("p"), F.sum("w").alias("n"))
    at = Window.partitionBy("draw").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("draw", "p", F.sum("p").over(at).alias("tp"), F.sum("n").over(at).alias("seen"))
    each = steps.groupBy("draw").agg(F.sum("p").alias("p"), F.max("seen").alias("n"), F.sum(F.col("p") * F.col("tp") / F.col("seen")).alias("s")).where("p > 0 and p < n")
    tail = (1 - confidence) / 2
    return each.select((F.col("s") / F.col("p")).alias("ap")).agg(F.percentile("ap", F.lit(tail)).alias("low"), F.percentile("ap", F.lit(1 - tail)).alias("high"), F.count(F.lit(1)).alias("draws"))


def temperature(rows: DataFrame, rounds: int = 3, points: int = 101, low: float = 0.05, high: float = 10.0) -> float:
    """The temperature with the least mean negative log-likelihood, by a grid that narrows each round. rows: logit, truth. Rows are summed once per round for all points."""
    counted = rows.groupBy("logit", "truth").agg(F.count(F.lit(1)).alias("c"))
    for _ in range(rounds):
        step = (high - low) / (points - 1)
        grid = [low + i * step for i in range(points)]
        each = counted.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        z = F.col("logit") / (low + F.col("i") * step)
        p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))))
        loss = -F.when(F.col("truth") == 1, F.log(p)).otherwise(F.log(1 - p)) * F.col("c")
        found = {r["i"]: r["l"] for r in each.groupBy("i").agg(F.sum(loss).alias("l")).collect()}
        best = min(range(points), key=lambda i: (found[i], i))
        low, high = max(0.05, grid[best] - step), min(10.0, grid[best] + step)
    return grid[best]


def false_positives(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows of truth 0 that score threshold or more."""
    return rows.where((F.col("truth") == 0) & (F.col("score") >= threshold))


def by_ledger(rows: DataFrame, ledger: DataFrame, row_id: str = "id") -> DataFrame:
    """Each row twice, by subset: all, and inspected if the ledger has its id, else clean. Rows without an id are clean; ids that the ledger has several times count once."""
    seen = ledger.select(F.col(row_id).alias("_seen")).dropDuplicates()
    told = rows.join(seen, rows[row_id] == seen["_seen"], "left")
    subset = F.array(F.lit("all"), F.when(F.col("_seen").isNotNull(), "inspected").otherwise("clean"))
    return told.withColumn("subset", F.explode(subset)).drop("_seen")


def paired_split(rows: DataFrame, threshold: float, truth: str = "truth", before: str = "before", after: str = "after", groups: list[str] | None = None) -> DataFrame:
    """What a change of the same rows does to their scores: recall and fpr before and after it, and how many rows cross the threshold upwards (raised) or downwards (lowered). A null score is below it; rows of an unknown truth count as flips alone."""
    was, now = (F.coalesce(F.col(c) >= threshold, F.lit(False)) for c in (before, after))

    def count(which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, 1).otherwise(0)), F.lit(0))

    yes, no = F.col(truth) == 1, F.col(truth) == 0
    sides = [F.round(ratio(count(kind & side), count(kind)), 6).alias(f"{name}_{when}") for name, kind in (("recall", yes), ("fpr", no)) for when, side in (("before", was), ("after", now))]
    return rows.groupBy(*(groups or [])).agg(*sides, count(now & ~was).alias("raised"), count(was & ~now).alias("lowered"))
