"""How well groups by shared keys hold when keys are lost: all conditions and all subsamples of them in one run, the condition being part of each node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.linking import components
from tallyloom.sources.shared import written


def unit(*parts: Column | str | int) -> Column:
    """A number from 0 up to 1 that depends on the parts alone."""
    told = [F.lit(str(p)) if isinstance(p, int) else F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *told), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def perturbed(rows: DataFrame, conditions: dict[str, float], resamples: int, fraction: float, seed: int, row_id: str = "id", key: str = "key") -> DataFrame:
    """condition, sample, id, key, truth: for each condition all rows (sample 0) and subsamples of about a fraction of them, each key kept for a share of the rows, the same in all samples."""
    runs = F.explode(F.array(*(F.struct(F.lit(name).alias("condition"), F.lit(float(keep)).alias("keep")) for name, keep in conditions.items())))
    wide = rows.select(F.col(row_id).alias("id"), F.col(key).alias("key"), "truth", runs.alias("r")).select("id", "truth", "r.condition", F.when(unit(seed, F.lit("key"), F.col("id")) < F.col("r.keep"), F.col("key")).alias("key"))
    samples = wide.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(resamples))))
    return samples.where((F.col("sample") == 0) | (unit(seed, F.col("sample"), F.col("id")) < fraction))


def _two(c: str) -> Column:
    return F.col(c).cast("double") * (F.col(c) - 1) / 2


def _cells(rows: DataFrame, conditions: dict[str, float], resamples: int, fraction: float, seed: int, row_id: str, key: str) -> tuple[DataFrame, DataFrame]:
    """A row for each id and truth: n rows, the id's least and greatest key, its sums (m, top, same; first: its first row), u and its samples. And ties: condition, sample, and two keys of an id with several."""
    slim = rows.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("id"), F.col(key).alias("key"), "truth")
    each = slim.groupBy("id", "truth").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    whole = Window.partitionBy("id")
    sums = {"key": F.min("low"), "other": F.max("high"), "m": F.sum("n"), "top": F.max("n"), "same": F.sum(_two("n"))}
    wide = each.select("id", "truth", "n", *(c.over(whole).alias(name) for name, c in sums.items()), (F.row_number().over(whole.orderBy("truth")) == 1).alias("first"))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(resamples)), lambda s: (s == 0) | (unit(seed, s, F.col("id")) < fraction))
    cells = written(wide.select("*", unit(seed, F.lit("key"), F.col("id")).alias("u"), drawn.alias("samples")), "stress-cells")
    several = cells.where(F.col("first") & (F.col("key") != F.col("other"))).select("id", F.col("key").alias("a"), "u", "samples")
    runs = F.explode(F.array(*(F.struct(F.lit(name).alias("condition"), F.lit(float(keep)).alias("keep")) for name, keep in conditions.items())))
    ties = several.join(slim.where("key is not null"), "id").where("a <> key").select("a", F.col("key").alias("b"), "u", "samples").select("a", "b", "u", "samples", runs.alias("r"))
    return cells, ties.where(F.col("u") < F.col("r.keep")).select(F.col("r.condition").alias("condition"), F.explode("samples").alias("sample"), "a", "b").dropDuplicates()


def stress_conditions(rows: DataFrame, conditions: dict[str, float], resamples: int = 20, fraction: float = 0.8, confidence: float = 0.95, seed: int = 0, row_id: str = "id", key: str = "key") -> DataFrame:
    """condition, n, groups, purity, ari, multi_member_share of all rows (id, key or null, truth), and for the last three the interval over subsamples (_low, _high).

    conditions: the share of rows that keep their key. Rows are counted by key, truth and sample, for all conditions at once; what has no key is a group of its own and adds to the sums where it is.
    Only keys that rows of several keys tie are nodes of a graph, whose nodes have condition and sample, so one contraction serves all. Rows without an id are left out.
    """
    run, names = ["condition", "sample"], list(conditions)
    cells, ties = _cells(rows, conditions, resamples, fraction, seed, row_id, key)
    drawn = cells.withColumn("sample", F.explode("samples"))
    holds = [F.col("key").isNotNull() & (F.col("u") < float(conditions[c])) for c in names]
    by_key = written(drawn.groupBy("sample", "key", "truth").agg(F.sum("n").alias("n"), *(F.sum(F.when(h, F.col("n"))).alias(f"n{k}") for k, h in enumerate(holds))), "stress-keys")
    truths = by_key.groupBy("sample", "truth").agg(F.sum("n").alias("t")).groupBy("sample").agg(F.sum("t").alias("n"), F.sum(_two("t")).alias("truths"))
    parts = {"groups": F.lit(1), "top": F.col("top"), "same": F.col("same"), "pairs": _two("m"), "several": F.when(F.col("m") > 1, F.col("m")).otherwise(0)}
    lone = drawn.where("first").groupBy("sample").agg(*(F.sum(F.when(~h, c)).alias(f"{name}{k}") for k, h in enumerate(holds) for name, c in parts.items()))
    told = lambda columns: F.explode(F.array(*(F.struct(F.lit(c).alias("condition"), *(F.col(f"{x}{k}").alias(x) for x in columns)) for k, c in enumerate(names))))
    alone = lone.select("sample", told(parts).alias("r")).select("sample", "r.*")
    keyed = by_key.where("key is not null").select("sample", "key", "truth", told(["n"]).alias("r")).select("sample", "key", "truth", "r.*").where("n > 0")
    if not ties.isEmpty():
        node = lambda c: F.struct("condition", "sample", F.col(c).alias("key"))
        label = components(ties.select(node("a").alias("a"), node("b").alias("b"))).select("node.*", F.col("component.key").alias("to"))
        keyed = keyed.join(label, [*run, "key"], "left").groupBy(*run, F.coalesce("to", "key").alias("key"), "truth").agg(F.sum("n").alias("n"))
    by_group = keyed.groupBy(*run, "key").agg(F.sum("n").alias("m"), F.max("n").alias("top"), F.sum(_two("n")).alias("same"))
    found = by_group.groupBy(*run).agg(*(F.sum(c).alias(name) for name, c in parts.items())).unionByName(alone).groupBy(*run).agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in parts))
    expected = F.col("pairs") * F.col("truths") / (F.col("n").cast("double") * (F.col("n") - 1) / 2)
    best = (F.col("pairs") + F.col("truths")) / 2
    ari = F.when((F.col("n") < 2) | (best == expected), 1.0).otherwise((F.col("same") - expected) / (best - expected))
    each = written(found.join(truths, "sample").select(*run, "n", "groups", (F.col("top") / F.col("n")).alias("purity"), ari.alias("ari"), (F.col("several") / F.col("n")).alias("multi_member_share")), "stress-runs")
    alpha = 1 - confidence
    spans = [F.percentile(c, F.lit(q)).alias(f"{c}_{end}") for c in ("purity", "ari", "multi_member_share") for end, q in (("low", alpha / 2), ("high", 1 - alpha / 2))]
    return each.where("sample = 0").drop("sample").join(each.where("sample > 0").groupBy("condition").agg(*spans), "condition", "left")
