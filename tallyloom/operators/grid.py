"""Manifests of texts to be made: cells with exact quotas on every axis, drawn by hashes, so they are the same in any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators.places import with_place
from tallyloom.operators.stress import unit


def shares(total: int, weights: dict[str, float]) -> dict[str, int]:
    """total dealt in proportion to weights; what is left goes to the largest remainders, of equal ones to the first."""
    whole = sum(weights.values())
    if total and whole <= 0:
        raise ValueError("weights must be above zero in all")
    exact = {k: total * w / whole if whole else 0.0 for k, w in weights.items()}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: -round(exact[k] - out[k], 9))[: total - sum(out.values())]:
        out[k] += 1
    return out


def _nth(place: Column, deck: dict[str, int]) -> Column:
    """The value of a deck (value: how many) at a place."""
    ends, at = [], 0
    for n in deck.values():
        at += n
        ends.append(at)
    passed = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= place))
    return F.element_at(F.array(*map(F.lit, deck)), passed + 1)


def dealt(cells: DataFrame, axis: str, deck: dict[str, int], seed: int, cell: str = "cell") -> DataFrame:
    """cells with a column axis: a shuffled deck of as many cards as there are cells. Cells are ordered by a hash of seed, axis and cell."""
    if (n := cells.count()) != sum(deck.values()):
        raise ValueError(f"{axis}: {sum(deck.values())} cards for {n} cells")
    deck = {k: v for k, v in deck.items() if v}
    if not deck:
        return cells.withColumn(axis, F.lit(None).cast("string"))
    mixed = with_place(cells.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(axis), F.col(cell).cast("string")), 256)), "_h", cell, out="_place")
    return mixed.withColumn(axis, _nth(F.col("_place"), deck)).drop("_h", "_place")


def drawn(options: DataFrame, groups: list[str], option: str, weight: str, k: Column | int, seed: int) -> DataFrame:
    """Up to k options of each group without replacement, each draw in proportion to the weights of those that are left: the ones with the smallest exponential keys.

    Options without a weight above zero are never drawn.
    """
    key = -F.log(1 - unit(seed, *[F.col(g) for g in groups], F.col(option))) / F.col(weight)
    order = Window.partitionBy(*groups).orderBy("_key", option)
    return options.where(F.col(weight) > 0).withColumn("_key", key).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= (F.lit(k) if isinstance(k, int) else k)).drop("_key", "_n")


def grid_manifest(spark: SparkSession, size: int, classes: dict[str, float], axes: dict[str, dict[str, float]], optional: DataFrame | None = None, least: int = 0, most: int = 2, seed: int = 0) -> DataFrame:
    """cell, class, a column for each axis, and tactics (sorted) of size cells. Classes have exact shares of all cells, and each axis of the cells of each class.

    optional: class, tactic, weight; a cell draws least to most of its class's tactics.
    """
    counts = shares(size, classes)
    rows = spark.range(size).select(F.col("id").alias("cell"))
    ends = {k: n for k, n in counts.items() if n}
    rows = rows.withColumn("class", _nth(F.col("cell"), ends)) if ends else rows.withColumn("class", F.lit(None).cast("string"))
    parts = []
    for name, n in ends.items():
        part = rows.where(F.col("class") == name)
        for axis, weights in axes.items():
            part = dealt(part, axis, shares(n, weights), seed)
        parts.append(part)
    whole = parts[0] if parts else rows.select("*", *(F.lit(None).cast("string").alias(a) for a in axes))
    for part in parts[1:]:
        whole = whole.unionByName(part)
    if optional is None:
        return whole
    k = F.lit(least) + F.floor(unit(seed, F.lit("how many"), F.col("cell")) * (most - least + 1))
    pool = whole.select("cell", "class").join(optional, "class").withColumn("_k", k)
    got = drawn(pool, ["cell"], "tactic", "weight", F.col("_k"), seed).groupBy("cell").agg(F.array_sort(F.collect_list("tactic")).alias("tactics"))
    return whole.join(got, "cell", "left").withColumn("tactics", F.coalesce("tactics", F.array().cast("array<string>")))


def with_constraint(cells: DataFrame, named: DataFrame, text: str, cell: str = "cell") -> DataFrame:
    """cells with constraint: text for those named, what they had for the others. Unknown cells and a blank text are errors."""
    if not text.strip():
        raise ValueError("a constraint can't be blank")
    ids = named.select(F.col(cell).alias("_c")).dropDuplicates()
    if unknown := ids.join(cells.select(F.col(cell).alias("_c")), "_c", "left_anti").limit(5).collect():
        raise ValueError(f"unknown cells: {[r[0] for r in unknown]}")
    old = F.col("constraint") if "constraint" in cells.columns else F.lit(None).cast("string")
    return cells.join(ids.withColumn("_hit", F.lit(True)), F.col(cell) == F.col("_c"), "left").withColumn("constraint", F.when(F.col("_hit"), text).otherwise(old)).drop("_c", "_hit")
