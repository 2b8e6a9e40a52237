"""Vectors as arrays: similarity, centroids, novelty and nearest rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1 - dot(a, b) / size).otherwise(1.0)


def centroids(rows: DataFrame, group: str = "label", vector: str = "embedding") -> DataFrame:
    """group, centroid: the mean of each group's vectors that aren't zero, place by place; a group of zero vectors has none."""
    parts = rows.where(F.exists(vector, lambda x: x != 0)).select(group, F.posexplode(vector).alias("pos", "x"))
    means = parts.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s")).select(group, F.transform("s", lambda s: s["m"]).alias("centroid"))


def novelty(orgs: DataFrame, most_small: int = 10, distance: float = 0.06) -> DataFrame:
    """orgs with nearest (distance to any large one) and is_novel: small, far from all large ones, with a centroid, and with a number or two members.

    orgs: org, size, centroid (null: no text), has_number. Without a large organization nothing is novel. Large ones are few, so they are broadcast if they are.
    """
    large = orgs.where((F.col("size") > most_small) & F.col("centroid").isNotNull()).select(F.col("centroid").alias("c"))
    small = orgs.where((F.col("size") <= most_small) & F.col("centroid").isNotNull())
    near = small.join(large, F.lit(True)).groupBy("org").agg(F.min(cosine_distance(F.col("centroid"), F.col("c"))).alias("nearest"))
    found = orgs.join(near, "org", "left")
    return found.withColumn("is_novel", F.coalesce((F.col("nearest") >= distance) & (F.col("has_number") | (F.col("size") >= 2)), F.lit(False)))


#: Queries and rows of two blocks that meet in a task.
ASKED, ROWS = 1024, 4096


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, row_id: str = "vec_id", vector: str = "embedding", least: float = 1e-12) -> DataFrame:
    """query_id, rank, id and score: the k rows nearest to each of a stated set of queries by cosine, norms clipped below; ties to the smaller id.

    Every query meets every row, as the measure asks, in pairs of blocks of a bounded size; a block gives its k best rows for each of its queries. Vectors that don't compare have no score and come last.
    """
    kind = rows.schema[row_id].dataType.simpleString()
    asked, held = (t.select(F.col(row_id).alias("i"), F.col(vector).cast("array<double>").alias("v"), (F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).alias("whole")).where("i is not null") for t in (queries, rows))
    across, along = (max(1, -(-t.count() // n)) for t, n in ((asked, ASKED), (held, ROWS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")
    dealt = asked.select(own(across).alias("x"), every(along).alias("y"), F.lit(True).alias("asks"), "*").unionByName(held.select(every(across).alias("x"), own(along).alias("y"), F.lit(False).alias("asks"), "*"))

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        asks = part["asks"].to_numpy(bool)
        q, r = part[asks], part[~asks].sort_values("i")
        names, out = r["i"].to_numpy(), []
        sides = [_sized(q, least), _sized(r, least)]
        for at in range(0, len(q) if len(r) else 0, 128):
            score, told = np.zeros((len(q.iloc[at : at + 128]), len(r))), np.zeros((len(q.iloc[at : at + 128]), len(r)), bool)
            for size, (rows_q, v, nv) in sides[0].items():
                mine = (rows_q >= at) & (rows_q < at + 128)
                if mine.any() and size in sides[1]:
                    rows_r, w, nw = sides[1][size]
                    total = np.zeros((mine.sum(), len(rows_r)))
                    for a, b in zip(v[mine].T, w.T, strict=True):  # place by place, so that equal vectors have equal scores
                        total += a[:, None] * b[None, :]
                    cells = np.ix_(rows_q[mine] - at, rows_r)
                    score[cells], told[cells] = total / (nw[None, :] * nv[mine][:, None]), True
            key = np.where(told, np.where(np.isnan(score), np.inf, score), -np.inf)
            for n, name in enumerate(q["i"].iloc[at : at + 128]):
                other = np.flatnonzero(names != name)
                own_key = key[n, other]
                best = np.partition(own_key, -k)[-k] if len(other) > k else -np.inf
                near = other[own_key >= best]
                rank = np.where(told[n, near], np.where(np.isnan(score[n, near]), 0, 1), 2)
                near = near[np.lexsort((near, -key[n, near], rank))[:k]]
                out.append(pd.DataFrame({"query_id": name, "id": names[near], "score": score[n, near], "told": told[n, near]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": [], "told": []})

    met = dealt.groupBy("x", "y").applyInPandas(meet, f"query_id {kind}, id {kind}, score double, told boolean")
    order = Window.partitionBy("query_id").orderBy("told", F.desc("score"), "id")
    found = met.select("query_id", "id", F.when(F.col("told"), F.coalesce("score", F.lit(float("nan")))).alias("score"), (~F.col("told")).alias("told"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def _sized(side: pd.DataFrame, least: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each number of components the places, vectors and norms (clipped below) of the vectors without a null."""
    out: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    whole = np.flatnonzero(side["whole"].to_numpy(bool))
    vectors = side["v"].to_numpy()[whole]
    sizes = np.array([len(v) for v in vectors], np.int64)
    for size in np.unique(sizes):
        x = np.array(vectors[sizes == size].tolist(), np.float64).reshape(-1, size)
        total = np.zeros(len(x))
        for c in x.T:
            total += c * c
        out[int(size)] = whole[sizes == size], x, np.maximum(np.sqrt(total), least)
    return out


#: Rows of a block, of which two meet in a task.
BLOCK = 1024


def nearest_in_group(rows: DataFrame, group: str = "label", row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and its highest cosine to another row of its group; -1 for a row alone. Rows without a group or vector are alone.

    Every two rows of a group meet, as the measure asks: in pairs of blocks of about BLOCK rows, so a task is of a bounded size however large a group is, and products are of whole blocks.
    """
    slim = rows.select(F.col(group).alias("g"), F.col(row_id).alias("i"), F.col(vector).cast("array<double>").alias("v")).where("g is not null and v is not null")
    blocks = slim.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = slim.join(blocks, "g").withColumn("b", F.pmod(F.xxhash64("i"), F.col("blocks")))
    met = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("g", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "i", "v")
    kind = slim.schema["i"].dataType.simpleString()

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        at = part["b"].to_numpy()
        sides = [part[at == part["x"].iloc[0]], part[at == part["y"].iloc[0]]]
        unit = []
        for side in sides:
            v = np.array(side["v"].tolist(), np.float64).reshape(len(side), -1)
            size = np.sqrt((v * v).sum(1, keepdims=True))
            unit.append(np.divide(v, size, out=np.zeros_like(v), where=size > 0))
        if not len(unit[0]) or not len(unit[1]):
            return pd.DataFrame({"i": [], "best": []})
        names = [side["i"].to_numpy() for side in sides]
        product = unit[0] @ unit[1].T
        product[names[0][:, None] == names[1][None, :]] = -np.inf
        found = pd.DataFrame({"i": np.concatenate(names), "best": np.concatenate([product.max(1), product.max(0)])})
        return found[np.isfinite(found["best"])]

    best = met.groupBy("g", "x", "y").applyInPandas(meet, f"i {kind}, best double").groupBy("i").agg(F.max("best").alias("best"))
    return rows.select(row_id).join(best, F.col(row_id) == F.col("i"), "left").select(row_id, F.coalesce("best", F.lit(-1.0)).alias("best"))


def linear_head(vector: Column, weights: list[float], bias: float) -> Column:
    """The logistic value of a linear head, its argument kept within 700."""
    z = dot(vector, F.array(*map(F.lit, weights))) + bias
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))


def fused_head(vector: Column, members: list[tuple[list[float], float, float, float]]) -> Column:
    """The mean over members (weights, bias, a, b) of the calibrated value 1 / (1 + exp(a d + b))."""
    each = [1 / (1 + F.exp(a * (dot(vector, F.array(*map(F.lit, w))) + c) + b)) for w, c, a, b in members]
    return sum(each[1:], each[0]) / len(each)
