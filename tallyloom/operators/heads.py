"""Linear heads for many labels at once: balanced, regularised, with scores out of fold and calibrated on folds that a head hasn't seen.

All heads of all folds are trained together, by Newton's steps: one pass over the rows gives each one its gradient and curvature, summed in two steps by head, so what reaches the driver is
folds x heads x dimensions squared, whatever the number of rows. Folds are of whole groups, by a hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOLDS, C, STEPS, SALTS = 5, 4.0, 12, 16
#: Gain of a step, relative to the size of the weights, under which training ends.
ENOUGH = 1e-9


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[int, np.ndarray]], width: int) -> dict[int, np.ndarray]:
    """Sums of part(x, y, fold), an array of width numbers for each model, over all rows (x, y, fold)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x, y = (np.array(batch.column(c).to_pylist(), np.float64) for c in (0, 1))
                for model, found in part(x, y, batch.column(2).to_numpy()).items():
                    held[model] = held.get(model, 0) + found
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(np.zeros(len(held)), pa.int32()), pa.array([v.astype("<f8").tobytes() for v in held.values()], pa.binary())], names=["model", "salt", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for model, salt, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[model, salt] = held.get((model, salt), np.zeros(width)) + np.frombuffer(sums, "<f8")
        yield pa.RecordBatch.from_arrays([pa.array([k[n] for k in held], pa.int32()) for n in (0, 1)] + [pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["model", "salt", "sums"])

    schema = "model int, salt int, sums binary"
    salted = rows.select("x", "y", "fold").mapInArrow(each, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)).cast("int"))
    once = salted.repartition("model", "salt").mapInArrow(add, schema).withColumn("salt", F.lit(0))
    return {r["model"]: np.frombuffer(r["sums"], "<f8") for r in once.repartition("model").mapInArrow(add, schema).collect()}


@dataclass
class Heads:
    """Weights (with the bias last) of each head trained without each fold, the last one with all; and a curve (a, b) for each of these."""

    weights: np.ndarray
    able: np.ndarray  # whether both classes were there
    curves: np.ndarray


def _newton(rows: DataFrame, dim: int, heads: int, folds: int, c: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    models, d = (folds + 1) * heads, dim + 1

    def counts(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> dict[int, np.ndarray]:
        return {f * heads + h: np.array([(y[fold != f, h] == 1).sum(), (y[fold != f, h] == 0).sum()], float) for f in range(folds + 1) for h in range(heads)}

    seen = np.zeros((models, 2))
    for m, v in _summed(rows, counts, 2).items():
        seen[m] = v
    able = (seen > 0).all(1)
    balance = np.where(seen > 0, seen.sum(1, keepdims=True) / (2 * np.maximum(seen, 1)), 0.0)
    w = np.zeros((models, d))
    penalty = np.append(np.full(dim, 1 / c), 0.0)  # the bias is free
    for _ in range(steps):
        now = w.copy()

        def slopes(x: np.ndarray, y: np.ndarray, fold: np.ndarray, now: np.ndarray = now) -> dict[int, np.ndarray]:
            wide, out = np.concatenate([x, np.ones((len(x), 1))], 1), {}
            for f in range(folds + 1):
                use = fold != f
                for h in range(heads):
                    m = f * heads + h
                    if not able[m]:
                        continue
                    own = use & ~np.isnan(y[:, h])
                    a, t = wide[own], y[own, h]
                    p = sigmoid(a @ now[m])
                    by = np.where(t == 1, balance[m, 0], balance[m, 1])
                    out[m] = np.concatenate([a.T @ (by * (p - t)), (a.T @ (a * (by * np.maximum(p * (1 - p), 1e-12))[:, None])).ravel()])
            return out

        moved = 0.0
        for m, v in _summed(rows, slopes, d + d * d).items():
            step = np.linalg.solve(v[d:].reshape(d, d) + np.diag(penalty + 1e-12), v[:d] + penalty * w[m])
            w[m] -= step
            moved = max(moved, float((step**2).sum() / max((w[m] ** 2).sum(), 1e-12)))
        if moved < ENOUGH:
            break
    return w.reshape(folds + 1, heads, d), able.reshape(folds + 1, heads)


def trained(rows: DataFrame, folds: int = FOLDS, c: float = C, steps: int = STEPS) -> Heads:
    """Heads of rows (x: features, y: for each head 1, 0 or null, fold from 0). A head that has one class only, without some fold, isn't able there.

    A curve is fitted to the margins that rows have out of fold, with the targets of Platt: that of a fold on the others, the last one on all.
    """
    first = rows.select(F.size("x").alias("d"), F.size("y").alias("h")).first()
    if first is None:
        return Heads(np.zeros((folds + 1, 0, 1)), np.zeros((folds + 1, 0), bool), np.zeros((folds + 1, 0, 2)))
    dim, heads = first
    w, able = _newton(rows, dim, heads, folds, c, steps)
    curves = np.tile([1.0, 0.0], (folds + 1, heads, 1))
    targets: dict[int, np.ndarray] = {}

    def counts(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> dict[int, np.ndarray]:
        return {f * heads + h: np.array([(y[fold != f, h] == 1).sum(), (y[fold != f, h] == 0).sum()], float) for f in range(folds + 1) for h in range(heads)}

    for m, (pos, neg) in _summed(rows, counts, 2).items():
        targets[m] = np.array([(pos + 1) / (pos + 2), 1 / (neg + 2)])
    for _ in range(steps):
        now = curves.copy()

        def slopes(x: np.ndarray, y: np.ndarray, fold: np.ndarray, now: np.ndarray = now) -> dict[int, np.ndarray]:
            wide = np.concatenate([x, np.ones((len(x), 1))], 1)
            margin = np.einsum("nd,nhd->nh", wide, w[fold])  # of the heads that haven't seen the row's fold
            out = {}
            for f in range(folds + 1):
                for h in range(heads):
                    own = (fold != f) & ~np.isnan(y[:, h]) & able[fold, h]
                    z, t = margin[own, h], np.where(y[own, h] == 1, *targets[f * heads + h])
                    p = sigmoid(now[f, h, 0] * z + now[f, h, 1])
                    g, k = p - t, np.maximum(p * (1 - p), 1e-12)
                    out[f * heads + h] = np.array([(g * z).sum(), g.sum(), (k * z * z).sum(), (k * z).sum(), k.sum()])
            return out

        moved = 0.0
        for m, (ga, gb, aa, ab, bb) in _summed(rows, slopes, 5).items():
            step = np.linalg.solve(np.array([[aa + 1e-6, ab], [ab, bb + 1e-6]]), np.array([ga, gb]))
            step = np.clip(step, -4, 4)
            curves[m // heads, m % heads] -= step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-8:
            break
    return Heads(w, able, curves)


def folded(rows: DataFrame, group: str, folds: int = FOLDS) -> DataFrame:
    """rows with fold: all rows of a group have the same."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds)).cast("int"))


def out_of_fold_scores(rows: DataFrame, row_id: str = "id", group: str | None = None, features: str = "x", labels: str = "y", folds: int = FOLDS, c: float = C, steps: int = STEPS) -> DataFrame:
    """id, head, fold, label, score of each row and head: the calibrated value of a head, and a curve, that haven't seen the row's group. A null score where the head had one class only.

    Rows without features or labels are left out; a null among the labels takes no part in that head's training, but has a score.
    """
    use = folded(rows.where(F.col(features).isNotNull() & F.col(labels).isNotNull()), group or row_id, folds)
    slim = use.select(F.col(row_id).alias("id"), F.col(features).cast("array<double>").alias("x"), F.col(labels).cast("array<double>").alias("y"), "fold")
    known = trained(slim, folds, c, steps)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = known.weights.shape[1]
        for batch in batches:
            n, fold = batch.num_rows, batch.column(3).to_numpy()
            if not n:
                continue
            x, y = (np.array(batch.column(k).to_pylist(), np.float64) for k in (1, 2))
            margin = np.einsum("nd,nhd->nh", np.concatenate([x, np.ones((n, 1))], 1), known.weights[fold])
            p = sigmoid(known.curves[fold, :, 0] * margin + known.curves[fold, :, 1])
            row, head = np.repeat(np.arange(n), heads), np.tile(np.arange(heads), n)
            label = y.ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(head, pa.int32()), pa.array(fold[row], pa.int32()), pa.array(label, mask=np.isnan(label)), pa.array(p.ravel(), mask=~known.able[fold].ravel())],
                names=["id", "head", "fold", "label", "score"],
            )

    return slim.mapInArrow(score, f"id {slim.schema['id'].dataType.simpleString()}, head int, fold int, label double, score double")


def cv_auc(scores: DataFrame) -> DataFrame:
    """head, n, auc: of pairs of a positive and a negative row, the share in which the positive has the higher score, ties half. Null for one class only."""
    each = scores.where("score is not null and label is not null").groupBy("head", "score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("head").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    won = each.withColumn("won", F.col("pos") * (below + F.col("neg") / 2)).groupBy("head").agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return won.select("head", (F.col("pos") + F.col("neg")).cast("long").alias("n"), F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("won") / (F.col("pos") * F.col("neg"))).alias("auc"))
