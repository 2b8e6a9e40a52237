"""Spans in texts, turns as arrays, labels, and what is told of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verbatim(text: Column, spans: Column) -> Column:
    """Whether every span (text, start, end; code points) is what stands there."""
    return F.forall(spans, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]) == s["text"])


def first_places(text: Column, phrases: Column) -> Column:
    """text, start and end of the first place of each phrase that the text has, in the order of phrases; blank ones are left out."""
    found = F.transform(phrases, lambda p: F.struct(p.alias("text"), (F.position(p, text) - 1).cast("int").alias("start"), (F.position(p, text) - 1 + F.length(p)).cast("int").alias("end")))
    return F.filter(found, lambda s: (s["start"] >= 0) & (F.trim(s["text"]) != ""))


def split_turns(turns: Column, clean: Column | None = None) -> Column:
    """Turns (speaker, text) with those that hold line ends split, speakers alternating from the first, and empty ones dropped."""

    def one(t: Column) -> Column:
        lines = F.filter(F.split(t["text"], r"\n+"), lambda x: F.trim(x) != "")
        other = F.when(t["speaker"] == "caller", "callee").otherwise("caller")
        return F.transform(lines, lambda x, i: F.struct(F.when(i % 2 == 0, t["speaker"]).otherwise(other).alias("speaker"), F.trim(x).alias("text")))

    return F.flatten(F.transform(turns, one))


def excerpt(text: Column, most: int = 200) -> Column:
    """The first most characters, or half of a shorter text, with an ellipsis."""
    return F.concat(F.substring(text, F.lit(1), F.least(F.lit(most), F.floor(F.length(text) / 2)).cast("int")), F.lit("…"))


def visible(spans: Column, limit: Column) -> tuple[Column, Column]:
    """The spans that end within the limit, and how many don't."""
    kept = F.filter(spans, lambda s: s["end"] <= limit)
    return kept, F.size(spans) - F.size(kept)


def overlapping(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def migrate_tags(tags: Column, successors: dict[str, list[str]], roles: Column) -> Column:
    """Tags with each that has successors replaced by those among roles, or by its first one; each once."""

    def one(t: Column) -> Column:
        out = F.array(t)
        for old, new in successors.items():
            fit = F.array_intersect(F.array(*map(F.lit, new)), roles)
            out = F.when(t == old, F.when(F.size(fit) > 0, fit).otherwise(F.array(F.lit(new[0])))).otherwise(out)
        return out

    return F.array_distinct(F.flatten(F.transform(tags, one)))


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails; null if none does."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks), F.lit(None).cast("string"))


def client_key(forwarded: Column, hops: int) -> Column:
    """The hops-th address from the right of a list of proxies, or the first if there are fewer."""
    parts = F.transform(F.split(forwarded, ","), lambda x: F.trim(x))
    return F.element_at(parts, -F.least(F.lit(hops), F.size(parts)))


def tune_thresholds(rows: DataFrame, default: float = 0.5, grid: tuple[float, ...] = (0.5, 0.55, 0.6, 0.65, 0.7), least: int = 8) -> DataFrame:
    """tactic, threshold: of a grid the one with the best F1, ties to the lowest; default with fewer than least positives. rows: tactic, p, truth."""
    each = rows.withColumn("t", F.explode(F.array(*map(F.lit, grid))))
    said = F.col("p") >= F.col("t")
    counts = each.groupBy("tactic", "t").agg(F.sum(F.when(said & (F.col("truth") == 1), 1).otherwise(0)).alias("tp"), F.sum(F.when(said & (F.col("truth") == 0), 1).otherwise(0)).alias("fp"), F.sum(F.when(~said & (F.col("truth") == 1), 1).otherwise(0)).alias("fn"))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 12)).otherwise(0.0)
    best = Window.partitionBy("tactic").orderBy(F.desc("f1"), "t")
    top = counts.withColumn("f1", f1).withColumn("n", F.row_number().over(best)).where("n = 1")
    return top.select("tactic", F.when(F.col("tp") + F.col("fn") >= least, F.col("t")).otherwise(default).alias("threshold"))


def positive_weight(rows: DataFrame, truth: str = "truth") -> DataFrame:
    """weight: negatives for each positive; 1 without positives."""
    p, n = F.sum(F.col(truth)), F.sum(1 - F.col(truth))
    return rows.agg(F.when(p > 0, n / p).otherwise(1.0).alias("weight"))


def subsample_interval(pairs: DataFrame, draws: int = 20, share: float = 0.8, seed: int = 0) -> DataFrame:
    """low, high of purity over subsamples by hash: a row is in a draw if its hash with the draw is under share. pairs: id, truth, cluster."""
    drawn = pairs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("id").cast("string")), 256), 1, 12), 16, 10).cast("double") / float(16**12)
    cells = drawn.where(u < share).groupBy("draw", "cluster", "truth").agg(F.count(F.lit(1)).alias("n")).groupBy("draw", "cluster").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    each = cells.groupBy("draw").agg((F.sum("top") / F.sum("n")).alias("purity"))
    return each.agg(F.round(F.percentile("purity", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("purity", F.lit(0.975)), 6).alias("high"))


def trained_head(rows: DataFrame, vector: str, truth: str, reg: float = 0.01):
    """A balanced logistic model over an array column, by Spark's own trainer: its coefficients and intercept."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    weight = positive_weight(rows, truth).first()["weight"]
    data = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("x"), F.col(truth).cast("double").alias("y"), F.when(F.col(truth) == 1, F.lit(float(weight))).otherwise(1.0).alias("w"))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=reg, maxIter=50).fit(data)
    return list(map(float, model.coefficients)), float(model.intercept)
