"""Can a simple model tell which of two sources wrote a text? Characters' n-grams by TF-IDF, a linear model, and its AUC out of fold."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.heads import cv_auc, folded
from tallyloom.sources.shared import drop_but, written, written_tables

#: Places that n-grams are hashed to, and the lengths of n-grams.
PLACES, SHORTEST, LONGEST = 1 << 18, 2, 4
FOLDS, ROUNDS, RIDGE = 3, 60, 1e-3


def gram_counts(rows: DataFrame, text: str = "text", places: int = PLACES) -> DataFrame:
    """rows with tf: how often the text has each hashed n-gram of SHORTEST to LONGEST characters, in lower case."""
    chars = rows.withColumn("_chars", F.split(F.lower(F.coalesce(text, F.lit(""))), ""))
    grams = []
    for n in range(SHORTEST, LONGEST + 1):
        chars = NGram(n=n, inputCol="_chars", outputCol=f"_{n}").transform(chars)
        grams.append(f"_{n}")
    whole = chars.withColumn("_all", F.concat(*grams))
    return HashingTF(numFeatures=places, inputCol="_all", outputCol="tf").transform(whole).drop("_chars", "_all", *grams)


def probe_scores(rows: DataFrame, label: str = "label", group: str = "id", text: str = "text", folds: int = FOLDS, places: int = PLACES) -> DataFrame:
    """id, head (0), fold, label, score: the probability of label 1 that a model gives which hasn't seen the row's group, nor counted its documents. Rows without a label are left out."""
    known = written_tables()
    use = folded(rows.where(F.col(label).isNotNull()), group, folds).select(F.col("id"), F.col(label).cast("double").alias("label"), "fold", F.col(text).alias("text"))
    counted = written(gram_counts(use, places=places).drop("text"), "gram-counts")
    out = None
    for fold in range(folds):
        seen = counted.where(F.col("fold") != fold)
        if seen.select("label").distinct().limit(2).count() < 2:
            continue
        idf = IDF(minDocFreq=1, inputCol="tf", outputCol="weighed").fit(seen)
        unit = Normalizer(inputCol="weighed", outputCol="features")
        model = LogisticRegression(maxIter=ROUNDS, regParam=RIDGE, standardization=False, labelCol="label").fit(unit.transform(idf.transform(seen)))
        done = model.transform(unit.transform(idf.transform(counted.where(F.col("fold") == fold))))
        part = done.select("id", F.lit(0).alias("head"), "fold", "label", vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = counted.select("id", F.lit(0).alias("head"), "fold", "label", F.lit(None).cast("double").alias("score"))
    found = written(out, "probe-scores")
    drop_but(rows.sparkSession, known, found)
    return found


def generator_probe(rows: DataFrame, label: str = "label", group: str = "id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """n, auc of probe_scores(): about a half where the sources can't be told."""
    return cv_auc(probe_scores(rows, label, group, text, folds)).select("n", "auc")
