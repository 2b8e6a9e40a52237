"""Small operators that no query has alone, by hand-made cases."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import build, governance, intake, metrics, scoring, spans, speech, vectors


def test_reports(spark):
    rows = spark.createDataFrame([("c1", "give me the code", 80, ["t1"], ["the code", "nowhere"], 5, datetime.datetime(2024, 1, 1))], "content_id string, text string, risk_score int, tactic_ids array<string>, phrases array<string>, number int, ts timestamp")
    r = intake.report_incidents(rows).first()
    assert r["id"] == "live-c1" and r["risk"] == 0.8 and r["tags"][0]["id"] == "t1" and [tuple(s) for s in r["spans"]] == [(8, 16, "the code")]
    told = spark.createDataFrame([("r2", "a", 1), ("r1", "a", 1), ("r0", "b", 1)], "receipt_id string, source string, n int")
    assert intake.receipt(told, source="a", n=1).first()["receipt_id"] == "r1" and intake.receipt(told, source="z").count() == 0
    risky = spark.createDataFrame([(0.5, False), (0.49, False), (0.9, True)], "risk double, is_hard_negative boolean")
    assert intake.positives(risky).count() == 1
    label = spark.createDataFrame([("a", "a"), ("b", "a")], "id string, component string")
    assert {r["id"]: r["org"] for r in intake.placements(spark.createDataFrame([("a",), ("b",), ("z",)], "id string"), label).collect()} == {"a": "a", "b": "a", "z": "unassigned"}
    at = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 12),)], "ts timestamp").select(intake.utc(F.col("ts"), "Asia/Almaty").alias("u"), "ts").first()
    assert at["ts"] - at["u"] in (datetime.timedelta(hours=5), datetime.timedelta(hours=6))


def test_columns(spark):
    df = spark.createDataFrame([([(0, 3), (4, 9)], "id-1", [1.0], [2.0, 3.0], ["b", "a"], ["a", "c"])], "s array<struct<start:int,end:int>>, i string, x array<double>, y array<double>, p array<string>, q array<string>")
    kept, hidden = spans.visible(F.col("s"), F.lit(5))
    r = df.select(kept.alias("k"), hidden.alias("h"), scoring.hybrid(F.col("x"), F.col("y")).alias("v"), scoring.role_line("{role}: {span}", F.lit("bank"), F.col("i")).alias("l"), governance.merge_sets(F.col("p"), F.col("q")).alias("m"), build.base_id(F.concat("i", F.lit(build.SUFFIX))).alias("b")).first()
    assert len(r["k"]) == 1 and r["h"] == 1 and r["v"] == [1.0, 2.0, 3.0] and r["l"] == "bank: id-1" and r["m"] == ["a", "b", "c"] and r["b"] == "id-1"


def test_frames():
    assert speech.frames_of([0.0] * 4 + [1.0, -1.0, 1.0, -1.0], 4, 8) == [(-100.0, 0.0), (0.0, 6.0)]


def test_intervals_in_batches(spark):
    df = spark.createDataFrame([(0, 10), (5, 10), (5, 10), (10, 10), (None, 3), (0, 0), (1, None)], "k int, n int")
    for r in metrics.with_interval(df, "k", "n").collect():
        want = metrics.clopper_pearson(r["k"], r["n"])
        assert (r["low"], r["high"]) == (pytest.approx(want) if want else (None, None))


def test_verdicts_find_their_organization(spark):
    orgs = spark.createDataFrame([("o1", 1, ["n1"], ["a", "b", "c"]), ("o2", 2, ["n2", "n1"], ["d"]), ("o3", 3, [], ["e", "f", "g", "h"])], "org string, place int, numbers array<string>, members array<string>")
    events = spark.createDataFrame([(1, ["n1"], ["d"]), (2, [], ["d", "a", "b"]), (3, [], ["e", "x", "y"]), (4, ["zz"], ["e", "f"]), (5, [], [])], "event_id long, snapshot_numbers array<string>, snapshot_members array<string>")
    assert {r["event_id"]: r["org"] for r in governance.match_verdict(events, orgs).collect()} == {1: "o1", 2: "o1", 4: "o3"}


@pytest.mark.parametrize("block", [7, 1024])
def test_nearest_in_group_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = [(i, [0, 0, 0, 1, 2][i % 5], list(map(float, rng.normal(size=4)))) for i in range(90)] + [(200, 9, [1.0, 0.0, 0.0, 0.0]), (201, 2, [0.0] * 4), (202, None, [1.0] * 4), (203, 1, None)]
    got = {r["vec_id"]: r["best"] for r in vectors.nearest_in_group(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)).collect()}
    for i, g, v in rows:
        others = [np.array(w) for j, h, w in rows if j != i and h == g and h is not None and w is not None and v is not None]
        cos = [0.0 if not (np.any(w) and np.any(v)) else float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) for w in others]
        assert got[i] == pytest.approx(max(cos, default=-1.0))
    assert len(got) == len(rows)
