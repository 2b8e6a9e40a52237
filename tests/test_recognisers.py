"""Matching of recognisers over a stream: against a plain replay, in any cut and order."""

import random

import pytest

from tallyloom.streaming.meter_stream import metered
from tallyloom.streaming.recognisers import Call, best, utterances

SCHEMA = "call long, ts timestamp, language string, final boolean, text string, confidence double"
LANGS = ["a", "b"]


def run(spark, tmp_path, batches, name):
    for k, rows in enumerate(batches):
        told = spark.createDataFrame([(c, ms, lang, final, text, conf) for c, ms, lang, final, text, conf in rows], "call long, ms long, language string, final boolean, text string, confidence double")
        told.selectExpr("call", "timestamp_millis(ms) as ts", "language", "final", "text", "confidence").coalesce(1).write.parquet(f"{tmp_path}/{name}/in/{k:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        q = utterances(stream, LANGS).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}/c").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        return sorted(map(tuple, spark.table(name).where("call >= 0").collect())), q
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


#: Moves the watermark on, after all others.
LAST = (-1, 10_000_000, "a", True, "", 0.0)


def test_late_missing_and_repeated(spark, tmp_path):
    first = [(1, 1000, "a", True, "sälem", 0.9), (1, 1400, "b", True, "salem", 0.8)]  # both in time
    second = [(1, 9000, "b", True, "privet", 0.7), (1, 8900, "a", False, "pri", 0.4)]  # one is missing: its partial stands in
    third = [(1, 10_900, "a", True, "pri vet", 0.99), (1, 14_000, "a", True, "again", 0.6)]  # too late, then new and alone
    fourth = [(1, 20_000, "a", True, "one", 0.5), (1, 20_300, "a", True, "two", 0.5), (1, 20_400, "b", True, "deux", 0.51)]  # one speaks twice
    other = [(2, 1000, "b", True, "", 0.9), (2, 1100, "a", True, "word", 0.1), (2, 30_000, "b", False, "never final", 0.9), (None, 5000, "a", True, "x", 0.5), (2, 40_000, "zz", True, "x", 0.5)]
    got, q = run(spark, tmp_path, [first + other[:1], other[1:2] + second, third, fourth + other[2:], [LAST]], "late")
    assert got == [
        (1, "a", "again", 0.6, 14_000, 15_200),
        (1, "a", "one", 0.5, 20_000, 20_300),
        (1, "a", "sälem", 0.9, 1000, 1400),
        (1, "a", "two", 0.5, 20_300, 20_400),
        (1, "b", "privet", 0.7, 9000, 10_200),
        (2, "a", "word", 0.1, 1000, 1100),
    ]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # of the last event alone


def test_any_cut_and_order_within_lateness(spark, tmp_path):
    rng = random.Random(3)
    events = [(c, 50_000 + rng.randrange(20_000), rng.choice(LANGS), rng.random() < 0.6, rng.choice(["x", "y", "z", ""]), round(rng.random(), 2)) for c in range(4) for _ in range(25)]
    want = []
    for c in range(4):
        call = Call(LANGS)
        for e in sorted(e[1:] for e in events if e[0] == c):
            want += [(c, *u) for u in call.take(*e)]
        want += [(c, *u) for u in call.until(10**9)]
    for name, size in (("cut1", 100), ("cut2", 30)):
        near = sorted(events, key=lambda e: e[1] + rng.randrange(2000))  # out of order by less than the lateness
        got, _ = run(spark, tmp_path, [*[near[k : k + size] for k in range(0, len(near), size)], [LAST]], name)
        assert got == sorted(want) and len(got) > 20


@pytest.mark.parametrize(("said", "won"), [({}, None), ({"a": ("", 1.0)}, None), ({"a": ("x", 0.5), "b": ("y", 0.51)}, "a"), ({"a": ("x", 0.5), "b": ("y", 0.6)}, "b"), ({"a": ("", 0.9), "b": ("y", -1.0)}, "b")])
def test_best(said, won):
    assert best(said, LANGS) == won


def test_meter_forgets_calls_that_are_over(spark, tmp_path):
    """A call that goes on after its state has gone begins anew; one within the time goes on."""
    batches = [[(1, 1, 0), (2, 1, 0)], [(9, 1, 3000)], [(9, 2, 3001)], [(1, 2, 3002), (2, 2, 3003), (9, 3, 3004)]]
    for k, rows in enumerate(batches):
        told = spark.createDataFrame([(c, t, 0.9, 1.0, "", s) for c, t, s in rows], "conv_id long, turn int, risk double, conf double, ids string, s long")
        told.selectExpr("conv_id", "turn", "risk", "conf", "ids", "timestamp_seconds(1000000 + s) as ts").coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    schema = "conv_id long, turn int, risk double, conf double, ids string, ts timestamp"
    for idle, again in ((1_000_000, 1), (10_000_000, 2)):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = metered(stream, "ts", "1 seconds", idle).writeStream.format("memory").queryName(f"idle{again}").outputMode("append").option("checkpointLocation", f"{tmp_path}/c{again}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {(r["conv_id"], r["turn"]) for r in spark.table(f"idle{again}").collect()}
        assert got == {(1, 1), (2, 1), (9, 1), (9, 2), (9, 3)} | {(1, again), (2, again)}
