"""Versions of tables, and reports that are ingested as a stream into them."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import intake
from tallyloom.sources import versions
from tallyloom.streaming import ingest_stream

REPORTS = "content_id string, number long, ts timestamp, `order` long"


def numbers(spark, *n):
    return spark.createDataFrame([(x,) for x in n], "n long")


def seen(spark, store, table="t"):
    found = store.latest()
    return sorted(r[0] for r in found.read(spark, table).collect()) if found else None


def test_readers_see_old_or_new(spark, tmp_path):
    store = versions.Versions(spark, f"file://{tmp_path}/s")
    assert store.latest() is None
    store.commit({"t": numbers(spark, 0), "u": numbers(spark)})
    got, wrong, stop = set(), [], threading.Event()

    def read():
        own = versions.Versions(spark, f"file://{tmp_path}/s")
        while not stop.is_set():
            try:
                got.add(tuple(seen(spark, own)))
            except Exception as error:  # noqa: BLE001  whatever a reader sees that it shouldn't
                wrong.append(error)

    readers = [threading.Thread(target=read) for _ in range(2)]
    [t.start() for t in readers]
    for k in range(1, 8):
        store.commit({"t": numbers(spark, *range(k + 1)), "u": numbers(spark, k)})
    stop.set()
    [t.join() for t in readers]
    assert not wrong and got <= {tuple(range(k + 1)) for k in range(8)} and len(got) > 1
    held = store.at(3)
    assert sorted(r[0] for r in held.read(spark, "t").collect()) == [0, 1, 2] and [r[0] for r in held.read(spark, "u").collect()] == [2]
    assert store.clear(2) == 6 and seen(spark, store) == list(range(8))
    with pytest.raises(ValueError, match="no version 3"):
        store.at(3)


def test_writers_at_once(spark, tmp_path):
    paths = [versions.Versions(spark, f"file://{tmp_path}/s") for _ in range(4)]
    base = paths[0].commit({"t": numbers(spark, 0)})
    out = []

    def write(store, k):
        try:
            out.append(store.commit({"t": numbers(spark, k)}, based_on=base).number)
        except versions.Conflict:
            out.append(None)

    writers = [threading.Thread(target=write, args=(s, k)) for k, s in enumerate(paths)]
    [t.start() for t in writers]
    [t.join() for t in writers]
    assert sorted(out, key=str) == [2, None, None, None]
    # without a base all are kept, one after the other; with one token the first counts
    writers = [threading.Thread(target=lambda s=s: s.commit({"t": numbers(spark, 9)})) for s in paths]
    [t.start() for t in writers]
    [t.join() for t in writers]
    assert paths[0].latest().number == 6
    assert [paths[0].commit({"t": numbers(spark, k)}, token="b1").number for k in (1, 2)] == [7, 7] and seen(spark, paths[0]) == [1]


def test_claims_that_are_never_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "WAIT", 0.2)
    store = versions.Versions(spark, f"file://{tmp_path}/s")
    store.commit({"t": numbers(spark, 1)})
    (tmp_path / "s" / "_versions" / "000000000002").write_text("")  # a writer that died
    assert seen(spark, store) == [1]
    assert store.commit({"t": numbers(spark, 2)}).number == 3 and seen(spark, store) == [2]


def test_lost_files_are_an_error(spark, tmp_path):
    store = versions.Versions(spark, f"file://{tmp_path}/s")
    found = store.commit({"t": numbers(spark, 1, 2, 3).repartition(3)})
    next((tmp_path / "s").glob("data-*/t/part-*.parquet")).unlink()
    with pytest.raises(ValueError, match="rows instead of 3"):
        found.read(spark, "t")


def test_checked_embeddings_and_call_tables(spark):
    schema = "id string, embedding array<double>"
    good = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], schema)
    assert versions.checked_embeddings(good).count() == 2 and versions.checked_embeddings(good.limit(0)).count() == 0
    for row in (("a", [5.0, 6.0]), (None, [5.0, 6.0]), ("c", [5.0]), ("c", None), ("c", [None, 1.0])):
        with pytest.raises(ValueError):
            versions.checked_embeddings(good.unionByName(spark.createDataFrame([row], schema)))
    calls = spark.createDataFrame([("c1", "hello", "8 701 234 56 78"), ("c2", None, None), ("c3", "x", "12")], "call_id string, text string, caller_number string")
    kept = versions.call_tables(calls, b"key")
    assert "caller_number" not in kept["dialogues"].columns and kept["dialogues"].count() == 3
    assert [r["call_id"] for r in kept["numbers"].collect()] == ["c1"]


def embed(rows):
    embed.asked.append(rows.count())
    return rows.select("id", F.array(F.length("id").cast("double"), F.lit(1.0)).alias("embedding"))


def make(rng, n):
    return [(f"c{rng.randrange(40):02d}", rng.choice([None, *range(12)]), None if rng.random() < 0.1 else 1000 + k, k) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "content_id string, number long, s long, `order` long").selectExpr("content_id", "number", "timestamp_seconds(s) as ts", "`order`")


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_gives_one_batch(spark, tmp_path, seed):
    """A report's content counts with the number it first comes with, so reports of one content are alike here but for their time."""
    rng = random.Random(seed)
    first = {}
    rows = [(c, first.setdefault(c, n), s, k) for c, n, s, k in make(rng, 60)]
    empty = spark.createDataFrame([], "id string, number long, ts timestamp")
    want = {(r["id"], r["component"]) for r in intake.ingest(frame(spark, rows), empty)[1].collect()}
    assert len(want) > 20 and len({c for _, c in want}) < len(want)
    embed.asked = []
    store = versions.Versions(spark, f"file://{tmp_path}/s")
    size = rng.choice([13, 25])
    for k in range(0, len(rows), size):
        ingest_stream.ingest_batch(store, frame(spark, rows[k : k + size]), f"b{k}", embed)
    last = store.latest()
    assert {(r["id"], r["component"]) for r in last.read(spark, "label").collect()} == want
    assert sum(embed.asked) == len(want) == last.read(spark, "embeddings").count()  # each once
    again = ingest_stream.ingest_batch(store, frame(spark, rows[:size]), "b0", embed)
    assert again == last
    # the same reports in a new batch change nothing either
    other = ingest_stream.ingest_batch(store, frame(spark, rows[:size]), "b-new")
    assert {(r["id"], r["component"]) for r in other.read(spark, "label").collect()} == want


def test_stream_of_reports(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, int(c[1:]) % 9, s, k) for c, _, s, k in make(rng, 40)]
    for k in range(0, 40, 20):
        frame(spark, rows[k : k + 20]).coalesce(1).write.parquet(f"{tmp_path}/in/{k:02d}")
    store = versions.Versions(spark, f"file://{tmp_path}/s")
    for _ in range(2):  # the second run finds all done
        stream = spark.readStream.schema(REPORTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = ingest_stream.start(stream, store, f"{tmp_path}/c")
        q.awaitTermination(240)
        assert q.exception() is None
    assert store.latest().number == 2
    want = {(r["id"], r["component"]) for r in intake.ingest(frame(spark, rows), spark.createDataFrame([], "id string, number long, ts timestamp"))[1].collect()}
    assert {(r["id"], r["component"]) for r in store.latest().read(spark, "label").collect()} == want


def test_embeddings_are_rebuilt_when_ids_differ(spark):
    incidents = spark.createDataFrame([("a",), ("bb",), ("ccc",)], "id string")
    new = incidents.where("id = 'ccc'")
    cached = spark.createDataFrame([("a", [9.0]), ("bb", [9.0])], "id string, embedding array<double>")
    made = lambda rows: rows.select("id", F.array(F.lit(1.0)).alias("embedding"))
    values = lambda cache: sorted((r["id"], r["embedding"][0]) for r in intake.extended(cache, incidents, new, made).collect())
    assert values(cached) == [("a", 9.0), ("bb", 9.0), ("ccc", 1.0)]
    assert values(cached.where("id = 'a'")) == values(cached.unionByName(spark.createDataFrame([("zz", [9.0])], cached.schema))) == [("a", 1.0), ("bb", 1.0), ("ccc", 1.0)]
