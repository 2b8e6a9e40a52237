"""Text functions, metrics, sources and governance by hand-computed cases."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import corpus, governance, linking, live, metrics, rules, vectors
from tallyloom.sources import records
from tallyloom.streaming import meter_stream


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


SCRUBBED = [
    ("write to a.b+c@mail.example.org now", "write to [EMAIL] now"),
    ("IBAN KZ86 125K ZT50 0410 0100 x", "IBAN [IBAN] x"),
    ("card 4400 1234 5678 9010 and 4400123456789010.", "card [CARD] and [CARD]."),
    ("id 940101300123", "id [IIN]"),
    ("call +7 (701) 123-45-67 or 87011234567", "call [PHONE] or [PHONE]"),
    ("abroad +44 20 7946 0958 it is", "abroad [PHONE] it is"),
    ("local (701) 123-45-67", "local [PHONE]"),
    ("paid 5000 and 123456", "paid 5000 and 123456"),
    ("digest a4400123456789010", "digest a4400123456789010"),
    ("", ""),
]


@pytest.mark.parametrize("text,want", SCRUBBED)
def test_scrub(spark, text, want):
    assert one(spark, tx.scrub(F.col("t")), t=text) == want
    assert one(spark, tx.scrub(F.col("t")), t=want) == want


def test_hashes(spark):
    import hashlib

    assert one(spark, tx.keyed_hash(F.col("t"), b"k" * 70), t="+7 701 123 45 67") == tx.reference_keyed_hash("77011234567", b"k" * 70)
    assert one(spark, tx.keyed_hash(F.col("t"), b"key"), t="123") is None
    with pytest.raises(ValueError):
        tx.keyed_hash(F.col("t"), b"")
    for row_id in ("a", "row 7", "x" * 50):
        u = int(hashlib.sha256(f"3:{row_id}".encode()).hexdigest(), 16) % 10**6 / 10**6
        assert one(spark, tx.assign_split(F.col("t"), seed=3), t=row_id) == ("train" if u < 0.7 else "val" if u < 0.85 else "test")


def test_clean_and_corrupted(spark):
    assert one(spark, tx.clean(F.col("t")), t='  "he said  this\r\n and  that" ') == "he said this\nand that"
    assert one(spark, tx.clean(F.col("t")), t='"left open') == "left open"
    assert one(spark, tx.corrupted(F.col("t")), t="ab\x01c") and one(spark, tx.corrupted(F.col("t")), t="a\nb") and not one(spark, tx.corrupted(F.col("t")), t="a \n b")


def test_lcs_against_the_table():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert tx.lcs_length(a, b) == row[-1]


def test_find_phrase():
    assert tx.find_phrase("Say the CODE now", "the code") == (4, 12)
    assert tx.find_phrase("short cut", "shirt cut") is None  # too short for an edit
    text = "well\nplease transfer al the money to me"
    start, end = tx.find_phrase(text, "transfer all the money")
    assert text[start:end] == "transfer al the money"
    assert tx.find_phrase("transfer all\nthe money", "transfer all the moneys") is None  # never across lines
    assert tx.find_phrase("", "x") is None


def test_phrases_in_spark(spark):
    df = spark.createDataFrame([(1, "please transfer al the money"), (2, "nothing"), (3, None)], "id int, text string")
    got = {r["id"]: [(h["tactic"], h["start"], h["end"]) for h in r["hits"]] for r in rules.match_phrases(df, [("pay", "transfer all the money"), ("no", "nothing")]).collect()}
    assert got == {1: [("pay", 7, 28)], 2: [("no", 0, 7)], 3: []}


def test_components_of_chains_rings_and_lone_records(spark):
    keys = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, None), (5, "c"), (6, "c"), (6, "d"), (7, "d"), (5, "d")] + [(10 + k, f"k{k}") for k in range(30)] + [(11 + k, f"k{k}") for k in range(30)]
    got = dict(linking.link_by_shared_keys(spark.createDataFrame(keys, "id int, key string")).collect())
    assert {got[k] for k in (1, 2, 3)} == {1} and got[4] == 4 and {got[k] for k in (5, 6, 7)} == {5} and {got[k] for k in range(10, 41)} == {10}


def test_intervals():
    low, high = metrics.clopper_pearson(22, 417)
    assert (round(low, 3), round(high, 3)) == (0.033, 0.079)
    low, high = metrics.clopper_pearson(187, 411)
    assert (round(low, 3), round(high, 3)) == (0.406, 0.504) or (round(low, 3), round(high, 3)) == (0.406, 0.505)
    assert metrics.clopper_pearson(0, 10)[0] == 0.0 and metrics.clopper_pearson(10, 10)[1] == 1.0 and metrics.clopper_pearson(0, 0) is None
    assert metrics.upper_bound(0, 20) == pytest.approx(1 - 0.05 ** (1 / 20)) and metrics.upper_bound(0, 0) is None


def test_metrics_on_empty_and_one_class(spark):
    empty = spark.createDataFrame([], "id long, truth int, score double")
    assert metrics.average_precision(empty).first()["pr_auc"] == 0.0
    same = spark.createDataFrame([(1, 1, 0.2), (2, 1, 0.9)], "id long, truth int, score double")
    assert metrics.average_precision(same).first()["pr_auc"] == 0.0 and metrics.roc_auc(same).first()["roc_auc"] is None
    pairs = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "truth int, cluster int")
    assert metrics.adjusted_rand(pairs).first()["ari"] == 1.0 and metrics.purity(pairs.limit(0)).first()["purity"] == 0.0


def test_meter_by_hand(spark):
    rows = [(1, 0, 1.0, 1.0, []), (1, 1, 1.0, 1.0, ["otp"]), (1, 2, 0.0, 1.0, ["safe"]), (1, 3, 0.0, 1.0, [])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, risk double, conf double, ids array<string>")
    trace = live.meter(df).first()["trace"]
    first = 100 * 0.5 / 3
    second = max(first + 0.5 * 2 / 3 * (100 - first), 61.0)
    assert [round(s["score"], 6) for s in trace] == [round(first, 6), round(second, 6), 81.0, 81.0]
    assert [s["latched"] for s in trace] == [False, True, True, True]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, t, rng.random(), rng.choice([0.6, 1.0]), rng.choice(["", "", "otp", "safe"])) for c in range(6) for t in range(5)]
    schema = "conv_id long, turn int, risk double, conf double, ids string"
    for t in range(5):  # a file for each turn, in order
        spark.createDataFrame([r for r in rows if r[1] == t], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    q = meter_stream.metered(stream).writeStream.format("memory").queryName("metered").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["conv_id"], r["turn"]): (round(r["score"], 9), r["latched"]) for r in spark.table("metered").collect()}
    batch = spark.createDataFrame([(c, t, r, f, [i] if i else []) for c, t, r, f, i in rows], "conv_id long, turn long, risk double, conf double, ids array<string>")
    want = {(r["conv_id"], s["turn"]): (round(s["score"], 9), s["latched"]) for r in live.meter(batch).collect() for s in r["trace"]}
    assert got == want


def test_records(spark, tmp_path):
    path = f"{tmp_path}/r.jsonl"
    with open(path, "w") as f:
        f.write('{"a": 1, "b": "x y"}\n\n{"a": 2}\nnot json\n')
    assert records.count_records(spark, path) == 3
    with pytest.raises(ValueError, match="1 of 3"):
        records.read_records(spark, path, "a int, b string")
    rows = records.read_records(spark, path, "a int, b string", skip_corrupt=True).orderBy("a").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(1, "x y"), (2, None)]
    assert records.read_records(spark, f"{tmp_path}/none", "a int", missing_ok=True).count() == 0
    for n in (3, 5):
        records.write_whole(spark.range(n), f"{tmp_path}/t")
        assert records.read_records(spark, f"{tmp_path}/t", "id long").count() == n


def test_calls_table(spark, tmp_path):
    path = f"{tmp_path}/c.csv"
    head = ",".join(records.CALLS)
    with open(path, "w") as f:
        f.write(head + "\n a ,ru,scam,x; y;,+7,t.txt,a.wav,c1\n")
    assert records.read_calls(spark, path).first()["tactic_ids"] == ["x", "y"]
    with open(path, "w") as f:
        f.write("other\n1\n")
    with pytest.raises(ValueError):
        records.read_calls(spark, path)


def test_embedding_cache(spark):
    rows, cache = spark.createDataFrame([("a",), ("b",), ("a",)], "text string"), spark.createDataFrame([], "h string, embedding array<double>")
    calls = []

    def embed(new):
        calls.append(new.count())
        return new.select("h", F.array(F.length("text").cast("double")).alias("embedding"))

    done, cache = records.embedded(rows, cache, embed)
    assert done.count() == 3 and calls == [2]
    _, cache = records.embedded(rows, cache, embed)
    assert calls == [2, 0] and cache.count() == 2


def test_rate_limit_against_a_loop(spark):
    rng = random.Random(2)
    hits = [(k, i, rng.random() * 50) for i, k in enumerate(rng.choice([1, 2, 3]) for _ in range(200))]
    got = {r["id"]: r["allowed"] for r in governance.rate_limited(spark.createDataFrame(hits, "key int, id int, s double"), "key", "id", "s", 10.0, 3).collect()}
    held = {}
    for k, i, s in sorted(hits, key=lambda h: (h[0], h[2], h[1])):
        kept = [x for x in held.get(k, []) if s - x < 10]
        assert got[i] == (len(kept) < 3)
        held[k] = kept + [s] if len(kept) < 3 else kept


def test_chain(spark):
    log = governance.sealed([("x", "1"), ("y", "2"), ("z", "3")], b"key")
    df = spark.createDataFrame(log, "seq int, who string, what string, prev string, mac string")
    assert governance.chain_breaks(df).first()["first_break"] is None
    assert governance.chain_breaks(df.where("seq <> 1")).first()["first_break"] == 2
    assert governance.chain_breaks(df.withColumn("mac", F.when(F.col("seq") == 1, "bad").otherwise(F.col("mac")))).first()["first_break"] == 2


def test_verdict_matches_by_number_first(spark):
    orgs = spark.createDataFrame([("o1", 1, ["n1"], ["a", "b"]), ("o2", 2, ["n2"], ["c", "d", "e"])], "org string, place int, numbers array<string>, members array<string>")
    events = spark.createDataFrame([(1, ["n2"], ["a", "b"]), (2, ["zz"], ["a", "q"]), (3, ["zz"], ["c", "q", "r"])], "event_id int, snapshot_numbers array<string>, snapshot_members array<string>")
    assert dict(governance.match_verdict(events, orgs).collect()) == {1: "o2", 2: "o1"}


def test_vectors(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 0.0]), (3, "b", [0.0, 2.0])], "vec_id int, label string, embedding array<double>")
    assert {r["label"]: r["centroid"] for r in vectors.centroids(df).collect()} == {"a": [1.0, 0.0], "b": [0.0, 2.0]}
    assert df.select(vectors.cosine_distance(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))).alias("d")).orderBy("vec_id").first()["d"] == 0.0


def test_largest_remainder_and_order(spark):
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "key string, weight double")
    assert dict(corpus.largest_remainder(w, 10).collect()) == {"a": 4, "b": 3, "c": 3}


def test_gram_contamination_against_all_pairs(spark):
    base = ["the quick brown fox jumps over it", "pack my box with five dozen jugs", "ab", "xyzxyzxyz"]
    docs = [base[0] + " now", base[1][:-6], base[0][:15], base[0] * 40, "xyz" * 500, "", None, "THE quick  brown fox jumps over it", "unlike the others here"]
    grams = [{t[i : i + 5] for i in range(len(t) - 4)} for t in (" ".join((d or "").lower().split()) for d in docs + base)]
    want = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(grams[: len(docs)]) for j, b in enumerate(grams[len(docs) :]) if a and b and len(a & b) >= 0.7 * len(a | b)}
    left, right = (spark.createDataFrame(list(enumerate(x)), f"{n} long, text string") for n, x in (("doc_id", docs), ("item_id", base)))
    got = {(r["doc_id"], r["item_id"]): r["jaccard"] for r in corpus.gram_contamination(left, "doc_id", right, "item_id").collect()}
    assert got == want and {(0, 0), (4, 3), (7, 0)} <= set(got)
