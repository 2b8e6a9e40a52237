"""Stress conditions, audit logs of many writers, and manifests of cells."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import audit, grid, stress
from tallyloom.sources import shared

KEY = b"a key"


def ari(groups, truths):
    two = lambda c: sum(n * (n - 1) / 2 for n in c.values())
    n = len(groups)
    same, a, b = two(Counter(zip(groups, truths, strict=True))), two(Counter(groups)), two(Counter(truths))
    expected = a * b / (n * (n - 1) / 2)
    return 1.0 if (a + b) / 2 == expected else (same - expected) / ((a + b) / 2 - expected)


def test_stress_equals_plain(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, *range(8)]), rng.randrange(4)) for i in range(120)]
    df = spark.createDataFrame([*rows, (None, 1, 1)], "id long, key long, truth int").repartition(4)
    conditions = {"as they are": 1.0, "half": 0.5, "none": 0.0}
    got = {r["condition"]: r for r in stress.stress_conditions(df, conditions, resamples=6).collect()}
    kept = {(r["condition"], r["sample"], r["id"]): r["key"] for r in stress.perturbed(df.where("id is not null"), conditions, 6, 0.8, 0).collect()}
    truth = {i: t for i, _, t in rows}
    for name in conditions:
        each = []
        for s in range(7):
            own = {i: k for (c, n, i), k in kept.items() if c == name and n == s}
            groups = [("k", k) if k is not None else ("i", i) for i, k in own.items()]
            sizes = Counter(groups)
            top = sum(max(Counter(truth[i] for i, g in zip(own, groups, strict=True) if g == x).values()) for x in sizes)
            each.append((top / len(own), ari(groups, [truth[i] for i in own]), sum(n for n in sizes.values() if n > 1) / len(own), len(sizes), len(own)))
        r = got[name]
        assert (r["purity"], r["ari"], r["multi_member_share"]) == pytest.approx(each[0][:3]) and (r["groups"], r["n"]) == each[0][3:]
        for k, c in enumerate(("purity", "ari", "multi_member_share")):
            values = [e[k] for e in each[1:]]
            assert min(values) - 1e-9 <= r[f"{c}_low"] <= r[f"{c}_high"] <= max(values) + 1e-9
    assert got["none"]["groups"] == 120 and got["half"]["groups"] > got["as they are"]["groups"]
    assert stress.stress_conditions(df.limit(0), conditions, resamples=1).count() == 0


def test_stress_ids_of_several_keys(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(60), rng.choice([None, *range(30)]), rng.randrange(3)) for _ in range(110)]
    df = spark.createDataFrame(rows, "id long, key long, truth int").repartition(3)
    conditions = {"all": 1.0, "half": 0.5}
    got = {r["condition"]: r for r in stress.stress_conditions(df, conditions, resamples=2).collect()}
    kept = {(r["condition"], r["id"]) for r in stress.perturbed(df, conditions, 0, 0.8, 0).where("key is not null").collect()}
    for name in conditions:
        up = {}
        find = lambda x: x if up.setdefault(x, x) == x else find(up[x])  # noqa: B023, E731
        for i, k, _ in rows:
            find(("i", i))
            if k is not None and (name, i) in kept:
                up[find(("i", i))] = find(("k", k))
        groups = [find(("i", i)) for i, _, _ in rows]
        r, sizes = got[name], Counter(groups)
        assert (r["n"], r["groups"]) == (len(rows), len(sizes))
        assert r["ari"] == pytest.approx(ari(groups, [t for _, _, t in rows])) and r["multi_member_share"] == pytest.approx(sum(n for n in sizes.values() if n > 1) / len(rows))


def test_stress_shuffles_keys_not_runs(spark):
    """No plan of a run broadcasts or joins rows: what is written for all runs has a row for each key, truth and sample at most, and one for each id and truth."""
    df = spark.range(3000).selectExpr("id", "id % 10 AS key", "CAST(id % 3 AS INT) AS truth")
    before = set(shared.written_tables())
    stress.stress_conditions(df, {"all": 1.0, "half": 0.5, "a fifth": 0.2}, resamples=8).collect()
    rows = [spark.read.parquet(t).count() for t in shared.written_tables() if t not in before]
    assert sum(rows) <= 3000 + 9 * 11 * 3 + 27


@pytest.fixture(scope="module")
def log(spark):
    rows = spark.createDataFrame([(n, f"who{n % 3}", None if n % 4 else "x\x01 ", n / 3) for n in range(45)], "at long, who string, note string, v double").repartition(5)
    one = audit.sealed(rows.where("at < 30"), KEY, "w1", "at", size=8)
    other = audit.sealed(rows.where("at >= 30"), KEY, "w2", "at", size=8)
    whole, heads = (a.unionByName(b) for a, b in zip(one, other, strict=True))
    return spark.createDataFrame(whole.collect(), whole.schema), spark.createDataFrame(heads.collect(), heads.schema)


def found(log, heads, key=KEY):
    return sorted(((r["segment"], r["seq"], r["reason"]) for r in audit.breaks(log, heads, key).collect()), key=str)


def test_breaks_are_found_and_named(spark, log):
    rows, heads = log
    assert heads.count() == 6 and found(rows, heads) == []
    top = audit.root(heads, KEY)
    assert len(top) == 64 and top == audit.root(heads.repartition(4), KEY) != audit.root(heads, b"other")
    changed = rows.withColumn("note", F.when(F.col("at") == 11, "other").otherwise(F.col("note")))
    assert found(changed, heads) == [("w1/1", 3, "changed")]
    assert found(rows.where("at <> 11"), heads) == [("w1/1", 4, "gap"), ("w1/1", None, "cut short")]
    assert found(rows.where("at <> 15"), heads) == [("w1/1", None, "cut short")]
    assert found(rows.where("segment <> 'w2/0'"), heads) == [("w2/0", None, "segment gone")]
    assert found(rows, heads.where("segment <> 'w2/0'")) == [("w2/0", None, "unknown segment")]
    twice = rows.unionByName(rows.where("at = 3"))
    assert ("w1/0", None, "entries added") in found(twice, heads)
    moved = rows.withColumn("segment", F.when(F.col("segment") == "w1/0", "w2/0").when(F.col("segment") == "w2/0", "w1/0").otherwise(F.col("segment")))
    assert {s for s, _, _ in found(moved, heads)} == {"w1/0", "w2/0"}
    assert len(found(rows, heads, b"other")) == 12  # every segment's chain and head
    # a whole segment that goes together with its head is told by the root
    assert audit.root(heads.where("segment <> 'w2/0'"), KEY) != top and found(rows.where("segment <> 'w2/0'"), heads.where("segment <> 'w2/0'")) == []
    assert {(r["segment"], r["seq"]) for r in audit.audit_head(rows).collect()} == {("w1/0", 7), ("w1/1", 7), ("w1/2", 7), ("w1/3", 5), ("w2/0", 7), ("w2/1", 6)}


def test_tree_of_many_heads_and_empty_logs(spark, log, monkeypatch):
    monkeypatch.setattr(audit, "FAN", 4)
    heads = spark.range(70).selectExpr("format_string('s%03d', id) as segment", "1L as n", "sha2(cast(id as string), 256) as head")
    top = audit.root(heads, KEY)
    assert top and all(audit.root(heads.withColumn("head", F.when(F.col("segment") == s, "f" * 64).otherwise(F.col("head"))), KEY) != top for s in ("s000", "s069"))
    assert audit.root(heads.limit(0), KEY) is None
    rows, own = audit.sealed(log[0].drop("segment", "seq", "mac").limit(0), KEY, "w9")
    assert rows.count() == own.count() == 0 and found(rows, own) == []
    with pytest.raises(ValueError):
        audit.sealed(log[0], b"", "w9")


AXES = {"stage": {"hook": 1, "middle": 2, "end": 1}, "register": {"plain": 0.5, "formal": 0.5}, "odd": {"only": 1.0}}


def test_manifest_has_exact_quotas_in_any_partitioning(spark):
    optional = spark.createDataFrame([(c, f"t{n}", float(n)) for c in ("scam", "legit") for n in range(5)], "class string, tactic string, weight double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    made = []
    try:
        for parts in ("3", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            made.append(sorted(grid.grid_manifest(spark, 101, {"scam": 0.6, "legit": 0.4, "never": 0.0}, AXES, optional.repartition(int(parts)), 1, 3, seed=4).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert made[0] == made[1]
    by_class = Counter(r["class"] for r in made[0])
    assert by_class == {"scam": 61, "legit": 40}
    for c, n in by_class.items():
        for axis, weights in AXES.items():
            assert Counter(r[axis] for r in made[0] if r["class"] == c) == {k: v for k, v in grid.shares(n, weights).items() if v}
    assert {len(r["tactics"]) for r in made[0]} == {1, 2, 3} and not any("t0" in r["tactics"] for r in made[0])
    assert [r["stage"] for r in made[0]] != sorted(r["stage"] for r in made[0])
    assert grid.grid_manifest(spark, 0, {"a": 1.0}, AXES).count() == 0
    with pytest.raises(ValueError):
        grid.dealt(spark.range(3).toDF("cell"), "x", {"a": 2}, 0)


def test_draws_follow_weights(spark):
    options = spark.range(4000).select(F.col("id").alias("cell"), F.explode(F.array(*(F.struct(F.lit(n).alias("tactic"), F.lit(w).alias("weight")) for n, w in (("a", 1.0), ("b", 2.0), ("c", 5.0))))).alias("o")).select("cell", "o.*")
    first = Counter(r["tactic"] for r in grid.drawn(options, ["cell"], "tactic", "weight", 1, 1).collect())
    assert all(abs(first[k] / 4000 - p) < 4 * math.sqrt(p * (1 - p) / 4000) for k, p in (("a", 1 / 8), ("b", 2 / 8), ("c", 5 / 8)))
    both = Counter(tuple(sorted(t)) for t in grid.drawn(options, ["cell"], "tactic", "weight", 2, 1).groupBy("cell").agg(F.collect_list("tactic").alias("t")).toPandas()["t"])
    p = 2 / 8 * 5 / 6 + 5 / 8 * 2 / 3  # b and c, in either order
    assert abs(both["b", "c"] / 4000 - p) < 0.04


def test_constraints(spark):
    cells = spark.range(4).toDF("cell")
    once = grid.with_constraint(cells, cells.where("cell = 2"), "shorter")
    again = grid.with_constraint(once, cells.where("cell = 3"), "longer")
    assert [r["constraint"] for r in again.orderBy("cell").collect()] == [None, None, "shorter", "longer"]
    for named, text in ((spark.range(9, 10).toDF("cell"), "x"), (cells, " ")):
        with pytest.raises(ValueError):
            grid.with_constraint(cells, named, text)
