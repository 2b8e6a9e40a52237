"""Pairs of rows of which many are alike."""

from itertools import combinations

import pytest

from tallyloom.operators import corpus, pairs
from tallyloom.plans import catalog
from tallyloom.sources import shared


@pytest.mark.parametrize("block", [2, 1000])
def test_overlap_of_copies(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    texts = ["a large ring of steel"] * 9 + ["a large ring of steels"] * 4 + ["something else"] + ["abc"] * 3 + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    before = set(shared.written_tables())
    got = {(r["a"], r["b"]): r["jaccard"] for r in corpus.gram_overlap(rows, "id", least=0.9).collect()}
    sets = [{t[i : i + 5] for i in range(len(t or "") - 4)} for t in texts]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(range(len(texts)), 2) if sets[a] | sets[b]}
    assert got == {p: pytest.approx(j) for p, j in want.items() if j >= 0.9} and len(got) == 78
    compared = [t for t in shared.written_tables() if t not in before and "/gram-sets-" in t]
    assert [spark.read.parquet(t).count() for t in compared] == [3]  # each text once, however many copies it has


def test_names_are_compared_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(pairs, "BLOCK", 4)
    parts = [(i, ["ring", "rings", None][i % 3], "b" if i % 5 else None, "t", 1 + i % 2) for i in range(60)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"file://{tmp_path}/part.parquet")
    before = set(shared.written_tables())
    got = {(r["p_partkey"], r["other"]): r["similarity"] for r in catalog.QUERIES["name_similarity"](spark, f"file://{tmp_path}").collect()}
    want = {(a[0], b[0]): None if a[1] is None or b[1] is None else 1.0 if a[1] == b[1] else 0.8 for a, b in combinations(parts, 2) if a[2] and b[2] and a[4] == b[4]}
    assert got == want
    met = [t for t in shared.written_tables() if t not in before and "/block-pairs-" in t]
    assert len(met) == 1 and spark.read.parquet(met[0]).count() < len(want) / 4
