"""Rules and taxonomies as tables, and phrases that needn't leave the JVM."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.text import find_phrase
from tallyloom.operators import rule_tables, rules
from tallyloom.plans.governance import SCHEMES

GOOD = [("a", 1, 0, None, "all", None), ("a", 1, 1, 0, "tactic", "x"), ("a", 1, 2, 0, "any", None), ("a", 1, 3, 2, "any_tactic", "y, z"), ("a", 1, 4, 2, "role", "bank"), ("b", 2, 7, None, "tactic", "y")]


def table(spark, rows):
    return spark.createDataFrame(rows, rule_tables.RULES)


def flat(trees):
    out = []
    for place, (name, tree) in enumerate(trees):
        def add(node, parent, name=name, place=place):
            ((kind, value),) = node.items()
            own = len(out)
            parts = kind in rule_tables.WITH_PARTS
            out.append((name, place, own, parent, kind, None if parts else ",".join(value) if isinstance(value, list) else value))
            for part in value if parts else []:
                add(part, own)
        add(tree, None)
    return out


def test_a_table_equals_the_rules_in_code(spark):
    kinds = ["error", "signup", "purchase", "click", "view"]
    rng = random.Random(2)
    df = spark.createDataFrame([(n, rng.sample(kinds, rng.randrange(6))) for n in range(80)], "id long, t array<string>")
    known = rule_tables.compiled(table(spark, flat(SCHEMES)).repartition(3), spark.createDataFrame([(k,) for k in kinds], "id string"))
    got = df.select(known.first(F.col("t")).alias("a"), rules.scheme(list(SCHEMES), F.col("t")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and len({r["a"] for r in got}) == 4
    named = known.within({"view", "click"})
    assert [n for n, _ in named.trees] == [n for n, _ in SCHEMES if known.tags[n] <= {"view", "click"}] and len(named.trees) < len(known.trees)


def test_roles_and_order(spark):
    known = rule_tables.compiled(table(spark, GOOD))
    df = spark.createDataFrame([(["x", "z"], None), (["x"], "bank"), (["x"], None), (["y"], None), ([], "bank"), (["x", "y"], None)], "t array<string>, r string")
    assert [r[0] for r in df.select(known.first(F.col("t"), F.col("r"))).collect()] == ["a", "a", None, "b", None, "a"]
    assert rule_tables.compiled(table(spark, [])).trees == ()


@pytest.mark.parametrize(
    ("change", "told"),
    [
        (("a", 1, 1, 0, "tactic", " "), "scheme a, node 1: no value"),
        (("a", 1, 1, 0, "tactic", "q"), "scheme a, node 1: unknown tag q"),
        (("a", 1, 1, 0, "sometimes", "x"), "scheme a, node 1: unknown kind sometimes"),
        (("a", 1, 1, 9, "tactic", "x"), "scheme a, node 1: no parent 9"),
        (("a", 1, 1, 3, "tactic", "x"), "scheme a, node 1: its parent can't have parts"),
        (("a", 1, 1, None, "tactic", "x"), "scheme a: 2 roots"),
        (("a", 1, 2, 2, "any", None), "scheme a, node 2: in a circle"),
        (("a", 1, 2, 0, "any", "x"), "scheme a, node 2: a value where parts should be"),
        (("b", 1, 7, None, "tactic", "y"), "scheme b: at the place of a"),
        (("b", None, 7, None, "tactic", "y"), "scheme b: no one place"),
    ],
)
def test_wrong_rows_are_named(spark, change, told):
    rows = [change if (r[0], r[2]) == (change[0], change[2]) else r for r in GOOD]
    with pytest.raises(rule_tables.WrongRow, match=told):
        rule_tables.compiled(table(spark, rows), spark.createDataFrame([("x",), ("y",), ("z",)], "id string"))


def test_a_node_without_parts_and_one_that_comes_twice(spark):
    for rows, told in ((GOOD + [("c", 3, 1, None, "any", None)], "scheme c, node 1: no parts"), (GOOD + [GOOD[-1]], "scheme b, node 7: comes twice")):
        with pytest.raises(rule_tables.WrongRow, match=told):
            rule_tables.compiled(table(spark, rows))


def test_taxonomy(spark):
    rows = [("x", 3, "An X", "tactic", True, True), ("y", 1, "A Y", "tactic", True, False), ("n", 2, "None", "negative", True, False), ("o", 4, "Old", "tactic", False, True)]
    df = rule_tables.taxonomy(spark.createDataFrame(rows, rule_tables.TAXONOMY))
    assert {(r["id"], r["place"]) for r in rule_tables.label_space(df).collect()} == {("y", 0), ("x", 1)}
    assert [r["id"] for r in rule_tables.hard_signals(df).collect()] == ["x"] and [r["id"] for r in rule_tables.label_space(df, "negative").collect()] == ["n"]
    ids = spark.createDataFrame([("x",), ("zz",)], "id string")
    assert {r["name"] for r in rule_tables.display_names(df, ids).collect()} == {"An X", "zz"}
    for bad, told in ((("x", 9, "Again", "tactic", True, True), "id comes 2 times"), ((None, 9, "A", "tactic", True, True), "no id"), (("q", 9, " ", "tactic", True, True), "no name"), (("q", 9, "Q", "other", True, True), "unknown kind"), (("q", 1, "Q", "tactic", True, True), "place comes 2 times")):
        with pytest.raises(rule_tables.WrongRow, match=told):
            rule_tables.taxonomy(spark.createDataFrame([*rows, bad], rule_tables.TAXONOMY))


def test_migrated_tags(spark):
    df = spark.createDataFrame([(1, ["old", "b", "older"]), (2, ["gone"]), (3, None), (4, [])], "id long, tags array<string>")
    moves = spark.createDataFrame([("old", "new"), ("older", "new"), ("gone", None)], "tag string, to string")
    assert {r["id"]: r["tags"] for r in rule_tables.migrated(df, moves).collect()} == {1: ["new", "b"], 2: [], 3: None, 4: []}


def test_phrases_searched_in_python_or_not_are_the_same(spark):
    rng = random.Random(7)
    phrases = [("safe", "переведите на безопасный счет"), ("code", "код из смс"), ("safe", "move it to a safe account now"), ("rush", "act immediately or lose it")]

    def broken(p):
        s = list(p)
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([[], [s[k], rng.choice("абxy")], [rng.choice("абxy ")]])
        return "".join(s)

    texts = [rng.choice(["", "well ", "ё—", "ｆ ", "x²\n"]) + broken(rng.choice(phrases)[1]).replace("е", rng.choice("её")) + rng.choice(["", " and КОД ИЗ СМС", "!"]) for _ in range(250)] + [None, "", "nothing at all"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: {(h["tactic"], h["start"], h["end"]) for h in (r["hits"] or [])} for r in rules.match_phrases(df, phrases).collect()}
    found = 0
    for k, text in enumerate(texts):
        want = {}
        for literal in (True, False):
            for t, p in phrases:
                if t not in want and text and (not literal or p.lower() in text.lower()) and (at := find_phrase(text, p)):
                    want[t] = (t, *at)
        assert got[k] == set(want.values())
        found += bool(want)
    assert 60 < found < 250
