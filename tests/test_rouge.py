"""The highest ROUGE-L of each text against all pairs."""

import random
import re

import pytest

from tallyloom.functions.text import lcs_length
from tallyloom.operators.rouge import max_rouge_l

SCHEMA = "id long, lang string, text string"


def all_pairs(rows, least):
    said = [(i, lang or "", re.findall(r"\w+", (text or "").lower())) for i, lang, text in rows]
    out = []
    for n, (i, lang, a) in enumerate(said):
        others = [b for m, (_, other, b) in enumerate(said) if m != n and other == lang and a and b]
        top = max((2 * lcs_length(a, b) / (len(a) + len(b)) for b in others), default=0.0)
        out.append((i, round(top, 9) if top >= least - 1e-12 else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0.4, 0.7, 1.0])
def test_equals_all_pairs(spark, least):
    rng = random.Random(7)
    rows = []
    for n in range(120):
        base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(rng.randint(1, 14))]
        rows.append((n, rng.choice(["kk", "ru", None]), " ".join(base)))
        if n % 3 == 0:  # with changes, in another order, and copies that differ by case and marks
            other = [w if rng.random() < 0.8 else "z" for w in base]
            rows += [(n + 1000, rows[-1][1], ", ".join(other)), (n + 2000, rows[-1][1], " ".join(reversed(base)))]
        if n % 10 == 0:
            rows += [(n + 3000, rows[-1][1], rows[-1][2].upper() + "!")] * 2
    rows += [(5000, "kk", None), (5001, "kk", ""), (5002, "kk", "?!"), (None, "ru", "one two three four"), (5003, "ru", "One two, three four five")]
    got = [(r["id"], r["rouge_l"] if r["rouge_l"] is None else round(r["rouge_l"], 9)) for r in max_rouge_l(spark.createDataFrame(rows, SCHEMA), "id", least=least).collect()]
    assert sorted(got, key=repr) == all_pairs(rows, least)


def test_copies_make_no_pairs(spark):
    rows = spark.range(20_000).selectExpr("id", "'kk' as lang", "'the same few words again' as text")
    assert max_rouge_l(rows, "id").where("rouge_l = 1").count() == 20_000
    assert max_rouge_l(rows.limit(0), "id").count() == 0


def test_least_is_checked(spark):
    with pytest.raises(ValueError):
        max_rouge_l(spark.createDataFrame([], SCHEMA), "id", least=0)
