"""Votes over spans against all paths."""

import itertools
import math
import random

import numpy as np
import pytest

from tallyloom.operators import span_vote

LANGS = ["a", "b", "c"]
WORDS = "call long, lang string, word string, start double, end double, p double"


def odds(p):
    q = min(1 - 1e-3, max(1e-3, p))
    return math.log(q / (1 - q))


def plain(words, switch, missing, pause, bias, frozen=()):
    """All paths of a call's spans: the highest total, of equal ones the one whose last languages come first."""
    cuts = sorted({t for w in words for t in w[2:4]} | {t for f in frozen for t in f[:2]})
    spans, last, prices = [], None, []
    for a, b in itertools.pairwise(cuts):
        x = (a + b) / 2
        row = []
        for lang in LANGS:
            own = sorted(w for w in [(w[2], w[3], w[4]) for w in words if w[0] == lang] if w[0] <= x < w[1])
            row.append(odds(own[0][2]) if own else None)
        if any(r is not None for r in row):
            lock = [f[2] for f in frozen if f[0] <= x < f[1]]
            spans.append((a, b, [-1e9 if lock and lock[0] != lang else (b - a) * ((missing if r is None else r) + bias.get(lang, 0)) for lang, r in zip(LANGS, row, strict=True)]))
            prices.append(0 if last is not None and pause is not None and a - last >= pause else switch)
            last = b
    best = None
    for path in itertools.product(range(len(LANGS)), repeat=len(spans)):
        total = sum(s[2][k] for s, k in zip(spans, path, strict=True)) - sum(p for p, i, j in zip(prices[1:], path, path[1:], strict=False) if i != j)
        if best is None or total > best[0] + 1e-9:
            best = total, path
    return [(a, b, LANGS[k]) for (a, b, _), k in zip(spans, best[1], strict=True)] if spans else [], best[0] if spans else 0


def value(spans, words, switch, missing, pause, bias, frozen=()):
    total, last = 0.0, None
    for a, b, lang in spans:
        x = (a + b) / 2
        own = sorted((w[2], w[3], w[4]) for w in words if w[0] == lang and w[2] <= x < w[3])
        lock = [f[2] for f in frozen if f[0] <= x < f[1]]
        total += -1e9 if lock and lock[0] != lang else (b - a) * ((odds(own[0][2]) if own else missing) + bias.get(lang, 0))
        if last and last[1] != lang and not (pause is not None and a - last[0] >= pause):
            total -= switch
        last = b, lang
    return total


def random_words(rng, n):
    out = []
    for _ in range(n):
        start = rng.randrange(0, 24) / 4
        out.append((rng.choice(LANGS), f"w{rng.randrange(9)}", start, start + rng.randrange(1, 5) / 4, rng.random()))
    return out


@pytest.mark.parametrize("run", [4096, 2])
def test_best_of_all_paths(spark, monkeypatch, run):
    monkeypatch.setattr(span_vote, "RUN", run)
    rng = random.Random(run)
    calls = {c: random_words(rng, rng.randrange(1, 5)) for c in range(12)}
    frozen = {3: [(0.25, 1.5, "c")], 5: [(1.0, 2.0, "a"), (2.0, 3.0, "b")]}
    rows = [(c, *w) for c, words in calls.items() for w in words] + [(None, "a", "x", 0.0, 1.0, 0.5), (99, "a", "x", None, 1.0, 0.5), (99, "zz", "x", 0.0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, WORDS).repartition(3)
    locks = spark.createDataFrame([(c, *f) for c, fs in frozen.items() for f in fs], "call long, a double, b double, lang string")
    for pause, bias in ((None, {}), (0.5, {"b": 0.4})):
        got = {}
        for r in span_vote.labelled(df, LANGS, 0.7, -0.5, pause, bias, locks).collect():
            got.setdefault(r["call"], []).append((r["a"], r["b"], r["lang"]))
        assert set(got) == set(calls)
        for c, words in calls.items():
            spans, best = plain(words, 0.7, -0.5, pause, bias, frozen.get(c, ()))
            assert [s[:2] for s in sorted(got[c])] == [s[:2] for s in spans]
            assert value(sorted(got[c]), words, 0.7, -0.5, pause, bias, frozen.get(c, ())) == pytest.approx(best)


def test_words_and_freeze(spark):
    rows = [(1, "a", "salem", 0.0, 1.0, 0.9), (1, "b", "sale", 0.1, 0.9, 0.2), (1, "b", "privet", 2.0, 3.0, 0.95), (1, "a", "pri", 2.1, 2.9, 0.1)]
    words = spark.createDataFrame(rows, WORDS)
    spans = span_vote.labelled(words, ["a", "b"], 0.5, -2.0)
    assert sorted(r["word"] for r in span_vote.voted_words(words, spans).collect()) == ["privet", "salem"]
    added, until = span_vote.advanced_freeze(spans, words, None, 0.5)
    assert [r["until"] for r in until.collect()] == [2.5] and max(r["b"] for r in added.collect()) == 2.5
    # a later hypothesis no longer changes what is frozen
    later = spark.createDataFrame([(1, "b", "drugoe", 0.0, 1.0, 0.999), (1, "a", "x", 0.0, 1.0, 0.01), *rows[2:]], WORDS)
    again = {(r["a"], r["lang"]) for r in span_vote.labelled(later, ["a", "b"], 0.5, -2.0, frozen=added).collect()}
    assert all(lang == "a" for a, lang in again if a < 1.0)
    more, now = span_vote.advanced_freeze(spans, words, until, 1.5)
    assert more.count() == 0 and [r["until"] for r in now.collect()] == [2.5]
    assert span_vote.labelled(words.limit(0), ["a", "b"], 0.5, -2.0).count() == 0


def test_many_calls_at_once():
    """Paths of several runs at once are those of each run by itself."""
    rng = np.random.default_rng(2)
    sizes = np.array([5, 1, 40, 17, 40, 3])
    scores, prices = rng.integers(-3, 4, (sizes.sum(), 3)).astype(float), rng.choice([0.0, 0.7], sizes.sum())
    at, want = 0, []
    for n in sizes:
        total, back = span_vote.best_path(scores[at : at + n], prices[at : at + n], np.zeros(3))
        path = [int(total.argmax())]
        for row in back[:0:-1]:
            path.append(int(row[path[-1]]))
        want += path[::-1]
        at += n
    assert span_vote.best_paths(scores, prices, sizes).tolist() == want
