"""One language for each stretch of a call that several recognisers have heard.

A call is cut wherever a word of any of them begins or ends. In each of these spans a language counts the span's length times the log-odds of its word there, or a fixed value without one, and
languages change at a price; the best path over a call is taken. Spans are put into runs of a bounded length: a run says what each language costs from each other one, the runs of a call
are added up, and each run then finds its own path between the languages that it begins after and ends with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.shared import written

#: Times closer than this are one.
EPS = 1e-6
#: What a language counts that a frozen span doesn't have.
NEVER = -1e9
#: Spans of a run, and seconds that words and spans are looked up by.
RUN, BUCKET = 4096, 4.0


def log_odds(p: Column, clip: float = 1e-3) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(q / (1 - q))


def elementary_spans(words: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """call, a, b of the stretches between all starts and ends of words (call, start, end) and of frozen spans (call, a, b)."""
    cuts = words.select("call", F.explode(F.array("start", "end")).alias("t"))
    if frozen is not None:
        cuts = cuts.unionByName(frozen.select("call", F.explode(F.array("a", "b")).alias("t")))
    after = F.lead("t").over(Window.partitionBy("call").orderBy("t"))
    return cuts.dropDuplicates().select("call", F.col("t").alias("a"), after.alias("b")).where(F.col("b") - F.col("a") > EPS)


def _at(points: DataFrame, ranges: DataFrame, on: list[str]) -> DataFrame:
    """points (on, x) with the ranges (on, lo, hi) that hold x; both are looked up by on and a bucket of time."""
    near = points.withColumn("bucket", F.floor(F.col("x") / BUCKET))
    wide = ranges.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("lo") - EPS) / BUCKET), F.floor((F.col("hi") + EPS) / BUCKET))))
    return near.join(wide, [*on, "bucket"]).where((F.col("lo") - EPS <= F.col("x")) & (F.col("x") < F.col("hi") + EPS))


def best_path(scores: np.ndarray, prices: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best totals at the end of a run, and for each span the language before each language. before: totals at its start; scores: spans x languages. Of equally good ones the first."""
    total, back = before, np.zeros(scores.shape, np.int64)
    for t, (row, price) in enumerate(zip(scores, prices, strict=True)):
        ways = total[:, None] - price * (1 - np.eye(len(row)))
        back[t] = ways.argmax(0)
        total = ways[back[t], np.arange(len(row))] + row
    return total, back


def best_paths(scores: np.ndarray, prices: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The languages of the best path of each of several runs, one after the other (spans x languages), of these sizes: as best_path() has them from zeros, for all runs at once."""
    order = np.argsort(-sizes, kind="stable")
    begin, long = (np.cumsum(sizes) - sizes)[order], sizes[order]
    change = 1 - np.eye(scores.shape[1])
    total, back = np.zeros((len(sizes), scores.shape[1])), np.zeros(scores.shape, np.int64)
    for t in range(long[0]):
        now = np.searchsorted(-long, -t)  # runs that are longer than t
        at = begin[:now] + t
        ways = total[:now, :, None] - prices[at, None, None] * change
        back[at] = ways.argmax(1)
        total[:now] = ways.max(1) + scores[at]
    state, last = np.zeros(len(scores), np.int64), total.argmax(1)
    for t in range(long[0] - 1, -1, -1):
        now = np.searchsorted(-long, -t)
        at = begin[:now] + t
        state[at] = last[:now]
        last[:now] = back[at, last[:now]]
    return state


def _whole_calls(parts: Iterator[pd.DataFrame], most: int = 200_000) -> Iterator[pd.DataFrame]:
    """The rows of some calls at a time, of parts in which they lie together."""
    held: list[pd.DataFrame] = []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) >= most:
            rows = pd.concat(held, ignore_index=True)
            cut = np.flatnonzero(rows["n"].to_numpy() == 0)[-1]
            held = [rows.iloc[cut:]]
            if cut:
                yield rows.iloc[:cut]
    if held:
        yield pd.concat(held, ignore_index=True)


def decoded(spans: DataFrame, languages: int) -> DataFrame:
    """call, a, b, state of spans (call, n: place in the call, a, b, price: of a change before it, scores: one for each language). Calls of one run are decoded many at once, longer ones run by run."""
    sized = written(spans.withColumn("_long", F.max("n").over(Window.partitionBy("call")) >= RUN), "vote-spans")
    short = sized.where("not _long").select("call", "n", "a", "b", "price", *(F.col("scores")[k].alias(f"s{k}") for k in range(languages)))
    kind = spans.schema["call"].dataType.simpleString()

    def several(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_calls(p for p in parts if len(p)):
            first = np.flatnonzero(rows["n"].to_numpy() == 0)
            state = best_paths(rows[[f"s{k}" for k in range(languages)]].to_numpy(), rows["price"].to_numpy(), np.diff([*first, len(rows)]))
            yield rows[["call", "a", "b"]].assign(state=state)

    found = short.repartition("call").sortWithinPartitions("call", "n").mapInPandas(several, f"call {kind}, a double, b double, state int")
    rest = sized.where("_long").drop("_long")
    return found if rest.isEmpty() else found.unionByName(_decoded_runs(rest, languages))


def _decoded_runs(spans: DataFrame, languages: int) -> DataFrame:
    """decoded() for calls of several runs."""
    kind = spans.schema["call"].dataType.simpleString()
    runs = spans.withColumn("run", F.floor(F.col("n") / RUN))

    def through(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        scores, prices = np.array(rows["scores"].tolist()), rows["price"].to_numpy()
        start = np.where(np.eye(languages) > 0, 0.0, 2 * languages * NEVER)
        table = np.stack([best_path(scores, prices, row)[0] for row in start])
        return pd.DataFrame({"call": [rows["call"].iloc[0]], "run": [rows["run"].iloc[0]], "table": [table.ravel()]})

    def along(rows: pd.DataFrame) -> pd.DataFrame:
        """The totals that each run begins with."""
        total, out = np.zeros(languages), []
        for _, run, table in rows.sort_values("run").itertuples(index=False):
            out.append((rows["call"].iloc[0], run, total))
            total = (total[:, None] + np.array(table).reshape(languages, languages)).max(0)
        return pd.DataFrame(out, columns=["call", "run", "before"])

    tables = runs.groupBy("call", "run").applyInPandas(through, f"call {kind}, run long, table array<double>")
    begin = tables.groupBy("call").applyInPandas(along, f"call {kind}, run long, before array<double>")
    held = runs.join(begin, ["call", "run"])

    def ends(rows: pd.DataFrame) -> pd.DataFrame:
        """For each language that a run may end with, the one before the run; and its totals at the end."""
        rows = rows.sort_values("n")
        total, back = best_path(np.array(rows["scores"].tolist()), rows["price"].to_numpy(), np.array(rows["before"].iloc[0]))
        at = np.arange(languages)
        for row in back[::-1]:
            at = row[at]
        return pd.DataFrame({"call": [rows["call"].iloc[0]], "run": [rows["run"].iloc[0]], "total": [total], "first": [at]})

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        """The language that each run ends with, from the last one back."""
        out, last = [], None
        for _, run, total, first in rows.sort_values("run", ascending=False).itertuples(index=False):
            last = int(np.argmax(total)) if last is None else last
            out.append((rows["call"].iloc[0], run, last))
            last = int(first[last])
        return pd.DataFrame(out, columns=["call", "run", "last"])

    last = held.groupBy("call", "run").applyInPandas(ends, f"call {kind}, run long, total array<double>, first array<long>")
    last = last.groupBy("call").applyInPandas(choose, f"call {kind}, run long, last int")

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", ignore_index=True)
        _, back = best_path(np.array(rows["scores"].tolist()), rows["price"].to_numpy(), np.array(rows["before"].iloc[0]))
        state, at = np.zeros(len(rows), np.int64), int(rows["last"].iloc[0])
        for t in range(len(rows) - 1, -1, -1):
            state[t] = at
            at = int(back[t, at])
        return rows[["call", "a", "b"]].assign(state=state)

    return held.join(last, ["call", "run"]).groupBy("call", "run").applyInPandas(follow, f"call {kind}, a double, b double, state int")


def labelled(words: DataFrame, languages: list[str], switch: float, missing: float, pause: float | None = None, bias: dict[str, float] | None = None, frozen: DataFrame | None = None) -> DataFrame:
    """call, a, b, lang of the spans that hold a word. words: call, lang, start, end, p (that the word is right).

    A change of language costs switch, but nothing after a pause of so many seconds without a word. Frozen spans (call, a, b, lang) keep their language. Where two words of a
    language overlap, the one that starts first counts. Words without times, probability, or one of the languages are left out; so are calls without words.
    """
    words = words.where("start is not null and end is not null and p is not null and call is not null").where(F.col("lang").isin(languages))
    spans = elementary_spans(words, frozen).withColumn("x", (F.col("a") + F.col("b")) / 2)
    ranges = words.select("call", "lang", F.col("start").alias("lo"), F.col("end").alias("hi"), log_odds(F.col("p")).alias("odds"))
    heard = _at(spans, ranges, ["call"]).groupBy("call", "bucket", "a", "b", "x", "lang").agg(F.min(F.struct("lo", "hi", "odds")).alias("first"))
    odds = heard.groupBy("call", "bucket", "a", "b", "x").agg(*(F.max(F.when(F.col("lang") == lang, F.col("first.odds"))).alias(f"odds{k}") for k, lang in enumerate(languages)))
    if frozen is not None:
        fixed = frozen.select("call", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("lang").alias("fixed"))
        locks = _at(odds.select("call", "a", "x"), fixed, ["call"]).groupBy("call", "a").agg(F.min_by("fixed", "lo").alias("fixed"))
        odds = odds.join(locks, ["call", "a"], "left")
    else:
        odds = odds.withColumn("fixed", F.lit(None).cast("string"))
    each = [F.when(F.col("fixed").isNotNull() & (F.col("fixed") != lang), NEVER).otherwise((F.col("b") - F.col("a")) * (F.coalesce(F.col(f"odds{k}"), F.lit(missing)) + (bias or {}).get(lang, 0.0))) for k, lang in enumerate(languages)]
    order = Window.partitionBy("call").orderBy("a")
    price = F.when((F.col("a") - F.lag("b").over(order) >= pause) if pause is not None else F.lit(False), 0.0).otherwise(float(switch))
    rows = odds.select("call", (F.row_number().over(order) - 1).alias("n"), "a", "b", price.alias("price"), F.array(*each).alias("scores"))
    return decoded(rows, len(languages)).select("call", "a", "b", F.element_at(F.array(*map(F.lit, languages)), F.col("state") + 1).alias("lang"))


def voted_words(words: DataFrame, spans: DataFrame) -> DataFrame:
    """The words whose middle is in a span (see labelled) of their language."""
    middle = words.withColumn("x", (F.col("start") + F.col("end")) / 2).withColumn("_k", F.struct("lang", "start", "end", "word"))
    ranges = spans.select("call", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("lang").alias("told"))
    first = _at(middle.select("call", "_k", "x").dropDuplicates(), ranges, ["call"]).groupBy("call", "_k").agg(F.min_by("told", "lo").alias("told"))
    return words.withColumn("_k", F.struct("lang", "start", "end", "word")).join(first.where(F.col("told") == F.col("_k.lang")), ["call", "_k"], "left_semi").drop("_k")


def advanced_freeze(spans: DataFrame, words: DataFrame, until: DataFrame | None, seconds: float) -> tuple[DataFrame, DataFrame]:
    """What is frozen anew (call, a, b, lang), and until when each call now is (call, until): so many seconds before the end of its newest word, never earlier than before."""
    newest = words.groupBy("call").agg((F.max("end") - seconds).alias("until"))
    old = until if until is not None else newest.select("call", F.lit(0.0).alias("until")).limit(0)
    now = newest.unionByName(old).groupBy("call").agg(F.greatest(F.max("until"), F.lit(0.0)).alias("until"))
    met = spans.join(now, "call").join(old.select("call", F.col("until").alias("since")), "call", "left")
    clipped = met.select("call", F.greatest("a", F.coalesce("since", F.lit(0.0))).alias("a"), F.least("b", "until").alias("b"), "lang")
    return clipped.where("b > a"), now
