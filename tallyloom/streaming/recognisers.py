"""Utterances of a call that several recognisers hear at once, over a stream: what each of them says is matched within a window of event time, and the best is kept.

Events wait in the state until the watermark has passed them, and are then taken in order of time; so neither how a stream is cut into batches nor the order of events within the allowed
lateness changes what comes out. A window opens with the first result. It closes when every recogniser has one, or by a timer. One that has none by then stands in with its latest partial
result, and its own result is left out if it comes within a while after that.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds that a window is open, and that a result which comes too late is left out; confidences closer than this are a tie.
WINDOW, LATE, TIE = 1200, 1500, 0.02

UTTERANCES = "call long, language string, text string, confidence double, opened long, closed long"
EVENT = "at long, language string, final boolean, text string, confidence double"


def best(said: dict[str, tuple[str, float]], order: list[str]) -> str | None:
    """The language whose text has the highest confidence; of those within TIE of it the first in order. Empty texts never win."""
    able = {k: max(0.0, c) for k, (t, c) in said.items() if t}
    return next((k for k in order if k in able and max(able.values()) - able[k] <= TIE), None)


@dataclass
class Call:
    """What is known of a call between events. Times are milliseconds."""

    languages: list[str]
    window: int = WINDOW
    late: int = LATE
    opened: int | None = None
    results: dict[str, tuple[str, float]] = field(default_factory=dict)
    partials: dict[str, tuple[str, float]] = field(default_factory=dict)
    muted: dict[str, int] = field(default_factory=dict)

    def close(self, now: int) -> list[tuple]:
        """The utterance of the open window, if anybody said something in it."""
        said, opened = {**self.partials, **self.results}, self.opened
        self.muted.update({k: now + self.late for k, (text, _) in self.partials.items() if text and k not in self.results})
        self.opened, self.results, self.partials = None, {}, {}
        won = best(said, self.languages)
        return [(won, said[won][0], max(0.0, said[won][1]), opened, now)] if won else []

    def until(self, now: int) -> list[tuple]:
        """What time alone brings up to now."""
        out = self.close(self.opened + self.window) if self.opened is not None and self.opened + self.window <= now else []
        self.muted = {k: t for k, t in self.muted.items() if t > now}
        return out

    def take(self, at: int, language: str, final: bool, text: str, confidence: float) -> list[tuple]:
        out = self.until(at)
        if language not in self.languages:
            return out
        if not final:
            self.partials[language] = (text, confidence)
            return out
        if language in self.muted:
            self.partials.pop(language, None)
            return out
        if language in self.results:  # it goes on before the others have said anything
            out += self.close(at)
        self.partials.pop(language, None)
        self.results[language] = (text, confidence)
        self.opened = at if self.opened is None else self.opened
        return out + (self.close(at) if len(self.results) == len(self.languages) else [])

    @property
    def empty(self) -> bool:
        return self.opened is None and not self.partials and not self.muted

    def dumps(self) -> str:
        return json.dumps([self.opened, self.results, self.partials, self.muted])

    def loads(self, told: str) -> Call:
        self.opened, results, partials, self.muted = json.loads(told)
        self.results, self.partials = ({k: tuple(v) for k, v in x.items()} for x in (results, partials))
        return self


class Matching(StatefulProcessor):
    def __init__(self, languages: list[str], window: int, late: int, idle: int) -> None:
        self.languages, self.window, self.late, self.idle = languages, window, late, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", "told string, seen long")
        self.held = handle.getListState("held", EVENT)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = [(int(r.at), r.language, bool(r.final), r.text or "", float(r.confidence)) for part in rows for r in part.itertuples(index=False)]
        self.held.appendList(new)
        for at in {r[0] for r in new}:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        call, seen, out = Call(self.languages, self.window, self.late), 0, []
        if self.call.exists():
            told, seen = self.call.get()
            call.loads(told)
        held = sorted(tuple(r) for r in self.held.get())
        due = [r for r in held if r[0] <= now]
        for event in due:
            out += call.take(*event)
            seen = event[0]
        out += call.until(now)
        rest = held[len(due) :]
        if due:
            self.held.put(rest) if rest else self.held.clear()
        if not rest and (call.empty or call.opened is None and seen + self.idle <= now):
            self.call.clear()  # partial results that nothing followed go with the call
        else:
            self.call.update((call.dumps(), seen))
            later = [call.opened + self.window] if call.opened is not None else [*call.muted.values(), seen + self.idle]
            for at in later:
                if at > now:
                    self.handle.registerTimer(at)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=[c.split()[0] for c in UTTERANCES.split(", ")])

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> None:
    """Sets the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def utterances(events: DataFrame, languages: list[str], lateness: str = "5 seconds", window: int = WINDOW, late: int = LATE, idle: int = 600_000) -> DataFrame:
    """A row for each utterance of a stream of events (call, ts, language, final, text, confidence): call, language, text, confidence, opened, closed (milliseconds).

    languages: those that listen, the preferred one first. Events that are later than lateness are left out, and so are those without a call, time, language or confidence. A call's state goes once its window
    is closed and no late result is awaited; partial results that nothing follows for idle milliseconds go too.
    """
    from pyspark.sql import functions as F

    with_state_store(events.sparkSession)
    rows = events.where("call is not null and ts is not null and language is not null and confidence is not null and final is not null").withWatermark("ts", lateness)
    slim = rows.select(F.col("call").cast("long").alias("call"), "ts", F.unix_millis("ts").alias("at"), "language", "final", "text", F.col("confidence").cast("double").alias("confidence"))
    return slim.groupBy("call").transformWithStateInPandas(Matching(languages, window, late, idle), UTTERANCES, "Append", "EventTime")
