"""The risk meter over a stream of turns: the same step as the batch fold, with the state kept per call."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.operators.live import ARM_TURN, DOUBLE, DOWN, ENTER, EXIT, SHORT_TURNS, SINGLE, UP

OUT = "conv_id long, turn int, score double, latched boolean"
STATE = "turn int, score double, latched boolean, ids string"


def advance(turn: int, score: float, latched: bool, ids: set[str], risk: float, conf: float, new: set[str]) -> tuple[int, float, bool, set[str]]:
    """One turn of the meter, as operators.live.meter_step has it."""
    turn, target = turn + 1, 100.0 * risk
    alpha = UP * min(1.0, turn / SHORT_TURNS) if target > score else DOWN
    ids = ids | new
    score = score + alpha * conf * (target - score)
    if ids:
        score = max(score, DOUBLE if len(ids) > 1 else SINGLE)
    score = min(max(score, 0.0), 100.0)
    return turn, score, score > EXIT if latched else (turn >= ARM_TURN or bool(ids)) and score >= ENTER, ids


def _step(idle: int, timed: bool, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    turn, score, latched, ids = state.get if state.exists else (0, 0.0, False, "")
    held, rows, newest = set(ids.split("\x1f")) - {""}, [], 0
    for part in sorted((r for p in parts for r in p.itertuples(index=False)), key=lambda r: r.turn):
        turn, score, latched, held = advance(turn, score, latched, held, part.risk, part.conf, set(part.ids.split(",")) - {""})
        rows.append((key[0], turn, score, latched))
        newest = max(newest, int(part.at)) if timed else 0
    state.update((turn, score, latched, "\x1f".join(sorted(held))))
    if timed:
        state.setTimeoutTimestamp(max(newest + idle, state.getCurrentWatermarkMs() + 1))
    else:
        state.setTimeoutDuration(idle)
    yield pd.DataFrame(rows, columns=["conv_id", "turn", "score", "latched"])


def metered(turns: DataFrame, ts: str | None = None, late: str = "10 minutes", idle: int = 3_600_000) -> DataFrame:
    """A row for each turn of a stream of turns (conv_id, turn, risk, conf, ids: comma-separated). Turns of a call must come in order from batch to batch; within a batch they are sorted.

    The state is a score, the latch and the ids of hard signals, which are few, so it doesn't grow with a call. It goes when a call has had no turn for idle milliseconds: of the time in the column ts
    as far as the watermark is (turns that are later than late are left out), or of the clock without such a column. A call that goes on after that begins anew.
    """
    rows = turns.withWatermark(ts, late).withColumn("at", F.unix_millis(ts)) if ts else turns
    kind = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("conv_id").applyInPandasWithState(functools.partial(_step, idle, ts is not None), OUT, STATE, "append", kind)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n of runs of events with gaps under gap; events that come later than late are left out."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
