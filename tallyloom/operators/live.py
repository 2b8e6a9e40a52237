"""Conversations turn by turn: windows, hysteresis, and the risk meter as a fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The meter's constants.
UP, DOWN, SHORT_TURNS, ARM_TURN = 0.5, 0.12, 3, 3
ENTER, EXIT, SINGLE, DOUBLE, SURE = 59.0, 49.0, 61.0, 81.0, 0.8


def band(score: Column) -> Column:
    return F.when(score <= 30, "low").when(score <= 60, "medium").when(score <= 80, "high").otherwise("critical")


def confidence_band(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").when(c >= 0.8, "high").when(c >= 0.6, "medium").otherwise("low")


def prefixes(turns: DataFrame, step: int = 1, call: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """call, end_turn (from 1) and the text of all turns up to it, at every step-th turn and the last."""
    by = Window.partitionBy(call).orderBy(turn)
    told = turns.select(call, F.row_number().over(by).alias("end_turn"), F.count(F.lit(1)).over(Window.partitionBy(call)).alias("_n"), F.array_join(F.collect_list(text).over(by.rowsBetween(Window.unboundedPreceding, 0)), "\n").alias("window_text"))
    return told.where((F.pmod("end_turn", F.lit(step)) == 0) | (F.col("end_turn") == F.col("_n"))).drop("_n")


def rolling_window(turns: DataFrame, room: int = 6000, head: int = 4, call: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """call, kept turns: all if they fit, else the first head turns and as many of the last as fit, the newest always. A turn costs its length and one."""
    by = Window.partitionBy(call).orderBy(turn)
    cost = F.length(text) + 1
    n = F.count(F.lit(1)).over(Window.partitionBy(call))
    rows = turns.select(call, turn, text, F.row_number().over(by).alias("_k"), n.alias("_n"), (F.sum(cost).over(Window.partitionBy(call)) - 1).alias("_all"), cost.alias("_cost"))
    rows = rows.withColumn("_head", F.sum(F.when(F.col("_k") <= head, F.col("_cost")).otherwise(0)).over(Window.partitionBy(call)))
    back = F.sum(F.when(F.col("_k") > head, F.col("_cost")).otherwise(0)).over(Window.partitionBy(call).orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_back", back)
    keep = (F.col("_all") <= room) | (F.col("_k") <= head) | (F.col("_k") == F.col("_n")) | (F.col("_head") + F.col("_back") - 1 <= room)
    return rows.where(keep).select(call, turn, text)


def hysteresis(rows: DataFrame, enter: float, exit_: float, call: str = "conv_id", turn: str = "turn", score: str = "score") -> DataFrame:
    """rows with is_on: on from a score of enter or more until one of exit_ or less. The last score that decides is enough, so no fold is needed."""
    if exit_ >= enter:
        raise ValueError("exit must be below enter")
    sign = F.when(F.col(score) >= enter, True).when(F.col(score) <= exit_, False)
    by = Window.partitionBy(call).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("is_on", F.coalesce(F.last(sign, ignorenulls=True).over(by), F.lit(False)))


def meter_step(state: Column, x: Column, up: Column | float = UP, down: Column | float = DOWN, enter: Column | float = ENTER, exit_: Column | float = EXIT) -> Column:
    """The meter's next state. state: turn, score, latched, ids; x: risk (0 to 1), conf, ids (of confident hard signals)."""
    turn, target = state["turn"] + 1, 100.0 * x["risk"]
    alpha = F.when(target > state["score"], up * F.least(F.lit(1.0), turn / float(SHORT_TURNS))).otherwise(down)
    ids = F.array_union(state["ids"], x["ids"])
    moved = state["score"] + alpha * x["conf"] * (target - state["score"])
    raised = F.when(F.size(ids) >= 2, F.greatest(moved, F.lit(DOUBLE))).when(F.size(ids) == 1, F.greatest(moved, F.lit(SINGLE))).otherwise(moved)
    score = F.least(F.greatest(raised, F.lit(0.0)), F.lit(100.0))
    armed = (turn >= ARM_TURN) | (F.size(ids) > 0)
    latched = F.when(state["latched"], score > exit_).otherwise(armed & (score >= enter))
    return F.struct(turn.cast("int").alias("turn"), score.alias("score"), latched.alias("latched"), ids.alias("ids"))


def meter(turns: DataFrame, call: str = "conv_id", turn: str = "turn", keep: list[str] | None = None) -> DataFrame:
    """call, trace: the meter's state after each turn. turns: risk, conf and ids of each turn. A call is one row and one fold, in order of turn."""
    first = F.struct(F.lit(0).alias("turn"), F.lit(0.0).alias("score"), F.lit(False).alias("latched"), F.array().cast("array<string>").alias("ids"))
    calls = turns.groupBy(call, *(keep or [])).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("risk").cast("double").alias("risk"), F.col("conf").cast("double").alias("conf"), F.col("ids").alias("ids")))).alias("_turns"))
    fold = F.aggregate("_turns", F.array(first), lambda acc, x: F.concat(acc, F.array(meter_step(F.element_at(acc, -1), x))))
    return calls.select(call, *(keep or []), F.expr("1").alias("_"), F.slice(fold, F.lit(2), F.size("_turns")).alias("trace")).drop("_")


def meter_variants(turns: DataFrame, variants: DataFrame, call: str = "conv_id", turn: str = "turn") -> DataFrame:
    """variant, call, first_latched: the first turn (from 1) at which each variant (name, up, down, enter, exit) latches. Turns are gathered once for all variants."""
    calls = turns.groupBy(call).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("risk").cast("double").alias("risk"), F.col("conf").cast("double").alias("conf"), F.col("ids").alias("ids")))).alias("_turns"))
    rows = calls.join(F.broadcast(variants), F.lit(True))
    first = F.struct(F.lit(0).alias("turn"), F.lit(0.0).alias("score"), F.lit(False).alias("latched"), F.array().cast("array<string>").alias("ids"))
    start = F.struct(first.alias("s"), F.lit(None).cast("int").alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        s = meter_step(acc["s"], x, F.col("up"), F.col("down"), F.col("enter"), F.col("exit"))
        return F.struct(s.alias("s"), F.coalesce(acc["hit"], F.when(s["latched"], s["turn"])).alias("hit"))

    return rows.select("variant", call, F.aggregate("_turns", start, step)["hit"].alias("first_latched"))


def alerts(traces: DataFrame, call: str = "conv_id", keep: list[str] | None = None) -> DataFrame:
    """call, turns_to_alert (first latched turn, from 1; null if none), top (highest score), final_band."""
    hit = F.filter("trace", lambda s: s["latched"])
    return traces.select(
        call,
        *(keep or []),
        F.when(F.size(hit) > 0, hit[0]["turn"]).alias("turns_to_alert"),
        F.round(F.array_max(F.transform("trace", lambda s: s["score"])), 6).alias("top"),
        band(F.element_at("trace", -1)["score"]).alias("final_band"),
    )


def new_evidence(spans: DataFrame, call: str, turn: str, text: str) -> DataFrame:
    """Spans whose text no earlier turn of the call had."""
    return spans.withColumn("_first", F.min(turn).over(Window.partitionBy(call, text))).where(F.col(turn) == F.col("_first")).drop("_first")


def top_utterances(turns: DataFrame, k: int, least: float, call: str = "conv_id", turn: str = "turn", text: str = "text", score: str = "score") -> DataFrame:
    """call, turn, start, end of the k turns with the highest scores of least or more, as offsets in the turns joined by line ends."""
    by = Window.partitionBy(call).orderBy(turn)
    start = F.coalesce(F.sum(F.length(text) + 1).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = turns.withColumn("start", start).withColumn("end", F.col("start") + F.length(text)).where(F.col(score) >= least)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(call).orderBy(F.desc(score), turn))).where(F.col("_n") <= k).select(call, turn, "start", "end")


def runs(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, run, value, first, last, n: consecutive rows with one value."""
    by = Window.partitionBy(group).orderBy(order)
    marked = rows.withColumn("_new", F.when(F.lag(value).over(by).eqNullSafe(F.col(value)), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def rolling_text(texts: Column, room: int = 6000, head: int = 4) -> Column:
    """The turns of a call so far as one text: all if they fit, else the first head turns and as many of the last as fit, the newest always. See rolling_window()."""

    def cost(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, t: a + F.length(t) + 1)

    first = F.slice(texts, 1, head)
    spent = cost(first)
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("back"))

    def step(acc: Column, t: Column) -> Column:
        back = acc["back"] + F.length(t) + 1
        fits = (acc["back"] == 0) | (spent + back - 1 <= room)
        return F.struct(F.when(fits, F.concat(acc["kept"], F.array(t))).otherwise(acc["kept"]).alias("kept"), back.alias("back"))

    last = F.reverse(F.aggregate(F.reverse(F.slice(texts, head + 1, F.greatest(F.size(texts), F.lit(1)))), start, step)["kept"])
    return F.when(cost(texts) - 1 <= room, F.array_join(texts, "\n")).otherwise(F.array_join(F.concat(first, last), "\n"))


def session(turns: DataFrame, tactics: list, call: str = "conv_id", turn: str = "turn", text: str = "text", conf: str = "conf", room: int = 6000, head: int = 4) -> DataFrame:
    """A call turn by turn: call, turn, risk, hits (of the window's scorer), score, latched and band of the meter, tags (names so far), new_evidence (phrases no earlier turn had), and
    whether advice is due (from the medium band up). The scorer sees the rolling window; hard signals raise the meter."""
    from tallyloom.operators import scoring

    by = Window.partitionBy(call).orderBy(turn)
    so_far, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.select(call, turn, F.col(conf).alias("conf"), F.collect_list(F.coalesce(text, F.lit(""))).over(so_far).alias("_texts"))
    rows = rows.withColumn("hits", scoring.hits(rolling_text(F.col("_texts"), room, head), tactics)).drop("_texts")
    rows = rows.withColumn("risk", scoring.risk_of(F.col("hits"))).withColumn("ids", F.transform(F.filter("hits", lambda h: h["hard"]), lambda h: h["tactic"]))
    phrases = F.transform("hits", lambda h: h["text"])
    rows = rows.withColumn("tags", F.array_distinct(F.flatten(F.collect_list(F.transform("hits", lambda h: h["tactic"])).over(so_far))))
    rows = rows.withColumn("new_evidence", F.array_except(phrases, F.flatten(F.collect_list(phrases).over(before))))
    states = meter(rows, call, turn).select(F.col(call).alias("_call"), F.explode("trace").alias("_s"))
    numbered = rows.withColumn("_n", F.row_number().over(by))
    met = numbered.join(states, (F.col(call) == F.col("_call")) & (F.col("_n") == F.col("_s.turn")))
    level = band(F.col("_s.score"))
    return met.select(call, turn, "risk", "hits", F.col("_s.score").alias("score"), F.col("_s.latched").alias("latched"), level.alias("band"), "tags", "new_evidence", (level != "low").alias("advice"))
