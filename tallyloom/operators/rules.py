"""Phrases, rules over tags, and advice, as columns compiled from small tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import PLAIN, find_phrase, phrase_parts

#: Rows of advice up to which it is broadcast.
BROADCAST_ADVICE = 100_000


def rule_holds(rule: dict, tags: Column, role: Column | None = None) -> Column:
    """A rule tree as a column. Nodes: all, any (lists of rules), tactic (a tag), any_tactic (tags), role."""
    ((kind, value),) = rule.items()
    if kind == "all":
        parts = [rule_holds(r, tags, role) for r in value]
        out = F.lit(True)
        for p in parts:
            out = out & p
        return out
    if kind == "any":
        out = F.lit(False)
        for r in value:
            out = out | rule_holds(r, tags, role)
        return out
    if kind == "tactic":
        return F.array_contains(tags, value)
    if kind == "any_tactic":
        return F.arrays_overlap(tags, F.array(*map(F.lit, value)))
    if kind == "role":
        return F.coalesce(role == value, F.lit(False)) if role is not None else F.lit(False)
    raise ValueError(f"unknown rule {kind}")


def scheme(rules: list[tuple[str, dict]], tags: Column, role: Column | None = None) -> Column:
    """The first rule that holds, by name; null if none does."""
    return F.coalesce(*(F.when(rule_holds(rule, tags, role), F.lit(name)) for name, rule in rules), F.lit(None).cast("string"))


def reassurance(text: Column, sensitive: list[str], reassuring: list[str], room: int = 70) -> Column:
    """Whether a sensitive and a reassuring term stand within room characters of a sentence, in either order."""

    def terms(words: list[str]) -> str:
        return "(?:" + "|".join(r"\s*".join(r"\Q" + w + r"\E" for w in t.split()) for t in words) + ")"

    a, b, gap = terms(sensitive), terms(reassuring), rf"[^.!?\n]{{0,{room}}}"
    return text.rlike(f"(?iu){a}{gap}{b}|{b}{gap}{a}")


def match_phrases(rows: DataFrame, phrases: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """rows with hits: for each tactic the first of its phrases that the text has, as tactic, start, end.

    A text goes to Python, to be searched with edits, only if it holds a part of a phrase of a tactic that it doesn't have literally: of a phrase with k edits one of k + 1 parts must be there. Texts
    with letters beyond ASCII and Cyrillic go there in any case.
    """
    tactics = list(dict.fromkeys(t for t, _ in phrases))
    kept = rows.columns

    def literal(t: str) -> Column:
        tries = [F.when(F.instr(F.lower(text), p.lower()) > 0, F.struct(F.lit(t).alias("tactic"), (F.instr(F.lower(text), p.lower()) - 1).alias("start"), (F.instr(F.lower(text), p.lower()) - 1 + len(p)).alias("end"))) for x, p in phrases if x == t]
        return F.coalesce(*tries)

    exact = rows.withColumn("hits", F.filter(F.array(*map(literal, tactics)), lambda h: h.isNotNull()))
    folded = F.regexp_replace(F.replace(F.lower(text), F.lit("ё"), F.lit("е")), PLAIN, "")
    missing = F.col(text).rlike(r"[^\x00-\x7f\xa0«»\u0400-\u04ff\u2010-\u2015\u2018-\u201f\u2026]") & (F.size("hits") < len(tactics))
    for t in tactics:
        if parts := sorted({x for u, p in phrases if u == t for x in phrase_parts(p)}):
            missing = missing | (folded.rlike("|".join(parts)) & ~F.array_contains(F.transform("hits", lambda h: h["tactic"]), t))
    missing = F.coalesce(missing, F.lit(False))
    schema = T.StructType([*rows.schema.fields, exact.schema["hits"]])

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for whole, hits in zip(part[text], part["hits"], strict=True):
                have = {h["tactic"]: h for h in (hits if hits is not None else [])}
                for t, p in phrases:
                    if t not in have and (at := find_phrase(whole or "", p)):
                        have[t] = {"tactic": t, "start": at[0], "end": at[1]}
                found.append([have[t] for t in tactics if t in have])
            yield part[kept].assign(hits=found)

    return exact.where(~missing).unionByName(exact.where(missing).mapInPandas(search, schema))


def decode_tags(probabilities: Column, thresholds: dict[str, float]) -> Column:
    """The tags of a map whose probability reaches their threshold, most likely first, ties by name."""
    limit = F.create_map(*(x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v))))
    held = F.filter(F.map_entries(probabilities), lambda e: e["value"] >= F.coalesce(F.try_element_at(limit, e["key"]), F.lit(0.5)))
    return F.transform(F.array_sort(F.transform(held, lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("k")))), lambda s: s["k"])


def advice(tags: DataFrame, table: DataFrame, call: str = "conv_id", most: int = 3) -> DataFrame:
    """call, place, text: advice for tags (call, tactic, weight, order), hard signals first, then by weight, then as tagged; each text once. table: tactic, hard, text."""
    rows = tags.join(F.broadcast(table) if table.count() <= BROADCAST_ADVICE else table, "tactic")
    order = Window.partitionBy(call).orderBy(F.desc("hard"), F.desc("weight"), "order")
    first = rows.withColumn("_n", F.row_number().over(order)).groupBy(call, "text").agg(F.min("_n").alias("_n"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(call).orderBy("_n"))).where(F.col("place") <= most).drop("_n")


def merged_tags(rows: DataFrame, call: str, tag: str, weight: str, order: str) -> DataFrame:
    """call, tag, weight: the highest weight of each tag; first_seen says in which order they came."""
    return rows.groupBy(call, tag).agg(F.max(weight).alias(weight), F.min(order).alias("first_seen"))


def display_names(profile: DataFrame, families: DataFrame, group: str, tactic: str, most: int = 2) -> DataFrame:
    """group, name: its most frequent tactics joined by " + ", else its family, else its id. profile: group, tactic, place."""
    named = profile.where(F.col("place") <= most).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("place", tactic))).alias("s"))
    rows = families.join(named, group, "left")
    joined = F.array_join(F.transform("s", lambda s: s[tactic].cast("string")), " + ")
    return rows.select(group, F.coalesce(joined, F.col("family"), F.col(group).cast("string")).alias("name"))
