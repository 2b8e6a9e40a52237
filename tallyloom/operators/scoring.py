"""A scorer of texts by the phrases of tactics, its labels and evidence, and what is said about them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.live import confidence_band

#: id, whether one hit is enough to be sure, and phrases.
Tactic = tuple[str, bool, Sequence[str]]
#: Risk with a hard signal, with two tactics and more, with one, and with none: fixed values.
HARD, SEVERAL, ONE, NOTHING = 0.9, 0.6, 0.35, 0.05
HARD_WEIGHT, WEIGHT = 1.0, 0.6
#: The most that a call which is legitimate by construction may be rated.
HARD_NEGATIVE_RISK = 0.02


def hits(text: Column, tactics: Sequence[Tactic]) -> Column:
    """For each tactic, in order, the first of its phrases that the text has in any case: tactic, hard, start, end, text. Null texts have none."""
    low = F.lower(text)
    found = []
    for name, hard, phrases in tactics:
        spans = []
        for phrase in phrases:
            start = F.instr(low, phrase.lower()) - 1
            span = F.struct(F.lit(name).alias("tactic"), F.lit(hard).alias("hard"), start.cast("int").alias("start"), (start + len(phrase)).cast("int").alias("end"), F.substring(text, start + 1, F.lit(len(phrase))).alias("text"))
            spans.append(F.when(start >= 0, span))
        found.append(F.coalesce(*spans))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def risk_of(found: Column) -> Column:
    return F.when(F.exists(found, lambda h: h["hard"]), HARD).when(F.size(found) >= 2, SEVERAL).when(F.size(found) == 1, ONE).otherwise(NOTHING)


def tags_of(found: Column) -> Column:
    """id and weight of each hit's tactic."""
    return F.transform(found, lambda h: F.struct(h["tactic"].alias("id"), F.when(h["hard"], HARD_WEIGHT).otherwise(WEIGHT).alias("weight")))


def scored(rows: DataFrame, tactics: Sequence[Tactic], text: str = "text") -> DataFrame:
    """rows with risk, tags and spans of the scorer. Columns of these names are replaced."""
    found = rows.drop("risk", "tags", "spans").withColumn("_hits", hits(F.col(text), tactics))
    spans = F.transform("_hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["text"].alias("text")))
    return found.withColumn("risk", risk_of(F.col("_hits"))).withColumn("tags", tags_of(F.col("_hits"))).withColumn("spans", spans).drop("_hits")


def with_evidence(tags: Column, spans: Column, found: Column) -> tuple[Column, Column]:
    """tags and spans with hits of phrases as evidence: their tactics weigh 1, added if missing; their spans are added, one for each range, in order of start."""
    names = F.array_distinct(F.transform(found, lambda h: h["tactic"]))
    raised = F.transform(tags, lambda t: F.struct(t["id"].alias("id"), F.when(F.array_contains(names, t["id"]), F.lit(1.0)).otherwise(t["weight"]).alias("weight")))
    more = F.filter(names, lambda n: ~F.exists(tags, lambda t: t["id"] == n))
    added = F.transform(more, lambda n: F.struct(n.alias("id"), F.lit(1.0).alias("weight")))
    ranges = F.transform(found, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["text"].alias("text")))
    return F.concat(raised, added), F.array_sort(F.array_distinct(F.concat(spans, ranges)))


def clean_label(risk: Column, tags: Column, known: Sequence[str], hard_negative: Column) -> tuple[Column, Column]:
    """A stated label made valid: risk and weights between 0 and 1, a missing weight 1, unknown tags left out; a hard negative has no tags and hardly any risk."""
    between = F.greatest(F.lit(0.0), F.least(F.lit(1.0), risk))
    valid = F.filter(tags, lambda t: t["id"].isin(*known))
    valid = F.transform(valid, lambda t: F.struct(t["id"].alias("id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t["weight"], F.lit(1.0)))).alias("weight")))
    return F.when(hard_negative, F.least(between, F.lit(HARD_NEGATIVE_RISK))).otherwise(between), F.when(hard_negative, F.slice(valid, 1, 0)).otherwise(valid)


def multi_hot(tags: Column, space: Sequence[str]) -> Column:
    """1 for each tag of the space that tags (names) hold, else 0."""
    return F.array(*(F.array_contains(tags, name).cast("double") for name in space))


def hybrid(*blocks: Column) -> Column:
    """Feature blocks one after the other; null if one is missing."""
    return F.concat(*(b.cast("array<double>") for b in blocks))


def label_space(rows: DataFrame, label: str, order: str) -> DataFrame:
    """label, first: the different labels that aren't blank, by where they are first seen."""
    return rows.where(F.trim(F.col(label)) != "").groupBy(label).agg(F.min(order).alias("first"))


def known_tags(space: Column, spaces: Sequence[str], since: dict[str, str]) -> Column:
    """For each tag of since (the space it came with) whether a row labelled in space could have it. Unknown spaces know none."""
    rank = F.coalesce(*(F.when(space == s, n) for n, s in enumerate(spaces)), F.lit(-1))
    return F.array(*(rank >= list(spaces).index(s) for s in since.values()))


def reason(names: Column, phrases: Column, none: str, template: str, no_phrases: str) -> Column:
    """Why a text looks as it does. template has {tags} and {spans}; phrases stand in guillemets."""
    shown = F.when(F.size(phrases) > 0, F.array_join(F.transform(phrases, lambda p: F.concat(F.lit("«"), p, F.lit("»"))), ", ")).otherwise(F.lit(no_phrases))
    filled = F.replace(F.replace(F.lit(template), F.lit("{tags}"), F.array_join(names, ", ")), F.lit("{spans}"), shown)
    return F.when(F.size(names) == 0, F.lit(none)).otherwise(filled)


def caveat(backend: Column, calibrated: Sequence[str], text: str, suffix: str) -> Column:
    """text, with suffix ({backend}) where the backend's confidence isn't calibrated."""
    return F.when(backend.isin(*calibrated), F.lit(text)).otherwise(F.concat(F.lit(text), F.replace(F.lit(suffix), F.lit("{backend}"), backend)))


def role_line(template: str, role: Column, span: Column) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{role}"), role), F.lit("{span}"), span)


def explained(rows: DataFrame, names: dict[str, str], words: dict[str, str], calibrated: Sequence[str] = (), text: str = "text") -> DataFrame:
    """rows (text, tags, spans, confidence, backend) with reason, highlights, confidence_label and caveat; rows with a blank text are left out.

    Spans that aren't what the text has there are never shown. words: none, template, no_phrases, caveat, suffix.
    """
    shown = F.array_sort(F.filter("spans", lambda s: F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"]) == s["text"]))
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    called = F.filter(F.transform("tags", lambda t: F.try_element_at(table, t["id"])), lambda n: n.isNotNull())
    out = rows.where(F.trim(F.col(text)) != "").withColumn("highlights", shown)
    out = out.withColumn("reason", reason(called, F.transform("highlights", lambda s: s["text"]), words["none"], words["template"], words["no_phrases"]))
    return out.withColumn("confidence_label", confidence_band(F.col("confidence"))).withColumn("caveat", caveat(F.col("backend"), calibrated, words["caveat"], words["suffix"]))
