"""Who a speaker claims to be: stated cues, and introductions that put an organisation beside a marker, as patterns that the JVM matches."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    name: str
    cues: Sequence[str] = ()
    organisations: Sequence[str] = ()


@dataclass(frozen=True)
class Introduction:
    """markers ("this is", "calling from"); words that may stand between a marker and an organisation; words that deny it when they do; and words beside an organisation that make it
    a channel and no employer ("app", "link"). A * at the end stands for any ending."""

    markers: Sequence[str]
    window: int = 3
    denials: Sequence[str] = ()
    channels_before: Sequence[str] = ()
    channels_after: Sequence[str] = ()
    endings: Sequence[str] = field(default=())


#: What is between two words of a sentence, and a word.
_GAP, _WORD = r"[^\p{L}\p{N}.!?\n]+", r"[\p{L}\p{N}]+"


def _phrases(phrases: Sequence[str], endings: Sequence[str] = ()) -> str:
    end = "(?:" + "|".join(re.escape(e) for e in endings) + ")?" if endings else ""

    def one(phrase: str) -> str:
        return _GAP.join(re.escape(w[:-1]) + r"[\p{L}\p{N}]*" if w.endswith("*") else re.escape(w) for w in phrase.split())

    return "(?:" + "|".join(map(one, sorted(phrases, key=lambda p: (-len(p), p)))) + ")" + end


def introduction(organisations: Sequence[str], how: Introduction) -> str:
    """The pattern of a claim: a marker and an organisation of one sentence, in either order, with at most window words between and no denial among them."""
    start, stop = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
    denied = rf"(?!{_phrases(how.denials)}{stop})" if how.denials else ""
    between = rf"(?:{_GAP}{denied}{_WORD}){{0,{how.window}}}?{_GAP}"
    marker, company = _phrases(how.markers), _phrases(organisations, how.endings)
    before = "".join(rf"(?<!{re.escape(w)} )" for w in how.channels_before)
    after = rf"(?!{_GAP}{_phrases(how.channels_after)}{stop})" if how.channels_after else ""
    company = rf"{before}{start}{company}{stop}{after}"
    return rf"(?iu){start}{marker}{between}{company}|{company}{between}{start}{marker}{stop}"


def claims(text: Column, roles: Sequence[Role], how: Introduction) -> Column:
    """role, start, end and text of the roles that a text claims, by start and then in order of roles.

    A role's claim is the earliest of its cues and introductions, of two that start together the longer. One that overlaps a longer claim of another role is left out.
    """
    found = []
    for place, role in enumerate(roles):
        patterns = ([rf"(?iu)(?<![\p{{L}}\p{{N}}]){_phrases(role.cues)}(?![\p{{L}}\p{{N}}])"] if role.cues else []) + ([introduction(role.organisations, how)] if role.organisations else [])
        for pattern in patterns:
            said = F.regexp_substr(text, F.lit(pattern))
            start = (F.regexp_instr(text, F.lit(pattern)) - 1).cast("int")
            found.append(F.when(said.isNotNull(), F.struct(start.alias("start"), (-F.length(said)).alias("_short"), F.lit(place).alias("_place"), F.lit(role.name).alias("role"), said.alias("text"))))
    every = F.array_sort(F.filter(F.array(*found), lambda c: c.isNotNull()))
    first = F.filter(every, lambda c: ~F.exists(every, lambda o: (o["_place"] == c["_place"]) & (o < c)))
    end = lambda c: c["start"] - c["_short"]
    alone = F.filter(first, lambda c: ~F.exists(first, lambda o: (o["start"] < end(c)) & (c["start"] < end(o)) & (o["_short"] < c["_short"])))
    ordered = F.array_sort(F.transform(alone, lambda c: F.struct(c["start"].alias("start"), c["_place"].alias("_place"), c["role"].alias("role"), end(c).alias("end"), c["text"].alias("text"))))
    return F.transform(ordered, lambda c: F.struct(c["role"].alias("role"), c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text")))
