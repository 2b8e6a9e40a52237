"""Taxonomies and rules as tables: read, checked with the place of what is wrong, and compiled to one expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.rules import scheme

#: Rows of a table of rules, at most: it is compiled on the driver.
MOST = 50_000
#: A node has parts, or a value: a tag, tags with commas between them, or a role.
WITH_PARTS, WITH_VALUE = ("all", "any"), ("tactic", "any_tactic", "role")
RULES = "scheme string, place long, node long, parent long, kind string, value string"
TAXONOMY = "id string, place long, name string, kind string, active boolean, hard boolean"


class WrongRow(ValueError):
    """What is wrong in a table, and in which rows."""


@dataclass(frozen=True)
class Rules:
    """Schemes in order: name and tree (see rules.rule_holds), and the tags that each one names."""

    trees: tuple[tuple[str, dict], ...]
    tags: dict[str, frozenset[str]]

    def first(self, tags: Column, role: Column | None = None) -> Column:
        """The first scheme that holds; null if none does."""
        return scheme(list(self.trees), tags, role) if self.trees else F.lit(None).cast("string")

    def within(self, tags: set[str]) -> Rules:
        """The schemes that name only these tags."""
        kept = tuple(t for t in self.trees if self.tags[t[0]] <= tags)
        return Rules(kept, {name: self.tags[name] for name, _ in kept})


def taxonomy(rows: DataFrame) -> DataFrame:
    """rows (id, place, name, kind, active, hard), checked: ids and places are there once, names aren't blank, kinds are tactic or negative."""
    wrong = F.when(F.col("id").isNull() | (F.trim("id") == ""), "no id").when(F.col("place").isNull(), "no place").when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name")
    wrong = wrong.when(~F.coalesce(F.col("kind").isin("tactic", "negative"), F.lit(False)), "unknown kind").when(F.col("active").isNull() | F.col("hard").isNull(), "a flag is missing")
    found = [(f"{r['place']} ({r['id']})", r["wrong"]) for r in rows.withColumn("wrong", wrong).where("wrong is not null").orderBy("place", "id").limit(20).collect()]
    for column in ("id", "place"):
        found += [(str(r[0]), f"{column} comes {r['count']} times") for r in rows.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1").orderBy(column).limit(20).collect()]
    if found:
        raise WrongRow("; ".join(f"row {place}: {what}" for place, what in found))
    return rows


def label_space(rows: DataFrame, kind: str = "tactic") -> DataFrame:
    """id, place of the active rows of a kind, numbered in order from 0."""
    kept = rows.where(F.col("active") & (F.col("kind") == kind)).select("id", "place")
    below = kept.select(F.col("place").alias("p"))
    return kept.join(below, F.col("p") < F.col("place"), "left").groupBy("id", "place").agg(F.count("p").alias("n")).select("id", F.col("n").alias("place"))


def hard_signals(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("active") & F.col("hard") & (F.col("kind") == "tactic")).select("id")


def display_names(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """ids with name: that of the taxonomy, else the id itself."""
    known = rows.select(F.col("id").alias("_t"), "name")
    return ids.join(known, F.col(column) == F.col("_t"), "left").withColumn("name", F.coalesce("name", column)).drop("_t")


def compiled(rows: DataFrame, tags: DataFrame | None = None) -> Rules:
    """The rules of a table (scheme, place of the scheme, node, parent, kind, value). tags (id): those that may be named.

    WrongRow names the scheme and node of each unknown kind, missing or needless value, unknown tag, node without parts or with a parent that isn't there or can't have any, of circles, and of schemes that have no one root or
    no one place.
    """
    if (n := rows.count()) > MOST:
        raise WrongRow(f"{n} rows, of {MOST} at most")
    known = {r[0] for r in tags.select("id").collect()} if tags is not None else None
    wrong: list[str] = []
    schemes: dict[str, dict[int, tuple]] = {}
    places: dict[str, set] = {}
    for r in rows.orderBy("place", "scheme", "node").collect():
        own = schemes.setdefault(r["scheme"], {})
        places.setdefault(r["scheme"], set()).add(r["place"])
        where = f"scheme {r['scheme']}, node {r['node']}"
        if r["node"] is None or r["scheme"] is None:
            wrong.append(f"{where}: no name")
            continue
        if r["node"] in own:
            wrong.append(f"{where}: comes twice")
        value = (r["value"] or "").strip()
        if r["kind"] in WITH_PARTS:
            if value:
                wrong.append(f"{where}: a value where parts should be")
        elif r["kind"] in WITH_VALUE:
            named = [x.strip() for x in value.split(",")] if r["kind"] == "any_tactic" else [value]
            if not all(named):
                wrong.append(f"{where}: no value")
            elif r["kind"] != "role" and known is not None:
                wrong += [f"{where}: unknown tag {x}" for x in named if x not in known]
        else:
            wrong.append(f"{where}: unknown kind {r['kind']}")
        own[r["node"]] = (r["parent"], r["kind"], value)
    trees, used = [], {}
    at: dict[object, str] = {}
    for name, own in schemes.items():
        if len(places[name]) != 1 or None in places[name]:
            wrong.append(f"scheme {name}: no one place")
        elif (other := at.setdefault(next(iter(places[name])), name)) != name:
            wrong.append(f"scheme {name}: at the place of {other}")
        parts: dict[int, list[int]] = {}
        for node, (parent, _, _) in own.items():
            if parent is not None and parent not in own:
                wrong.append(f"scheme {name}, node {node}: no parent {parent}")
            elif parent is not None and own[parent][1] not in WITH_PARTS:
                wrong.append(f"scheme {name}, node {node}: its parent can't have parts")
            if parent is not None:
                parts.setdefault(parent, []).append(node)
        roots = [n for n, (parent, _, _) in own.items() if parent is None]
        reached, todo = set(), list(roots)
        while todo:
            node = todo.pop()
            reached.add(node)
            todo += parts.get(node, [])
            if own[node][1] in WITH_PARTS and node not in parts:
                wrong.append(f"scheme {name}, node {node}: no parts")
        wrong += [f"scheme {name}, node {n}: in a circle" for n in own if n not in reached and own[n][0] in own]
        if len(roots) != 1:
            wrong.append(f"scheme {name}: {len(roots)} roots")
        if wrong:
            continue

        def tree(node: int, own: dict = own, parts: dict = parts) -> dict:
            _, kind, value = own[node]
            if kind in WITH_PARTS:
                return {kind: [tree(n) for n in sorted(parts[node])]}
            return {kind: [x.strip() for x in value.split(",")] if kind == "any_tactic" else value}

        trees.append((name, tree(roots[0])))
        used[name] = frozenset(x.strip() for _, kind, value in own.values() if kind in ("tactic", "any_tactic") for x in value.split(","))
    if wrong:
        raise WrongRow("; ".join(wrong[:50]))
    return Rules(tuple(trees), used)


def migrated(rows: DataFrame, moves: DataFrame, row_id: str = "id", tags: str = "tags") -> DataFrame:
    """rows with their tags renamed by moves (tag, to: null drops it): each new tag once, where it first stood. Tags without a move stay. moves is broadcast up to MOST rows."""
    told = moves.select(F.col("tag").alias("_tag"), F.col("to").alias("_to"), F.lit(True).alias("_moved"))
    each = rows.select(F.col(row_id).alias("_id"), F.posexplode(tags).alias("_n", "_tag")).join(F.broadcast(told) if told.count() <= MOST else told, "_tag", "left")
    new = each.withColumn("_new", F.when(F.col("_moved"), F.col("_to")).otherwise(F.col("_tag"))).where("_new is not null").groupBy("_id", "_new").agg(F.min("_n").alias("_n"))
    held = new.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_n", "_new"))).alias("_s"))
    joined = rows.join(held, F.col(row_id) == F.col("_id"), "left")
    return joined.withColumn(tags, F.when(F.col(tags).isNotNull(), F.coalesce(F.transform("_s", lambda s: s["_new"]), F.array().cast("array<string>")))).select(*rows.columns)
