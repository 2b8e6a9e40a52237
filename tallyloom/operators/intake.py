"""Reports that become incidents, verdicts that merge organizations, and forgetting everywhere. Each step can be repeated without a change."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators import governance, linking
from tallyloom.sources.shared import written

PREFIX = "live-"


def utc(ts: Column, zone: Column | str) -> Column:
    """A stated local time in UTC."""
    return F.to_utc_timestamp(ts, zone)


def report_incidents(reports: DataFrame) -> DataFrame:
    """Incidents of reports (content_id, text, risk_score of 100, tactic_ids, phrases, number, ts): id, text, risk, tags of weight 1, spans of phrases that the text has, number, ts."""
    spans = F.filter(F.transform("phrases", lambda p: F.struct((F.instr(F.col("text"), p) - 1).alias("start"), (F.instr(F.col("text"), p) - 1 + F.length(p)).alias("end"), p.alias("text"))), lambda s: (s["start"] >= 0) & (s["text"] != ""))
    tags = F.transform("tactic_ids", lambda t: F.struct(t.alias("id"), F.lit(1.0).alias("weight")))
    return reports.select(F.concat(F.lit(PREFIX), "content_id").alias("id"), "text", (F.col("risk_score") / 100.0).alias("risk"), tags.alias("tags"), spans.alias("spans"), "number", "ts")


def receipt(reports: DataFrame, **keys: object) -> DataFrame:
    """The first report by receipt_id whose columns have all these values."""
    found = reports
    for name, value in keys.items():
        found = found.where(F.col(name) == F.lit(value))
    return found.orderBy("receipt_id").limit(1)


def positives(rows: DataFrame, risk: str = "risk", hard_negative: str = "is_hard_negative") -> DataFrame:
    return rows.where((F.col(risk) >= 0.5) & ~F.col(hard_negative))


def copies(reports: DataFrame, of: DataFrame) -> DataFrame:
    """Reports with the source, partner and content of a row of of; nulls are equal."""
    keys = ("source", "partner_id", "content_id")
    named = of.select(*(F.col(k).alias("_" + k) for k in keys)).dropDuplicates()
    return reports.join(named, [F.col(k).eqNullSafe(F.col("_" + k)) for k in keys], "left_semi")


def placements(incidents: DataFrame, label: DataFrame, row_id: str = "id", missing: str = "unassigned") -> DataFrame:
    """id, org: each incident's organization, or missing."""
    return incidents.select(row_id).join(label.select(F.col(row_id).alias("_i"), F.col("component").cast("string").alias("org")), F.col(row_id) == F.col("_i"), "left").select(row_id, F.coalesce("org", F.lit(missing)).alias("org"))


def extended(cached: DataFrame, incidents: DataFrame, new: DataFrame, embed: Callable[[DataFrame], DataFrame], row_id: str = "id") -> DataFrame:
    """Embeddings (id, embedding) of incidents, of which new have just come: if those cached are of exactly the other ones, they stay and embed(new) is added; else all are embedded anew."""
    old = incidents.select(row_id).join(new.select(row_id), row_id, "left_anti")
    both = cached.select(row_id, F.lit(1).alias("_c")).unionByName(old.select(row_id, F.lit(-1).alias("_c")))
    same = both.groupBy(row_id).agg(F.sum("_c").alias("_c")).where("_c <> 0").isEmpty()
    return cached.unionByName(embed(new).select(*cached.columns)) if same else embed(incidents).select(*cached.columns)


def grown(label: DataFrame, keys: DataFrame, more: DataFrame) -> DataFrame:
    """label (id, component) with the rows of more (id, key: several rows an id, null without one), which keys (those that label was made of) may tie to what is there.

    Only components that share a key with new rows are looked at: they and the new rows are linked as nodes are, and rows of others keep their component.
    """
    asked = more.where("key is not null").select("key").dropDuplicates()
    met = keys.join(asked, "key", "left_semi").join(label, "id").select("component", "key").dropDuplicates()
    moved = written(linking.link_by_shared_keys(met.select(F.col("component").alias("id"), "key").unionByName(more.select("id", "key"))).select(F.col("id").alias("node"), F.col("component").alias("to")), "moved")
    changed = moved.where("node <> to")
    kept = label.join(changed, F.col("component") == F.col("node"), "left").select("id", F.coalesce("to", "component").alias("component"))
    fresh = more.select("id").dropDuplicates().join(moved, F.col("id") == F.col("node")).select("id", F.col("to").alias("component"))
    return kept.unionByName(fresh)


def ingest(reports: DataFrame, incidents: DataFrame, number: str = "number") -> tuple[DataFrame, DataFrame]:
    """All incidents (id, number, ts) with those of reports that aren't there yet, each content once, and id, component of all by shared numbers.

    reports: content_id, number, ts, order. Reports without a time stay pending.
    """
    known = incidents.where(F.col("id").startswith(PREFIX)).select(F.substring("id", len(PREFIX) + 1, 1 << 20).alias("content_id"))
    new = governance.pending(reports.where("ts is not null"), known, "content_id", "order").select(F.concat(F.lit(PREFIX), "content_id").alias("id"), number, "ts")
    every = incidents.select("id", number, "ts").unionByName(new)
    return every, linking.link_by_shared_keys(every.select("id", F.col(number).alias("key")))


def forget_in_verdicts(events: DataFrame, gone: DataFrame, live_numbers: DataFrame) -> DataFrame:
    """events (event_id, snapshot_members, snapshot_numbers, target_members: null without a target) without the ids and numbers of gone (id, number), unless live_numbers still has a number.

    Events whose snapshot or target is left without members go.
    """
    lost_numbers = gone.select("number").where("number is not null").dropDuplicates().join(live_numbers.select("number").dropDuplicates(), "number", "left_anti")

    def left(column: str, lost: DataFrame, key: str) -> DataFrame:
        each = events.select("event_id", F.posexplode(column).alias("_n", key)).join(lost.select(key).dropDuplicates(), key, "left_anti")
        held = each.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("_n", key))).alias("_s"))
        return held.select("event_id", F.transform("_s", lambda s: s[key]).alias("_" + column))

    rows = events
    for column, lost, key in (("snapshot_members", gone, "id"), ("target_members", gone, "id"), ("snapshot_numbers", lost_numbers, "number")):
        rows = rows.join(left(column, lost, key), "event_id", "left")
    empty = F.array().cast("array<string>")
    rows = rows.where(F.col("_snapshot_members").isNotNull() & (F.col("target_members").isNull() | F.col("_target_members").isNotNull()))
    numbers = F.coalesce("_snapshot_numbers", F.when(F.col("snapshot_numbers").isNotNull(), empty))
    kept = [c for c in events.columns if c not in ("snapshot_members", "snapshot_numbers", "target_members")]
    return rows.select(*kept, F.col("_snapshot_members").alias("snapshot_members"), numbers.alias("snapshot_numbers"), F.col("_target_members").alias("target_members"))


def forget_reports(reports: DataFrame, incidents: DataFrame, receipts: DataFrame) -> dict[str, DataFrame]:
    """What is left after the reports of receipts (receipt_id), their copies and the incidents made of them: reports, incidents, label (id, component), and gone (id, number)."""
    named = reports.join(receipts.select("receipt_id").dropDuplicates(), "receipt_id", "left_semi")
    going = copies(reports, named)
    kept = reports.join(going.select("receipt_id"), "receipt_id", "left_anti")
    gone = going.select(F.concat(F.lit(PREFIX), "content_id").alias("id"), "number").dropDuplicates()
    left = incidents.join(gone.select("id").dropDuplicates(), "id", "left_anti")
    return {"reports": kept, "incidents": left, "label": linking.link_by_shared_keys(left.select("id", F.col("number").alias("key"))), "gone": gone}


def purge(reports: DataFrame, incidents: DataFrame, now: Column, days: int) -> dict[str, DataFrame]:
    """forget_reports() for all reports (received, ts) whose time is over, and without incidents that no report is left of."""
    over = reports.where(governance.expired(F.col("received"), F.col("ts"), now, days))
    left = forget_reports(reports, incidents, over)
    backed = left["reports"].select(F.concat(F.lit(PREFIX), "content_id").alias("id")).dropDuplicates()
    stranded = governance.orphans(left["incidents"], backed, "id", PREFIX).select("id")
    kept = left["incidents"].join(stranded, "id", "left_anti")
    return {**left, "incidents": kept, "label": linking.link_by_shared_keys(kept.select("id", F.col("number").alias("key")))}


FACTOR = 0.2


def verdicts_applied(orgs: DataFrame, events: DataFrame) -> DataFrame:
    """orgs (org, priority, is_novel, members, numbers) after all verdicts in order of ts and event_id: org, priority, is_novel, members, numbers, feedback; merged ones are gone.

    events: event_id, ts, action, org, target (matched before). Dismissals and confirmations start from the base state; a merge unites both, keeps the target's name and the higher priority,
    and what was merged answers to the target's name from then on. Organizations that merges connect are one group, folded in a task, event by event; no other group is larger than one.
    """
    merges = events.where("action = 'merge' and target is not null").select(F.col("org").alias("a"), F.col("target").alias("b"))
    label = linking.components(merges)
    held = orgs.join(label, F.col("org") == F.col("node"), "left").select(*orgs.columns, F.coalesce("component", "org").alias("_group"))
    said = events.join(label, F.col("org") == F.col("node"), "left").select("event_id", "ts", "action", "org", "target", F.coalesce("component", "org").alias("_group"))
    schema = T.StructType([*orgs.schema.fields, T.StructField("feedback", T.StringType())])
    names = orgs.columns
    both = held.withColumn("_kind", F.lit(0)).unionByName(said.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    order = [F.col("_group"), F.col("_kind"), F.col("ts").asc_nulls_last(), F.col("event_id").asc_nulls_last()]
    dealt = both.repartition("_group").sortWithinPartitions(*order).select("_group", "_kind", "action", "target", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Group after group, each one's organizations before its events."""
        base: dict[object, dict] = {}
        now: dict[object, dict] = {}
        stands: dict[object, object] = {}
        group, done, fields = object(), [], None

        def out() -> pa.RecordBatch:
            told = [{**o, "priority": None if o["priority"] != o["priority"] else o["priority"]} for o in done]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array([o[f.name] for o in told], f.type) for f in fields], schema=pa.schema(fields))

        for batch in batches:
            fields = [pa.field(c, batch.schema.field(c).type) for c in names] + [pa.field("feedback", pa.string())]
            for g, kind, action, target, *org in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if g != group:
                    done += now.values()
                    group, base, now, stands = g, {}, {}, {}
                row = dict(zip(names, org, strict=True))
                if kind:
                    _fold(base, now, stands, action, row["org"], target)
                else:
                    row = {**row, "priority": float("nan") if row["priority"] is None else row["priority"], "feedback": None}
                    base[row["org"]], now[row["org"]], stands[row["org"]] = row, dict(row), row["org"]
            if len(done) >= 10_000:
                yield out()
        done += now.values()
        if done:
            yield out()

    return dealt.mapInArrow(run, schema)


def _fold(base: dict, now: dict, stands: dict, action: str, name: object, target: object) -> None:
    """What an event does to a group: its organizations' base states, present states, and the names that they now answer to."""
    org, target = stands.get(name), stands.get(target)
    if org is None or (action == "merge" and (target is None or target == org)):
        return
    if action == "merge":
        for state in (base, now):
            a, b = state.pop(org), state[target]
            b.update(members=sorted({*a["members"], *b["members"]}), numbers=sorted({*a["numbers"], *b["numbers"]}), priority=max(a["priority"], b["priority"]), is_novel=bool(a["is_novel"] and b["is_novel"]), feedback="merged")
        stands.update({k: target for k, v in stands.items() if v == org})
    elif action == "dismiss":
        now[org].update(priority=base[org]["priority"] * FACTOR, is_novel=False, feedback="dismissed")
    else:
        now[org] = base[org] | {"feedback": "confirmed"}
