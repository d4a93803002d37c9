"""Golden records: edits of several systems merged field by field, as keyed state.

Every row of a key is decided in the order of arrival: what merely echoes a delivery is
dropped, of two edits the later commit time wins, and what loses is logged. The same
function serves a stream (state per key, RocksDB) and a batch replay (rows per key).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Milliseconds after which a delivery that did not come back is no longer awaited.
EXPECT_MS = 3_600_000
ALL = "*"


@dataclass(frozen=True)
class Entity:
    """What is merged: its fields, those a record needs, the fields that each system carries (None: all), and whose word stands at the first sync."""

    fields: tuple[str, ...]
    systems: Mapping[str, tuple[str, ...] | None]
    authority: str
    required: tuple[str, ...] = ()

    def carries(self, system: str) -> tuple[str, ...]:
        return self.systems.get(system) or self.fields

    def others(self, system: str | None, name: str) -> list[str]:
        return [s for s in self.systems if s != system and name in self.carries(s)]


@dataclass
class Golden:
    """A key's state: the record, its fields' commit times and systems, and what is awaited and remembered."""

    values: dict[str, Any] | None = None
    at: dict[str, int] = field(default_factory=dict)
    by: dict[str, str] = field(default_factory=dict)
    rev: int = 0
    changed: str | None = None
    skip: str | None = None
    deleted: list | None = None
    awaited: list[list] = field(default_factory=list)
    before: dict[str, dict] = field(default_factory=dict)
    polled: dict[str, dict] = field(default_factory=dict)

    def expect(self, system: str, name: str, value: Any, ms: int) -> None:
        """Await a value's echo, unless the newest awaited one of the field is the same."""
        mine = [a for a in self.awaited if a[0] == system and a[1] == name]
        if not mine or mine[-1][2] != value:
            self.awaited.append([system, name, value, ms])

    def consume(self, system: str, name: str, value: Any) -> bool:
        """Whether the value was awaited; the oldest equal one and all older ones are then done with."""
        mine = [a for a in self.awaited if a[0] == system and a[1] == name]
        hit = next((i for i, a in enumerate(mine) if a[2] == value), None)
        if hit is None:
            return False
        done = [id(a) for a in mine[: hit + 1]]
        self.awaited = [a for a in self.awaited if id(a) not in done]
        return True


def decide(g: Golden, e: Entity, system: str, kind: str, ms: int, row: Mapping[str, Any], unmapped: Sequence[str] = ()) -> tuple[str, list[tuple]]:
    """Take one row into the state: (outcome, conflicts as (field, kept, kept_by, kept_ms, lost, lost_by, lost_ms, reason)).

    Outcomes: before, echo, unchanged, deleted, lost, created, applied.
    """
    g.awaited = [a for a in g.awaited if a[3] > ms - EXPECT_MS]
    carried = [f for f in e.carries(system) if f in row]
    after, before = {f: row[f] for f in carried}, None
    if kind == "UPDATE_BEFORE":
        g.before[system] = after
        return "before", []
    if kind == "UPDATE_AFTER":
        before = g.before.pop(system, None)
    elif kind == "POLL":
        before, g.polled[system] = g.polled.get(system), after
    emptied = kind == "DELETE" and not set(e.required) <= set(carried)
    if emptied:
        before, after = after, dict.fromkeys(carried)
    elif kind == "DELETE":
        return _delete(g, e, system, ms)
    log = [(f, (g.values or {}).get(f), g.by.get(f), g.at.get(f), None, system, ms, "unmapped") for f in unmapped if f in carried]
    after = {f: v for f, v in after.items() if f not in unmapped}
    before = None if before is None else {f: v for f, v in before.items() if f not in unmapped}
    if g.values is None:
        outcome, more = _create(g, e, system, ms, after, emptied)
    else:
        outcome, more = _edit(g, e, system, kind, ms, before, after)
    return outcome, log + more


def _delete(g: Golden, e: Entity, system: str, ms: int) -> tuple[str, list[tuple]]:
    if g.consume(system, ALL, None):
        return "echo", []
    if g.values is None:
        return "unchanged", []
    newest = max(g.at.values(), default=ms)
    if ms >= newest:
        g.deleted, g.values, g.at, g.by, g.changed, g.skip = [ms, system], None, {}, {}, ALL, system
        for s, fields in e.systems.items():
            if fields is None and s != system:
                g.expect(s, ALL, None, ms)
        return "deleted", []
    last = max(g.at, key=lambda f: g.at[f])
    g.rev, g.changed, g.skip = g.rev + 1, ALL, None
    for f in e.carries(system):
        g.expect(system, f, g.values.get(f), ms)
    return "lost", [(ALL, None, g.by[last], newest, None, system, ms, "edit")]


def _create(g: Golden, e: Entity, system: str, ms: int, after: dict, emptied: bool) -> tuple[str, list[tuple]]:
    if emptied:
        return "unchanged", []
    if after and all([g.consume(system, f, v) for f, v in after.items()]):
        return "echo", []
    if g.deleted and ms <= g.deleted[0]:
        return "lost", [(ALL, None, g.deleted[1], g.deleted[0], None, system, ms, "edit")]
    g.values = {f: after.get(f) for f in e.fields}
    g.at, g.by = dict.fromkeys(after, ms), dict.fromkeys(after, system)
    g.rev, g.changed, g.skip, g.deleted = 0, ALL, system, None
    for f, v in after.items():
        for s in e.others(system, f):
            g.expect(s, f, v, ms)
    return "created", []


def _edit(g: Golden, e: Entity, system: str, kind: str, ms: int, before: dict | None, after: dict) -> tuple[str, list[tuple]]:
    won, lost, echoed, log = {}, [], False, []
    for f, v in after.items():
        have = g.values.get(f)
        if g.consume(system, f, v):
            echoed = True
            continue
        if before is not None and f in before:
            g.awaited = [a for a in g.awaited if not (a[0] == system and a[1] == f and a[2] == before[f])]
            if before[f] == v:
                continue
        if v == have:
            continue
        facts = (have, g.by.get(f), g.at.get(f)), (v, system, ms)
        if kind == "INSERT" and f not in g.at:
            won[f] = v
        elif kind == "INSERT" and v is None:
            continue
        elif kind == "INSERT" and have is not None:  # both held the record before they met
            ours = system == e.authority
            (won.__setitem__(f, v) if ours else lost.append(f))
            kept, gone = facts[::-1] if ours else facts
            log.append((f, *kept, *gone, "seed"))
        else:
            current = before is not None and f in before and before[f] == have
            wins = current or (ms, system) > (g.at.get(f, -1), g.by.get(f, ""))
            (won.__setitem__(f, v) if wins else lost.append(f))
            if not wins:
                log.append((f, *facts[0], *facts[1], "edit"))
            elif not current and have is not None:
                log.append((f, *facts[1], *facts[0], "edit"))
    awaited_here = {f for f in won if any(a[0] == system and a[1] == f for a in g.awaited)}
    gap = any(g.values.get(r) is None and won.get(r) is not None for r in e.required)
    if won or lost:
        names = sorted({*won, *lost})
        g.rev, g.changed = g.rev + 1, ALL if gap else f",{','.join(names)},"
        g.skip = None if lost or awaited_here else system
        for f, v in won.items():
            g.values[f], g.at[f], g.by[f] = v, ms, system
            for s in e.others(None if f in awaited_here else system, f):
                g.expect(s, f, v, ms)
        for f in lost:
            g.expect(system, f, g.values.get(f), ms)
    return "applied" if won else "lost" if lost else "echo" if echoed else "unchanged", log


OUT = "key string, seq long, system string, outcome string, rev long, record string, changed string, skip string, conflicts string"


def _decided(g: Golden, e: Entity, key: str | None, r: Mapping[str, Any]) -> tuple:
    outcome, log = decide(g, e, r["system"], r["row_kind"], int(r["source_ms"]), json.loads(r["row"]), json.loads(r["unmapped"]) if r["unmapped"] else ())
    record = None if g.values is None else json.dumps(g.values, sort_keys=True, ensure_ascii=False)
    return key, int(r["seq"]), r["system"], outcome, g.rev, record, g.changed, g.skip, json.dumps(log, ensure_ascii=False) if log else None


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def as_batch(rows: Sequence[tuple], ddl: str) -> pa.RecordBatch:
    """Rows as an Arrow batch of the columns of ddl. A task builds a key's rows in plain Python: a frame a key costs more than its decisions."""
    columns = [c.split() for c in ddl.split(", ")]
    cells = list(zip(*rows, strict=True)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, _ARROW[t]) for v, (_, t) in zip(cells, columns, strict=True)], [n for n, _ in columns])


_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def _dicts(pdf: pd.DataFrame) -> list[dict]:
    columns = [[None if x != x else x for x in pdf[c].tolist()] for c in pdf]
    return [dict(zip(pdf.columns, r, strict=True)) for r in zip(*columns, strict=True)]


def replay(inbox: DataFrame, entity: Entity) -> DataFrame:
    """Outcome and golden revision of every inbox row (key, seq, system, row_kind, source_ms, row as JSON, unmapped as JSON), in a batch.

    A key's rows pass one task in order, which holds the key's state and a batch of rows, not its history.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, g = object(), Golden()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["key"] != key:
                    key, g = r["key"], Golden()
                out.append(_decided(g, entity, key, r))
            yield as_batch(out, OUT)

    return inbox.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, OUT)


class _Merging(StatefulProcessor):
    """A key's golden state in the state store: the record as a value, what is awaited as a list, before images and polls as maps by system.

    What nothing has answered leaves by a timer, so keys that no row touches again keep no stale expectations.
    """

    def __init__(self, entity: Entity, expires: bool):
        self.entity, self.expires = entity, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "record string, at string, by string, rev bigint, changed string, skip string, deleted string")
        self.awaited = handle.getListState("awaited", "system string, field string, value string, ms bigint, since bigint")
        self.before = handle.getMapState("before", "system string", "row string")
        self.polled = handle.getMapState("polled", "system string", "row string")

    def load(self) -> Golden:
        g = Golden()
        if self.record.exists():
            record, at, by, g.rev, g.changed, g.skip, deleted = self.record.get()
            g.values, g.at, g.by, g.deleted = json.loads(record), json.loads(at), json.loads(by), json.loads(deleted)
        g.awaited = [[s, f, json.loads(v), ms, since] for s, f, v, ms, since in self.awaited.get()]
        g.before, g.polled = ({k[0]: json.loads(v[0]) for k, v in m.iterator()} for m in (self.before, self.polled))
        return g

    def save(self, g: Golden, now: int) -> None:
        cells = [json.dumps(x, ensure_ascii=False) for x in (g.values, g.at, g.by)]
        self.record.update((*cells, g.rev, g.changed, g.skip, json.dumps(g.deleted)))
        self._keep(g.awaited, now)
        for m, rows in ((self.before, g.before), (self.polled, g.polled)):
            for k in [k[0] for k in m.keys() if k[0] not in rows]:
                m.removeKey((k,))
            for k, row in rows.items():
                m.updateValue((k,), (json.dumps(row, ensure_ascii=False),))

    def _keep(self, awaited: list[list], now: int) -> None:
        rows = [(a[0], a[1], json.dumps(a[2], ensure_ascii=False), a[3], a[4] if len(a) > 4 else now) for a in awaited]
        if not rows:
            self.awaited.clear()
            return
        self.awaited.put(rows)
        if self.expires:
            self.handle.registerTimer(min(r[4] for r in rows) + EXPECT_MS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        g, found = self.load(), [r for pdf in rows for r in _dicts(pdf)]
        yield pd.DataFrame([_decided(g, self.entity, key[0], r) for r in sorted(found, key=lambda r: r["seq"])], columns=_COLUMNS)
        self.save(g, timerValues.getCurrentProcessingTimeInMs() if self.expires else 0)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        kept = [[s, f, json.loads(v), ms, since] for s, f, v, ms, since in self.awaited.get() if since > now - EXPECT_MS]
        self._keep(kept, now)
        yield pd.DataFrame([], columns=_COLUMNS)


def stream(inbox: DataFrame, entity: Entity, expires: bool = False) -> DataFrame:
    """The same of a stream; a key's state lives in the state store (RocksDB, see flows.rocksdb) between its rows.

    Rows only count what was sent within the hour before them. expires: timers also drop what
    keys without further rows await, an hour after it was sent; such a stream runs batches
    without rows, so it is one that does not end by itself.
    """
    return inbox.groupBy("key").transformWithStateInPandas(_Merging(entity, expires), OUT, "append", "ProcessingTime" if expires else "None")


def golden_records(decided: DataFrame) -> DataFrame:
    """Each key's last revision; deleted keys are left out."""
    last = decided.groupBy("key").agg(F.max_by(F.struct("record", "rev", "changed", "skip"), "seq").alias("r"))
    return last.select("key", "r.*").where("record is not null")


def conflicts(decided: DataFrame) -> DataFrame:
    """A row for each value that lost or was overruled."""
    rows = F.from_json("conflicts", "array<array<string>>")
    names = ("field", "kept", "kept_by", "kept_ms", "lost", "lost_by", "lost_ms", "reason")
    out = decided.where("conflicts is not null").select("key", "seq", F.explode(rows).alias("c"))
    return out.select("key", "seq", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)])


def last_writer(edits: DataFrame, key: str, name: str, value: str, ms: str, system: str) -> DataFrame:
    """The part of the merge that needs no memory: of each key's field the edit with the latest commit time, on ties of the greater system."""
    return edits.groupBy(key, name).agg(F.max_by(F.struct(value, ms, system), F.struct(ms, system)).alias("w")).select(key, name, "w.*")


def poll_changes(polls: DataFrame, key: str, at: str, columns: Sequence[str], placed: Column | None = None) -> DataFrame:
    """Rows of repeated listings that differ from the member's listing before; the first one always does.

    A listing whose row was held is not stored: only one that was placed is the next one's before image.
    """
    order = Window.partitionBy(key).orderBy(at)
    row = F.struct(*columns)
    stored = F.last(F.when(placed, row), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)) if placed is not None else F.lag(row).over(order)
    return polls.withColumn("_was", stored).where(F.col("_was").isNull() | ~F.col("_was").eqNullSafe(row)).drop("_was")


@dataclass(frozen=True)
class Crosswalk:
    """Systems number their records differently: a code column for each system, and columns that find an unknown record."""

    codes: Mapping[str, str]
    link_by: tuple[str, ...]
    required: tuple[str, ...] = ()


def _found(rows: DataFrame, golden: DataFrame, walk: Crosswalk, system: str) -> DataFrame:
    """rows with _known (the record that has the code), _linked (the one record of equal link columns) and _why that one may not be taken."""
    code = walk.codes[system]
    known = golden.where(F.col(code).isNotNull()).select(F.col(code).alias("_code"), F.col("key").alias("_known"))
    links = golden.groupBy(*[F.col(c).alias(f"_{c}") for c in walk.link_by]).agg(F.count(F.lit(1)).alias("_n"), F.min("key").alias("_linked"), F.bool_or(F.col(code).isNotNull()).alias("_taken"))
    out = rows.join(known, F.col(code) == F.col("_code"), "left").join(links, [F.col(c) == F.col(f"_{c}") for c in walk.link_by], "left")
    missing, unlinkable = F.lit(False), F.lit(False)
    for r in walk.required:
        missing = missing | F.col(r).isNull()
    for c in walk.link_by:
        unlinkable = unlinkable | F.col(c).isNull()
    why = F.when(missing, "part").when(unlinkable, "unmatchable").when(F.col("_n") > 1, "ambiguous").when(F.col("_taken"), "taken")
    return out.select(*rows.columns, "_known", "_linked", why.alias("_why"))


def resolve(rows: DataFrame, golden: DataFrame, walk: Crosswalk, system: str) -> DataFrame:
    """rows with key, the golden record they are about, and held, why they wait instead (part, unmatchable, ambiguous, taken) or null.

    golden has key, the code columns and the link columns. A known code decides; else one
    record of equal link columns without a code of this system; a row that finds none is a
    new record (key and held are null). All by equi-joins, hits are counted before.
    """
    key = F.coalesce("_known", F.when(F.col("_why").isNull(), F.col("_linked")))
    return _found(rows, golden, walk, system).select(*rows.columns, key.alias("key"), F.when(F.col("_known").isNull(), F.col("_why")).alias("held"))


def awaited(rows: DataFrame, expected: DataFrame, golden: DataFrame, code: str, fields: Sequence[str]) -> DataFrame:
    """code and key of rows that answer a delivery: one record without this code awaits nothing but what the row says.

    expected has key, field and value (text) of all that the system was sent and has not
    answered; several values of a field may be awaited, any of them will do. Where expected
    and rows have ms, what was sent more than EXPECT_MS before the row is no longer awaited. A
    record whose deletion is awaited (field `*`) is answered by no row.
    """
    timed = "ms" in expected.columns and "ms" in rows.columns
    asks = _asks(expected.join(golden.where(F.col(code).isNull()).select("key"), "key", "left_semi"), fields, timed)
    said = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])
    names = asks.select("names").distinct()  # the sets of fields that records await together
    told = rows.select(F.col(code).alias("_code"), *(["ms"] if timed else []), said.alias("_said")).crossJoin(F.broadcast(names))
    told = told.select("_code", *(["ms"] if timed else []), "names", F.to_json(F.transform("names", lambda n: F.col("_said")[n])).alias("cells"))
    if not timed:
        of = asks.groupBy("names", "cells").agg(F.count_distinct("key").alias("_n"), F.min("key").alias("key"))
        hits = told.join(of, ["names", "cells"])
    else:
        hits = _active(told, asks)
    # Of a code's rows each may be answered by several records (_n), or by different ones.
    hits = hits.groupBy("_code").agg(F.max("_n").alias("_n"), F.min("key").alias("key"), F.max("key").alias("_other"))
    return hits.where("_n = 1 and key = _other").select(F.col("_code").alias(code), "key")


def _asks(expected: DataFrame, fields: Sequence[str], timed: bool) -> DataFrame:
    """names, cells and key: all that a record awaits, as its fields in order and a text of their values, a row for each choice of values; with the times from (null: ever) and until which it awaits just that."""
    sent = F.col("ms").cast("long") if timed else F.lit(0).cast("long")
    entry = F.struct(sent.alias("sent"), "field", F.col("value").cast("string").alias("value"))
    of = expected.where(sent.isNotNull()).groupBy("key").agg(F.collect_set(entry).alias("all"))
    of = of.select("key", "all", F.array_sort(F.array_distinct("all.sent")).alias("ends"))
    of = of.select("key", "all", "ends", F.posexplode("ends").alias("at", "last"))
    fresh = F.filter("all", lambda x: x["sent"] >= F.col("last"))
    of = of.select("key", F.when(F.col("at") > 0, F.get("ends", F.col("at") - 1) + EXPECT_MS).alias("from"), (F.col("last") + EXPECT_MS).alias("until"), fresh.alias("fresh"))
    of = of.withColumn("names", F.array_sort(F.array_distinct("fresh.field"))).where(F.size(F.array_except("names", F.array(*[F.lit(f) for f in fields]))) == 0)
    values = lambda n: F.array_distinct(F.transform(F.filter("fresh", lambda x: x["field"] == n), lambda x: x["value"]))
    more = lambda made, n: F.flatten(F.transform(made, lambda m: F.transform(values(n), lambda v: F.concat(m, F.array(v)))))
    choices = F.aggregate("names", F.array(F.array().cast("array<string>")), more)
    return of.select("names", F.explode(choices).alias("cell"), "key", "from", "until").withColumn("cells", F.to_json("cell")).drop("cell")


def _active(told: DataFrame, asks: DataFrame) -> DataFrame:
    """_code, key and _n of the rows told that some asks of the same names and cells are met by at their ms: how many, and which, where it is one.

    Asks come and go in time, so a running count tells how many there are, and a running
    exclusive or of their digests which one; no row is paired with all that ask the same.
    """
    digest = F.xxhash64("key")
    event = lambda df, at, side, n, code: df.select("names", "cells", at.alias("at"), F.lit(side).alias("side"), F.lit(n).alias("n"), (digest if n else F.lit(0).cast("long")).alias("which"), code.alias("_code"))
    none = F.lit(None).cast(told.schema["_code"].dataType)
    events = event(asks, F.coalesce("from", F.lit(-(1 << 63))), 0, 1, none).unionByName(event(asks, F.col("until"), 0, -1, none))
    events = events.unionByName(event(told.where("ms is not null"), F.col("ms").cast("long"), 1, 0, F.col("_code")))
    upto = Window.partitionBy("names", "cells").orderBy("at", "side")
    found = events.withColumns({"_n": F.sum("n").over(upto), "_which": F.bit_xor("which").over(upto)}).where("side = 1 and _n > 0")
    a = asks.select("names", "cells", "key", digest.alias("_which"), "from", "until")
    one = found.where("_n = 1").select("names", "cells", "_which", "at", "_code", "_n").join(a, ["names", "cells", "_which"])
    one = one.where((F.col("from").isNull() | (F.col("at") >= F.col("from"))) & (F.col("at") < F.col("until")))
    return one.select("_code", "key", "_n").unionByName(found.where("_n > 1").select("_code", F.lit(None).cast(asks.schema["key"].dataType).alias("key"), "_n"))


def place(rows: DataFrame, golden: DataFrame, walk: Crosswalk, system: str, expected: DataFrame, fields: Sequence[str], tombstones: DataFrame | None = None) -> DataFrame:
    """rows with key, held and withdrawn: where each belongs, in this order.

    A known code; the code of a deleted record (tombstones: code, key, deleted_ms), of
    several the one deleted last; the link rule, unless the row lacks what a record needs or
    what it is found by; an awaited delivery, also of rows that the rule holds as ambiguous or
    taken or would make new records. A DELETE (row_kind, where rows have it) under a code that
    was never placed is withdrawn: nothing waits for it and what waits under its code goes.
    """
    code = walk.codes[system]
    out = _found(rows, golden, walk, system)
    answers = awaited(rows, expected, golden, code, fields).select(F.col(code).alias("_code"), F.col("key").alias("_answers"))
    out, gone = out.join(answers, F.col(code) == F.col("_code"), "left").drop("_code"), F.lit(None)
    if tombstones is not None:
        dead = tombstones.groupBy(F.col(code).alias("_code")).agg(F.max_by("key", F.struct("deleted_ms", "key")).alias("_gone"))
        out, gone = out.join(dead, F.col(code) == F.col("_code"), "left"), F.col("_gone")
    deletes = F.col("row_kind") == "DELETE" if "row_kind" in rows.columns else F.lit(False)
    ruled = F.when(F.col("_why").isNull(), F.col("_linked"))
    answered = F.when(F.coalesce(F.col("_why"), F.lit("")).isin("", "ambiguous", "taken"), F.col("_answers"))
    key = F.coalesce("_known", gone, F.when(~deletes, F.coalesce(ruled, answered)))
    return out.select(*rows.columns, key.alias("key"), F.when(key.isNull() & ~deletes, F.col("_why")).alias("held"), (key.isNull() & deletes).alias("withdrawn"))


def linkable(golden: DataFrame, link_by: Sequence[str]) -> DataFrame:
    """golden and linkable: whether other systems may find a record by its link columns, that is, no other record has the same."""
    others = golden.where(" and ".join(f"{c} is not null" for c in link_by)).groupBy(*link_by).agg(F.count(F.lit(1)).alias("_n"))
    return golden.join(others, list(link_by), "left").select(*golden.columns, F.coalesce(F.col("_n") == 1, F.lit(True)).alias("linkable"))


def linked(held: DataFrame, decisions: DataFrame, golden: DataFrame, code: str) -> DataFrame:
    """held rows that a person decided on: key, and refused, why the decision cannot stand (null where it does).

    decisions has the code and key, null for a record of its own.
    """
    g = golden.select(F.col("key").alias("_record"), F.col(code).alias("_taken"))
    out = held.join(decisions.select(F.col(code).alias("_code"), "key"), F.col(code) == F.col("_code")).join(g, F.col("key") == F.col("_record"), "left")
    why = F.when(F.col("key").isNotNull() & F.col("_record").isNull(), "no such record").when(F.col("_taken") != F.col(code), "the record has another key")
    return out.select(*held.columns, "key", why.alias("refused"))


def replay_order(held: DataFrame, required: Sequence[str], code: str) -> DataFrame:
    """held and nth: the order in which rows under one code are taken again, those that have most of what a record requires first, so its owner makes it."""
    lacks = F.lit(0)
    for r in required:
        lacks = lacks + F.col(r).isNull().cast("int")
    return held.withColumn("nth", F.row_number().over(Window.partitionBy(code).orderBy(lacks, "system")))


def declared(inbox: DataFrame, columns: Sequence[str]) -> DataFrame:
    """inbox with row, the JSON of those columns that `fields` declares: what a flow does not carry is no value, a null that it carries is one."""
    cells = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])
    own = F.map_filter(cells, lambda k, _: F.array_contains(F.split("fields", ","), k))
    return inbox.withColumn("row", F.to_json(own, {"ignoreNullFields": "false"})).drop(*columns)


def inbox_history(decided: DataFrame) -> DataFrame:
    """The decided rows that something came of; those that changed nothing are no history."""
    return decided.where("outcome <> 'unchanged'")


def candidates(held: DataFrame, golden: DataFrame, link_by: Sequence[str]) -> DataFrame:
    """Held rows with the records that they might be, by equal link columns as text."""
    g = golden.select("key", *[F.col(c).cast("string").alias(f"_{c}") for c in link_by])
    return held.join(g, [F.col(c).cast("string") == F.col(f"_{c}") for c in link_by])
