"""The crosswalk as a stream: rows of systems that number their records differently, from an inbox to golden records.

Two keyed states in line, with no table looked up. The first one is of a system's code: it
knows which family of records the code belongs to, and keeps its rows until that is known. A
family is the records that were first placed under the same link values, so all that a link
rule asks is in one state: the second one places rows, holds what a person must decide, takes
held rows again when their code gets a record, and merges. A batch passes the same rows
through the same functions.
"""

from __future__ import annotations

import gc
import hashlib
import json
import pickle
import zlib
from collections.abc import Iterator, MutableMapping, Sequence
from dataclasses import dataclass, field
from operator import itemgetter
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .golden import ALL, EXPECT_MS, Entity, Golden, _dicts, as_batch, decide

#: What an inbox row may be besides a row kind: a person's decision on a held code (row: {"key": record or null for one of its own}).
LINK = "LINK"
_HELD, _WITHDRAW = "HELD", "WITHDRAW"
ROUTED = "family string, seq long, nth int, system string, code string, row_kind string, source_ms long, row string, unmapped string, reason string"
OUT = "key string, seq long, nth int, system string, code string, outcome string, reason string, rev long, record string, changed string, skip string, conflicts string"
_ROUTED, _OUT = ([c.split()[0] for c in s.split(", ")] for s in (ROUTED, OUT))
_said = itemgetter(*_ROUTED[3:])
_hashed, _sorted = json.JSONEncoder(ensure_ascii=False, default=str).encode, json.JSONEncoder(ensure_ascii=False, sort_keys=True).encode


@dataclass(frozen=True)
class Rules:
    """What a record needs and is found by."""

    entity: Entity
    link_by: tuple[str, ...]

    def lacks(self, row: dict) -> int:
        return sum(r not in row for r in self.entity.required)

    def waits(self, row: dict) -> str | None:
        """Why a row of an unknown code cannot be looked up by the link rule."""
        if self.lacks(row):
            return "part"
        return "unmatchable" if any(row.get(c) is None for c in self.link_by) else None

    def family(self, row: dict) -> str:
        return _digest([row[c] for c in self.link_by])

    def in_order(self, rows: dict[str, dict]) -> list[dict]:
        """Rows under one code by system, the owner's first: what has most of what a record requires."""
        return [rows[s] for s in sorted(rows, key=lambda s: (self.lacks(json.loads(rows[s]["row"])), s))]


def _digest(parts: Sequence[Any]) -> str:
    return hashlib.sha256(_hashed(parts).encode()).hexdigest()[:24]


def _root(system: str) -> str:
    return system.split(".")[0]


# --- the first state: a code


@dataclass
class Code:
    family: str | None = None
    rows: dict[str, dict] = field(default_factory=dict)  # the last row of each system


def route(code: Code, rules: Rules, row: dict) -> list[dict]:
    """What a row of a code sends to a family: itself, and what has waited for it."""
    fields, kind = json.loads(row["row"] or "{}"), row["row_kind"]
    to = lambda r, family, kind=None, **more: {**r, "family": family, "row_kind": kind or r["row_kind"], "reason": None, **more}
    if kind == LINK:
        key, before = fields.get("key"), code.family
        code.family = key.split(":")[0] if key else _digest(["own", _root(row["system"]), row["code"]])
        out = [to(row, before, _WITHDRAW)] if before else []
        return out + [to(row, code.family)] + [to(r, code.family, "INSERT") for r in rules.in_order(code.rows)]
    waiting = dict(code.rows)
    if kind == "DELETE":
        code.rows.pop(row["system"], None)
    elif kind != "UPDATE_BEFORE":
        code.rows[row["system"]] = row
    if code.family:
        return [to(row, code.family)]
    alone = _digest(["held", row["system"], row["code"]])
    if kind in ("DELETE", "UPDATE_BEFORE"):
        return [to(row, alone, _HELD, reason="withdrawn" if kind == "DELETE" else "before")]
    if why := rules.waits(fields):
        return [to(row, alone, _HELD, reason=why)]
    code.family = rules.family(fields)
    waiting.pop(row["system"], None)
    return [to(row, code.family)] + [to(r, code.family, "INSERT") for r in rules.in_order(waiting)]


def _numbered(rows: list[dict], of: dict) -> list[tuple]:
    """Released rows follow the row that released them."""
    return [(r["family"], of["seq"], i, *_said(r)) for i, r in enumerate(rows)]


# --- the second state: a family


@dataclass
class Family:
    """records by key; the record of each code, as [key]; held rows by code and system."""

    records: MutableMapping[str, Golden]
    codes: MutableMapping[str, list]
    held: MutableMapping[str, dict]
    of: MutableMapping[str, dict]  # each record's code by system


def _answered(family: Family, row: dict, fields: dict) -> str | None:
    """The one record without a code of this system that awaits nothing from it but what the row says."""
    hits = []
    for key, g in family.records.items():
        mine = [a for a in g.awaited if a[0] == row["system"] and a[3] > row["source_ms"] - EXPECT_MS]
        names = {a[1] for a in mine}
        if g.values is not None and mine and ALL not in names and _root(row["system"]) not in family.of.get(key, {}) and all(any(a[1] == n and n in fields and fields[n] == a[2] for a in mine) for n in names):
            hits.append(key)
    return hits[0] if len(hits) == 1 else None


def _place(family: Family, rules: Rules, row: dict, fields: dict) -> tuple[str | None, str | None]:
    """(key, why it is held) of a row whose code has no record."""
    if why := rules.waits(fields):
        return None, why
    hits = [k for k, g in family.records.items() if g.values is not None and all(g.values.get(c) == fields[c] for c in rules.link_by)]
    why = "ambiguous" if len(hits) > 1 else "taken" if hits and _root(row["system"]) in family.of.get(hits[0], {}) else None
    key = hits[0] if hits and not why else _answered(family, row, fields)
    if key or why:
        return key, None if key else why
    return f"{row['family']}:{_root(row['system'])}|{row['code']}", None


def settle(family: Family, rules: Rules, row: dict) -> list[tuple]:
    """Place a row, merge it, and take held rows of its code again: what came of each."""
    at, kind, system = f"{_root(row['system'])}|{row['code']}", row["row_kind"], row["system"]
    told = lambda outcome, reason=None, key=None: [(key, row["seq"], row["nth"], system, row["code"], outcome, reason, *[None] * 5)]
    if kind == _HELD:
        return told(row["reason"] if row["reason"] in ("withdrawn", "before") else "held", None if row["reason"] in ("withdrawn", "before") else row["reason"])
    if kind == _WITHDRAW:
        family.held.pop(at, None)
        return []
    fields = json.loads(row["row"] or "{}")
    if kind == LINK:
        key = fields.get("key") or f"{row['family']}:{at}"
        family.codes[at] = [key]
        family.of[key] = {**family.of.get(key, {}), _root(system): row["code"]}
        return told("linked", key=key)
    known = family.codes.get(at)
    if known is None:
        if kind in ("DELETE", "UPDATE_BEFORE"):
            if kind == "DELETE" and (held := family.held.get(at)):
                left = {s: r for s, r in held.items() if s != system}
                family.held[at] = left
            return told("withdrawn" if kind == "DELETE" else "before")
        key, why = _place(family, rules, row, fields)
        if key is None:
            family.held[at] = {**(family.held.get(at) or {}), system: row}
            return told("held", why)
        family.codes[at] = [key]
        family.of[key] = {**family.of.get(key, {}), _root(system): row["code"]}
    else:
        key = known[0]
    g = family.records.get(key) or Golden()
    outcome, log = decide(g, rules.entity, system, kind, int(row["source_ms"]), fields, json.loads(row["unmapped"]) if row["unmapped"] else ())
    family.records[key] = g
    record = None if g.values is None else _sorted(g.values)
    out = [(key, row["seq"], row["nth"], system, row["code"], outcome, None, g.rev, record, g.changed, g.skip, json.dumps(log, ensure_ascii=False) if log else None)]
    if known is None and (held := family.held.pop(at, None)):
        for i, r in enumerate(rules.in_order({s: r for s, r in held.items() if s != system}), 1):
            out += settle(family, rules, {**r, "seq": row["seq"], "nth": row["nth"] + i, "row_kind": "INSERT"})
    return out


# --- in a batch, and as a stream


def _in_turn(frames: Iterator[pd.DataFrame], *by: str) -> list[dict]:
    return sorted((r for pdf in frames for r in _dicts(pdf)), key=itemgetter(*by))


def _rows(inbox: DataFrame) -> DataFrame:
    return inbox.select(F.substring_index("system", ".", 1).alias("root"), "system", "code", "seq", "row_kind", "source_ms", "row", "unmapped")


def replay(inbox: DataFrame, rules: Rules) -> DataFrame:
    """What comes of every inbox row (system, code, seq, row_kind, source_ms, row and unmapped as JSON), in a batch; held rows that were taken again have a row of their own for that."""

    def grouped(batches: Iterator[pa.RecordBatch], by: list[str], new, take, ddl: str) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (key := [row[c] for c in by]) != now:
                    now, state = key, new()
                out += take(state, row)
            yield as_batch(out, ddl)

    first = lambda batches: grouped(batches, ["root", "code"], Code, lambda s, row: _numbered(route(s, rules, row), row), ROUTED)
    second = lambda batches: grouped(batches, ["family"], lambda: Family({}, {}, {}, {}), lambda s, row: settle(s, rules, row), OUT)
    routed = _rows(inbox).repartition("root", "code").sortWithinPartitions("root", "code", "seq").mapInArrow(first, ROUTED)
    return routed.repartition("family").sortWithinPartitions("family", "seq", "nth").mapInArrow(second, OUT)


def _paged(rows: DataFrame, by: Sequence[str], pages: int) -> DataFrame:
    return rows.withColumn("page", F.pmod(F.xxhash64(*by), F.lit(pages)).cast("int"))


class _Slots:
    """A page's state: entries by name, dealt over slots that are read and written whole. A batch touches only slots that its rows name, unpacks only entries that it asks for, and asks nothing of a new page."""

    def __init__(self, state: MapState, number: int):
        self.state, self.number = state, number
        self.slots, self.packed, self.values, self.changed = {}, {}, {}, set()
        self.new = not state.exists()

    def of(self, kind: str, key: str | None) -> str:
        if (at := (kind, key)) not in self.slots:
            self.slots[at] = f"{kind} {zlib.crc32(str(key).encode()) % self.number}"
        return self.slots[at]

    def _entries(self, slot: str) -> dict[Any, bytes]:
        if slot not in self.packed:
            found = None if self.new else self.state.getValue((slot,))
            self.packed[slot] = pickle.loads(zlib.decompress(found[0])) if found else {}
        return self.packed[slot]

    def get(self, slot: str, name: Any) -> Any:
        if (at := (slot, name)) not in self.values:
            packed = self._entries(slot).get(name)
            self.values[at] = None if packed is None else pickle.loads(packed)
        return self.values[at]

    def set(self, slot: str, name: Any, value: Any) -> None:
        """None removes."""
        self.values[slot, name] = value
        self.changed.add((slot, name))

    def flush(self) -> None:
        for slot, name in self.changed:
            if (value := self.values[slot, name]) is None:
                self._entries(slot).pop(name, None)
            else:
                self._entries(slot)[name] = pickle.dumps(value)
        for slot in {slot for slot, _ in self.changed}:
            if entries := self.packed[slot]:
                self.state.updateValue((slot,), (zlib.compress(pickle.dumps(entries), 1),))
            elif not self.new:
                self.state.removeKey((slot,))


class _Paging(StatefulProcessor):
    """A page of keys: one call and a few slots for many keys, as every call and every read or write of a state costs more than the decisions on a row."""

    columns: list[str]

    def __init__(self, rules: Rules, slots: int):
        self.rules, self.slots = rules, slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("slots", "slot string", "entries binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        slots, collects = _Slots(self.state, self.slots), gc.isenabled()
        gc.disable()  # a page's many rows and entries hold no cycles, and looking for some takes a fifth of the time
        try:
            out = self.take(slots, rows)
            slots.flush()
        finally:
            if collects:
                gc.enable()
        yield pd.DataFrame(out, columns=self.columns)


class _Routing(_Paging):
    """A page of codes: of each its family, and the last row of each system, of which a code has few."""

    columns = _ROUTED

    def take(self, slots: _Slots, rows: Iterator[pd.DataFrame]) -> list[tuple]:
        codes, out = {}, []
        for row in _in_turn(rows, "seq"):
            at = slots.of(row["root"], row["code"]), row["code"]
            if at not in codes:
                codes[at] = Code(*slots.get(*at) or ())
            out += _numbered(route(codes[at], self.rules, row), row)
        for at, code in codes.items():
            slots.set(*at, [code.family, code.rows])
        return out


class _OfFamily:
    """What a family keeps of its records, as a mapping: all in one entry, as they are few."""

    def __init__(self, slots: _Slots, family: str, kind: str, load=lambda x: x, dump=lambda x: x):
        self.slots, self.kind, self.load, self.dump = slots, kind, load, dump
        self.at = slots.of("family", family), family

    def _kept(self) -> dict[str, dict]:
        return self.slots.get(*self.at) or {}

    def get(self, key: str, default: Any = None) -> Any:
        found = self._kept().get(self.kind, {}).get(key)
        return default if found is None else self.load(found)

    def items(self) -> list[tuple[str, Any]]:
        return [(k, self.load(v)) for k, v in self._kept().get(self.kind, {}).items()]

    def __setitem__(self, key: str, value: Any) -> None:
        kept = self._kept()
        kept.setdefault(self.kind, {})[key] = self.dump(value)
        self.slots.set(*self.at, kept)


class _OfCodes:
    """What a family keeps of its codes, as a mapping: an entry for each in the code's own slot, as they may be many."""

    def __init__(self, slots: _Slots, family: str, kind: str):
        self.slots, self.family, self.kind = slots, family, kind

    def _at(self, key: str) -> tuple[str, str]:
        return self.slots.of(key.split("|")[0], key), (self.family, key)

    def get(self, key: str) -> Any:
        return (self.slots.get(*self._at(key)) or {}).get(self.kind)

    def pop(self, key: str, default: Any = None) -> Any:
        kept = self.slots.get(*(at := self._at(key))) or {}
        if self.kind not in kept:
            return default
        found = kept.pop(self.kind)
        self.slots.set(*at, kept or None)
        return found

    def __setitem__(self, key: str, value: Any) -> None:
        at = self._at(key)
        self.slots.set(*at, {**(self.slots.get(*at) or {}), self.kind: value})


class _Settling(_Paging):
    """A page of families: of each its few records, the record of each code, and held rows by code."""

    columns = _OUT

    def take(self, slots: _Slots, rows: Iterator[pd.DataFrame]) -> list[tuple]:
        families, out = {}, []
        for row in _in_turn(rows, "seq", "nth"):
            if (name := row["family"]) not in families:
                records = _OfFamily(slots, name, "records", lambda x: Golden(**x), lambda g: g.__dict__)
                families[name] = Family(records, _OfCodes(slots, name, "codes"), _OfCodes(slots, name, "held"), _OfFamily(slots, name, "of"))
            out += settle(families[name], self.rules, row)
        return out


def stream(inbox: DataFrame, rules: Rules, pages: int = 1024, slots: int = 8) -> DataFrame:
    """The same of a stream of inbox rows in the order of seq, batch after batch; both states live in RocksDB (see flows.rocksdb).

    Codes, and families too, are dealt over pages, and a page's entries over slots for each
    system and for families. More of both make a slot, which is read and written whole where a
    batch touches it, smaller, and calls more; a stream goes on from its checkpoint with the
    numbers it began with.
    """
    routed = _paged(_rows(inbox), ("root", "code"), pages).groupBy("page").transformWithStateInPandas(_Routing(rules, slots), ROUTED, "append", "None")
    return _paged(routed, ("family",), pages).groupBy("page").transformWithStateInPandas(_Settling(rules, slots), OUT, "append", "None")


def still_held(settled: DataFrame) -> DataFrame:
    """system, code and reason of rows that wait: the last word on each is that it is held."""
    last = settled.groupBy("system", "code").agg(F.max_by(F.struct("outcome", "reason"), F.struct("seq", "nth")).alias("r"))
    return last.where("r.outcome = 'held'").select("system", "code", "r.reason")


def records(settled: DataFrame) -> DataFrame:
    """key and record of each golden record, as its last row left it; deleted ones are left out."""
    last = settled.where("rev is not null").groupBy("key").agg(F.max_by(F.struct("record"), F.struct("seq", "nth")).alias("r"))
    return last.select("key", "r.record").where("record is not null")
