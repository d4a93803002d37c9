"""Flows: rows of one system's table translated into another's, and what is refused up front."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.sources.contracts import Contract, Model

#: Aggregates of a flow, and settings of its job with their least and greatest value.
AGGREGATES = ("sum", "count", "min", "max", "avg")
SETTINGS = {"checkpointInterval": (1_000, 3_600_000), "checkpointTimeout": (10_000, 86_400_000), "rowsPerSecond": (1, 1_000_000), "pollSeconds": (1, 86_400)}
API_TYPES = ("string", "int", "bigint", "boolean")


@dataclass(frozen=True)
class Flow:
    id: str
    source: str
    target: str
    columns: Mapping[str, str] = field(default_factory=dict)
    values: Mapping[str, Mapping[Any, Any]] = field(default_factory=dict)
    match: Mapping[str, Any] = field(default_factory=dict)
    link_by: tuple[str, ...] = ()
    aggregates: Mapping[str, str] = field(default_factory=dict)
    filled_by_target: tuple[str, ...] = ()
    job: Mapping[str, int] = field(default_factory=dict)

    @property
    def system(self) -> str:
        """The system that the rows come from."""
        return self.source.split(".")[0]


def parse(doc: Mapping[str, Any]) -> Flow:
    return Flow(
        doc["id"], doc["from"], doc["to"], doc.get("columns") or {}, doc.get("values") or {}, doc.get("match") or {}, tuple(doc.get("linkBy") or ()), doc.get("aggregates") or {},
        tuple(doc.get("filledByTarget") or ()), doc.get("job") or {},
    )


def load_all(folder: str | Path) -> list[Flow]:
    """Every flow of a folder, in order of file names."""
    return [parse(yaml.safe_load(p.read_text(encoding="utf-8"))) for p in sorted(Path(folder).glob("*.yaml"))]


# --- translation


def _cases(cases: Iterable[tuple[Column, Any]]) -> Column:
    """The value of the first case that holds, else null."""
    return F.coalesce(*[F.when(holds, v) for holds, v in cases])


def mapped(source: str, values: Mapping[Any, Any] | None) -> Column:
    """A source column, or its value by a map; what the map does not hold is null."""
    text = lambda k: str(k).lower() if isinstance(k, bool) else str(k)
    return _cases((F.col(source).cast("string") == text(k), v) for k, v in values.items()) if values else F.col(source)


def translate(rows: DataFrame, flow: Flow, keep: Sequence[str] = ()) -> DataFrame:
    """The flow's target columns, `keep`, and _unmapped: fields that had a value which the map does not hold.

    Rows that differ from the flow's match are left out.
    """
    for c, v in flow.match.items():
        rows = rows.where(F.col(c) == F.lit(v))
    lost = [F.when(F.col(flow.columns[t]).isNotNull() & mapped(flow.columns[t], m).isNull(), F.lit(t)) for t, m in flow.values.items()]
    unmapped = F.array_compact(F.array(*lost)) if lost else F.array().cast("array<string>")
    return rows.select(*keep, *[mapped(s, flow.values.get(t)).alias(t) for t, s in flow.columns.items()], unmapped.alias("_unmapped"))


def back(rows: DataFrame, flow: Flow, keep: Sequence[str] = ()) -> DataFrame:
    """Target rows of an inbound flow in terms of its source: maps reversed, match columns filled in."""
    cells = [(_cases((F.col(t) == F.lit(v), k) for k, v in flow.values[t].items()) if flow.values.get(t) else F.col(t)).alias(s) for t, s in flow.columns.items()]
    return rows.select(*keep, *cells, *[F.lit(v).alias(c) for c, v in flow.match.items()])


def inbox_rows(rows: DataFrame, flow: Flow, kind: str = "row_kind", ms: str = "source_ms") -> DataFrame:
    """What a flow puts into its target's inbox: system, row_kind, source_ms, fields, unmapped and the columns."""
    out = translate(rows, flow, [kind, ms])
    return out.select(
        F.lit(flow.system).alias("system"), F.col(kind).alias("row_kind"), F.col(ms).alias("source_ms"), F.array_join(F.array(*map(F.lit, flow.columns)), ",").alias("fields"),
        F.array_join("_unmapped", ",").alias("unmapped"), *flow.columns,
    )


# --- refusals: each function returns sentences, none where all is well


def _models(contracts: Iterable[Contract]) -> dict[str, tuple[Contract, Model]]:
    """Tables by `system.table`, the system being the first part of the contract's id."""
    out = {}
    for c in contracts:
        for m in c.models:
            out[f"{c.id.split('.')[0]}.{m.name}"] = (c, m)
            out.setdefault(c.id, (c, m))
    return out


def _names(model: Model) -> set[str]:
    return {p.name for p in model.properties}


def mapping_problems(flow: Flow, source: Model, target: Model) -> list[str]:
    """Maps without a column, undeclared columns, columns filled twice, classifications that get lost."""
    out = [f"{flow.id}: {c} has a value map but no source column" for c in flow.values if c not in flow.columns]
    out += [f"{flow.id}: {t} is not a column of {target.name}" for t in flow.columns if t not in _names(target)]
    out += [f"{flow.id}: {s} is not a column of {source.name}" for s in flow.columns.values() if s not in _names(source)]
    out += [f"{flow.id}: {t} is filled by a column and by an aggregate" for t in flow.columns if t in flow.aggregates]
    theirs, ours = {p.name: p for p in source.properties}, {p.name: p for p in target.properties}
    for t, s in flow.columns.items():
        if s in theirs and t in ours and theirs[s].classification and not ours[t].classification:
            out.append(f"{flow.id}: {s} is classified {theirs[s].classification}, {t} is not")
    return out


def gaps(flow: Flow, target: Model) -> list[str]:
    """Required columns and keys that nothing fills."""
    filled = {*flow.columns, *flow.aggregates, *flow.filled_by_target}
    return [f"{flow.id}: nothing fills {p.name}, which {target.name} needs" for p in target.properties if (p.required or p.primary_key) and p.name not in filled]


def job_problems(flow: Flow) -> list[str]:
    out = [f"{flow.id}: no job setting is called {k}" for k in flow.job if k not in SETTINGS]
    for k, v in flow.job.items():
        if k in SETTINGS:
            low, high = SETTINGS[k]
            if isinstance(v, bool) or not isinstance(v, int):
                out.append(f"{flow.id}: {k} must be a whole number")
            elif not low <= v <= high:
                out.append(f"{flow.id}: {k} must be between {low} and {high}")
    if {"checkpointInterval", "pollSeconds"} <= set(flow.job) and not out and flow.job["checkpointInterval"] <= 1000 * flow.job["pollSeconds"]:
        out.append(f"{flow.id}: checkpoints must be further apart than polls")
    return out


def match_problems(flow: Flow, source: Model) -> list[str]:
    out = [f"{flow.id}: matches {c}, which {source.name} does not have" for c in flow.match if c not in _names(source)]
    out += [f"{flow.id}: matches {c}, which is not in the key of {source.name}" for c in flow.match if c in _names(source) and c not in source.keys]
    if flow.match:
        out += [f"{flow.id}: the key column {k} of {source.name} is neither matched nor mapped" for k in source.keys if k not in flow.match and k not in flow.columns.values()]
    return out


def pair_problems(there: Flow, here: Flow) -> list[str]:
    """Two flows that lead there and back: every round trip must end where it began."""
    out = []
    for t, s in there.columns.items():
        returned = {a: b for a, b in here.columns.items() if b == t}
        if not returned:
            out.append(f"{here.id}: {t} does not come back")
        elif s not in returned:
            out.append(f"{here.id}: {s} comes back as {', '.join(returned)}")
    for t, m in there.values.items():
        s = there.columns.get(t)
        if s not in here.values:
            out.append(f"{here.id}: {t} is mapped one way only")
            continue
        if len(set(map(str, m.values()))) < len(m):
            out.append(f"{there.id}: the map of {t} leads two values to one")
        if {str(v): str(k) for k, v in m.items()} != {str(k): str(v) for k, v in here.values[s].items()}:
            out.append(f"{here.id}: the map of {s} does not undo that of {t}")
    return out


_CALL = re.compile(r"^(\w+)\((\*|\w+)\)$")


def aggregate_problems(flow: Flow, source: Model, hub: bool = False) -> list[str]:
    if not flow.aggregates:
        return []
    out = [f"{flow.id}: a hub takes no aggregates"] if hub else []
    out += [f"{flow.id}: an aggregate flow has no value maps"] if flow.values else []
    for t, call in flow.aggregates.items():
        found = _CALL.match(str(call).replace(" ", ""))
        if not found or found[1] not in AGGREGATES:
            out.append(f"{flow.id}: {t} must be one of {', '.join(AGGREGATES)} of a column")
        elif found[2] == "*" and found[1] != "count":
            out.append(f"{flow.id}: only count takes *")
        elif found[2] != "*" and found[2] not in _names(source):
            out.append(f"{flow.id}: {found[2]} is not a column of {source.name}")
    out += [] if flow.columns else [f"{flow.id}: nothing says what the rows are grouped by"]
    out += [] if source.keys else [f"{flow.id}: {source.name} has no key, so its lines cannot be told apart"]
    return out


def link_problems(flow: Flow, hub: Model, codes: Mapping[str, str]) -> list[str]:
    """Crosswalks: a system's code column, and the columns that find a record it does not know."""
    code = codes.get(flow.system)
    out = []
    if codes and not code:
        out.append(f"{flow.id}: {flow.system} has no code column in {hub.name}")
    if code and code not in flow.columns:
        out.append(f"{flow.id}: the code column {code} is not filled")
    for c in flow.link_by:
        if c not in flow.columns:
            out.append(f"{flow.id}: links by {c}, which it does not carry")
        if c in codes.values() or c in hub.keys:
            out.append(f"{flow.id}: links by {c}, which is a key")
    return out + [f"{flow.id}: {c} is filled by the target and by the flow" for c in flow.filled_by_target if c in flow.columns]


def hub_problems(hub: Contract, flows: Sequence[Flow]) -> list[str]:
    """A hub needs an authority that feeds it and a key; one table of a system fills a field."""
    model, settings = hub.models[0], hub.custom.get("hub") or {}
    inbound = [f for f in flows if f.target in (hub.id, f"{hub.id.split('.')[0]}.{model.name}")]
    authority = settings.get("authority")
    out = [f"{hub.id}: no table is the authority"] if not authority else []
    if authority and authority not in {f.source for f in inbound}:
        out.append(f"{hub.id}: the authority {authority} sends nothing")
    out += [] if model.keys else [f"{hub.id}: the record has no key"]
    owner: dict[tuple[str, str], str] = {}
    keys = {*model.keys, *(settings.get("keys") or {}).values()}
    for f in inbound:
        for c in f.columns:
            if c not in keys and owner.setdefault((f.system, c), f.source) != f.source:
                out.append(f"{hub.id}: {f.source} and {owner[f.system, c]} both fill {c}")
    return out


def api_problems(flow: Flow, source: Contract | None, target: Contract | None) -> list[str]:
    """Tables behind an API are read, not written; a listing must say where its rows and their change time are."""
    out = []
    is_api = lambda c: c is not None and any(s.get("type") == "api" for s in c.servers)
    if is_api(target):
        out.append(f"{flow.id}: nothing can be written to the API behind {flow.target}")
    if is_api(source):
        server = next(s for s in source.servers if s.get("type") == "api")
        out += [f"{flow.id}: the API of {flow.source} does not say its {n}" for n in ("contentField", "changedAt") if not server.get(n)]
        out += [f"{flow.id}: {p.name} cannot be read as {p.type}; an API answers {', '.join(API_TYPES)}" for m in source.models for p in m.properties if p.type not in API_TYPES]
        if target is not None and "hub" not in target.custom:
            out.append(f"{flow.id}: what an API lists can only go to a hub")
    return out


def replication_problems(model: Model, columns: Sequence[str], where_columns: Sequence[str] = (), logical: bool = True, generated_columns: Sequence[str] = ()) -> list[str]:
    """A replica needs the source's key, and a logical one may filter on nothing else."""
    have, out = _names(model), []
    if not model.keys:
        out.append(f"{model.name}: without a key its rows cannot be told apart")
    out += [f"{model.name}: {c} is not a column" for c in [*columns, *where_columns] if c not in have]
    out += [f"{model.name}: the replica lacks the key column {k}" for k in model.keys if k not in columns]
    out += [f"{model.name}: the filter uses {c}, which is not in the key" for c in where_columns if logical and c in have and c not in model.keys]
    return out + [f"{model.name}: {c} is generated and copied" for c in generated_columns if c in columns]


def view_problems(model: Model, columns: Sequence[str], engine: str) -> list[str]:
    out = [] if engine in ("postgres", "postgresql", "parquet", "view") else [f"{model.name}: {engine} tables cannot be shown as views"]
    out += [f"{model.name}: {c} is not a column" for c in columns if c not in _names(model)]
    return out + [f"{model.name}: {c} is classified and would be shown" for c in columns if c in model.classified]


def identity_problem(results: DataFrame, contract_id: str) -> str | None:
    """Why a table's key cannot identify rows: its newest uniqueness check failed."""
    kinds = ("field_unique", "field_primary_key", "unique")
    newest = results.where((F.col("contract_id") == contract_id) & F.col("check_type").isin(*kinds)).orderBy(F.col("run_at").desc(), F.when(F.col("status") == "fail", 0).otherwise(1)).limit(1).collect()
    return f"{contract_id}: {newest[0]['name']} failed on {newest[0]['run_at']}" if newest and newest[0]["status"] == "fail" else None


def unresolved(contracts: Iterable[Contract]) -> list[str]:
    """Sources that contracts name and that are neither a contract nor a catalogue address."""
    contracts = list(contracts)
    known = {c.id for c in contracts}
    return [f"{c.id}: is derived from {d}, which nobody knows" for c in contracts for d in c.derived_from if d not in known and not d.startswith("//")]


def drift(declared: Model, df: DataFrame) -> list[str]:
    """How a live table differs from its contract where it matters: columns that are gone or of another type."""
    have = {f.name: f.dataType for f in df.schema}
    out = []
    for f in declared.schema():
        if f.name not in have:
            out.append(f"{declared.name}: {f.name} is gone")
        elif have[f.name] != f.dataType:
            out.append(f"{declared.name}: {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return out


def resume(checkpoint: bool, drifted: Sequence[str], log_reaches_back: bool = True) -> str:
    """What starting a flow means: fresh, resume or refuse."""
    if not checkpoint:
        return "fresh"
    return "refuse" if drifted or not log_reaches_back else "resume"


def problems(flows: Sequence[Flow], contracts: Sequence[Contract]) -> list[str]:
    """Everything that is refused about a set of flows; empty where all of them may run."""
    tables, out = _models(contracts), []
    for f in flows:
        missing = [t for t in (f.source, f.target) if t not in tables]
        out += [f"{f.id}: no contract describes {t}" for t in missing] + job_problems(f)
        if missing:
            continue
        (a, source), (b, target) = tables[f.source], tables[f.target]
        hub = b.custom.get("hub")
        out += mapping_problems(f, source, target) + match_problems(f, source) + aggregate_problems(f, source, bool(hub)) + api_problems(f, a, b)
        if hub:
            out += link_problems(f, target, hub.get("keys") or {})
        elif "hub" not in a.custom:
            out += gaps(f, target)
        if not hub and "hub" not in a.custom and not f.aggregates and any(g.source == f.target and g.target == f.source for g in flows):
            out.append(f"{f.id}: two tables that feed each other need a hub between them")
    for c in contracts:
        if c.custom.get("hub"):
            out += hub_problems(c, flows)
            for there in [f for f in flows if tables.get(f.target, (None,))[0] is c]:
                out += [p for here in flows if here.source == there.target and here.target == there.source for p in pair_problems(there, here)]
    return out
