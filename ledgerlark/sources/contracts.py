"""Contracts: what tables are promised to hold, read from YAML."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Physical types by their Spark type; what is not listed lands as a string.
_TYPES: dict[str, T.DataType] = {
    "bigint": T.LongType(), "int": T.IntegerType(), "integer": T.IntegerType(), "smallint": T.ShortType(), "tinyint": T.ShortType(), "bit": T.BooleanType(),
    "boolean": T.BooleanType(), "float": T.DoubleType(), "double": T.DoubleType(), "double precision": T.DoubleType(), "real": T.FloatType(), "date": T.DateType(),
    "datetime": T.TimestampNTZType(), "datetime2": T.TimestampNTZType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "bytea": T.BinaryType(),
}
_DECIMALS = ("decimal", "numeric", "money")


def spark_type(physical: str | None) -> T.DataType:
    """The Spark type of a physical type: precision is kept, a string's length is not, unknown types are strings."""
    name, _, rest = (physical or "").strip().lower().partition("(")
    name = name.strip()
    if name in _DECIMALS:
        digits = [int(x) for x in rest.rstrip(")").split(",") if x.strip().isdigit()]
        return T.DecimalType(digits[0] if digits else 38, digits[1] if len(digits) > 1 else 4 if not digits else 0)
    return _TYPES.get(name, T.StringType())


@dataclass(frozen=True)
class Property:
    name: str
    type: str = "text"
    required: bool = False
    unique: bool = False
    primary_key: bool = False
    classification: str | None = None
    references: tuple[str, ...] = ()


@dataclass(frozen=True)
class QualityRule:
    """A hand-written rule: a query for one number that must be `must_be`."""

    description: str
    query: str
    dimension: str | None = None
    must_be: float = 0
    scope: str = "window"
    engine: str | None = None


@dataclass(frozen=True)
class Model:
    name: str
    properties: tuple[Property, ...] = ()
    quality: tuple[QualityRule, ...] = ()
    window_predicate: str | None = None

    @property
    def keys(self) -> tuple[str, ...]:
        return tuple(p.name for p in self.properties if p.primary_key)

    @property
    def classified(self) -> tuple[str, ...]:
        return tuple(p.name for p in self.properties if p.classification)

    def schema(self) -> T.StructType:
        return T.StructType([
            T.StructField(p.name, spark_type(p.type), not (p.required or p.primary_key), {"pk": p.primary_key, "unique": p.unique, "classification": p.classification or "", "fk": list(p.references)})
            for p in self.properties
        ])


@dataclass(frozen=True)
class Contract:
    id: str
    name: str | None = None
    domain: str | None = None
    tenant: str | None = None
    models: tuple[Model, ...] = ()
    servers: tuple[Mapping[str, Any], ...] = ()
    sla: Mapping[str, Any] = field(default_factory=dict)
    custom: Mapping[str, Any] = field(default_factory=dict)

    #: The least score of a contract that states none.
    DEFAULT_FLOOR = 0.95

    @property
    def floor(self) -> float:
        return float(self.sla.get("minScore", self.DEFAULT_FLOOR))

    @property
    def window_predicate(self) -> str | None:
        return self.custom.get("windowPredicate")

    @property
    def derived_from(self) -> tuple[str, ...]:
        given = self.custom.get("derivedFrom") or ()
        return (given,) if isinstance(given, str) else tuple(given)

    def model(self, name: str) -> Model:
        return next(m for m in self.models if m.name == name)


def _references(relations: Iterable[Mapping[str, Any]] | None) -> tuple[str, ...]:
    """Targets `table.column` of the foreign keys; a scalar target and a list are both read."""
    out: list[str] = []
    for r in relations or ():
        if r.get("type") == "foreignKey":
            to = r.get("to") or ()
            out += [to] if isinstance(to, str) else list(to)
    return tuple(out)


def parse(doc: Mapping[str, Any]) -> Contract:
    """A contract from its YAML document."""
    if not doc.get("id"):
        raise ValueError("a contract needs an id")

    def property_(p: Mapping[str, Any]) -> Property:
        kind = p.get("physicalType") or p.get("logicalType") or "text"
        return Property(p["name"], kind, bool(p.get("required")), bool(p.get("unique")), bool(p.get("primaryKey")), p.get("classification"), _references(p.get("relationships")))

    def rule(q: Mapping[str, Any]) -> QualityRule:
        return QualityRule(q.get("description", ""), q["query"].strip(), q.get("dimension"), q.get("mustBe", 0), q.get("scope", "window"), q.get("engine"))

    def model(m: Mapping[str, Any]) -> Model:
        custom = {c["property"]: c.get("value") for c in m.get("customProperties") or ()}
        return Model(m["name"], tuple(map(property_, m.get("properties") or ())), tuple(rule(q) for q in m.get("quality") or () if q.get("type", "sql") == "sql" and q.get("query")), custom.get("windowPredicate"))

    by_name = lambda rows: {r["property"]: r.get("value") for r in rows or ()}
    sla = {r["property"]: (r["value"], r["unit"]) if r.get("unit") else r.get("value") for r in doc.get("slaProperties") or ()}
    return Contract(
        str(doc["id"]), doc.get("name"), doc.get("domain"), doc.get("tenant"), tuple(map(model, doc.get("schema") or ())), tuple(doc.get("servers") or ()), sla, by_name(doc.get("customProperties"))
    )


def with_rule(contract: Contract, model: str, rule: QualityRule) -> Contract:
    """The contract with a rule more; one of the same description is replaced."""

    def changed(m: Model) -> Model:
        return replace(m, quality=(*(q for q in m.quality if q.description != rule.description), rule)) if m.name == model else m

    contract.model(model)
    return replace(contract, models=tuple(map(changed, contract.models)))


def save_rule(path: str | Path, model: str, rule: QualityRule) -> None:
    """Write a rule into a contract's file, in place of one of the same description."""
    if not (rule.description and rule.query and rule.dimension):
        raise ValueError("a rule needs a description, a query and a dimension")
    doc = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    for m in doc["schema"]:
        if m["name"] == model:
            kept = [q for q in m.get("quality") or () if q.get("description") != rule.description]
            m["quality"] = [*kept, {"type": "sql", "description": rule.description, "query": rule.query, "mustBe": rule.must_be, "dimension": rule.dimension}]
    Path(path).write_text(yaml.safe_dump(doc, sort_keys=False, allow_unicode=True), encoding="utf-8")


def load(path: str | Path) -> Contract:
    return parse(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def load_all(folder: str | Path) -> list[Contract]:
    """Every contract of a folder, in order of file names."""
    return [load(p) for p in sorted(Path(folder).glob("*.odcs.yaml"))]


def contract_rows(spark: SparkSession, contracts: Iterable[Contract]) -> DataFrame:
    rows = [(c.id, c.name or c.id, c.domain, c.tenant, c.floor) for c in contracts]
    return spark.createDataFrame(rows, "contract_id string, title string, domain string, tenant string, sla_min double")


def property_rows(spark: SparkSession, contracts: Iterable[Contract]) -> DataFrame:
    """A row for each property of each model."""
    rows = [(c.id, m.name, p.name, p.type, p.required, p.unique, p.primary_key, p.classification, list(p.references)) for c in contracts for m in c.models for p in m.properties]
    return spark.createDataFrame(rows, "contract_id string, table_name string, column_name string, type string, required boolean, is_unique boolean, primary_key boolean, classification string, refs array<string>")
