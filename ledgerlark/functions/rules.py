"""Rule kinds: each builds the predicate of the rows that break it.

Predicates are three-valued, so a null breaks no rule but not_null.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from importlib.metadata import entry_points
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weights of the dimensions in a score; fixed values. A name that is not listed weighs DEFAULT_WEIGHT, none at all counts as unknown.
DIMENSION_WEIGHT = {"completeness": 5, "uniqueness": 5, "consistency": 5, "timeliness": 5, "accuracy": 3, "conformity": 3, "coverage": 3, "schema": 3, "unknown": 1}
DEFAULT_WEIGHT = 3

Builder = Callable[[Column, Mapping[str, Any]], Column]
PARAMETER_TYPES = ("text", "number", "list")
PLUGIN_GROUP = "ledgerlark.rule_kinds"


@dataclass(frozen=True)
class RuleKind:
    kind: str
    build: Builder
    dimension: str
    description: str
    parameters: Mapping[str, str]


def _needed(params: Mapping[str, Any], *names: str) -> list[Any]:
    missing = [n for n in names if params.get(n) in (None, "", [])]
    if missing:
        raise ValueError(f"missing {' and '.join(missing)}")
    return [params[n] for n in names]


def _accepted(col: Column, params: Mapping[str, Any]) -> Column:
    values = [v for v in params.get("values") or () if str(v) != ""]
    if not values:
        raise ValueError("accepted_values needs at least one value")
    return ~col.isin(*values)


def _between(col: Column, params: Mapping[str, Any]) -> Column:
    low, high = _needed(params, "min", "max")
    return ~col.between(low, high)


def _max_length(col: Column, params: Mapping[str, Any]) -> Column:
    return F.char_length(col) > int(_needed(params, "length")[0])


def _matches(col: Column, params: Mapping[str, Any]) -> Column:
    return ~col.like(_needed(params, "pattern")[0])


def _not_in_the_future(col: Column, params: Mapping[str, Any]) -> Column:
    day = params.get("as_of")
    return col > (F.lit(day).cast("date") if day else F.current_date())


#: Rules about single rows; their descriptions are fixed values, as results carry them. foreign_key and unique look beyond the row.
KINDS: dict[str, RuleKind] = {
    k.kind: k
    for k in (
        RuleKind("not_null", lambda c, p: c.isNull(), "completeness", "{column} must not be empty", {}),
        RuleKind("accepted_values", _accepted, "conformity", "{column} must be one of {values}", {"values": "list"}),
        RuleKind("between", _between, "accuracy", "{column} must be between {min} and {max}", {"min": "number", "max": "number"}),
        RuleKind("not_negative", lambda c, p: c < 0, "accuracy", "{column} must not be negative", {}),
        RuleKind("max_length", _max_length, "conformity", "{column} must be at most {length} characters", {"length": "number"}),
        RuleKind("matches", _matches, "conformity", "{column} must look like {pattern}", {"pattern": "text"}),
        RuleKind("not_in_the_future", _not_in_the_future, "timeliness", "{column} must not be in the future", {}),
    )
}
#: Rules about a table as a whole: kind to dimension, description and parameters.
TABLE_KINDS = {
    "foreign_key": ("consistency", "{column} must exist in {table}.{column_ref}", {"table": "text", "column": "text"}),
    "unique": ("uniqueness", "{column} must have no duplicates", {}),
}


def register(kind: RuleKind) -> None:
    """Add a rule kind; refuses one whose pieces do not fit together."""
    if kind.kind in KINDS or kind.kind in TABLE_KINDS:
        raise ValueError(f"the rule kind {kind.kind} exists already")
    if kind.dimension not in DIMENSION_WEIGHT:
        raise ValueError(f"{kind.kind}: the dimension {kind.dimension} has no weight")
    if bad := [n for n, t in kind.parameters.items() if t not in PARAMETER_TYPES]:
        raise ValueError(f"{kind.kind}: {', '.join(bad)} must be of type {', '.join(PARAMETER_TYPES)}")
    used = {f for _, f, _, _ in string.Formatter().parse(kind.description) if f}
    if stray := sorted(used - {"column", *kind.parameters}):
        raise ValueError(f"{kind.kind}: the description names {', '.join(stray)}, which no parameter declares")
    KINDS[kind.kind] = kind


def discover() -> list[str]:
    """Register the rule kinds of installed plugins; a broken one is named."""
    found = []
    for point in entry_points(group=PLUGIN_GROUP):
        try:
            kind = point.load()
            register(kind() if callable(kind) and not isinstance(kind, RuleKind) else kind)
        except Exception as e:
            raise RuntimeError(f"the rule plugin {point.name} cannot be used: {e}") from e
        found.append(point.name)
    return found


def predicate(kind: str, column: str, params: Mapping[str, Any] | None = None) -> Column:
    """True for the rows that break the rule."""
    if kind not in KINDS:
        raise ValueError(f"no rule kind is called {kind!r}; known are {', '.join(sorted([*KINDS, *TABLE_KINDS]))}")
    return KINDS[kind].build(F.col(column), params or {})


def describe(kind: str, column: str, params: Mapping[str, Any] | None = None) -> str:
    template = KINDS[kind].description if kind in KINDS else TABLE_KINDS[kind][1]
    shown = {k: ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else v for k, v in (params or {}).items()}
    if kind == "foreign_key":
        shown = {"table": shown["table"], "column_ref": shown["column"]}
    return template.format(column=column, **shown)


def dimension(kind: str) -> str:
    return KINDS[kind].dimension if kind in KINDS else TABLE_KINDS[kind][0]


def catalogue(spark: SparkSession) -> DataFrame:
    """kind, dimension, weight, description and parameters of every rule kind."""
    rows = [(k.kind, k.dimension, DIMENSION_WEIGHT[k.dimension], k.description, dict(k.parameters)) for k in KINDS.values()]
    rows += [(n, d, DIMENSION_WEIGHT[d], t, dict(p)) for n, (d, t, p) in TABLE_KINDS.items()]
    return spark.createDataFrame(rows, "kind string, dimension string, weight int, description string, parameters map<string,string>")


def foreign_key(child: DataFrame, column: str, parent: DataFrame, parent_column: str, count_null: bool = False) -> DataFrame:
    """The child rows without a parent; those without a value only where count_null is set."""
    keys = parent.select(F.col(parent_column).alias("_key")).where("_key is not null")
    rows = child if count_null else child.where(F.col(column).isNotNull())
    return rows.join(keys, rows[column] == keys["_key"], "left_anti")


def duplicate_groups(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, and n; nulls group together."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: keys, the duplicate keys, and rows, the rows that have them."""
    return duplicate_groups(df, columns).agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"))
