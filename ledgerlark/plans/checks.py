"""Contract checks compiled into as few scans as they need.

Every check that a predicate expresses is a conditional count, and all such checks of a
table and scope share one aggregate. Checks on other tables or on whole keys, and
hand-written queries, get a query each. Results come out as one row a check.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.functions import rules
from ledgerlark.sources.contracts import Contract, Model
from ledgerlark.sources.relations import contract_window

Tables = Mapping[str, DataFrame]

RESULT = (
    "run_at date, check_id string, contract_id string, dimension string, status string, failed_rows bigint, total_rows bigint, fail_ratio double, "
    "run_window string, name string, check_type string, field string, reason string"
)


@dataclass(frozen=True)
class Check:
    """key, the table it is about, and one of: failing, a predicate of broken rows; columns, a key without duplicates (present: or gaps); counted, a query for (failed); query, SQL for one number.

    parents are the tables that it reads beside its own, whole; one may be its own. distinct
    (columns whose duplicate keys are counted) and references (column, parent, its column) say
    what a counted check counts, for all days at once.
    """

    key: str
    table: str
    type: str
    dimension: str | None
    name: str
    field: str | None = None
    scope: str = "window"
    failing: Column | None = None
    columns: tuple[str, ...] = ()
    present: bool = False
    counted: Callable[[Tables, Tables], DataFrame] | None = None
    query: str | None = None
    must_be: float = 0
    parents: tuple[str, ...] = ()
    distinct: tuple[str, ...] = ()
    references: tuple[str, str, str] | None = None


def rule(kind: str, table: str, column: str, params: Mapping[str, Any] | None = None, scope: str | None = None, key: str | None = None, dimension: str | None = None) -> Check:
    """A check of a rule kind. unique counts duplicate keys; foreign_key leaves children without a value alone."""
    params = params or {}
    base = {"key": key or f"{table}.{column}.{kind}", "table": table, "type": kind, "dimension": dimension or rules.dimension(kind), "name": rules.describe(kind, column, params), "field": column}
    if kind == "unique":
        columns = [column, *params.get("with", ())]
        return Check(**base, scope=scope or "table", counted=lambda t, _: rules.duplicates(t[table], columns).select(F.col("keys").alias("failed")), distinct=tuple(columns))
    if kind == "foreign_key":
        count = lambda t, parents: rules.foreign_key(t[table], column, parents[params["table"]], params["column"]).agg(F.count(F.lit(1)).alias("failed"))
        return Check(**base, scope=scope or "window", counted=count, parents=(params["table"],), references=(column, params["table"], params["column"]))
    return Check(**base, scope=scope or "window", failing=rules.predicate(kind, column, params))


def derived(model: Model) -> list[Check]:
    """The checks that a model's properties imply; uniqueness is of the whole table."""
    out = []
    for p in model.properties:
        at = f"{model.name}.{p.name}"
        if p.required:
            out.append(Check(f"{at}.field_required", model.name, "field_required", "completeness", f"{p.name} is required", p.name, failing=F.col(p.name).isNull()))
        if p.unique:
            out.append(_no_duplicates(f"{at}.field_unique", model.name, "field_unique", (p.name,), False))
    if model.keys:
        out.append(_no_duplicates(f"{model.name}.field_primary_key", model.name, "field_primary_key", model.keys, True))
    return out


def _no_duplicates(key: str, table: str, kind: str, columns: Sequence[str], present: bool) -> Check:
    """failed: rows that share their key, and for a primary key rows that lack a part of it."""
    return Check(key, table, kind, "uniqueness", f"{', '.join(columns)} must be unique", ", ".join(columns), "table", columns=tuple(columns), present=present)


def _keyed(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """key, failed, total of all checks on one key, from one grouping."""
    columns = checks[0].columns
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).select("n", missing.alias("missing"))
    shared = F.when(F.col("n") > 1, F.col("n")).otherwise(0)
    broken = [F.coalesce(F.sum(F.when(F.col("missing"), F.col("n") if c.present else F.lit(0)).otherwise(shared)), F.lit(0)).alias(f"f{i}") for i, c in enumerate(checks)]
    row = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *broken)
    cells = F.array(*[F.struct(F.lit(c.key).alias("key"), F.col(f"f{i}").alias("failed")) for i, c in enumerate(checks)])
    return row.select("total", F.inline(cells)).select("key", "failed", "total")


def schema_rows(spark: SparkSession, model: Model, df: DataFrame) -> DataFrame:
    """A row for each declared column: is it there, and of the declared type?"""
    have = {f.name: f.dataType for f in df.schema}
    rows = []
    for f in model.schema():
        rows.append((model.name, f.name, "field_is_present", "pass" if f.name in have else "fail", None if f.name in have else "the column is missing"))
        if f.name in have:
            same = have[f.name] == f.dataType
            rows.append((model.name, f.name, "field_type", "pass" if same else "fail", None if same else f"{have[f.name].simpleString()} instead of {f.dataType.simpleString()}"))
    return spark.createDataFrame(rows, "table_name string, column_name string, check_type string, status string, reason string")


def of_contract(contract: Contract, engine: str = "spark") -> list[Check]:
    """All checks of a contract: those its properties imply and its hand-written queries for this engine."""
    out = []
    for m in contract.models:
        out += derived(m)
        for q in m.quality:
            if q.engine in (None, engine):
                out.append(Check(f"{m.name}.{q.description}", m.name, "sql", q.dimension, q.description, scope=q.scope, query=q.query, must_be=q.must_be))
    return out


def _fused(df: DataFrame, checks: Sequence[Check], by: Sequence[str] = ()) -> DataFrame:
    """key, failed, total of many checks from one aggregate of df."""
    counts = [F.count_if(c.failing).alias(f"f{i}") for i, c in enumerate(checks)]
    row = (df.groupBy(*by) if by else df).agg(F.count(F.lit(1)).alias("total"), *counts)
    cells = F.array(*[F.struct(F.lit(c.key).alias("key"), F.col(f"f{i}").alias("failed")) for i, c in enumerate(checks)])
    return row.select(*by, "total", F.inline(cells)).select(*by, "key", "failed", "total")


@contextmanager
def named(tables: Tables) -> Iterator[None]:
    """The tables as temporary views of their names; the session's own views of these names come back."""
    spark = next(iter(tables.values())).sparkSession
    own = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(name) for name in tables if name in own}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        yield
    finally:
        for name in tables:
            before[name].createOrReplaceTempView(name) if name in before else spark.catalog.dropTempView(name)


def _number(check: Check, tables: Tables) -> DataFrame:
    """failed of a hand-written query: 0 where its number is the wanted one, else the number."""
    with named(tables):
        found = next(iter(tables.values())).sparkSession.sql(check.query)
    value = F.col(f"`{found.columns[0]}`").cast("double")
    failed = F.when(value == check.must_be, 0).otherwise(F.greatest(F.coalesce(value, F.lit(1.0)), F.lit(1.0))).cast("long")
    return found.limit(1).select(failed.alias("failed"))


def _part(checks: Sequence[Check], tables: Tables, parents: Tables | None = None) -> DataFrame:
    """key, failed, total (null for a query of its own) of checks that one query measures; a check against parents gets them apart, as one may be its own table."""
    first = checks[0]
    if first.table not in tables:
        raise KeyError(f"no relation {first.table}")
    if first.failing is not None:
        out = _fused(tables[first.table], checks)
    elif first.columns:
        out = _keyed(tables[first.table], checks)
    else:
        found = _number(first, tables) if first.query else first.counted(tables, parents or {})
        out = found.select(F.lit(first.key).alias("key"), "failed", F.lit(None).alias("total"))
    return out.select("key", F.col("failed").cast("long"), F.col("total").cast("long"))


def _reason(e: Exception) -> str:
    return (str(e).splitlines() or [type(e).__name__])[0][:500]


def measure(checks: Iterable[Check], window: Tables, whole: Tables | None = None) -> DataFrame:
    """key, failed, total and error of each check, over the day's rows or, by its scope, the whole tables.

    Checks of a table and scope share their aggregate, those on one key their grouping, and
    a table is counted once. All are run as one job, a row a check; where that fails each is run
    by itself, and the one that cannot be planned or breaks while it runs has an error instead.
    """
    checks, whole = list(checks), whole or window
    spark = next(iter((whole or window).values())).sparkSession
    groups: dict[tuple, list[Check]] = {}
    for c in checks:
        alone = () if c.failing is not None or c.columns else (c.key,)
        groups.setdefault((c.scope, c.table, c.failing is not None, c.columns, alone), []).append(c)
    tables = {"table": whole, "window": window}
    rows: dict[str, tuple] = {}

    def plan(group: list[Check]) -> DataFrame | None:
        try:
            parents = {p for c in group for p in c.parents}
            if parents - set(whole):
                raise KeyError(f"no relation {', '.join(sorted(parents - set(whole)))}")
            return _part(group, tables[group[0].scope], {p: whole[p] for p in parents})
        except (PySparkException, KeyError) as e:
            if len(group) == 1:
                rows[group[0].key] = (None, None, _reason(e))
            return None

    def run(parts: list[tuple[list[Check], DataFrame]]) -> None:
        try:
            for r in reduce(DataFrame.unionByName, [df for _, df in parts]).collect():  # a row a check
                rows[r["key"]] = (r["failed"], r["total"], None)
        except PySparkException as e:
            if len(parts) > 1:
                for part in parts:
                    run([part])
            elif len(parts[0][0]) > 1:
                for c in parts[0][0]:
                    if df := plan([c]):
                        run([([c], df)])
            else:
                rows[parts[0][0][0].key] = (None, None, _reason(e))

    parts = []
    for group in groups.values():
        if df := plan(group):
            parts.append((group, df))
        elif len(group) > 1:
            parts += [([c], df) for c in group if (df := plan([c]))]
    counted = {(c.scope, c.table) for c in checks if c.failing is not None or c.columns}
    for scope, table in {(c.scope, c.table) for c in checks} - counted:
        if table in tables[scope]:
            key = f"#{scope}.{table}"
            total = tables[scope][table].agg(F.count(F.lit(1)).alias("total")).select(F.lit(key).alias("key"), F.lit(None).cast("long").alias("failed"), "total")
            parts.append(([Check(key, table, "count", None, key)], total))
    if parts:
        run(parts)
    totals = {(c.scope, c.table): rows[c.key][1] for c in checks if rows.get(c.key, (None,) * 2)[1] is not None}
    totals |= {(c.scope, c.table): rows[f"#{c.scope}.{c.table}"][1] for c in checks if f"#{c.scope}.{c.table}" in rows}
    told = []
    for c in checks:
        failed, total, error = rows.get(c.key, (None, None, "gave no row"))
        told.append((c.key, failed, None if error else total if total is not None else totals.get((c.scope, c.table), 0), error))
    return spark.createDataFrame(told, "key string, failed long, total long, error string")


def results(contract_id: str, checks: Iterable[Check], measured: DataFrame, run_at: dt.date | str | Column, mode: str = "incremental") -> DataFrame:
    """check_results rows of what was measured. A ratio above 1 is left as it is; an error has none."""
    checks = list(checks)
    facts = measured.sparkSession.createDataFrame(
        [(c.key, c.dimension or "unknown", c.name, c.type, c.field) for c in checks], "key string, dimension string, name string, check_type string, field string"
    )
    day = run_at if isinstance(run_at, Column) else F.lit(run_at).cast("date")
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("failed") > 0, "fail").otherwise("pass")
    total = F.coalesce("total", F.lit(0))
    return measured.join(F.broadcast(facts), "key").select(  # a row a check
        day.alias("run_at"), F.concat(F.lit(f"{contract_id}."), "key").alias("check_id"), F.lit(contract_id).alias("contract_id"), "dimension", status.alias("status"),
        F.coalesce("failed", F.lit(0)).alias("failed_rows"), total.alias("total_rows"), F.coalesce(F.col("failed") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("fail_ratio"),
        F.lit(mode).alias("run_window"), "name", "check_type", "field", F.col("error").alias("reason"),
    )


def run(contract: Contract, read: Callable[[str], DataFrame], as_of: dt.date | str, arrival: str = "loaded_at", mode: str = "incremental", extra: Iterable[Check] = ()) -> DataFrame:
    """check_results of a contract for a day; a day whose window has no relation gives one error row."""
    checks = [*of_contract(contract), *extra]
    try:
        window = contract_window(contract, read, arrival, as_of, mode)
    except LookupError as e:
        import pyspark

        spark = pyspark.sql.SparkSession.getActiveSession()
        row = (dt.date.fromisoformat(str(as_of)), f"{contract.id}.window_missing", contract.id, "unknown", "error", 0, 0, 0.0, mode, "window", "general", None, str(e))
        return spark.createDataFrame([row], RESULT)
    whole = {n: read(n) for n in window}
    for parent in {p for c in checks for p in c.parents} - set(whole):
        try:
            whole[parent] = read(parent)
        except (LookupError, PySparkException):
            pass  # its checks become errors
    return results(contract.id, checks, measure(checks, window, whole), as_of, mode)


def _key_days(df: DataFrame, checks: Sequence[Check], so_far: bool) -> DataFrame:
    """key, _day and delta: what a day's rows add to each check on one key; so_far: beside the rows of all days before.

    Rows are first counted by key and day, so a key has at most a row a day to be ordered.
    """
    columns = list(checks[0].columns or checks[0].distinct)
    groups = df.groupBy(*columns, "_day").agg(F.count(F.lit(1)).alias("n"))
    if so_far:
        before = Window.partitionBy(*columns).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
        groups = groups.withColumn("was", F.coalesce(F.sum("n").over(before), F.lit(0)))
    else:
        groups = groups.withColumn("was", F.lit(0))
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    now = F.col("was") + F.col("n")
    shared = lambda n: F.when(n > 1, n).otherwise(0)
    cells = []
    for c in checks:
        if c.distinct:
            delta = (now > 1).cast("long") - (F.col("was") > 1).cast("long")
        else:
            delta = F.when(missing, F.col("n") if c.present else F.lit(0)).otherwise(shared(now) - shared(F.col("was")))
        cells.append(F.struct(F.lit(c.key).alias("key"), delta.cast("long").alias("delta")))
    return groups.select("_day", F.inline(F.array(*cells))).where("delta <> 0")


def _reference_days(df: DataFrame, check: Check, parent: DataFrame, parent_arrival: str | None, so_far: bool) -> DataFrame:
    """key, _day and delta of a foreign key: children of a day before their parent's first one, which that one takes back; a parent without arrivals was always there."""
    column, _, parent_column = check.references
    children = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_child"), "_day").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.col(parent_arrival).cast("date")) if parent_arrival else F.lit("0001-01-01").cast("date")
    parents = parent.where(F.col(parent_column).isNotNull()).groupBy(F.col(parent_column).alias("_parent")).agg(first.alias("_first"))
    late = children.join(parents, F.col("_child") == F.col("_parent"), "left").where("_first is null or _first > _day")
    back = F.when(F.col("_first").isNotNull(), F.struct(F.col("_first").alias("_day"), (-F.col("n")).alias("delta"))) if so_far else F.lit(None)
    rows = F.array(F.struct("_day", F.col("n").alias("delta")), *([back] if so_far else []))
    return late.select(F.lit(check.key).alias("key"), F.explode(rows).alias("e")).where("e is not null").select("key", "e._day", "e.delta")


def by_day(contract_id: str, df: DataFrame, arrival: str, checks: Sequence[Check], mode: str = "incremental", parents: Tables | None = None, parent_arrival: Mapping[str, str] | None = None) -> DataFrame:
    """check_results of every day of df in one job, for checks of predicates, keys and foreign keys.

    Each day has what a run of that day would have found: keys of scope `table` among all
    rows up to the day, children without a parent (parents: whole tables by name, with the
    column of their arrival) that was there by then. cumulative: a day's rows and all before.
    What rows add to a check is summed by day, so no day reads the rows of others again.
    """
    rows, so_far = df.withColumn("_day", F.col(arrival).cast("date")).where("_day is not null"), mode == "cumulative"
    plain = [c for c in checks if c.failing is not None]
    days = rows.groupBy("_day").agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c.failing).alias(f"f{i}") for i, c in enumerate(plain)])
    own = {id(c): F.col(f"f{i}") for i, c in enumerate(plain)}
    cells = [F.struct(F.lit(c.key).alias("key"), F.lit(so_far or c.scope == "table").alias("sums"), own.get(id(c), F.lit(0)).cast("long").alias("delta")) for c in checks]
    told = days.select("_day", "rows", F.inline(F.array(*cells)))
    events, groups = [], {}
    for c in checks:
        if c.columns or c.distinct:
            groups.setdefault((c.columns or c.distinct, so_far or c.scope == "table"), []).append(c)
        elif c.references:
            if c.references[1] not in (parents or {}):
                raise KeyError(f"no relation {c.references[1]}")
            events.append(_reference_days(rows, c, parents[c.references[1]], (parent_arrival or {}).get(c.references[1]), so_far or c.scope == "table"))
        elif c.failing is None:
            raise ValueError(f"{c.key}: not a check that days can be summed for")
    events += [_key_days(rows, group, sums) for (_, sums), group in groups.items()]
    if events:
        more = reduce(DataFrame.unionByName, events).groupBy("key", "_day").agg(F.sum("delta").alias("delta"))
        sums = F.array_contains(F.array(*[F.lit(c.key) for c in checks if so_far or c.scope == "table"]).cast("array<string>"), F.col("key"))
        more = more.select("_day", F.lit(None).cast("long").alias("rows"), "key", sums.alias("sums"), "delta")
        told = told.unionByName(more).groupBy("key", "_day", "sums").agg(F.max("rows").alias("rows"), F.sum("delta").alias("delta"))
    found = told.withColumns({"failed": F.col("delta"), "total": F.col("rows")})
    if any(so_far or c.scope == "table" for c in checks):
        upto = Window.partitionBy("key").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
        found = told.withColumns({n: F.when(F.col("sums"), F.sum(c).over(upto)).otherwise(F.col(c)) for n, c in (("failed", "delta"), ("total", "rows"))})
    found = found.where("rows is not null").select("_day", "key", "failed", "total", F.lit(None).cast("string").alias("error"))
    return results(contract_id, checks, found, F.col("_day"), mode)


def failed_rows(reported: Column, status: Column, value: Column) -> Column:
    """How many rows an external checker's result means: as reported; 0 if passed; its value; or 1."""
    return F.coalesce(reported, F.when(status == "passed", 0), value, F.lit(1)).cast("long")


def denominator(own: Column, of_model: Column, of_only_table: Column) -> Column:
    """Rows that a result is a share of: its own count, its model's, the only table's, or 0; a count of 0 falls through too."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in (own, of_model, of_only_table)], F.lit(0)).cast("long")


def status_of(check_type: Column, outcome: Column) -> Column:
    """pass, fail or error of an external checker's outcome."""
    return F.when(check_type == "general", "error").when(outcome == "passed", "pass").when(outcome == "failed", "fail").otherwise("error")


def replaced_by_key(first: DataFrame, again: DataFrame) -> DataFrame:
    """Results of a first pass, with those that a second pass measured anew replaced."""
    return first.join(again.select("check_id"), "check_id", "left_anti").unionByName(again)
