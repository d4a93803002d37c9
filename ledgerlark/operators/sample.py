"""Rows that break a rule, with classified columns masked."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK, ROWS = "•••", 20


def masked(df: DataFrame, classified: Iterable[str], nulls_too: bool = False) -> DataFrame:
    """df with a mask in place of classified values; of missing ones only where nulls_too is set."""
    hide = set(classified)
    cell = lambda c: F.lit(MASK) if nulls_too else F.when(F.col(c).isNotNull(), F.lit(MASK))
    return df.select(*[cell(c).alias(c) if c in hide else F.col(c) for c in df.columns])


def failing_rows(df: DataFrame, failing: Column, key: str | list[str], classified: Iterable[str] = (), n: int = ROWS) -> DataFrame:
    """The first n broken rows in order of the key."""
    keys = [key] if isinstance(key, str) else key
    return masked(df.where(failing).orderBy(*keys).limit(n), classified, nulls_too=True)


def why_not(kind: str, has_predicate: bool) -> str | None:
    """Why a check has no failing rows to show, or None where it has."""
    if kind in ("unique", "field_unique", "field_primary_key"):
        return "the check is about groups of rows, not about rows"
    if not has_predicate:
        return "the check names no condition that a row could break"
    return None


def _below(plan: JavaObject) -> Iterator[JavaObject]:
    """A plan's nodes, those below before those above."""
    children = plan.children()
    for i in range(children.size()):
        yield from _below(children.apply(i))
    yield plan


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName()


def _renamed(plan: JavaObject, classified: set[str]) -> set[str]:
    """The classified names with those of columns that a query below made of them."""
    hide = set(classified)
    for node in _below(plan):
        made = node.expressions()
        for e in (made.apply(i) for i in range(made.size())):
            if _kind(e) == "Alias":
                read = e.references().iterator()
                while read.hasNext():
                    if read.next().name() in hide:
                        hide.add(e.name())
    return hide


def failing_rows_of(found: DataFrame, classified: Iterable[str] = (), n: int | None = ROWS) -> DataFrame | None:
    """Up to n rows (None: all) that a written query counts or lists, with all their columns, or None where it has no such rows.

    The query's own FROM and WHERE are taken from the plan that Spark made of it: what its
    uppermost selection reads from. A query that groups, has no WHERE or is a set operation
    has no rows to show. Classified columns are masked, as are columns that a subquery made
    of them. Of columns of one name, the later ones get a number.
    """
    spark, plan = found.sparkSession, found._jdf.queryExecution().analyzed()
    shared = None
    if _kind(plan) == "WithCTE":
        shared, plan = plan.cteDefs(), plan.plan()
    while _kind(plan) in ("GlobalLimit", "LocalLimit", "Sort", "Distinct", "Project") or (_kind(plan) == "Aggregate" and plan.groupingExpressions().isEmpty()):
        plan = plan.child()
    if _kind(plan) != "Filter" or _kind(plan.child()) == "Aggregate":  # a selection of groups is a HAVING
        return None
    hide = _renamed(plan, set(classified))
    if shared is not None:
        for i in range(shared.size()):
            hide |= _renamed(shared.apply(i), hide)
        plan = spark._jvm.org.apache.spark.sql.catalyst.plans.logical.WithCTE(plan, shared)
    rows = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)
    names: list[str] = []
    for c in rows.columns:
        names.append(c if c not in names else f"{c}_{1 + rows.columns[: len(names)].count(c)}")
    secret = {new for new, old in zip(names, rows.columns, strict=True) if old in hide}
    rows = rows.toDF(*names)
    return masked(rows if n is None else rows.limit(n), secret, nulls_too=True)
