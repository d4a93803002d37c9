"""Deliveries into target tables: merges, deletes and reconciliations as rewrites of a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def touched(field: str, changed: str = "_changed") -> Column:
    """Whether a golden revision changed the field: all fields are named `*`, others `,a,b,`."""
    return (F.col(changed) == "*") | F.col(changed).contains(f",{field},")


def outgoing(golden: DataFrame, system: str, fields: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """The revisions that a system is told of: not its own, touching a field it carries, with all it needs."""
    of_others = F.col("_skip").isNull() | (F.col("_skip") != system)
    about = F.lit(False)
    for f in fields:
        about = about | touched(f)
    whole = F.lit(True)
    for r in required:
        whole = whole & F.col(r).isNotNull()
    return golden.where(of_others & about & whole)


def split_matches(rows: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a value among the fields, and rows whose fields are all empty (deleted at the target)."""
    present = F.coalesce(*[F.col(f).isNotNull() | F.lit(None).cast("boolean") for f in fields]) if len(fields) == 1 else F.greatest(*[F.col(f).isNotNull() for f in fields])
    return rows.where(present), rows.where(~present)


def _links(source: DataFrame, target: DataFrame, keys: Sequence[str], link_by: Sequence[str], constants: Mapping[str, Any]) -> tuple[Column, DataFrame]:
    """Whether a source row looks for its row by link, and of each link value of the target (_l_ and its name) the keys (_t_) and _hits, the rows that have it."""
    free = F.coalesce(F.col("_link"), F.lit(False))
    for k in keys:
        free = free & F.col(k).isNull()
    for c in link_by:
        free = free & F.col(c).isNotNull()
    rows = target.where(reduce(and_, [F.col(c) == F.lit(v) for c, v in constants.items()], F.lit(True)))
    found = rows.groupBy(*[F.col(c).alias(f"_l_{c}") for c in link_by]).agg(F.count(F.lit(1)).alias("_hits"), *[F.min(k).alias(f"_t_{k}") for k in keys])
    return free, found


def refused_links(target: DataFrame, source: DataFrame, keys: Sequence[str], link_by: Sequence[str], constants: Mapping[str, Any] | None = None) -> DataFrame:
    """The source rows that look for their row by link and meet several: merge() leaves them out, a person decides."""
    free, found = _links(source, target, keys, link_by, constants or {})
    return source.where(free).join(found.where("_hits > 1"), [F.col(c) == F.col(f"_l_{c}") for c in link_by], "left_semi")


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], fields: Sequence[str], constants: Mapping[str, Any] | None = None, link_by: Sequence[str] = (), insert_always: bool = False, order: str | None = None) -> DataFrame:
    """target after source's rows, with an `_action` column: insert, update or null where nothing changed.

    source has keys, fields and `_changed`. Of a row that is there only the fields that
    the revision names are written. A new one is inserted when the revision names all
    (`*`) or a key; always for insert_always. A source row without keys that may be linked
    (`_link`) takes the keys of the one target row with the same link_by values, if there is
    one; rows that have keys are matched by them alone, so no join has an OR. Where rows then
    have the same keys, one is written: one that had them before one by link, of these the
    last by `order`. Rows whose link several target rows share are left out (refused_links).
    """
    constants = dict(constants or {})
    src = source.withColumns({k: F.lit(v) for k, v in constants.items()})
    on = [*keys, *constants]
    if link_by:
        free, found = _links(src, target, keys, link_by, constants)
        src = src.withColumn("_free", free).join(found, [F.col(c) == F.col(f"_l_{c}") for c in link_by], "left").where("not _free or _hits is null or _hits = 1")
        src = src.withColumns({k: F.when(F.col("_free"), F.col(f"_t_{k}")).otherwise(F.col(k)) for k in keys})
        whole = reduce(and_, [F.col(k).isNotNull() for k in keys])
        columns = list(dict.fromkeys([*on, *fields, "_changed"]))
        first = F.max_by(F.struct(*[c for c in columns if c not in on]), F.struct(~F.col("_free"), *([order] if order else []), *[F.col(f).cast("string") for f in fields]))
        met = src.where(whole).groupBy(*on).agg(first.alias("_r")).select(*on, "_r.*")
        src = met.select(*columns).unionByName(src.where(~whole).select(*columns))
    src = src.select(*[F.col(c).alias(f"s_{c}") for c in dict.fromkeys([*on, *fields])], F.col("_changed").alias("s__changed"))
    names_key = F.col("s__changed") == "*"
    for k in keys:
        names_key = names_key | touched(k, "s__changed")
    both = target.join(src, [F.col(c) == F.col(f"s_{c}") for c in on], "full_outer")
    there, told = F.col(on[0]).isNotNull(), F.col("s__changed").isNotNull()
    new = ~there & told & (F.lit(True) if insert_always else names_key)
    cell = {f: F.when(there & told & touched(f, "s__changed"), F.col(f"s_{f}")).when(there, F.col(f)).otherwise(F.col(f"s_{f}")) for f in fields}
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(cell[f])
    action = F.when(new, "insert").when(there & told & differs, "update")
    out = {c: cell[c] if c in cell else F.coalesce(F.col(c), F.col(f"s_{c}")) if c in on else F.col(c) for c in target.columns}
    return both.where(there | new).select(*[v.alias(c) for c, v in out.items()], action.alias("_action"))


def delete(target: DataFrame, gone: DataFrame, keys: Sequence[str], constants: Mapping[str, Any] | None = None) -> DataFrame:
    """target without the rows of the keys, among those that have the constants."""
    ids = gone.select(*keys).distinct().withColumns({k: F.lit(v) for k, v in (constants or {}).items()})
    return target.join(ids, [*keys, *(constants or {})], "left_anti")


def reconcile(wanted: DataFrame, have: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """keys, action (add, change, delete) and the wanted fields: what turns `have` into `wanted`. Null keys are equal."""
    a = wanted.select(*keys, F.struct(*fields).alias("_want"))
    b = have.select(*keys, F.struct(*fields).alias("_have"))
    b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    both = a.join(b, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "full_outer")
    both = both.withColumns({k: F.when(F.col("_want").isNull(), F.col(f"_{k}")).otherwise(F.col(k)) for k in keys})
    action = F.when(F.col("_have").isNull(), "add").when(F.col("_want").isNull(), "delete").when(~F.col("_want").eqNullSafe(F.col("_have")), "change")
    return both.withColumn("action", action).where("action is not null").select(*keys, "action", *[F.col(f"_want.{f}").alias(f) for f in fields])
