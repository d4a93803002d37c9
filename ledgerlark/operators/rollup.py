"""Group totals of lines: from scratch, kept up to date by the groups that changes touch, or by what changes add and take back."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CALLS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}


def _call(call: str) -> tuple[str, str]:
    found = re.fullmatch(r"(\w+)\((\*|\w+)\)", call.replace(" ", ""))
    if not found or found[1] not in _CALLS or (found[2] == "*" and found[1] != "count"):
        raise ValueError(f"{call!r} is not an aggregate of one column")
    return found[1], found[2]


def aggregate(call: str) -> Column:
    """sum, count, min, max or avg of one column, or count(*)."""
    name, column = _call(call)
    return F.count(F.lit(1)) if column == "*" else _CALLS[name](column)


def totals(lines: DataFrame, group: Mapping[str, str], aggregates: Mapping[str, str]) -> DataFrame:
    """One row a group: its columns by their new names, and the aggregates."""
    return lines.groupBy(*[F.col(s).alias(t) for t, s in group.items()]).agg(*[aggregate(c).alias(t) for t, c in aggregates.items()])


def _key(columns: Sequence[str]) -> Column:
    return F.struct(*columns)


def apply_changes(mirror: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(lines after, lines touched): changes carry op (delete or upsert) and the line; the last of a line's changes counts.

    The touched lines are those before and after, so a line that moves touches two groups.
    """
    newest = F.max_by(F.struct(*[c for c in changes.columns if c not in keys]), F.col(seq))
    last = changes.groupBy(*keys).agg(newest.alias("_c")).select(*keys, "_c.*")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    ids = last.select(*keys)
    left, old = mirror.join(ids, same(mirror, ids), "left_anti"), mirror.join(ids, same(mirror, ids), "left_semi")
    new = last.where("op = 'upsert'").select(*mirror.columns)
    return left.unionByName(new), old.unionByName(new)


def recompute(lines: DataFrame, touched: DataFrame, before: DataFrame, group: Mapping[str, str], aggregates: Mapping[str, str]) -> DataFrame:
    """Group rows to write: group columns, aggregates and _action (insert, update, delete); groups that came out the same are left out.

    Only lines of touched groups are read again. An empty group's row is deleted.
    """
    groups = touched.select(*[F.col(s).alias(t) for t, s in group.items()]).distinct()
    of_groups = lines.join(groups, [lines[s].eqNullSafe(groups[t]) for t, s in group.items()], "left_semi")
    now = totals(of_groups, group, aggregates).select(*group, F.struct(*aggregates).alias("_now"))
    was = before.select(*[F.col(t).alias(f"b_{t}") for t in group], F.struct(*aggregates).alias("_was"))
    rows = groups.join(now.select(*[F.col(t).alias(f"n_{t}") for t in group], "_now"), [F.col(t).eqNullSafe(F.col(f"n_{t}")) for t in group], "left")
    rows = rows.join(was, [F.col(t).eqNullSafe(F.col(f"b_{t}")) for t in group], "left")
    action = F.when(F.col("_now").isNull() & F.col("_was").isNotNull(), "delete").when(F.col("_was").isNull() & F.col("_now").isNotNull(), "insert").when(~F.col("_now").eqNullSafe(F.col("_was")), "update")
    return rows.withColumn("_action", action).where("_action is not null").select(*group, *[F.col(f"_now.{a}").alias(a) for a in aggregates], "_action")


# --- states that take changes back


def signed_changes(lines: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """apply_changes(), with _sign beside the touched lines: -1 for a line as it was, 1 as it is now."""
    after, _ = apply_changes(lines, changes, keys, seq)
    newest = F.max_by(F.struct(*[c for c in changes.columns if c not in keys]), F.col(seq))
    last = changes.groupBy(*keys).agg(newest.alias("_c")).select(*keys, "_c.*")
    ids = last.select(*keys)
    old = lines.join(ids, [lines[k].eqNullSafe(ids[k]) for k in keys], "left_semi")
    new = last.where("op = 'upsert'").select(*lines.columns)
    return after, old.withColumn("_sign", F.lit(-1)).unionByName(new.withColumn("_sign", F.lit(1)))


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [a[c].eqNullSafe(b[c]) for c in columns]


def deltas(signed: DataFrame, group: Mapping[str, str], aggregates: Mapping[str, str]) -> DataFrame:
    """What lines with _sign add to each group's state: _n lines, and for each aggregate a sum and the lines that have a value, or, for min and max, a map of values to lines."""
    rows = signed.withColumns({t: F.col(s) for t, s in group.items()})
    out, maps = [F.sum("_sign").cast("long").alias("_n")], {}
    for name, call in aggregates.items():
        fn, column = _call(call)
        if fn in ("sum", "avg"):
            out.append(F.sum(F.when(F.col("_sign") > 0, F.col(column)).otherwise(-F.col(column))).alias(f"{name}__s"))
        if column != "*":
            out.append(F.sum(F.when(F.col(column).isNotNull(), F.col("_sign")).otherwise(0)).cast("long").alias(f"{name}__n"))
        if fn in ("min", "max"):
            maps[name] = column
    found = rows.groupBy(*group).agg(*out)
    for name, column in maps.items():
        counts = rows.where(F.col(column).isNotNull()).groupBy(*group, F.col(column).alias("_v")).agg(F.sum("_sign").cast("long").alias("_c")).where("_c <> 0")
        map_ = counts.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_v", "_c"))).alias(f"{name}__m"))
        found = found.join(map_, _same(found, map_, list(group)), "left").select(*[found[c] for c in found.columns], map_[f"{name}__m"])
    return found


def states(lines: DataFrame, group: Mapping[str, str], aggregates: Mapping[str, str]) -> DataFrame:
    """The state of each group of lines, from scratch."""
    return deltas(lines.withColumn("_sign", F.lit(1)), group, aggregates)


def applied(state: DataFrame, delta: DataFrame, group: Mapping[str, str], aggregates: Mapping[str, str]) -> DataFrame:
    """state after delta; groups without lines are gone. Sums of decimals and whole numbers are exact, those of doubles drift as doubles do."""
    d = delta.withColumnsRenamed({c: f"d_{c}" for c in delta.columns})
    both = state.join(d, [state[g].eqNullSafe(d[f"d_{g}"]) for g in group], "full_outer")
    there = F.col("_n").isNotNull()
    out = {g: F.when(there, F.col(g)).otherwise(F.col(f"d_{g}")) for g in group}
    for c in state.columns:
        if c in group:
            continue
        was, more, kind = F.col(c), F.col(f"d_{c}"), state.schema[c].dataType
        if c.endswith("__m"):
            none = F.create_map().cast(kind)
            summed = F.map_zip_with(F.coalesce(was, none), F.coalesce(more, none), lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
            out[c] = F.map_filter(summed, lambda _, n: n != 0)
        elif c.endswith("__s"):
            out[c] = F.coalesce((was + more).cast(kind), was, more.cast(kind))
        else:
            out[c] = F.coalesce(was, F.lit(0)) + F.coalesce(more, F.lit(0))
    return both.select(*[v.alias(c) for c, v in out.items()]).where("_n <> 0")


def shown(state: DataFrame, group: Mapping[str, str], aggregates: Mapping[str, str]) -> DataFrame:
    """The totals that states stand for."""
    out = []
    for name, call in aggregates.items():
        fn, column = _call(call)
        has = F.col(f"{name}__n") > 0 if column != "*" else None
        value = {
            "count": lambda: F.col("_n") if column == "*" else F.col(f"{name}__n"), "sum": lambda: F.when(has, F.col(f"{name}__s")), "avg": lambda: F.when(has, F.col(f"{name}__s") / F.col(f"{name}__n")),
            "min": lambda: F.array_min(F.map_keys(f"{name}__m")), "max": lambda: F.array_max(F.map_keys(f"{name}__m")),
        }[fn]()
        out.append(value.alias(name))
    return state.select(*group, *out)
