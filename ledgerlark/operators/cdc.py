"""Change logs applied to replicas.

Log rows carry op (1 delete, 2 insert, 3 before image, 4 after image) and an order. A key
that changes is a delete of the old and an upsert of the new one; a row that leaves the
replica's filter is deleted there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DELETE, INSERT, BEFORE, AFTER = 1, 2, 3, 4


def intents(log: DataFrame, keys: list[str], seq: list[str], where: str | None = None, log_key: str | None = None) -> DataFrame:
    """One row for each thing to do: action (upsert or delete), _key, the row's columns and its order.

    A before image only lends its key to the after image that follows it: in the rows of
    equal `log_key` (a source, or the number that a log gives both images), without which
    one task orders the whole log. Where the filter is false or null for the after row,
    the action is a delete.
    """
    order = Window.partitionBy(*([log_key] if log_key else [F.lit(0)])).orderBy(*seq)
    key = F.struct(*keys)
    rows = log.withColumn("_was", F.lag(F.struct(F.col("op").alias("op"), key.alias("key"))).over(order))
    fits = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    action = F.when(F.col("op") == DELETE, "delete").otherwise(F.when(fits, "upsert").otherwise("delete"))
    moved = (F.col("op") == AFTER) & (F.col("_was.op") == BEFORE) & ~F.col("_was.key").eqNullSafe(key)
    own = F.struct(F.lit(1).alias("part"), action.alias("action"), key.alias("_key"))
    old = F.struct(F.lit(0).alias("part"), F.lit("delete").alias("action"), F.col("_was.key").alias("_key"))
    todo = rows.where(F.col("op") != BEFORE).withColumn("_todo", F.when(moved, F.array(old, own)).otherwise(F.array(own)))
    return todo.select("*", F.inline("_todo")).drop("_was", "_todo", "op")


def last_intents(todo: DataFrame, seq: list[str]) -> DataFrame:
    """The last intent of each key, which is what is left of them in the end; counted before the shuffle."""
    columns = [c for c in todo.columns if c != "_key"]
    newest = F.max_by(F.struct(*columns), F.struct(*seq, "part"))
    return todo.groupBy("_key").agg(newest.alias("_row")).select("_key", "_row.*")


def apply(target: DataFrame, todo: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The replica after the intents. Its columns are those it has; others of the log never reach it."""
    last = last_intents(todo, seq)
    touched = last.select(*[F.col(f"_key.{k}").alias(k) for k in keys])
    same = [target[k].eqNullSafe(touched[k]) for k in keys]
    kept = target.join(touched, same, "left_anti")
    return kept.unionByName(last.where("action = 'upsert'").select(*target.columns))


def counts(target: DataFrame, todo: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """One row: upserts and deletes meant, and inserted, updated and deleted keys in the end."""
    meant = todo.agg(F.count_if(F.col("action") == "upsert").alias("upserts"), F.count_if(F.col("action") == "delete").alias("deletes"))
    have = target.select(F.struct(*keys).alias("_key")).distinct().withColumn("_have", F.lit(True))
    net = last_intents(todo, seq).join(have, "_key", "left")
    there, up = F.col("_have").isNotNull(), F.col("action") == "upsert"
    net = net.agg(F.count_if(~there & up).alias("inserted"), F.count_if(there & up).alias("updated"), F.count_if(there & ~up).alias("deleted"))
    return meant.crossJoin(net)  # one row each


def resume(watermark: int | None, first_kept: int | None, last: int | None) -> str:
    """What a reader does next: snapshot (none yet), resnapshot (changes have left the log), wait, or changes."""
    if watermark is None:
        return "snapshot"
    if first_kept is not None and watermark < first_kept - 1:
        return "resnapshot"
    return "changes" if last is not None and last > watermark else "wait"


def generated(df: DataFrame, existing: DataFrame, column: str, key: str, at: str | None = None) -> DataFrame:
    """df with a number of its own for each new row, after the largest there is, in order of a numeric key; rows of one key are in order of a digest of all their columns.

    Ranges of the key are numbered on their own and moved by the rows before them, so no
    task orders all rows, and numbers are the same on every retry.
    """
    columns = df.columns
    top = existing.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
    cuts = df.agg(F.percentile_approx(key, [i / 200 for i in range(1, 200)], 10_000)).first()[0] or []
    df = df.withColumn("_part", F.coalesce(F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col(key))), F.lit(0)) if cuts else F.lit(0))
    sizes = df.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 200 rows
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(key, F.xxhash64(*columns)))
    out = df.withColumn("_nth", nth).join(sizes.select("_part", before.alias("_before")), "_part")
    out = out.withColumn(column, (F.lit(top) + F.col("_before") + F.col("_nth")).cast("long")).drop("_part", "_nth", "_before")
    return out.withColumn(at, F.current_timestamp()) if at else out


def replica(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table that a log's stream makes: the newest snapshot's rows and changes (op 1 deletes, 3 is a before image), each key's last one unless it is a deletion. An equal position's rows go by seq."""
    newest = rows.agg(F.max("snapshot").alias("snapshot"))  # one row
    last = rows.where("op <> 3").join(F.broadcast(newest), "snapshot").groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct("lsn", "seq")).alias("r"))
    return last.select(*keys, "r.*").where("op <> 1")
