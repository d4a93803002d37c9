"""Slowly changing dimensions: versions with half-open validity, and joins as of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPENING = "0001-01-01"


def _row(columns: list[str], prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in columns])


def from_snapshots(snapshots: DataFrame, key: str, attributes: list[str], day: str) -> DataFrame:
    """key, attributes, valid_from, valid_to, is_current from dated snapshots of a table.

    A version begins where an attribute differs from the snapshot before, null-safe; the
    first one is valid from the beginning of time.
    """
    # A count of their own keeps tasks small: by compressed bytes, of which repeated snapshots have few, many partitions would become one.
    snapshots = snapshots.repartition(int(snapshots.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    by_day = Window.partitionBy(key).orderBy(day)
    before = F.lag(_row(attributes)).over(by_day)
    first = F.row_number().over(by_day) == 1
    starts = snapshots.withColumn("_first", first).withColumn("_before", before).where(F.col("_first") | ~F.col("_before").eqNullSafe(_row(attributes)))
    starts = starts.withColumn("valid_from", F.when(F.col("_first"), F.lit(OPENING).cast("date")).otherwise(F.col(day).cast("date")))
    out = starts.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from")))
    return out.select(key, *attributes, "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"))


def close_and_open(dimension: DataFrame, source: DataFrame, key: str, attributes: list[str], day: str) -> DataFrame:
    """The dimension after a load of day `day`: changed versions closed, new ones opened the same day.

    A key without any version opens at the beginning of time. A version opened on the same
    day is replaced in place, so no version of zero length comes about. Keys that the
    source lacks stay as they are.
    """
    on = F.lit(day).cast("date")
    now = source.select(F.col(key).alias("_key"), _row(attributes).alias("_new"))
    current = dimension.where("is_current").join(now, F.col(key) == F.col("_key"), "left")
    changed = F.col("_key").isNotNull() & ~F.col("_new").eqNullSafe(_row(attributes))
    same_day = F.col("valid_from") == on
    kept = current.where(~changed).select(*dimension.columns)
    closed = current.where(changed & ~same_day).withColumn("valid_to", on).withColumn("is_current", F.lit(False)).select(*dimension.columns)
    opened = current.where(changed).select(F.col("_key").alias(key), "_new.*", on.alias("valid_from"))
    new = now.join(dimension.select(F.col(key).alias("_known")), F.col("_key") == F.col("_known"), "left_anti").select(F.col("_key").alias(key), "_new.*", F.lit(OPENING).cast("date").alias("valid_from"))
    opened = opened.unionByName(new).withColumn("valid_to", F.lit(None).cast("date")).withColumn("is_current", F.lit(True)).select(*dimension.columns)
    return dimension.where("not is_current").unionByName(kept).unionByName(closed).unionByName(opened)


def as_of(facts: DataFrame, dimension: DataFrame, key: str, day: str, attributes: list[str]) -> DataFrame:
    """facts with the attributes that were valid on their day; null where the key has no version."""
    versions = dimension.select(F.col(key).alias("_key"), *[F.col(a).alias(f"_{a}") for a in attributes], "valid_from", "valid_to")
    on = (F.col(key) == F.col("_key")) & (F.col(day).cast("date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(day).cast("date") < F.col("valid_to")))
    return facts.join(versions, on, "left").select(*facts.columns, *[F.col(f"_{a}").alias(a) for a in attributes])


def summary(dimension: DataFrame, key: str) -> DataFrame:
    return dimension.agg(
        F.count(F.lit(1)).alias("versions"), F.count_distinct(F.col(key)).alias("keys"), F.count_if("is_current").alias("current_versions"), F.min("valid_from").alias("first_from"), F.max("valid_from").alias("last_from")
    )


def changed_keys(dimension: DataFrame, key: str, n: int = 100) -> DataFrame:
    """The n keys with more than one version, the last closed first."""
    groups = dimension.groupBy(key).agg(F.count(F.lit(1)).alias("versions"), F.max("valid_to").alias("last_closed")).where("versions > 1")
    return groups.orderBy(F.col("last_closed").desc_nulls_last(), key).limit(n)


def diff(dimension: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Each version with the names of the attributes that changed; none for the first."""
    order = Window.partitionBy(key).orderBy("valid_from")
    before = dimension.withColumn("_before", F.lag(_row(attributes)).over(order)).withColumn("_n", F.row_number().over(order))
    names = F.array_compact(F.array(*[F.when((F.col("_n") > 1) & ~F.col(f"_before.{a}").eqNullSafe(F.col(a)), F.lit(a)) for a in attributes]))
    return before.withColumn("changed", names).drop("_before", "_n")


def overlaps(dimension: DataFrame, key: str) -> DataFrame:
    """Versions that begin before any earlier one of their key has ended; a version without an end has none."""
    earlier = Window.partitionBy(key).orderBy("valid_from", F.col("valid_to").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    until = F.max(F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))).over(earlier)
    return dimension.withColumn("_until", until).where(F.col("_until") > F.col("valid_from")).drop("_until")


def staged(orders: DataFrame, customer: str, status: str) -> DataFrame:
    """Orders that count: with a customer and not cancelled."""
    return orders.where(F.col(customer).isNotNull() & (F.col(status) != "CANCELLED"))


def revenue_daily(facts: DataFrame, keys: list[str], amount: str, loaded: str) -> DataFrame:
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("orders"), F.sum(amount).alias("revenue"), F.max(loaded).alias("loaded_at"))
