"""Column profiles: rows, nulls and distinct values of each column in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def column_profile(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """table_name, column_name, rows, nulls, distinct_count."""
    counts = [x for i, c in enumerate(columns) for x in (F.count(c).alias(f"c{i}"), F.count_distinct(F.col(c)).alias(f"d{i}"))]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *counts)
    cells = [F.struct(F.lit(c).alias("column_name"), (F.col("rows") - F.col(f"c{i}")).alias("nulls"), F.col(f"d{i}").alias("distinct_count")) for i, c in enumerate(columns)]
    return row.select(F.lit(table).alias("table_name"), "rows", F.inline(F.array(*cells))).select("table_name", "column_name", "rows", "nulls", "distinct_count")


def profile_by_day(df: DataFrame, columns: list[str], table: str, arrival: str) -> DataFrame:
    """The profile of every day, in one scan."""
    df = df.withColumn("run_at", F.col(arrival).cast("date"))
    counts = [x for i, c in enumerate(columns) for x in (F.count(c).alias(f"c{i}"), F.count_distinct(F.col(c)).alias(f"d{i}"))]
    row = df.groupBy("run_at").agg(F.count(F.lit(1)).alias("rows"), *counts)
    cells = [F.struct(F.lit(c).alias("column_name"), (F.col("rows") - F.col(f"c{i}")).alias("nulls"), F.col(f"d{i}").alias("distinct_count")) for i, c in enumerate(columns)]
    return row.select("run_at", F.lit(table).alias("table_name"), "rows", F.inline(F.array(*cells))).select("run_at", "table_name", "column_name", "rows", "nulls", "distinct_count")


def profile_change(profiles: DataFrame) -> DataFrame:
    """Each column's newest profile with the nulls and rows of the one before."""
    newest = Window.partitionBy("table_name", "column_name").orderBy(F.col("run_at").desc())
    rows = profiles.withColumn("nulls_before", F.lead("nulls").over(newest)).withColumn("rows_before", F.lead("rows").over(newest))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def sketches(df: DataFrame, columns: list[str], table: str, arrival: str, lg_k: int = 12) -> DataFrame:
    """run_at, table_name, column_name, rows, nulls and a sketch of the distinct values of each day: 2 ** lg_k registers, a few KB. In one scan, without a shuffle of values."""
    df = df.withColumn("run_at", F.col(arrival).cast("date"))
    counts = [x for i, c in enumerate(columns) for x in (F.count(c).alias(f"c{i}"), F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(f"s{i}"))]
    row = df.groupBy("run_at").agg(F.count(F.lit(1)).alias("rows"), *counts)
    cells = [F.struct(F.lit(c).alias("column_name"), (F.col("rows") - F.col(f"c{i}")).alias("nulls"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)]
    return row.select("run_at", F.lit(table).alias("table_name"), "rows", F.inline(F.array(*cells))).select("run_at", "table_name", "column_name", "rows", "nulls", "sketch")


def cumulative(sketched: DataFrame, lg_k: int = 12) -> DataFrame:
    """The profile of all rows up to each day, from stored sketches() alone: distinct_estimate and its relative standard error, which falls with the registers. A column's days, a row each, are one task's."""
    until = Window.partitionBy("table_name", "column_name").orderBy("run_at").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(c).over(until).alias(c) for c in ("rows", "nulls")]
    estimate = F.hll_sketch_estimate(F.hll_union_agg("sketch").over(until)).alias("distinct_estimate")
    return sketched.select("run_at", "table_name", "column_name", *sums, estimate, F.lit(1.04 / 2 ** (lg_k / 2)).alias("standard_error"))


def cumulative_exact(df: DataFrame, columns: list[str], table: str, arrival: str) -> DataFrame:
    """run_at, table_name, column_name, rows, nulls and distinct_count of all rows up to each day, in one job: a value counts from the first day that has it. Values are shuffled once, after a task has brought together its own."""
    values = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])
    seen = df.select(F.col(arrival).cast("date").alias("run_at"), F.inline(values)).groupBy("column_name", "v", "run_at").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("column_name", "v").orderBy("run_at")) == 1
    missing = F.col("v").isNull()
    # Nulls are one value, with a row a day at most here.
    added = seen.withColumn("_first", first & ~missing).groupBy("column_name", "run_at").agg(F.sum("n").alias("rows"), F.sum(F.when(missing, F.col("n")).otherwise(0)).alias("nulls"), F.count_if("_first").alias("distinct_count"))
    until = Window.partitionBy("column_name").orderBy("run_at").rowsBetween(Window.unboundedPreceding, 0)
    return added.select("run_at", F.lit(table).alias("table_name"), "column_name", *[F.sum(c).over(until).alias(c) for c in ("rows", "nulls", "distinct_count")])
