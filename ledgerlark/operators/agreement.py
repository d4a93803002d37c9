"""What a contract promises against what was measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.expressions import period_days


def measured(results: DataFrame, scores: DataFrame, as_of: str) -> DataFrame:
    """contract_id, age_days of the last run, completeness (share of its completeness checks that pass), availability (share of runs without errors)."""
    runs = scores.groupBy("contract_id").agg(
        F.date_diff(F.lit(as_of).cast("date"), F.max("run_at")).alias("age_days"), F.avg(F.when(F.col("checks_errored") == 0, 1.0).otherwise(0.0)).alias("availability"), F.max("run_at").alias("run_at")
    )
    rows = results.where("dimension = 'completeness'").join(runs.select("contract_id", "run_at"), ["contract_id", "run_at"])
    full = rows.groupBy("contract_id").agg(F.avg(F.when(F.col("status") == "pass", 1.0).otherwise(0.0)).alias("completeness"))
    return runs.select("contract_id", "age_days", "availability").join(full, "contract_id", "left")


def against(promises: DataFrame, found: DataFrame) -> DataFrame:
    """promises (contract_id, property, value, unit) with measured and kept; frequency is an age in days, the rest shares."""
    rows = promises.join(found, "contract_id", "left")
    actual = F.when(F.col("property") == "frequency", F.col("age_days").cast("double")).when(F.col("property") == "completeness", F.col("completeness")).when(F.col("property") == "availability", F.col("availability"))
    promised = F.when(F.col("property") == "frequency", period_days(F.col("value"), F.col("unit"))).otherwise(F.col("value").cast("double"))
    kept = F.when(F.col("property") == "frequency", actual <= promised).otherwise(actual >= promised)
    return rows.select("contract_id", "property", promised.alias("promised"), actual.alias("measured"), kept.alias("kept"))


def activity(inbox: DataFrame, at: str) -> DataFrame:
    """hour, system, n: how much each system sent."""
    return inbox.groupBy(F.date_trunc("hour", at).alias("hour"), "system").agg(F.count(F.lit(1)).alias("n"))


def latest_by_system(inbox: DataFrame, order: str, value: str) -> DataFrame:
    """system, last and n."""
    return inbox.groupBy("system").agg(F.max_by(value, order).alias("last"), F.count(F.lit(1)).alias("n"))


def paired(log: DataFrame, keys: list[str], seq: str, kind: str, columns: list[str]) -> DataFrame:
    """A log's updates as one entry each: keys, seq, and the columns that changed as name to (before, after)."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(seq)
    rows = log.withColumn("_k", F.lag(kind).over(order)).withColumn("_b", F.lag(F.struct(*columns)).over(order)).where(F.col(kind) == "UPDATE_AFTER")
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"_b.{c}").cast("string").alias("before"), F.col(c).cast("string").alias("after"), (~F.col(f"_b.{c}").eqNullSafe(F.col(c))).alias("differs")) for c in columns]
    changed = F.filter(F.array(*cells), lambda x: x["differs"])
    return rows.where("_k = 'UPDATE_BEFORE'").select(*keys, seq, F.inline(changed)).drop("differs")


def newest(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows of an order, the newest first."""
    return rows.orderBy(*[F.col(c).desc() for c in order]).limit(n)
