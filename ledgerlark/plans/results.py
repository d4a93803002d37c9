"""Tables of results: a run replaces its day, the last word on a check wins, logs only grow."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .scoring import latest


class ResultStore:
    """Parquet tables under a folder. check_results, contract_scores and column_profile are partitioned by month, day, window and contract.

    A table that is rewritten has versions, and a file of its name with `.at` that says which one holds.
    """

    DAY = ["run_month", "run_at", "run_window", "contract_id"]

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def replace_day(self, table: str, rows: DataFrame) -> None:
        """Write rows; of every (day, window, contract) among them, nothing older is left."""
        rows = rows.withColumn("run_month", F.date_format("run_at", "yyyy-MM"))
        rows.repartition(*self.DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.DAY).parquet(f"{self.folder}/{table}")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, table: str) -> str:
        """The folder of the table's rows: its own, or the version that its pointer names."""
        path, fs = self._fs()
        pointer = path(f"{self.folder}/{table}.at")
        if not fs.exists(pointer):
            return f"{self.folder}/{table}"
        return f"{self.folder}/{self.spark.read.text(pointer.toString()).first()[0]}"

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self._path(table))

    def read(self, table: str) -> DataFrame:
        """The table with run_at as a date; filters on run_month and run_at prune its partitions."""
        df = self.spark.read.parquet(self._path(table))
        return df.withColumn("run_at", F.col("run_at").cast("date")) if "run_month" in df.columns else df

    def last_word(self, table: str, keys: list[str], order: str) -> DataFrame:
        """Of an appended table, each key's newest row."""
        return latest(self.read(table), keys, order)

    def rewrite(self, table: str, rows: DataFrame) -> None:
        """Put rows in place of the table, from which they may be read: a new version is written whole, then the pointer is switched, then the old one goes.

        A reader or a crash in between finds the old version or the new one, never none.
        """
        old, new = self._path(table), f"{table}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{new}")
        tables.put(self.spark, f"{self.folder}/{table}.at", f"{new}\n")
        tables.delete(self.spark, old)

    def prune(self, table: str, column: str, cutoff: str) -> None:
        """Drop rows older than a moment."""
        self.rewrite(table, self.read(table).where(F.col(column) >= F.lit(cutoff)))


class RunStore:
    """Results, scores, profiles and statuses of runs under a folder, each run visible whole or not at all.

    The rows of a run go to partitions of its own; then its file among `runs`, named by day,
    window and contract, is switched to it by a rename. Readers take the rows of runs that
    such a file names: after a crash between tables that is the run before, with all its
    tables, and a run without rows leaves none of its day's older ones.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commit(self, run_at: str, window: str, contract_id: str, rows: Mapping[str, DataFrame]) -> str:
        """Write a run's tables and make them the ones of its day, window and contract; gives the run's name."""
        run = uuid.uuid4().hex
        for table, df in rows.items():
            df.withColumns({"run_month": F.lit(str(run_at)[:7]), "run": F.lit(run)}).write.mode("append").partitionBy("run_month", "run").parquet(f"{self.folder}/{table}")
        name = hashlib.sha256(json.dumps([str(run_at), window, contract_id]).encode()).hexdigest()[:32]
        about = {"run_at": str(run_at), "run_window": window, "contract_id": contract_id, "run": run, "tables": sorted(rows)}
        tables.put(self.spark, f"{self.folder}/runs/{name}.json", json.dumps(about))
        return run

    def runs(self) -> DataFrame:
        """run_at, run_window, contract_id and run of the runs that stand."""
        found = self.spark.read.schema("run_at date, run_window string, contract_id string, run string")
        if not tables.exists(self.spark, f"{self.folder}/runs"):
            return self.spark.createDataFrame([], "run_at date, run_window string, contract_id string, run string")
        return found.json(f"{self.folder}/runs/*.json")

    def read(self, table: str) -> DataFrame:
        """The rows of a table of all runs that stand; its partitions are pruned by their runs."""
        return self.spark.read.parquet(f"{self.folder}/{table}").join(self.runs().select("run"), "run", "left_semi").drop("run", "run_month")

    def vacuum(self, table: str) -> None:
        """Delete rows of runs that do not stand; run it when nothing reads them any more."""
        kept = {r.run for r in self.runs().collect()}
        for r in self.spark.read.parquet(f"{self.folder}/{table}").select("run_month", "run").distinct().collect():
            if r.run not in kept:
                tables.delete(self.spark, f"{self.folder}/{table}/run_month={r.run_month}/run={r.run}")


def land(df: DataFrame, path: str) -> None:
    """Raw rows as they are, in place of the last load."""
    df.write.mode("overwrite").parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those of the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
