"""Names resolved to DataFrames, and the slice of a table that a run looks at."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .contracts import Contract

Reader = Callable[[SparkSession, Mapping[str, str], str], DataFrame]


def _parquet(spark: SparkSession, server: Mapping[str, str], name: str) -> DataFrame:
    return spark.read.parquet(f"{server['path'].rstrip('/')}/{name}.parquet")


def _file(kind: str) -> Reader:
    return lambda spark, server, name: spark.read.format(kind).options(**server.get("options", {})).load(f"{server['path'].rstrip('/')}/{name}")


def _jdbc(spark: SparkSession, server: Mapping[str, str], name: str) -> DataFrame:
    """A database table; partitionColumn and numPartitions among the server's options split the read.

    Bounds that are not given are looked up, which the database does by itself. They only say
    where reads part: rows beyond them and nulls are in the first or last one.
    """
    at = {"url": server["url"], "dbtable": f"{server['schema']}.{name}" if server.get("schema") else name}
    options = dict(server.get("options", {}))
    column = options.get("partitionColumn")
    if column and not {"lowerBound", "upperBound"} <= set(options):
        rest = {k: v for k, v in options.items() if k not in ("partitionColumn", "numPartitions", "lowerBound", "upperBound")}
        low, high = spark.read.format("jdbc").options(**at, **rest).load().agg(F.min(column), F.max(column)).first()
        if low is None:
            options = rest
        else:
            options = {"numPartitions": "8"} | options | {"lowerBound": str(low), "upperBound": str(high)}
    return spark.read.format("jdbc").options(**at, **options).load()


def _view(spark: SparkSession, server: Mapping[str, str], name: str) -> DataFrame:
    return spark.table(name)


ENGINES: dict[str, Reader] = {"parquet": _parquet, "json": _file("json"), "csv": _file("csv"), "orc": _file("orc"), "jdbc": _jdbc, "postgres": _jdbc, "postgresql": _jdbc, "sqlserver": _jdbc, "mssql": _jdbc, "view": _view}


def engine(name: str) -> Reader:
    """The reader of an engine's name."""
    if name not in ENGINES:
        raise LookupError(f"no engine is called {name!r}; known are {', '.join(sorted(ENGINES))}")
    return ENGINES[name]


def resolver(spark: SparkSession, server: Mapping[str, str]) -> Callable[[str], DataFrame]:
    read = engine(server["type"])
    return lambda name: read(spark, server, name)


def windowed(df: DataFrame, column: str, as_of: dt.date | str, mode: str = "incremental", predicate: str | None = None) -> DataFrame:
    """The rows of df that a run of day `as_of` looks at.

    incremental: rows that arrived that day, or those of a predicate template with {col}
    and {day}; cumulative: rows up to the day. A table without the column passes whole.
    A timestamp column is compared over the day's span, so the filter reaches the scan.
    """
    if column not in df.columns:
        return df
    day = dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    if predicate and mode == "incremental":
        return df.where(predicate.format(col=f"`{column}`", day=f"DATE'{day.isoformat()}'"))
    kind = df.schema[column].dataType
    low, high = F.lit(day), F.lit(day + dt.timedelta(days=1))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        low, high = low.cast(kind), high.cast(kind)
    until = F.col(column) < high
    if mode == "cumulative":
        return df.where(until)
    if mode != "incremental":
        raise ValueError(f"a window is incremental or cumulative, not {mode!r}")
    return df.where((F.col(column) >= low) & until)


def contract_window(contract: Contract, read: Callable[[str], DataFrame], column: str, as_of: dt.date | str, mode: str = "incremental") -> dict[str, DataFrame]:
    """Each model's rows of the day. A model's own predicate goes before the contract's.

    Raises LookupError where no table can be read: nothing is measured then.
    """
    found: dict[str, DataFrame] = {}
    for m in contract.models:
        try:
            found[m.name] = windowed(read(m.name), column, as_of, mode, m.window_predicate or contract.window_predicate)
        except Exception as e:  # an unreadable table is reported, with the others measured
            if "PATH_NOT_FOUND" not in str(e) and "TABLE_OR_VIEW_NOT_FOUND" not in str(e):
                raise
    if not found:
        raise LookupError(f"{contract.id}: the window of {as_of} built no relation")
    return found


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, total_rows."""
    parts = [df.agg(F.count(F.lit(1)).alias("total_rows")).select(F.lit(name).alias("table_name"), "total_rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def paired_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """table_name, source_rows, target_rows and missing (rows that the target lacks, negative for too many) of two row_counts()."""
    both = source.withColumnRenamed("total_rows", "source_rows").join(target.withColumnRenamed("total_rows", "target_rows"), "table_name", "full_outer")
    return both.withColumn("missing", F.coalesce("source_rows", F.lit(0)) - F.coalesce("target_rows", F.lit(0)))


def captured(declared: DataFrame, log_columns: DataFrame) -> DataFrame:
    """column_name, column_id and captured: whether the log carries a declared column under its name and its number; one that was dropped and made anew has another number."""
    have = log_columns.select("column_name", "column_id").distinct().withColumn("_there", F.lit(True))
    return declared.join(have, ["column_name", "column_id"], "left").select("column_name", "column_id", F.coalesce("_there", F.lit(False)).alias("captured"))


def column_sample(df: DataFrame, column: str, key: str, n: int = 200) -> DataFrame:
    """The column's first n values that are not null, as text, in order of a key."""
    return df.where(F.col(column).isNotNull()).orderBy(key).limit(n).select(F.col(column).cast("string").alias("value"))


def documents_from_map(df: DataFrame, key: str, entries: str, name: str = "name", value: str = "value") -> DataFrame:
    """Nested documents flattened: a row for each entry of a map column."""
    return df.select(key, F.explode(entries).alias(name, value))


def missing_days(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """The days from first to last on which df has no row."""
    wanted = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return wanted.join(df.select(F.col(column).cast("date").alias("day")).distinct(), "day", "left_anti")


def poll_answers(df: DataFrame, body: str, content: str, schema: str) -> DataFrame:
    """Rows of a polled listing: `body` is an answer's JSON text, `content` its field with the members."""
    parsed = F.from_json(F.col(body), f"{content} array<struct<{schema}>>")
    return df.select(*[c for c in df.columns if c != body], F.inline(parsed[content]))


def snapshot_then_changes(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of a folder's change files: those that are there are the snapshot, later ones the changes."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def snapshot(df: DataFrame, columns: list[str], where: str | None = None) -> DataFrame:
    """A source table as inserts (op 2), with the columns and rows that are replicated."""
    return (df.where(where) if where else df).select(F.lit(2).alias("op"), *columns)


def snapshot_at(df: DataFrame, log: DataFrame, columns: list[str], where: str | None = None, lsn: str = "lsn") -> tuple[int | None, DataFrame]:
    """The log's last position, read before the snapshot, and the snapshot: changes from the position on may be in it, and applying them again changes nothing."""
    position = log.agg(F.max(lsn)).first()[0]
    return position, snapshot(df, columns, where)


def changes(log: DataFrame, since: int, to: int, lsn: str = "lsn", seq: str = "seq") -> DataFrame:
    """The log's changes after `since` up to `to`, in order; before images are kept."""
    return log.where((F.col(lsn) > since) & (F.col(lsn) <= to)).orderBy(lsn, seq)


def must_resnapshot(log: DataFrame, since: int | None, lsn: str = "lsn") -> bool:
    """Whether changes after `since` may have left the log already."""
    first = log.agg(F.min(lsn)).first()[0]
    return since is None or (first is not None and since < first - 1)


def columns_of(df: DataFrame, where: str) -> set[str]:
    """The columns of df that a filter reads, as Spark resolves it."""
    names = df.where(where)._jdf.queryExecution().analyzed().condition().references().iterator()
    out = set()
    while names.hasNext():
        out.add(names.next().name())
    return out


def row_kinds(changes: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, kind: str = "row_kind") -> DataFrame:
    """The changes of some kinds, or of all but some."""
    if include:
        return changes.where(F.col(kind).isin(*include))
    return changes.where(~F.col(kind).isin(*exclude)) if exclude else changes


def sync_status(runs: DataFrame, n: int = 10) -> DataFrame:
    """contract_id, runs, rows_read, upserted, deleted and last_run of each replication's last n runs."""
    newest = Window.partitionBy("contract_id").orderBy(F.col("run_at").desc())
    last = runs.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n)
    sums = [F.sum(c).alias(c) for c in ("rows_read", "upserted", "deleted")]
    return last.groupBy("contract_id").agg(F.count(F.lit(1)).alias("runs"), *sums, F.max("run_at").alias("last_run"))
