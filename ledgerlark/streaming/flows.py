"""Flows as streams: changes into an inbox, golden revisions out to tables, totals kept up to date."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlark.operators import deliver, rollup
from ledgerlark.plans.flows import Flow, inbox_rows
from ledgerlark.plans.tables import BucketedTable
from ledgerlark.sources.log import ChangeLog


def trigger(flow: Flow) -> dict[str, str]:
    """How often a flow's stream runs."""
    ms = flow.job.get("checkpointInterval") or 1000 * flow.job.get("pollSeconds", 3)
    return {"processingTime": f"{ms} milliseconds"}


def reader_options(flow: Flow) -> dict[str, str]:
    """What a source may hand a batch, by the flow's rowsPerSecond and how often it runs: rows for logs, which count them."""
    rows, ms = flow.job.get("rowsPerSecond"), int(trigger(flow)["processingTime"].split()[0])
    return {"maxOffsetsPerTrigger": str(max(1, rows * ms // 1000))} if rows else {}


def slow_batches(flow: Flow, durations: Mapping[int, int]) -> list[str]:
    """A sentence for each batch (number to milliseconds, from a query's progress) that took longer than the flow's checkpointTimeout."""
    most = flow.job.get("checkpointTimeout")
    return [f"{flow.id}: batch {n} took {ms} ms, more than {most}" for n, ms in durations.items() if most and ms > most]


def slow(query: StreamingQuery, flow: Flow) -> list[str]:
    """slow_batches of a stream's latest batches, running or stopped."""
    return slow_batches(flow, {p.batchId: p.durationMs.get("triggerExecution", 0) for p in query.recentProgress})


def change_log(spark: SparkSession, snapshot: str, log: str, columns: str, positions: str, flow: Flow | None = None) -> DataFrame:
    """A stream of a table's snapshot and then its log, in batches of the flow's rowsPerSecond; columns in DDL. See `sources.log.ChangeLog`."""
    spark.dataSource.register(ChangeLog)
    reader = spark.readStream.format(ChangeLog.name()).schema(f"snapshot long, op int, lsn long, seq long, {columns}")
    return reader.options(snapshot=snapshot, log=log, positions=positions, **(reader_options(flow) if flow else {})).load()


def into_inbox(changes: DataFrame, flow: Flow, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream of changes to the inbox of the flow's target."""
    writer = inbox_rows(changes, flow).withColumn("landed_at", F.current_timestamp()).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(**trigger(flow))).outputMode("append").start()


def out_to_table(revisions: DataFrame, table: BucketedTable, system: str, fields: Sequence[str], checkpoint: str, once: bool = False, required: Sequence[str] = (), match: Sequence[str] = ()) -> StreamingQuery:
    """Merge a stream of golden revisions (the table's keys, fields, rev, _changed, _skip, deleted) into a table, a batch at a time.

    Of a key's revisions in a batch the last one is delivered, three ways: rows to merge, rows
    of deleted records, and, for a flow of part of a record (match), rows whose fields are all
    empty, which go too. Only buckets of the batch's keys are read and written; a batch that
    runs again finds itself applied.
    """

    def batch(df: DataFrame, n: int) -> None:
        keys = table.keys
        newest = F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "rev")
        last = df.groupBy(*keys).agg(newest.alias("r")).select(*keys, "r.*").persist()
        told = deliver.outgoing(last.where("not deleted"), system, fields, required)
        gone = last.where("deleted").select(*keys)
        if match:
            told, emptied = deliver.split_matches(told, match)
            gone = gone.unionByName(emptied.select(*keys))
        table.update(last.select(*keys), lambda now: deliver.delete(deliver.merge(now, told, keys, fields).drop("_action"), gone, keys), (f"{checkpoint}", n))
        last.unpersist()

    writer = revisions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def keep_totals(changes: DataFrame, lines: BucketedTable, totals: BucketedTable, group: Mapping[str, str], aggregates: Mapping[str, str], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep a table of lines and the states of its group totals (rollup.states, shown by rollup.shown) up to date with a stream of line changes (op, seq).

    A changed line takes its old values out of its group's state and adds the new ones, so a
    batch reads the buckets of its lines and of their groups and no other line of a group. The
    totals are committed first: a batch that broke in between finds lines as they were.
    """

    def batch(df: DataFrame, n: int) -> None:
        keys, at = lines.keys, (checkpoint, n)
        if lines.applied(at):
            return
        before = lines.read(lines.touched(df.select(*keys)))
        _, touched = rollup.signed_changes(before, df, keys)
        delta = rollup.deltas(touched, group, aggregates).persist()
        totals.update(delta.select(*group), lambda now: rollup.applied(now, delta, group, aggregates), at)
        lines.update(df.select(*keys), lambda now: rollup.apply_changes(now, df, keys)[0], at)
        delta.unpersist()

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def problems(spark: SparkSession, idle_ok: bool = True) -> list[str]:
    """A sentence for each stream of the session that does not move."""
    out = []
    for q in spark.streams.active:
        if q.exception() is not None:
            out.append(f"{q.name or q.id}: stopped, {str(q.exception()).splitlines()[0]}")
        elif not idle_ok and not q.status["isDataAvailable"] and not q.status["isTriggerActive"]:
            out.append(f"{q.name or q.id}: nothing has arrived")
    return out


def replication_problems(statuses: DataFrame) -> DataFrame:
    """contract and problem, the first that its status tells of: statuses has contract, copying (tables), streaming and reachable; what is not told is no problem."""
    told = [
        (F.size("copying") > 0, F.concat(F.array_join("copying", ", "), F.lit(" still being copied, nothing replicates"))),
        (~F.col("streaming"), F.lit("the apply job is not running")), (~F.col("reachable"), F.lit("the source cannot be reached")),
    ]
    return statuses.select("contract", F.coalesce(*[F.when(at, sentence) for at, sentence in told]).alias("problem")).where("problem is not null")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start meanwhile keep their state in RocksDB, which typed state, timers and expiry need; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_once(start: Callable[[], StreamingQuery]) -> None:
    """Run what is there and wait for it."""
    start().awaitTermination()
