"""Change logs as streams, failing rows of written SQL, profiles from sketches."""

from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import cdc, profile, sample
from ledgerlark.queries import FLOW
from ledgerlark.streaming import flows as streams

SHAPE = "op int, lsn long, seq long, k long, v string, at timestamp"


def _log(spark, folder, rows, name):
    path = f"{folder}/{name}"
    spark.createDataFrame([(*r, None) for r in rows], SHAPE).coalesce(1).write.mode("overwrite").parquet(path)
    for i, part in enumerate(Path(path).glob("*.parquet")):
        (Path(folder) / "log").mkdir(exist_ok=True)
        part.rename(Path(folder) / "log" / f"{name}-{i}.parquet")


@pytest.fixture
def source(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(f"{tmp_path}/table")
    _log(spark, tmp_path, [(4, 10, 0, 1, "before the snapshot")], "one")
    return tmp_path


def _take(spark, at, most=None):
    """numbers of rows by batch, and the replica."""
    flow = replace(FLOW, job={"rowsPerSecond": most, "checkpointInterval": 1000}) if most else None
    reader = streams.change_log(spark, f"{at}/table", f"{at}/log", "k long, v string, at timestamp", f"{at}/positions", flow)
    q = reader.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/progress").trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.read.parquet(f"{at}/rows")
    return [p.numInputRows for p in q.recentProgress if p.numInputRows], rows, {(r.k, r.v) for r in cdc.replica(rows, ["k"]).collect()}


def test_snapshot_then_changes_in_small_batches(spark, source):
    taken, rows, now = _take(spark, source)
    assert taken == [2] and now == {(1, "a"), (2, "b")} and {(r.lsn, r.op, r.seq) for r in rows.collect()} == {(10, 2, 0)}
    # One position of three rows, which no limit splits; a before image and the after image of one; positions out of order among files.
    _log(spark, source, [(1, 13, 0, 2, None), (3, 14, 0, 1, "a"), (4, 14, 1, 1, "x")], "two")
    _log(spark, source, [(2, 11, 0, 3, "c"), (2, 11, 1, 4, "d"), (4, 11, 2, 4, "e"), (2, 12, 0, 5, None)], "three")
    taken, rows, now = _take(spark, source, most=2)
    assert taken == [3, 2, 2] and now == {(1, "x"), (3, "c"), (4, "e"), (5, None)} and rows.count() == 9
    assert _take(spark, source, most=2)[0] == []


def test_lost_positions_begin_a_new_snapshot(spark, source):
    _take(spark, source)
    for part in (source / "log").glob("one*"):
        part.unlink()
    spark.createDataFrame([(1, "a2"), (7, "z")], "k long, v string").write.mode("overwrite").parquet(f"{source}/table")
    _log(spark, source, [(4, 50, 0, 7, "z")], "late")  # 11 to 49 are gone
    taken, rows, now = _take(spark, source)
    assert taken == [2] and now == {(1, "a2"), (7, "z")} and rows.agg(F.max("snapshot"), F.max("lsn")).first() == (2, 50)
    _log(spark, source, [(1, 51, 0, 7, None)], "later")
    assert _take(spark, source)[2] == {(1, "a2")}


def test_empty_table_and_log(spark, tmp_path):
    spark.createDataFrame([], "k long, v string").write.parquet(f"{tmp_path}/table")
    taken, rows, now = _take(spark, tmp_path)
    assert taken == [] and now == set()


def test_slow_batches_of_a_stream(spark, source):
    reader = streams.change_log(spark, f"{source}/table", f"{source}/log", "k long, v string, at timestamp", f"{source}/positions")
    q = reader.writeStream.format("noop").option("checkpointLocation", f"{source}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    flow = replace(FLOW, job={"checkpointTimeout": 1})
    assert any(s.startswith(f"{flow.id}: batch 0 took") for s in streams.slow(q, flow))


@pytest.fixture
def people(spark):
    spark.createDataFrame([(1, "Ann", 5), (2, "Bob", -1), (3, None, -2)], "id int, name string, n int").createOrReplaceTempView("people_sampled")
    yield "people_sampled"
    spark.catalog.dropTempView("people_sampled")


def test_failing_rows_of_written_sql(spark, people):
    rows = lambda text, n=20: sample.failing_rows_of(spark.sql(text.format(people)), ["name"], n)
    assert sorted(map(tuple, rows("SELECT count(*) FROM {0} WHERE n < 0").collect())) == [(2, "•••", -1), (3, "•••", -2)]
    assert rows("SELECT count(*) FROM {0} WHERE n < 0", 1).count() == 1
    assert rows("SELECT id FROM {0} WHERE n < 0 ORDER BY id LIMIT 5").columns == ["id", "name", "n"]
    assert rows("SELECT count(*) FROM {0} WHERE id NOT IN (SELECT id FROM {0} WHERE n < 0)").count() == 1
    # A name under another name, once and twice removed, is still masked; so is one of a shared subquery.
    twice = rows("SELECT count(*) FROM (SELECT id, lower(alias) AS x, n FROM (SELECT id, name AS alias, n FROM {0})) q WHERE n < 0").collect()
    assert {r.x for r in twice} == {"•••"}
    assert {r.x for r in rows("WITH q AS (SELECT id, name AS x, n FROM {0}) SELECT count(*) FROM q WHERE n < 0").collect()} == {"•••"}
    assert rows("SELECT count(*) FROM {0} a JOIN {0} b ON a.id = b.id WHERE a.n < 0").columns == ["id", "name", "n", "id_2", "name_2", "n_2"]
    for text in ("SELECT n, count(*) FROM {0} WHERE n < 0 GROUP BY n", "SELECT count(*) FROM {0}", "SELECT count(*) AS c FROM {0} HAVING c > 1", "SELECT id FROM {0} WHERE n < 0 UNION SELECT id FROM {0}"):
        assert rows(text) is None


def test_profiles_up_to_a_day(spark):
    rows = [("2024-01-01", "a"), ("2024-01-01", None), ("2024-01-02", "a"), ("2024-01-02", "b"), ("2024-01-04", None)]
    df = spark.createDataFrame(rows, "day string, v string").withColumn("day", F.to_date("day"))
    exact = profile.cumulative_exact(df, ["v"], "t", "day").orderBy("run_at").select("rows", "nulls", "distinct_count")
    assert [tuple(r) for r in exact.collect()] == [(2, 1, 1), (4, 1, 2), (5, 2, 2)]
    told = profile.cumulative(profile.sketches(df, ["v"], "t", "day")).orderBy("run_at").select("rows", "nulls", "distinct_estimate")
    assert [tuple(r) for r in told.collect()] == [(2, 1, 1), (4, 1, 2), (5, 2, 2)]
    assert profile.cumulative_exact(df.limit(0), ["v"], "t", "day").count() == 0
