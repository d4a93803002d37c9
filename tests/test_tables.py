"""Bucketed tables, states that take changes back: files written, batches that run again, recomputation."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import rollup
from ledgerlark.plans import tables
from ledgerlark.plans.results import RunStore
from ledgerlark.plans.tables import BucketedTable


def versions(table):
    return table._manifest()["at"]


def test_a_batch_writes_the_buckets_of_its_keys_once(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    table = BucketedTable.create(spark.range(200).select("id", (F.col("id") * 2).alias("x")), at, ["id"], 16)
    before = versions(table)
    keys = spark.createDataFrame([(3,), (77,)], "id long")
    change = lambda now: now.join(keys, "id", "left_anti").unionByName(keys.withColumn("x", F.lit(0)))
    table.update(keys, change, ("s", 0))
    after = versions(table)
    assert {b for b in before if before[b] != after[b]} == {str(b) for b in table.touched(keys)} and len(table.touched(keys)) <= 2
    again = BucketedTable(spark, at)
    again.update(keys, lambda now: now.limit(0), ("s", 0))  # has run
    assert versions(again) == after and again.applied(("s", 0)) and not again.applied(("s", 1))
    assert again.read().count() == 200 and {r.x for r in again.read().join(keys, "id").collect()} == {0}
    again.vacuum()
    assert again.read().count() == 200
    again.update(spark.range(200), lambda now: now.limit(0), ("s", 1))
    assert again.read().count() == 0 and versions(again) == {} and again.read().columns == ["id", "x"]


def test_a_reader_sees_the_old_file_or_the_new_one(spark, tmp_path):
    at = f"file://{tmp_path}/a/m.json"
    for text in ("one", "two\nlines"):
        tables.put(spark, at, text)
        assert tables.get(spark, at) == text
    assert tables.exists(spark, at) and not tables.exists(spark, at + "x")


def test_states_with_changes_equal_recomputation(spark):
    r = random.Random(6)
    group, of = {"k": "g", "h": "h"}, {"s": "sum(x)", "n": "count(*)", "c": "count(x)", "lo": "min(x)", "hi": "max(x)", "a": "avg(x)", "first": "min(g)"}
    schema = "id long, g string, h int, x long"
    row = lambda i: (i, r.choice(["a", "b", None]), r.choice([1, None]), r.choice([None, *range(5)]))
    lines = spark.createDataFrame([row(i) for i in range(40)], schema)
    state = rollup.states(lines, group, of)
    for n in range(3):
        changes = spark.createDataFrame([(*row(r.randrange(60)), r.choice(["upsert", "delete"]), i) for i in range(25)], schema + ", op string, seq long")
        lines, touched = rollup.signed_changes(lines, changes, ["id"])
        state = rollup.applied(state, rollup.deltas(touched, group, of), group, of)
        rows = lines.collect()
        lines = spark.createDataFrame(rows, schema)
        state = spark.createDataFrame(state.collect(), state.schema)
        want = rollup.totals(lines, group, of).select(*group, *of)
        assert sorted(map(str, rollup.shown(state, group, of).collect())) == sorted(map(str, want.collect())), n


def test_a_run_is_seen_whole_and_an_empty_one_clears_its_day(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/runs")
    rows = lambda *x: spark.createDataFrame(list(x), "check_id string, failed long")
    assert store.runs().count() == 0
    store.commit("2024-05-01", "incremental", "c", {"results": rows(("a", 1), ("b", 2)), "scores": rows(("a", 9))})
    store.commit("2024-05-02", "incremental", "c", {"results": rows(("a", 3)), "scores": rows(("a", 8))})
    with pytest.raises(Exception, match="broken"):
        store.commit("2024-05-01", "incremental", "c", {"results": rows(("a", 100)), "scores": rows(("a", 1)).select(F.raise_error(F.lit("broken")).alias("check_id"))})
    assert sorted(map(tuple, store.read("results").collect())) == [("a", 1), ("a", 3), ("b", 2)]
    store.commit("2024-05-01", "incremental", "c", {"results": rows(), "scores": rows()})
    assert [tuple(r) for r in store.read("results").collect()] == [("a", 3)] and [tuple(r) for r in store.read("scores").collect()] == [("a", 8)]
    store.vacuum("results")
    assert spark.read.parquet(f"{store.folder}/results").count() == 1 and store.read("results").count() == 1
