"""Crosswalk placing, deliveries by link, and keys of all days, against cases by hand."""

import datetime as dt
import json
import random

import pandas as pd
import pytest

from ledgerlark.operators import deliver
from ledgerlark.plans import checks
from ledgerlark.streaming import crosswalk, golden
from ledgerlark.streaming import flows as streams

WALK = golden.Crosswalk({"shop": "code"}, ("name",), ("name",))
RECORDS = "key long, code long, name string"


def placed(spark, rows, records, sent=(), gone=()):
    rows = spark.createDataFrame(rows, "code long, name string, row_kind string, ms long")
    got = golden.place(
        rows, spark.createDataFrame(records, RECORDS), WALK, "shop", spark.createDataFrame(list(sent), "key long, field string, value string, ms long"), ["name"],
        spark.createDataFrame(list(gone), "code long, key long, deleted_ms long"),
    )
    return {r.code: (r.key, r.held, r.withdrawn) for r in got.collect()}


def test_a_deleted_record_keeps_its_code_whatever_the_link_says(spark):
    got = placed(spark, [(7, "Ada", "INSERT", 0), (8, "Ada", "INSERT", 0)], [(100, None, "Ada")], gone=[(7, 9, 50), (7, 55, 10)])
    assert got == {7: (9, None, False), 8: (100, None, False)}  # of two deleted records the one deleted last


def test_a_delete_of_what_was_never_placed_withdraws(spark):
    assert placed(spark, [(1, "Ada", "DELETE", 0), (2, "Bob", "DELETE", 0)], [(100, None, "Ada"), (200, 2, "Bob")]) == {1: (None, None, True), 2: (200, None, False)}


def test_deliveries_are_awaited_for_an_hour_and_part_rows_answer_none(spark):
    hour = golden.EXPECT_MS
    records = [(100, None, "Ada"), (101, None, "Ada"), (102, None, "Eve"), (103, None, "Eve")]
    rows = [(1, "Ada", "INSERT", hour + 5), (2, "Eve", "INSERT", hour + 5), (3, None, "INSERT", 5), (4, "New", "INSERT", 5)]
    sent = [(100, "name", "Ada", 6), (102, "name", "Eve", 5), (101, "name", None, 5)]
    assert placed(spark, rows, records, sent) == {1: (100, None, False), 2: (None, "ambiguous", False), 3: (None, "part", False), 4: (None, None, False)}


def test_a_target_row_takes_one_delivery_and_shared_links_none(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "y")], "id long, name string, link string")
    source = spark.createDataFrame([(1, "keyed", "x", "*", True), (None, "linked", "x", "*", True), (None, "both", "y", "*", True), (None, "new", "z", "*", True), (None, "none", None, "*", True)], "id long, name string, link string, _changed string, _link boolean")
    got = sorted(tuple(r) for r in deliver.merge(target, source, ["id"], ["name", "link"], link_by=["link"]).where("id is not null").collect())
    assert got == [(1, "keyed", "x", "update"), (2, "b", "y", None), (3, "c", "y", None)]
    assert [r.name for r in deliver.refused_links(target, source, ["id"], ["link"]).collect()] == ["both"]
    inserted = deliver.merge(target, source, ["id"], ["name", "link"], link_by=["link"]).where("id is null")
    assert sorted(r.name for r in inserted.collect()) == ["new", "none"]


def test_keys_of_all_days_equal_a_run_a_day(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [(1, 10, day(1)), (2, 10, day(2)), (3, None, day(2)), (4, 10, day(4)), (5, 11, day(4)), (6, 12, day(5)), (6, 12, day(5))]
    df = spark.createDataFrame(rows, "id long, ref long, at timestamp")
    parent = spark.createDataFrame([(10, day(2)), (11, day(9)), (12, None)], "ref long, at timestamp")
    of = [checks.rule("unique", "t", "ref", key="u"), checks._no_duplicates("p", "t", "field_primary_key", ("id",), True), checks.rule("foreign_key", "t", "ref", {"table": "p", "column": "ref"}, key="f")]
    for mode in ("incremental", "cumulative"):
        got = {(r.run_at.day, r.check_id): (r.failed_rows, r.total_rows) for r in checks.by_day("c", df, "at", of, mode, {"p": parent}, {"p": "at"}).collect()}
        for n in (1, 2, 4, 5):
            upto = df.where(df["at"] <= day(n))
            own = upto if mode == "cumulative" else df.where(df["at"] == day(n))
            want = {r.key: (r.failed, r.total) for r in checks.measure(of, {"t": own}, {"t": upto, "p": parent.where(parent["at"] <= day(n))}).collect()}
            assert {k: got[n, f"c.{k}"] for k in "upf"} == want, (mode, n)
    with pytest.raises(KeyError):
        checks.by_day("c", df, "at", of)


# --- the crosswalk from inbox to golden records

RULES = crosswalk.Rules(golden.Entity(("name", "city", "tel"), {"crm": ("name", "city"), "shop": ("name", "city"), "shop.tel": ("tel",)}, "crm", ("name",)), ("name",))
HOUR = golden.EXPECT_MS


def inbox(*rows):
    """(system, code, row kind, row) in order; ms and seq are the place."""
    return [{"system": s, "code": c, "row_kind": k, "row": json.dumps(r), "seq": i, "source_ms": 1000 * i, "unmapped": None} for i, (s, c, k, r) in enumerate(rows)]


def settled(spark, rows):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "system string, code string, row_kind string, row string, seq long, source_ms long, unmapped string")
    return df, crosswalk.replay(df, RULES)


def outcomes(found):
    return [(r.system, r.code, r.outcome, r.reason) for r in sorted(found.collect(), key=lambda r: (r.seq, r.nth))]


def names(found):
    return sorted(json.dumps({k: v for k, v in json.loads(r.record).items() if v is not None}, sort_keys=True) for r in crosswalk.records(found).collect())


def test_part_rows_wait_for_the_owner_and_a_person_decides_the_rest(spark):
    rows = inbox(
        ("shop.tel", "s1", "INSERT", {"tel": "1"}), ("shop.tel", "s1", "INSERT", {"tel": "2"}), ("crm", "c1", "INSERT", {"name": "Ada", "city": "Rome"}), ("shop", "s1", "INSERT", {"name": "Ada", "city": "Rome"}),
        ("shop", "s2", "INSERT", {"name": "Ada", "city": "Bonn"}), ("shop.tel", "s2", "INSERT", {"tel": "9"}), ("shop", "s3", "INSERT", {"name": None, "city": "x"}), ("shop", "s2", "LINK", {"key": None}), ("shop", "s2", "UPDATE_AFTER", {"name": "Ada", "city": "Köln"}),
    )
    _, found = settled(spark, rows)
    assert outcomes(found) == [
        ("shop.tel", "s1", "held", "part"), ("shop.tel", "s1", "held", "part"), ("crm", "c1", "created", None), ("shop", "s1", "echo", None), ("shop.tel", "s1", "applied", None), ("shop", "s2", "held", "taken"),
        ("shop.tel", "s2", "held", "part"), ("shop", "s3", "held", "unmatchable"), ("shop", "s2", "linked", None), ("shop", "s2", "created", None), ("shop.tel", "s2", "applied", None), ("shop", "s2", "applied", None),
    ]
    assert names(found) == sorted(['{"city": "Rome", "name": "Ada", "tel": "2"}', '{"city": "K\\u00f6ln", "name": "Ada", "tel": "9"}'])
    assert [tuple(r) for r in crosswalk.still_held(found).collect()] == [("shop", "s3", "unmatchable")]


def test_a_decision_for_a_record_that_is_there(spark):
    first = inbox(("crm", "c1", "INSERT", {"name": "Ada", "city": "Rome"}))
    _, found = settled(spark, first)
    key = found.first().key
    rows = inbox(("crm", "c1", "INSERT", {"name": "Ada", "city": "Rome"}), ("shop", "s1", "INSERT", {"name": None, "city": "Bari"}), ("shop", "s1", "LINK", {"key": key}), ("shop.tel", "s1", "INSERT", {"tel": "5"}))
    _, found = settled(spark, rows)
    assert {r.key for r in found.where("rev is not null").collect()} == {key}
    assert names(found) == ['{"city": "Rome", "name": "Ada", "tel": "5"}']  # the authority's word at the first sync


def test_a_withdrawn_row_is_not_replayed_and_a_deleted_record_keeps_its_code(spark):
    rows = inbox(
        ("shop.tel", "s1", "INSERT", {"tel": "1"}), ("shop.tel", "s1", "DELETE", {"tel": "1"}), ("shop", "s1", "INSERT", {"name": "Bob", "city": "Oslo"}),
        ("shop", "s1", "DELETE", {"name": "Bob", "city": "Oslo"}), ("crm", "c9", "INSERT", {"name": "Bob", "city": "Oslo"}), ("shop", "s1", "INSERT", {"name": "Bob", "city": "Rome"}),
    )
    _, found = settled(spark, rows)
    assert [o[2] for o in outcomes(found)] == ["held", "withdrawn", "created", "deleted", "created", "created"]
    keys = [r.key for r in sorted(found.where("rev is not null").collect(), key=lambda r: r.seq)]
    assert keys[0] == keys[1] == keys[3] != keys[2]


def test_the_stream_equals_the_batch_row_by_row(spark, tmp_path):
    r = random.Random(4)
    rows = inbox(*[
        (s := r.choice(["crm", "shop", "shop.tel"]), f"{s[0]}{r.randrange(6)}", r.choice(["INSERT", "INSERT", "UPDATE_AFTER", "UPDATE_BEFORE", "DELETE", "LINK"]) if s != "shop.tel" else r.choice(["INSERT", "DELETE"]),
         {"tel": str(r.randrange(3))} if s == "shop.tel" else {"name": r.choice(["Ada", "Bob", "Eve", None]), "city": r.choice(["x", "y"])})
        for _ in range(120)
    ])
    rows = [{**x, "row": '{"key": null}'} if x["row_kind"] == "LINK" else x for x in rows]
    df, found = settled(spark, rows)
    for i in range(3):
        df.where(f"seq >= {40 * i} and seq < {40 * i + 40}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = crosswalk.stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), RULES)
    with streams.rocksdb(spark):
        streams.run_once(lambda: out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start())
    assert sorted(map(str, spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect())) == sorted(map(str, found.collect()))


class _State:
    """A stand-in for value, list and map states."""

    def __init__(self):
        self.now = {}

    def exists(self):
        return bool(self.now)

    def get(self):
        return self.now["v"] if "v" in self.now else iter(self.now.get("l", []))

    def update(self, v):
        self.now = {"v": v}

    def put(self, rows):
        self.now = {"l": rows}

    def clear(self):
        self.now = {}

    def keys(self):
        return iter(list(self.now))

    def iterator(self):
        return iter(list(self.now.items()))

    def updateValue(self, k, v):  # noqa: N802
        self.now[k] = v

    def removeKey(self, k):  # noqa: N802
        del self.now[k]


def test_what_nothing_answers_leaves_by_a_timer():
    timers, clock = [], [5_000]

    class Handle:
        getValueState = getListState = getMapState = staticmethod(lambda *_: _State())  # noqa: N815
        registerTimer = staticmethod(timers.append)  # noqa: N815

    times = type("T", (), {"getCurrentProcessingTimeInMs": lambda self: clock[0]})()
    of = golden._Merging(RULES.entity, True)
    of.init(Handle)
    row = pd.DataFrame([{"seq": 1, "system": "crm", "row_kind": "INSERT", "source_ms": 10, "row": '{"name": "Ada", "city": "Rome"}', "unmapped": None}])
    assert [x.outcome.tolist() for x in of.handleInputRows(("1",), iter([row]), times)] == [["created"]]
    assert timers == [5_000 + HOUR] and {a[1] for a in of.load().awaited} == {"name", "city"}
    clock[0] += HOUR
    assert all(x.empty for x in of.handleExpiredTimer(("1",), times, None)) and of.load().awaited == [] and of.load().values["name"] == "Ada"
