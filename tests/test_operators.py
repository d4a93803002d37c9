"""Versions, change logs, deliveries, totals, golden records and streams on small rows of our own."""

import datetime as dt
import json

from pyspark.sql import functions as F

from ledgerlark.operators import catalog, cdc, classify, deliver, rollup, sample, versions
from ledgerlark.plans import flows
from ledgerlark.plans.tables import BucketedTable
from ledgerlark.streaming import flows as streams
from ledgerlark.streaming import golden

DIM = "id long, seg string, valid_from date, valid_to date, is_current boolean"


def dim(spark, rows):
    d = lambda s: dt.date.fromisoformat(s) if s else None
    return spark.createDataFrame([(i, s, d(a), d(b), b is None) for i, s, a, b in rows], DIM)


def told(df):
    return sorted((r.id, r.seg, str(r.valid_from), str(r.valid_to) if r.valid_to else None) for r in df.collect())


def load(spark, dimension, rows, day):
    return versions.close_and_open(dimension, spark.createDataFrame(rows, "id long, seg string"), "id", ["seg"], day)


def test_dimension_life(spark):
    d = load(spark, dim(spark, []), [(1, "A"), (2, None)], "2024-01-01")
    assert told(d) == [(1, "A", "0001-01-01", None), (2, None, "0001-01-01", None)]
    assert told(load(spark, d, [(1, "A"), (2, None)], "2024-01-02")) == told(d)
    d = load(spark, d, [(1, "B")], "2024-01-03")
    assert told(d) == [(1, "A", "0001-01-01", "2024-01-03"), (1, "B", "2024-01-03", None), (2, None, "0001-01-01", None)]
    d = load(spark, d, [(1, "C")], "2024-01-03")  # on the same day: no version of zero length
    assert told(d)[:2] == [(1, "A", "0001-01-01", "2024-01-03"), (1, "C", "2024-01-03", None)]
    d = load(spark, load(spark, d, [(1, "D")], "2024-01-05"), [(1, None)], "2024-01-07")
    assert versions.overlaps(d, "id").count() == 0
    facts = spark.createDataFrame([(1, dt.date(1999, 1, 1)), (1, dt.date(2024, 1, 4)), (1, dt.date(2024, 1, 5)), (9, dt.date(2024, 1, 5))], "id long, day date")
    assert [r.seg for r in versions.as_of(facts, d, "id", "day", ["seg"]).orderBy("id", "day").collect()] == ["A", "C", "D", None]
    assert [r.changed for r in versions.diff(d.where("id = 1"), "id", ["seg"]).orderBy("valid_from").collect()] == [[], ["seg"], ["seg"], ["seg"]]


def test_change_log(spark):
    rows = [(2, 1, 1, "TR"), (3, 2, 1, "TR"), (4, 3, 1, "DE"), (2, 4, 2, "TR"), (3, 5, 2, "TR"), (4, 6, 7, "TR"), (2, 8, 3, None), (1, 9, 4, "TR")]
    log = spark.createDataFrame(rows, "op int, seq long, id long, country string")
    todo = cdc.intents(log, ["id"], ["seq"], "country = 'TR'")
    assert [(r.seq, r.part, r.action, r._key.id) for r in todo.orderBy("seq", "part").collect()] == [(1, 1, "upsert", 1), (3, 1, "delete", 1), (4, 1, "upsert", 2), (6, 0, "delete", 2), (6, 1, "upsert", 7), (8, 1, "delete", 3), (9, 1, "delete", 4)]
    target = spark.createDataFrame([(4, "TR"), (5, "TR")], "id long, country string")
    assert sorted(map(tuple, cdc.apply(target, todo, ["id"], ["seq"]).collect())) == [(5, "TR"), (7, "TR")]
    assert tuple(cdc.counts(target, todo, ["id"], ["seq"]).first()) == (3, 4, 1, 0, 1)
    assert [cdc.resume(None, 1, 9), cdc.resume(3, 9, 20), cdc.resume(9, 9, 9), cdc.resume(9, 9, 12)] == ["snapshot", "resnapshot", "wait", "changes"]


def test_merge_by_link(spark):
    target = spark.createDataFrame([(1, "t1", "a"), (2, "t2", "b")], "id long, tax string, name string")
    source = spark.createDataFrame([(None, "t1", "A", ",name,", True), (None, "t9", "N", "*", True), (2, "t2", "B", ",tax,", False), (5, "t5", "X", ",name,", False)], "id long, tax string, name string, _changed string, _link boolean")
    got = deliver.merge(target, source, ["id"], ["tax", "name"], link_by=["tax"])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "t1", "A", "update"), (2, "t2", "b", None), (None, "t9", "N", "insert")]))


def test_split_and_touched(spark):
    df = spark.createDataFrame([("a", None, ",city,"), (None, None, "*"), ("b", "c", ",name,")], "city string, zip string, _changed string")
    some, none = deliver.split_matches(df, ["city", "zip"])
    assert (some.count(), none.count(), df.where(deliver.touched("city")).count()) == (2, 1, 2)


def test_totals_follow_a_line_that_moves(spark):
    lines = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "b", 1)], "id long, g string, x long")
    changes = spark.createDataFrame([(3, "a", 1, "upsert", 1), (2, "a", 9, "upsert", 1), (2, "a", 7, "upsert", 2)], "id long, g string, x long, op string, seq long")
    after, touched = rollup.apply_changes(lines, changes, ["id"])
    before = rollup.totals(lines, {"k": "g"}, {"s": "sum(x)", "n": "count(*)"})
    got = rollup.recompute(after, touched, before, {"k": "g"}, {"s": "sum(x)", "n": "count(*)"})
    assert sorted(map(str, map(tuple, got.collect()))) == ["('a', 13, 3, 'update')", "('b', None, None, 'delete')"]


def test_masks(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, mail string")
    assert [r.mail for r in sample.masked(df, ["mail"]).orderBy("id").collect()] == [None, "•••"]
    assert [r.mail for r in sample.failing_rows(df, F.col("id") > 0, "id", ["mail"]).collect()] == ["•••", "•••"]
    assert sample.why_not("unique", True) and sample.why_not("sql", False) and not sample.why_not("between", True)


def test_kinds(spark):
    values = ["a@b.example.com", "10.1.2.3", "4111111111111111", "+90 212 555 00 11", "TR330006100519786457841326", "10000000146", "hello", "4111111111111112"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(classify.kind_of(F.col("v"))).collect()]
    assert got == ["EMAIL_ADDRESS", "IP_ADDRESS", "CREDIT_CARD", "PHONE_NUMBER", "IBAN_CODE", "TR_NATIONAL_ID", None, None]


# --- golden records

E = golden.Entity(("name", "city"), {"crm": ("name",), "billing": None, "shop": ("name", "city")}, "crm", ("name",))


def play(*rows):
    g, out = golden.Golden(), []
    for system, kind, ms, row in rows:
        out.append(golden.decide(g, E, system, kind, ms, row))
    return g, [o for o, _ in out], [c for _, log in out for c in log]


def test_create_and_echo():
    g, out, log = play(("crm", "INSERT", 1, {"name": "A"}), ("billing", "INSERT", 2, {"name": "A", "city": None}), ("shop", "INSERT", 3, {"name": "A"}))
    assert out == ["created", "echo", "echo"] and g.values == {"name": "A", "city": None} and not log


def test_later_edit_wins_and_the_earlier_is_logged():
    g, out, log = play(("crm", "INSERT", 10, {"name": "A"}), ("billing", "UPDATE_AFTER", 30, {"name": "B"}), ("shop", "UPDATE_AFTER", 20, {"name": "C"}))
    assert out == ["created", "applied", "lost"] and g.values["name"] == "B" and g.skip is None and g.changed == ",name,"
    assert [c[-1] for c in log] == ["edit", "edit"]


def test_an_edit_of_the_current_value_wins_quietly():
    g, out, log = play(("crm", "INSERT", 10, {"name": "A"}), ("billing", "UPDATE_BEFORE", 5, {"name": "A"}), ("billing", "UPDATE_AFTER", 5, {"name": "B"}))
    assert out == ["created", "before", "applied"] and g.values["name"] == "B" and not log


def test_ties_go_to_the_greater_system():
    g, out, _ = play(("crm", "INSERT", 10, {"name": "A"}), ("billing", "UPDATE_AFTER", 10, {"name": "B"}), ("shop", "UPDATE_AFTER", 10, {"name": "C"}))
    assert out == ["created", "lost", "applied"] and g.values["name"] == "C"


def test_at_the_first_sync_the_authority_stands():
    g, out, log = play(("billing", "INSERT", 50, {"name": "B", "city": "X"}), ("crm", "INSERT", 10, {"name": "A"}))
    assert out == ["created", "applied"] and g.values["name"] == "A" and [c[-1] for c in log] == ["seed"]
    g, out, log = play(("crm", "INSERT", 10, {"name": "A"}), ("billing", "INSERT", 50, {"name": "B", "city": "X"}))
    assert out[1] == "applied" and g.values == {"name": "A", "city": "X"} and [c[-1] for c in log] == ["seed"]


def test_delete_tombstone_and_resurrection():
    g, out, _ = play(("crm", "INSERT", 10, {"name": "A"}), ("shop", "DELETE", 20, {"name": "A"}), ("billing", "DELETE", 21, {"name": "A"}), ("crm", "INSERT", 15, {"name": "A2"}), ("crm", "INSERT", 30, {"name": "A3"}))
    assert out == ["created", "deleted", "echo", "lost", "created"] and g.values["name"] == "A3"


def test_a_delete_older_than_the_record_loses():
    g, out, log = play(("crm", "INSERT", 10, {"name": "A"}), ("shop", "DELETE", 5, {"name": "A"}))
    assert out == ["created", "lost"] and g.changed == "*" and g.skip is None and log[0][0] == "*"


def test_a_row_without_what_a_record_needs_is_emptied_not_deleted():
    part = golden.Entity(("name", "city"), {"crm": ("name",), "addr": ("city",)}, "crm", ("name",))
    g = golden.Golden()
    golden.decide(g, part, "crm", "INSERT", 1, {"name": "A"})
    golden.decide(g, part, "addr", "INSERT", 2, {"city": "X"})
    assert golden.decide(g, part, "addr", "DELETE", 3, {"city": "X"})[0] == "applied" and g.values == {"name": "A", "city": None}


def test_polls_and_unmapped_values():
    g, out, _ = play(("crm", "INSERT", 1, {"name": "A"}), ("shop", "POLL", 2, {"name": "A", "city": "X"}), ("shop", "POLL", 3, {"name": "A", "city": "X"}), ("shop", "POLL", 4, {"name": "A", "city": "Y"}))
    assert out == ["created", "applied", "unchanged", "applied"] and g.values["city"] == "Y"
    outcome, log = golden.decide(g, E, "billing", "UPDATE_AFTER", 9, {"name": "Z", "city": None}, ["city"])
    assert outcome == "applied" and g.values == {"name": "Z", "city": "Y"} and "unmapped" in [c[-1] for c in log]


def test_expectations_expire():
    g, out, _ = play(("crm", "INSERT", 1, {"name": "A"}), ("shop", "UPDATE_AFTER", 2 + golden.EXPECT_MS, {"name": "A"}))
    assert out[1] == "unchanged" and not g.awaited


def _inbox(spark):
    rows = [("k1", 1, "crm", "INSERT", 1, {"name": "A"}), ("k1", 2, "shop", "UPDATE_AFTER", 5, {"name": "B"}), ("k2", 3, "crm", "INSERT", 1, {"name": "C"}), ("k2", 4, "crm", "DELETE", 9, {"name": "C"})]
    return spark.createDataFrame([(k, n, s, kind, ms, json.dumps(r), None) for k, n, s, kind, ms, r in rows], "key string, seq long, system string, row_kind string, source_ms long, row string, unmapped string")


def test_stream_and_replay_agree(spark, tmp_path):
    inbox, folder = _inbox(spark), f"file://{tmp_path}/inbox"
    batch = golden.replay(inbox, E)
    assert [(r.key, r.record) for r in golden.golden_records(batch).collect()] == [("k1", '{"city": null, "name": "B"}')]
    assert golden.conflicts(batch).first().reason == "edit"
    inbox.where("seq <= 1").coalesce(1).write.mode("append").parquet(folder)
    out = golden.stream(spark.readStream.schema(inbox.schema).parquet(folder), E)
    run = lambda: out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    with streams.rocksdb(spark):
        run()
        inbox.where("seq > 1").coalesce(1).write.mode("append").parquet(folder)
        run()
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def test_flow_streams(spark, tmp_path):
    at = f"file://{tmp_path}"
    flow = flows.parse({"id": "f", "from": "crm.account", "to": "hub.customer", "columns": {"id": "code", "name": "title"}, "job": {"checkpointInterval": 5000}})
    rows = spark.createDataFrame([(1, "a", "INSERT", 5)], "code int, title string, row_kind string, source_ms long")
    rows.write.parquet(f"{at}/src")
    streams.run_once(lambda: streams.into_inbox(spark.readStream.schema(rows.schema).parquet(f"{at}/src"), flow, f"{at}/inbox", f"{at}/c1", once=True))
    assert [(r.system, r.fields, r["name"]) for r in spark.read.parquet(f"{at}/inbox").collect()] == [("crm", "id,name", "a")]
    assert streams.trigger(flow) == {"processingTime": "5000 milliseconds"}

    target = BucketedTable.create(spark.createDataFrame([(1, "old"), (3, "gone")], "id int, name string"), f"{at}/target", ["id"], 4)
    rev = spark.createDataFrame([(1, "x", 1, ",name,", None, False), (1, "new", 2, ",name,", None, False), (2, "two", 0, "*", "crm", False), (4, "mine", 0, "*", "shop", False), (3, None, 5, "*", None, True)], "id int, name string, rev long, _changed string, _skip string, deleted boolean")
    rev.write.parquet(f"{at}/rev")
    streams.run_once(lambda: streams.out_to_table(spark.readStream.schema(rev.schema).parquet(f"{at}/rev"), target, "shop", ["name"], f"{at}/c2", once=True))
    assert sorted(map(tuple, target.read().collect())) == [(1, "new"), (2, "two")]

    lines = BucketedTable.create(spark.createDataFrame([(1, "a", 5), (2, "a", 7)], "id long, g string, x long"), f"{at}/lines", ["id"], 4)
    totals = BucketedTable.create(rollup.states(lines.read(), {"k": "g"}, {"s": "sum(x)"}), f"{at}/totals", ["k"], 4)
    ch = spark.createDataFrame([(2, "b", 7, "upsert", 1)], "id long, g string, x long, op string, seq long")
    ch.write.parquet(f"{at}/ch")
    streams.run_once(lambda: streams.keep_totals(spark.readStream.schema(ch.schema).parquet(f"{at}/ch"), lines, totals, {"k": "g"}, {"s": "sum(x)"}, f"{at}/c3", once=True))
    assert sorted(map(tuple, rollup.shown(totals.read(), {"k": "g"}, {"s": "sum(x)"}).collect())) == [("a", 5), ("b", 7)]
    assert streams.problems(spark) == []
    statuses = spark.createDataFrame([("a", ["t"], False, None), ("b", [], False, None), ("c", None, None, False), ("d", None, None, None)], "contract string, copying array<string>, streaming boolean, reachable boolean")
    assert [(r.contract, r.problem.split()[0]) for r in streams.replication_problems(statuses).collect()] == [("a", "t"), ("b", "the"), ("c", "the")]


def test_lineage_of_a_long_chain_is_whole(spark):
    edges = spark.createDataFrame([(f"t{i}", f"t{i + 1}", "derived") for i in range(8)] + [("a", "b", "derived"), ("b", "a", "derived")], catalog.EDGE)
    got = catalog.downstream(edges)
    assert got.where("origin like 't%'").count() == 36 and got.agg({"steps": "max"}).first()[0] == 8


def test_merge_by_link_loses_no_row_with_a_key(spark):
    target = spark.createDataFrame([(1, "x", "old"), (5, "y", "old")], "k int, link string, v string")
    told = spark.createDataFrame([(5, "x", "by key", ",v,", False), (None, "x", "by link", ",v,", True), (None, "x", "may not", ",v,", False)], "k int, link string, v string, _changed string, _link boolean")
    got = {r.k: (r.v, r._action) for r in deliver.merge(target, told, ["k"], ["v", "link"], link_by=["link"]).collect()}
    assert got == {1: ("by link", "update"), 5: ("by key", "update")}


def test_versions_inside_a_longer_one_overlap(spark):
    day = "valid_from date, valid_to date"
    rows = spark.createDataFrame([("a", *map(dt.date.fromisoformat, x)) for x in (("2024-01-01", "2024-12-01"), ("2024-02-01", "2024-03-01"), ("2024-06-01", "2024-07-01"), ("2024-12-01", "2025-01-01"))], f"k string, {day}")
    assert {r.valid_from.month for r in versions.overlaps(rows, "k").collect()} == {2, 6}


def test_spans_against_brute_force(spark):
    import random
    import re

    r = random.Random(8)
    parts = ["a@b.example", "x.y@z.co", "10.0.0.1", "999.1.1.1", "+90 (532) 123 45 67", "1234567", "4000000000000002", "4000 0000 0000 0002", "4000000000000003", "GB82WEST12345698765432", "GB82WEST12345698765433", "10000000146", "10000000147", "1234567890", "word", "1.2.3.4.5", "é@ü.de", "c@10.0.0.1.com", ""]
    texts = [None, "", *[" ".join(r.choices(parts, k=6)) for _ in range(40)], *["".join(r.choices(parts, k=3)) for _ in range(20)]]
    luhn = lambda s: sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(re.sub(r"\D", "", s)[::-1])) % 10 == 0
    iban = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    citizen = lambda s: (sum(map(int, s[0:9:2])) * 7 - sum(map(int, s[1:8:2]))) % 10 == int(s[9]) and sum(map(int, s[:10])) % 10 == int(s[10])

    def vkn(s):
        total = 0
        for j, c in enumerate(s[:9], 1):
            t = (int(c) + 10 - j) % 10
            total += 9 if t == 9 else t * 2 ** (10 - j) % 9
        return (10 - total % 10) % 10 == int(s[9])

    right = {"CREDIT_CARD": luhn, "IBAN_CODE": iban, "TR_NATIONAL_ID": citizen, "TR_VKN": vkn, "PHONE_NUMBER": lambda s: 7 <= len(re.sub(r"\D", "", s)) <= 15 and not s.isdigit()}

    def by_hand(text):
        every = [(m.start(), m.end(), k, score, m[0]) for k, (p, score) in classify.PATTERNS.items() for m in re.finditer(p, text or "", re.A) if right.get(k, lambda _: True)(m[0])]
        rank = lambda s: (-s[3], s[0] - s[1], s[0], s[2])
        return sorted(s for s in every if not any(s[0] < t[1] and t[0] < s[1] and rank(t) < rank(s) for t in every))

    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", classify.spans(F.col("text")).alias("s")).collect()
    for row in rows:
        assert [tuple(s) for s in row.s or []] == by_hand(texts[row.id]), texts[row.id]
    values = spark.createDataFrame([("t", "note", "mail a@b.example now"), ("t", "note", "tel +90 532 123 45 67"), ("t", "note", "from 10.0.0.1"), ("t", "note", "card 4000000000000002"), ("t", "note", "nothing"), ("t", "note", None)], "table_name string, column_name string, value string")
    assert sorted((x.kind, x.share, x.classified) for x in classify.text_shares(values).collect()) == [("CREDIT_CARD", 0.2, True), ("EMAIL_ADDRESS", 0.2, True), ("IP_ADDRESS", 0.2, True), ("PHONE_NUMBER", 0.2, True)]


def test_a_database_is_read_in_parts_and_filters_there(spark):
    from ledgerlark import queries_plans
    from ledgerlark.sources import relations

    server = queries_plans._database(spark, "/root/testdata/sf0.001")
    orders = relations.resolver(spark, server)("orders")
    whole = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert orders.rdd.getNumPartitions() == 4 and orders.count() == whole.count()
    day = relations.windowed(orders, "o_orderdate", "1998-03-01")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(o_orderdate" in plan
    spark.range(0).withColumnRenamed("id", "k").write.format("jdbc").options(url=server["url"], dbtable="empty").save()
    assert relations.resolver(spark, server | {"options": {"partitionColumn": "k"}})("empty").count() == 0
