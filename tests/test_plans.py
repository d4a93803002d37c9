"""Contracts, rules, checks, scores, results and flows on small rows of our own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import expressions, rules
from ledgerlark.plans import checks, flows, results, scoring
from ledgerlark.sources import contracts, relations

YAML = """
id: shop.order
domain: sales
slaProperties: [{property: minScore, value: 0.8}, {property: frequency, value: 2, unit: d}]
customProperties: [{property: windowPredicate, value: "{col} >= {day}"}, {property: derivedFrom, value: shop.raw}]
schema:
  - name: orders
    properties:
      - {name: id, physicalType: bigint, primaryKey: true, required: true, unique: true}
      - {name: amount, physicalType: "numeric(12,2)"}
      - {name: mail, physicalType: text, classification: pii}
      - {name: customer, physicalType: int, relationships: [{type: foreignKey, to: customers.id}]}
    quality:
      - {type: sql, description: no debts, query: select count(*) from orders where amount < 0, mustBe: 0, dimension: accuracy}
      - {type: sql, description: broken, query: select count(*) from orders where nothing < 0, dimension: accuracy}
      - {type: sql, description: elsewhere, query: select 1, engine: sqlserver}
"""


@pytest.fixture
def contract(tmp_path):
    (tmp_path / "b.odcs.yaml").write_text(YAML)
    (tmp_path / "a.odcs.yaml").write_text("id: first\n")
    found = contracts.load_all(tmp_path)
    assert [c.id for c in found] == ["first", "shop.order"] and found[0].floor == 0.95
    return found[1]


def test_contract(contract):
    m = contract.model("orders")
    assert contract.floor == 0.8 and contract.derived_from == ("shop.raw",) and m.keys == ("id",) and m.classified == ("mail",)
    assert m.schema().simpleString() == "struct<id:bigint,amount:decimal(12,2),mail:string,customer:int>"
    assert m.properties[3].references == ("customers.id",)
    with pytest.raises(ValueError):
        contracts.parse({"name": "no id"})


def test_contract_run(contract, spark):
    rows = [(1, 5, "a", 1, dt.date(2024, 1, 1)), (1, -1, "b", 1, dt.date(2024, 1, 2)), (None, 7, None, 2, dt.date(2024, 1, 2))]
    df = spark.createDataFrame(rows, "id bigint, amount int, mail string, customer int, loaded_at date")
    got = {r.check_id: r for r in checks.run(contract, lambda _: df, "2024-01-02").collect()}
    assert got["shop.order.orders.id.field_required"].failed_rows == 1 and got["shop.order.orders.id.field_required"].total_rows == 2
    assert got["shop.order.orders.id.field_unique"].failed_rows == 2 and got["shop.order.orders.id.field_unique"].total_rows == 3
    assert got["shop.order.orders.field_primary_key"].failed_rows == 3
    assert got["shop.order.orders.no debts"].failed_rows == 1
    assert got["shop.order.orders.broken"].status == "error" and "nothing" in got["shop.order.orders.broken"].reason
    assert not any("elsewhere" in k for k in got)


def test_missing_window_is_one_error(contract, spark):
    got = checks.run(contract, relations.resolver(spark, {"type": "parquet", "path": "/tmp/nowhere-at-all"}), "2024-01-02").collect()
    assert [r.status for r in got] == ["error"] and got[0].check_type == "general"


def test_windows(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),), (dt.date(2024, 1, 3),)], "loaded_at date")
    n = lambda *a: relations.windowed(df, "loaded_at", "2024-01-02", *a).count()
    assert (n(), n("cumulative"), n("incremental", "{col} > {day}")) == (1, 2, 1)
    assert relations.windowed(df, "other", "2024-01-02").count() == 3
    with pytest.raises(ValueError):
        n("sideways")
    with pytest.raises(LookupError, match="parquet"):
        relations.engine("abacus")


def test_window_reaches_the_scan(spark):
    plan = relations.windowed(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_orderdate", "1998-03-02")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_a_null_breaks_no_rule_but_not_null(spark):
    df = spark.createDataFrame([(None, None, None)], "n int, s string, d date")
    made = {
        "accepted_values": ("s", {"values": ["a"]}), "between": ("n", {"min": 1, "max": 2}), "not_negative": ("n", {}), "max_length": ("s", {"length": 1}), "matches": ("s", {"pattern": "a%"}), "not_in_the_future": ("d", {}), "not_null": ("n", {})
    }
    for kind, (column, params) in made.items():
        assert df.where(rules.predicate(kind, column, params)).count() == (kind == "not_null")


@pytest.mark.parametrize("kind,params", [("accepted_values", {"values": [""]}), ("between", {"min": 1}), ("max_length", {}), ("matches", {}), ("nonsense", {})])
def test_refused_rules(spark, kind, params):
    with pytest.raises(ValueError):
        rules.predicate(kind, "c", params)


def test_rule_plugins(spark):
    even = rules.RuleKind("even", lambda c, p: c % p["by"] != 0, "accuracy", "{column} must divide by {by}", {"by": "number"})
    try:
        rules.register(even)
        assert spark.range(5).where(rules.predicate("even", "id", {"by": 2})).count() == 2 and rules.describe("even", "id", {"by": 2}) == "id must divide by 2"
        for bad in (even, rules.RuleKind("x", even.build, "beauty", "", {}), rules.RuleKind("x", even.build, "accuracy", "{by}", {}), rules.RuleKind("x", even.build, "accuracy", "", {"by": "colour"})):
            with pytest.raises(ValueError):
                rules.register(bad)
    finally:
        rules.KINDS.pop("even", None)
    assert rules.discover() == []


def test_fused_checks_scan_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    made = [checks.rule("not_null", "orders", "o_custkey", key="a"), checks.rule("not_negative", "orders", "o_totalprice", key="b"), checks.rule("accepted_values", "orders", "o_orderstatus", {"values": ["O"]}, key="c")]
    plan = checks._part(made, {"orders": df})._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("FileScan") == 1


def _results(spark, rows):
    return spark.createDataFrame([(dt.date(2024, 1, day), f"c.{k}", "c", dim, status, 1, 10, ratio, "incremental", k) for day, k, dim, status, ratio in rows], "run_at date, check_id string, contract_id string, dimension string, status string, failed_rows long, total_rows long, fail_ratio double, run_window string, name string")


@pytest.mark.parametrize(
    "rows,score",
    [
        ([(1, "a", "accuracy", "pass", 0.0)], 1.0), ([(1, "a", "accuracy", "error", 0.0)], 1.0), ([(1, "a", "accuracy", "fail", 0.000001)], 0.4), ([(1, "a", "x", "pass", 0.0), (1, "b", None, "fail", 1.0)], 0.75),
        ([(1, "a", "uniqueness", "fail", 0.5), (1, "b", "accuracy", "pass", 0.0)], 0.5), ([(1, "a", "accuracy", "fail", 2.0)], -0.4),
    ],
)
def test_score(spark, rows, score):
    assert scoring.score(_results(spark, rows)).first().score == pytest.approx(score)


def test_series(spark):
    rows = [(1, "a", "accuracy", "pass", 0.0), (2, "a", "accuracy", "fail", 0.1), (3, "a", "accuracy", "error", 0.0), (4, "a", "accuracy", "fail", 0.1), (4, "b", "accuracy", "fail", 0.1), (4, "d", "accuracy", "fail", 0.1)]
    df, status = _results(spark, rows), spark.createDataFrame([("c.d", "accepted")], "check_id string, state string")
    assert {(r.check_id, r.since.day) for r in scoring.failing_since(df).collect()} == {("c.a", 2), ("c.b", 4), ("c.d", 4)}
    assert {r.check_id for r in scoring.newly_failing_vs_previous(df, status).collect()} == {"c.a", "c.b"}
    k = scoring.kpis(df, scoring.with_sla(scoring.score(df), spark.createDataFrame([], "contract_id string, sla_min double")), status).first()
    assert (k.contracts, k.at_sla, k.checks, k.failing, k.newly_failing, k.accepted) == (1, 0, 3, 3, 1, 1)
    assert {r.bucket: r.n for r in scoring.aging(df, status).collect()} == {"week": 1, "new": 1}
    assert [scoring.message("2024-01-04", 1, df.limit(0), df.limit(0))] == [None]
    new = spark.createDataFrame([("c", str(i)) for i in range(5)], "contract_id string, name string")
    assert "Newly failing in c: 0, 1, 2 (+2 more)" in scoring.message("2024-01-04", 1, df.limit(0), new, ["x"])


def test_result_store(spark, tmp_path):
    store = results.ResultStore(spark, f"file://{tmp_path}")
    store.replace_day("r", _results(spark, [(1, "a", "accuracy", "pass", 0.0), (1, "gone", "accuracy", "pass", 0.0)]))
    store.replace_day("r", _results(spark, [(2, "a", "accuracy", "pass", 0.0)]))
    store.replace_day("r", _results(spark, [(1, "a", "accuracy", "fail", 0.0)]))
    got = store.read("r")
    assert {(r.run_at.day, r.check_id, r.status) for r in got.collect()} == {(1, "c.a", "fail"), (2, "c.a", "pass")}
    assert "PartitionFilters: [isnotnull(run_month" in got.where("run_month = '2024-01'")._jdf.queryExecution().executedPlan().toString()
    store.append("log", spark.createDataFrame([("a", 1), ("a", 2)], "k string, at int"))
    store.append("log", spark.createDataFrame([("a", 3), ("b", 1)], "k string, at int"))
    assert {(r.k, r.at) for r in store.last_word("log", ["k"], "at").collect()} == {("a", 3), ("b", 1)}
    store.prune("log", "at", 2)
    assert store.read("log").count() == 2


def test_expressions(spark):
    v = lambda f, s: spark.createDataFrame([(s,)], "s string").select(f(F.col("s"))).first()[0]
    assert v(expressions.is_citizen_number, "10000000146") and not v(expressions.is_citizen_number, "10000000147") and not v(expressions.is_citizen_number, "0000")
    valid = [f"123456789{c}" for c in range(10) if v(expressions.is_tax_number, f"123456789{c}")]
    assert len(valid) == 1
    assert v(expressions.root_cause, "plain\nline") == "plain" and expressions.phrase("SLA missed", "tr") != expressions.phrase("SLA missed")
    assert spark.range(1).select(expressions.period_days(F.lit("2"), F.lit("w"))).first()[0] == 14


# --- flows


def _model(name, *columns, key=(), required=(), classified=()):
    return contracts.Model(name, tuple(contracts.Property(c, "text", c in required, False, c in key, "pii" if c in classified else None) for c in columns))


SOURCE, TARGET = _model("account", "code", "kind", "title", "active", key=("code", "kind"), classified=("title",)), _model("customer", "id", "name", "on", key=("id",), required=("name",))


def _flow(**kw):
    return flows.Flow(**({"id": "f", "source": "crm.account", "target": "hub.customer", "columns": {"id": "code", "name": "title"}} | kw))


@pytest.mark.parametrize(
    "found,words",
    [
        (lambda: flows.mapping_problems(_flow(values={"on": {"Y": True}}), SOURCE, TARGET), "no source column"), (lambda: flows.mapping_problems(_flow(columns={"x": "code"}), SOURCE, TARGET), "x is not a column"),
        (lambda: flows.mapping_problems(_flow(columns={"id": "x"}), SOURCE, TARGET), "x is not a column"), (lambda: flows.mapping_problems(_flow(aggregates={"id": "count(*)"}), SOURCE, TARGET), "by a column and by an aggregate"),
        (lambda: flows.mapping_problems(_flow(), SOURCE, TARGET), "classified"), (lambda: flows.gaps(_flow(columns={"id": "code"}), TARGET), "nothing fills name"),
        (lambda: flows.job_problems(_flow(job={"speed": 1})), "no job setting"), (lambda: flows.job_problems(_flow(job={"pollSeconds": 0})), "between"), (lambda: flows.job_problems(_flow(job={"pollSeconds": "x"})), "whole number"),
        (lambda: flows.job_problems(_flow(job={"pollSeconds": 10, "checkpointInterval": 5000})), "further apart"), (lambda: flows.match_problems(_flow(match={"x": 1}), SOURCE), "does not have"),
        (lambda: flows.match_problems(_flow(match={"active": 1}), SOURCE), "not in the key"), (lambda: flows.match_problems(_flow(match={"code": 1}, columns={}), SOURCE), "neither matched nor mapped"),
        (lambda: flows.pair_problems(_flow(), _flow(columns={"title": "name"})), "does not come back"), (lambda: flows.pair_problems(_flow(), _flow(columns={"x": "id", "title": "name"})), "comes back as"),
        (lambda: flows.pair_problems(_flow(columns={"on": "active"}, values={"on": {"Y": "1"}}), _flow(columns={"active": "on"})), "one way only"),
        (lambda: flows.pair_problems(_flow(columns={"on": "active"}, values={"on": {"Y": "1", "X": "1"}}), _flow(columns={"active": "on"}, values={"active": {"1": "Y"}})), "two values to one"),
        (lambda: flows.pair_problems(_flow(columns={"on": "active"}, values={"on": {"Y": "1"}}), _flow(columns={"active": "on"}, values={"active": {"1": "N"}})), "does not undo"),
        (lambda: flows.aggregate_problems(_flow(aggregates={"n": "median(code)"}), SOURCE), "must be one of"), (lambda: flows.aggregate_problems(_flow(aggregates={"n": "sum(*)"}), SOURCE), "only count"),
        (lambda: flows.aggregate_problems(_flow(aggregates={"n": "sum(x)"}), SOURCE), "not a column"), (lambda: flows.aggregate_problems(_flow(aggregates={"n": "count(*)"}), SOURCE, True), "hub takes no"),
        (lambda: flows.aggregate_problems(_flow(aggregates={"n": "count(*)"}, columns={}), SOURCE), "grouped by"), (lambda: flows.aggregate_problems(_flow(aggregates={"n": "count(*)"}), _model("x", "code")), "has no key"),
        (lambda: flows.aggregate_problems(_flow(aggregates={"n": "count(*)"}, values={"id": {}}), SOURCE), "no value maps"), (lambda: flows.link_problems(_flow(), TARGET, {"billing": "b"}), "no code column"),
        (lambda: flows.link_problems(_flow(), TARGET, {"crm": "c"}), "is not filled"), (lambda: flows.link_problems(_flow(link_by=("on",)), TARGET, {}), "does not carry"), (lambda: flows.link_problems(_flow(link_by=("id",)), TARGET, {}), "is a key"),
        (lambda: flows.link_problems(_flow(filled_by_target=("id",)), TARGET, {}), "by the target"), (lambda: flows.replication_problems(_model("t", "a"), ["a"]), "without a key"), (lambda: flows.replication_problems(SOURCE, ["code"]), "lacks the key column kind"),
        (lambda: flows.replication_problems(SOURCE, ["code", "kind", "x"]), "x is not a column"), (lambda: flows.replication_problems(SOURCE, ["code", "kind"], ["active"]), "not in the key"), (lambda: flows.replication_problems(SOURCE, ["code", "kind"], (), True, ["code"]), "generated and copied"),
        (lambda: flows.view_problems(SOURCE, ["title"], "parquet"), "would be shown"), (lambda: flows.view_problems(SOURCE, ["x"], "abacus"), "cannot be shown"), (lambda: flows.view_problems(SOURCE, ["x"], "view"), "is not a column"),
    ],
)
def test_refusals(found, words):
    assert any(words in s for s in found())


def test_sets_of_flows_are_refused_as_a_whole():
    hub = contracts.Contract("hub.customer", models=(TARGET,), custom={"hub": {"keys": {"crm": "id"}}})
    crm = contracts.Contract("crm.account", models=(SOURCE,))
    said = flows.problems([_flow(match={"kind": "A"}), _flow(id="g", source="nowhere.t")], [hub, crm])
    assert any("no contract describes nowhere.t" in s for s in said) and any("no table is the authority" in s for s in said)
    fed = contracts.Contract("hub.customer", models=(TARGET,), custom={"hub": {"authority": "crm.account", "keys": {"crm": "id"}}})
    plain = contracts.Contract("crm.account", models=(_model("account", "code", "title", key=("code",)),))
    back = flows.Flow("b", "hub.customer", "crm.account", {"code": "id", "title": "name"})
    assert flows.problems([_flow(), back], [fed, plain]) == []
    api = contracts.Contract("loyalty.member", models=(_model("member", "n"),), servers=({"type": "api"},))
    assert any("does not say its contentField" in s for s in flows.api_problems(_flow(), api, plain)) and any("nothing can be written" in s for s in flows.api_problems(_flow(), plain, api))
    assert flows.unresolved([contracts.Contract("a", custom={"derivedFrom": ["b", "//c", "a"]})]) == ["a: is derived from b, which nobody knows"]


def test_flow_files(tmp_path, spark):
    (tmp_path / "f.yaml").write_text("id: f\nfrom: crm.account\nto: hub.customer\nmatch: {kind: INV}\ncolumns: {id: code, live: active}\nvalues: {live: {Y: true, N: false}}\n")
    flow = flows.load_all(tmp_path)[0]
    rows = spark.createDataFrame([(1, "INV", "Y"), (2, "INV", "?"), (3, "INV", None), (4, "SHP", "Y")], "code int, kind string, active string")
    assert [tuple(r) for r in flows.translate(rows, flow).orderBy("id").collect()] == [(1, True, []), (2, None, ["live"]), (3, None, [])]
    assert [tuple(r) for r in flows.back(flows.translate(rows, flow), flow).orderBy("code").collect()] == [(1, "Y", "INV"), (2, None, "INV"), (3, None, "INV")]


def test_drift_and_resume(spark):
    df = spark.createDataFrame([(1,)], "code int")
    assert flows.drift(_model("t", "code", "gone"), df) == ["t: code is int, not string", "t: gone is gone"]
    assert [flows.resume(False, []), flows.resume(True, []), flows.resume(True, ["x"]), flows.resume(True, [], False)] == ["fresh", "resume", "refuse", "refuse"]


def test_identity(spark):
    df = _results(spark, [(1, "a", "uniqueness", "pass", 0.0), (2, "a", "uniqueness", "fail", 0.0)]).withColumn("check_type", F.lit("field_unique"))
    assert flows.identity_problem(df, "c").startswith("c: a failed") and flows.identity_problem(df.where("status = 'pass'"), "c") is None


def test_authored_rules(contract, tmp_path, spark):
    rule = contracts.QualityRule("no debts", "select count(*) from orders where amount < 10", "accuracy")
    assert [q.query for q in contracts.with_rule(contract, "orders", rule).model("orders").quality if q.description == "no debts"] == [rule.query]
    contracts.save_rule(tmp_path / "b.odcs.yaml", "orders", rule)
    again = contracts.load(tmp_path / "b.odcs.yaml")
    assert [q.query for q in again.model("orders").quality if q.description == "no debts"] == [rule.query] and again.floor == 0.8
    with pytest.raises(ValueError):
        contracts.save_rule(tmp_path / "b.odcs.yaml", "orders", contracts.QualityRule("x", "select 1"))
    assert relations.columns_of(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), "a > 1 and lower(b) = 'x'") == {"a", "b"}
