"""Every operator of the engine as a query over the driver's tables, with the same rows in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlark.functions import expressions, rules
from ledgerlark.operators import agreement, catalog, cdc, classify, deliver, profile, rollup, sample, versions
from ledgerlark.plans import checks, flows, scoring
from ledgerlark.plans.results import ResultStore
from ledgerlark.plans.tables import BucketedTable
from ledgerlark.sources import contracts, relations
from ledgerlark.streaming import flows as streams
from ledgerlark.streaming import golden

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


DAY, ARRIVAL = "1998-03-02", "o_orderdate"
MONEY = "decimal(18,2)"

# --- rules: one row each, failed and total


def _rule(spark: SparkSession, d: str, table: str, kind: str, column: str, params: dict | None = None) -> DataFrame:
    tables = {n: _t(spark, d, n) for n in {table, *([params["table"]] if params and "table" in params else [])}}
    return checks.measure([checks.rule(kind, table, column, params, key=kind)], tables).select("key", "failed", "total")


def _rule_sql(kind: str, table: str, where: str) -> str:
    return f"SELECT '{kind}' AS key, count(*) FILTER (WHERE {where}) AS failed, count(*) AS total FROM {table}"


@query(_rule_sql("not_null", "orders", "o_custkey IS NULL"))
def rule_not_null(spark, d):
    return _rule(spark, d, "orders", "not_null", "o_custkey")


@query(_rule_sql("accepted_values", "orders", "NOT (o_orderstatus IN ('O', 'F'))"))
def rule_accepted_values(spark, d):
    return _rule(spark, d, "orders", "accepted_values", "o_orderstatus", {"values": ["O", "F", " "]})


@query(_rule_sql("between", "lineitem", "NOT (l_quantity BETWEEN 5 AND 45)"))
def rule_between(spark, d):
    return _rule(spark, d, "lineitem", "between", "l_quantity", {"min": 5, "max": 45})


@query(_rule_sql("not_negative", "customer", "c_acctbal < 0"))
def rule_not_negative(spark, d):
    return _rule(spark, d, "customer", "not_negative", "c_acctbal")


@query(_rule_sql("max_length", "part", "length(p_name) > 9"))
def rule_max_length(spark, d):
    return _rule(spark, d, "part", "max_length", "p_name", {"length": 9})


@query(_rule_sql("matches", "part", "NOT (p_brand LIKE 'Brand#1%')"))
def rule_matches(spark, d):
    return _rule(spark, d, "part", "matches", "p_brand", {"pattern": "Brand#1%"})


@query(_rule_sql("not_in_the_future", "orders", "o_orderdate > TIMESTAMP '1999-12-31 00:00:00'"))
def rule_not_in_the_future(spark, d):
    return _rule(spark, d, "orders", "not_in_the_future", "o_orderdate", {"as_of": "1999-12-31"})


@query("SELECT 'foreign_key' AS key, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal >= 0)) AS failed, count(*) AS total FROM orders o WHERE o_custkey IS NOT NULL")
def rule_foreign_key(spark, d):
    tables = {"orders": _t(spark, d, "orders"), "customer": _t(spark, d, "customer").where("c_acctbal >= 0")}
    return checks.measure([checks.rule("foreign_key", "orders", "o_custkey", {"table": "customer", "column": "c_custkey"}, key="foreign_key")], tables).select("key", "failed", "total")


@query("""SELECT count(*) AS failed FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS k FROM orders) o
WHERE k IS NULL OR k NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""")
def rule_foreign_key_null_counted(spark, d):
    child = _t(spark, d, "orders").select(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("k"))
    return rules.foreign_key(child, "k", _t(spark, d, "customer").where("c_acctbal >= 0"), "c_custkey", count_null=True).agg(F.count(F.lit(1)).alias("failed"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def rule_unique_groups(spark, d):
    return rules.duplicate_groups(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT count(*) AS keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def rule_unique_rows(spark, d):
    return rules.duplicates(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT count(*) AS failed FROM orders o JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS lines FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
WHERE abs(o_totalprice - lines) > 100000""")
def rule_header_equals_lines(spark, d):
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double").alias("lines"))
    both = _t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.agg(F.count_if(F.abs(F.col("o_totalprice") - F.col("lines")) > 100_000).alias("failed"))


@query("WITH n AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) SELECT day, n FROM n WHERE n < (SELECT avg(n) / 2 FROM n)")
def rule_volume_floor(spark, d):
    days = _t(spark, d, "orders").groupBy(F.col(ARRIVAL).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days.createOrReplaceTempView("order_days")
    return spark.sql("SELECT day, n FROM order_days WHERE n < (SELECT avg(n) / 2 FROM order_days)")


@query("SELECT CAST(CASE WHEN max(o_orderdate) < DATE '2002-01-01' - INTERVAL 1 DAY THEN 1 ELSE 0 END AS BIGINT) AS failed FROM orders")
def rule_freshness(spark, d):
    q = contracts.QualityRule("fresh", "SELECT CASE WHEN max(o_orderdate) < DATE'2002-01-01' - 1 THEN 1 ELSE 0 END FROM orders", "timeliness", scope="table")
    c = checks.Check("fresh", "orders", "sql", q.dimension, q.description, scope=q.scope, query=q.query)
    return checks.measure([c], {"orders": _t(spark, d, "orders")}).select("failed")


@query("""SELECT count(*) FILTER (WHERE trim(p_name) = '') AS blank, count(*) FILTER (WHERE p_size < 1 OR p_size > 40) AS out_of_range,
count(*) FILTER (WHERE p_brand LIKE '%_#_%_') AS two_digits, count(*) FILTER (WHERE p_type = 'SMALL' AND p_size > 30) AS conflicting FROM part""")
def rule_handwritten(spark, d):
    c = F.col
    return _t(spark, d, "part").agg(
        F.count_if(F.trim("p_name") == "").alias("blank"), F.count_if((c("p_size") < 1) | (c("p_size") > 40)).alias("out_of_range"),
        F.count_if(c("p_brand").like("%_#_%_")).alias("two_digits"), F.count_if((c("p_type") == "SMALL") & (c("p_size") > 30)).alias("conflicting"),
    )


@query("SELECT count(*) FILTER (WHERE abs(l_extendedprice - l_quantity * 1000) > 0.01 * l_extendedprice) AS failed FROM lineitem")
def rule_product_tolerance(spark, d):
    c = F.col
    return _t(spark, d, "lineitem").agg(F.count_if(F.abs(c("l_extendedprice") - c("l_quantity") * 1000) > 0.01 * c("l_extendedprice")).alias("failed"))


@query("""SELECT kind, dimension, CAST(weight AS INTEGER) AS weight, description, CAST(n AS INTEGER) AS n_parameters FROM (VALUES
('not_null','completeness',5,'{column} must not be empty',0), ('accepted_values','conformity',3,'{column} must be one of {values}',1), ('between','accuracy',3,'{column} must be between {min} and {max}',2),
('not_negative','accuracy',3,'{column} must not be negative',0), ('max_length','conformity',3,'{column} must be at most {length} characters',1), ('matches','conformity',3,'{column} must look like {pattern}',1),
('not_in_the_future','timeliness',5,'{column} must not be in the future',0), ('foreign_key','consistency',5,'{column} must exist in {table}.{column_ref}',2), ('unique','uniqueness',5,'{column} must have no duplicates',0)) v(kind, dimension, weight, description, n)""")
def rule_catalogue(spark, d):
    return rules.catalogue(spark).withColumn("n_parameters", F.size("parameters")).drop("parameters")


# --- windows


def _window(spark: SparkSession, d: str, mode: str, predicate: str | None = None) -> DataFrame:
    return relations.windowed(_t(spark, d, "orders"), ARRIVAL, DAY, mode, predicate).select("o_orderkey", "o_custkey", "o_orderstatus")


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '{DAY}'")
def window_incremental(spark, d):
    return _window(spark, d, "incremental")


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '{DAY}'")
def window_cumulative(spark, d):
    return _window(spark, d, "cumulative")


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderdate > DATE '{DAY}' - INTERVAL 7 DAY AND o_orderdate <= DATE '{DAY}'")
def window_custom_predicate(spark, d):
    return _window(spark, d, "incremental", "{col} > {day} - INTERVAL 7 DAY AND {col} <= {day}")


@query("SELECT 'orders' AS table_name, count(*) AS total_rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer")
def row_counts(spark, d):
    return relations.row_counts({n: _t(spark, d, n) for n in ("orders", "lineitem", "customer")})


@query("SELECT CAST(c_acctbal AS VARCHAR) AS value FROM (SELECT c_acctbal FROM customer ORDER BY c_custkey LIMIT 200)")
def column_sample(spark, d):
    return relations.column_sample(_t(spark, d, "customer"), "c_acctbal", "c_custkey")


@query("SELECT CAST(g AS DATE) AS day FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) t(g) WHERE CAST(g AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)")
def missing_days(spark, d):
    return relations.missing_days(_t(spark, d, "orders"), ARRIVAL, "1995-01-01", "2001-12-31")


@query("SELECT event_id, 'k' AS name, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events")
def map_explode(spark, d):
    docs = _t(spark, d, "events").select("event_id", F.from_json("props", "map<string,double>").alias("entries"))
    return relations.documents_from_map(docs, "event_id", "entries")


@query("SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def poll_answers(spark, d):
    body = F.concat(F.lit('{"members":['), F.col("props"), F.lit("]}"))
    return relations.poll_answers(_t(spark, d, "events").select("event_id", "user_id", body.alias("body")), "body", "members", "k bigint")


# --- contracts and checks

ORDERS = contracts.parse({
    "id": "sales.orders", "name": "Orders", "domain": "sales", "slaProperties": [{"property": "minScore", "value": 0.9}],
    "schema": [
        {"name": "orders", "properties": [
            {"name": "o_orderkey", "physicalType": "bigint", "required": True, "unique": True, "primaryKey": True},
            {"name": "o_custkey", "physicalType": "bigint", "required": True, "relationships": [{"type": "foreignKey", "to": "customer.c_custkey"}]},
            {"name": "o_orderstatus", "physicalType": "text", "required": True},
            {"name": "o_totalprice", "physicalType": "double"}, {"name": "o_orderdate", "physicalType": "timestamp"}, {"name": "o_comment", "physicalType": "text"},
        ], "quality": [{"type": "sql", "description": "finished orders cost something", "query": "select count(*) from orders where o_orderstatus = 'F' and o_totalprice < 5000", "mustBe": 0, "dimension": "consistency"}]},
        {"name": "lineitem", "properties": [
            {"name": "l_orderkey", "physicalType": "bigint", "primaryKey": True, "relationships": [{"type": "foreignKey", "to": ["orders.o_orderkey"]}]},
            {"name": "l_linenumber", "physicalType": "int", "primaryKey": True},
        ]},
    ],
})
CUSTOMERS = contracts.parse({
    "id": "crm.customer", "domain": "sales", "customProperties": [{"property": "derivedFrom", "value": ["sales.orders", "//store/raw", "lost.source"]}],
    "schema": [{"name": "customer", "properties": [{"name": "c_custkey", "physicalType": "bigint", "primaryKey": True, "required": True}, {"name": "c_name", "physicalType": "text", "classification": "pii"}]}],
})

def _series() -> list[checks.Check]:
    """Rules over orders that the series of daily results is made of; columns need a session, so they are built on use."""
    return [
        checks.rule("accepted_values", "orders", "o_orderstatus", {"values": ["O", "F"]}, key="status"),
        checks.rule("between", "orders", "o_totalprice", {"min": 0, "max": 495_000}, key="price"),
        checks.rule("matches", "orders", "o_orderpriority", {"pattern": "_-%"}, key="priority"),
        checks.rule("not_null", "orders", "o_custkey", key="customer"),
    ]


def _results(spark: SparkSession, d: str, mode: str = "incremental") -> DataFrame:
    return checks.by_day("sales.orders", _t(spark, d, "orders"), ARRIVAL, _series(), mode)


_FACTS = (
    ("status", "conformity", "o_orderstatus must be one of O, F", "NOT (o_orderstatus IN ('O', 'F'))"), ("price", "accuracy", "o_totalprice must be between 0 and 495000", "NOT (o_totalprice BETWEEN 0 AND 495000)"),
    ("priority", "conformity", "o_orderpriority must look like _-%", "NOT (o_orderpriority LIKE '_-%')"), ("customer", "completeness", "o_custkey must not be empty", "o_custkey IS NULL"),
)


def _r(mode: str = "incremental") -> str:
    """CTEs: r, the daily results."""
    parts = " UNION ALL ".join(
        f"SELECT CAST(o_orderdate AS DATE) AS run_at, 'sales.orders.{k}' AS check_id, '{dim}' AS dimension, '{name}' AS name, count(*) FILTER (WHERE {p}) AS failed_rows, count(*) AS total_rows FROM orders GROUP BY 1"
        for k, dim, name, p in _FACTS
    )
    over = "OVER (PARTITION BY check_id ORDER BY run_at)"
    so_far = f"CAST(sum(failed_rows) {over} AS BIGINT) AS failed_rows, CAST(sum(total_rows) {over} AS BIGINT) AS total_rows" if mode == "cumulative" else "failed_rows, total_rows"
    return f"""p AS ({parts}), q AS (SELECT run_at, check_id, dimension, name, {so_far} FROM p),
r AS (SELECT *, 'sales.orders' AS contract_id, CASE WHEN failed_rows > 0 THEN 'fail' ELSE 'pass' END AS status, failed_rows / total_rows AS fail_ratio, '{mode}' AS run_window FROM q)"""


_W = "CASE dimension WHEN 'completeness' THEN 5 ELSE 3 END"
_S = f"""s AS (SELECT run_at, contract_id, run_window, round(CAST(0.6 AS DOUBLE) * (CAST(sum(CASE WHEN status = 'pass' THEN {_W} ELSE 0 END) AS DOUBLE) / sum({_W})) + CAST(0.4 AS DOUBLE) * (sum({_W} * (1 - fail_ratio)) / sum({_W})), 4) AS score,
count(*) AS checks_total, count(*) FILTER (WHERE status = 'fail') AS checks_failed, count(*) FILTER (WHERE status = 'error') AS checks_errored FROM r GROUP BY 1, 2, 3)"""
_RESULT = ["run_at", "check_id", "contract_id", "dimension", "status", "failed_rows", "total_rows", "fail_ratio", "run_window", "name"]


@query(f"WITH {_r()} SELECT {', '.join(_RESULT)} FROM r")
def checks_by_day_backfill(spark, d):
    return _results(spark, d).select(*_RESULT)


@query(f"WITH {_r('cumulative')} SELECT {', '.join(_RESULT)} FROM r")
def checks_by_day_cumulative(spark, d):
    return _results(spark, d, "cumulative").select(*_RESULT)


@query(" UNION ALL ".join(f"SELECT '{k}' AS key, count(*) FILTER (WHERE {p}) AS failed, count(*) AS total FROM orders" for k, _, _, p in _FACTS))
def checks_fused_one_scan(spark, d):
    return checks.measure(_series(), {"orders": _t(spark, d, "orders")}).select("key", "failed", "total")


@query(f"""WITH o AS (SELECT * FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '{DAY}'), n AS (SELECT count(*) AS n FROM o), a AS (SELECT count(*) AS n FROM orders), l AS (SELECT count(*) AS n FROM lineitem), c AS (
SELECT 'orders.o_orderkey.field_required' AS k, count(*) FILTER (WHERE o_orderkey IS NULL) AS f, count(*) AS t FROM o
UNION ALL SELECT 'orders.o_custkey.field_required', count(*) FILTER (WHERE o_custkey IS NULL), count(*) FROM o
UNION ALL SELECT 'orders.o_orderstatus.field_required', count(*) FILTER (WHERE o_orderstatus IS NULL), count(*) FROM o
UNION ALL SELECT 'orders.o_orderkey.field_unique', CAST((SELECT coalesce(sum(x), 0) FROM (SELECT count(*) AS x FROM orders WHERE o_orderkey IS NOT NULL GROUP BY o_orderkey HAVING count(*) > 1)) AS BIGINT), (SELECT n FROM a)
UNION ALL SELECT 'orders.field_primary_key', CAST((SELECT coalesce(sum(x), 0) FROM (SELECT count(*) AS x FROM orders GROUP BY o_orderkey HAVING count(*) > 1 OR o_orderkey IS NULL)) AS BIGINT), (SELECT n FROM a)
UNION ALL SELECT 'orders.finished orders cost something', count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice < 5000), count(*) FROM o
UNION ALL SELECT 'lineitem.field_primary_key', CAST((SELECT coalesce(sum(x), 0) FROM (SELECT count(*) AS x FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS BIGINT), (SELECT n FROM l))
SELECT DATE '{DAY}' AS run_at, 'sales.orders.' || k AS check_id, CASE WHEN f > 0 THEN 'fail' ELSE 'pass' END AS status, f AS failed_rows, t AS total_rows, coalesce(f / nullif(t, 0), 0) AS fail_ratio FROM c""")
def contract_run(spark, d):
    """A contract's derived and hand-written checks for one day; keys are checked over whole tables."""
    return checks.run(ORDERS, relations.resolver(spark, {"type": "parquet", "path": d}), DAY, ARRIVAL).select("run_at", "check_id", "status", "failed_rows", "total_rows", "fail_ratio")


@query("""SELECT 'orders' AS table_name, c AS column_name, k AS check_type, s AS status FROM (VALUES ('o_orderkey','field_is_present','pass'), ('o_orderkey','field_type','pass'), ('o_custkey','field_is_present','pass'), ('o_custkey','field_type','pass'),
('o_orderstatus','field_is_present','pass'), ('o_orderstatus','field_type','pass'), ('o_totalprice','field_is_present','pass'), ('o_totalprice','field_type','pass'), ('o_orderdate','field_is_present','pass'), ('o_orderdate','field_type','pass'), ('o_comment','field_is_present','fail')) v(c, k, s)""")
def derived_schema(spark, d):
    return checks.schema_rows(spark, ORDERS.model("orders"), _t(spark, d, "orders")).drop("reason")


def _derived(spark: SparkSession, d: str, kind: str, table: str) -> DataFrame:
    picked = [c for c in checks.derived(ORDERS.model(table)) if c.type == kind]
    return checks.measure(picked, {table: _t(spark, d, table)}).select("key", "failed", "total")


@query("SELECT 'orders.' || c || '.field_required' AS key, f AS failed, (SELECT count(*) FROM orders) AS total FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus']) AS c, unnest([count(*) - count(o_orderkey), count(*) - count(o_custkey), count(*) - count(o_orderstatus)]) AS f FROM orders)")
def derived_required(spark, d):
    return _derived(spark, d, "field_required", "orders")


@query("SELECT 'orders.o_orderkey.field_unique' AS key, CAST(coalesce(sum(n), 0) AS BIGINT) AS failed, (SELECT count(*) FROM orders) AS total FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1)")
def derived_unique(spark, d):
    return _derived(spark, d, "field_unique", "orders")


@query("SELECT 'lineitem.field_primary_key' AS key, CAST(coalesce(sum(n), 0) AS BIGINT) AS failed, (SELECT count(*) FROM lineitem) AS total FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def derived_primary_key(spark, d):
    return _derived(spark, d, "field_primary_key", "lineitem")


@query("""SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 7 WHEN event_type = 'view' THEN 0 WHEN event_type = 'click' THEN round(value) ELSE 1 END AS BIGINT) AS failed_rows,
coalesce(nullif(event_id % 2, 0), nullif(event_id % 5, 0), nullif(event_id % 3, 0), 0) AS total_rows, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'pass' WHEN event_type = 'click' THEN 'fail' ELSE 'error' END AS status FROM events""")
def external_results(spark, d):
    """Outcomes of an external checker read as check results."""
    e = _t(spark, d, "events")
    outcome = F.when(F.col("event_type") == "view", "passed").when(F.col("event_type") == "click", "failed").otherwise("skipped")
    own = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 7)
    value = F.when(F.col("event_type") == "click", F.round("value"))
    kind = F.when(F.col("event_type") == "error", "general").otherwise("sql")
    return e.select("event_id", checks.failed_rows(own, outcome, value).alias("failed_rows"), checks.denominator(F.col("event_id") % 2, F.col("event_id") % 5, F.col("event_id") % 3).alias("total_rows"), checks.status_of(kind, outcome).alias("status"))


# --- scores and what is read off them


def _scores(spark: SparkSession, d: str, mode: str = "incremental") -> DataFrame:
    return scoring.score(_results(spark, d, mode))


def _contracts(spark: SparkSession) -> DataFrame:
    return contracts.contract_rows(spark, [ORDERS, CUSTOMERS])


def _status(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("sales.orders.priority", "open"), ("sales.orders.status", "accepted")], "check_id string, state string")


_ST = "st AS (SELECT * FROM (VALUES ('sales.orders.priority', 'open'), ('sales.orders.status', 'accepted')) v(check_id, state))"
_SINCE = "pa AS (SELECT check_id, max(run_at) AS passed FROM r WHERE status = 'pass' GROUP BY 1), si AS (SELECT r.check_id, min(run_at) AS since FROM r LEFT JOIN pa USING (check_id) WHERE status = 'fail' AND (passed IS NULL OR run_at > passed) GROUP BY 1)"
_SCORE = "run_at, contract_id, run_window, score, checks_total, checks_failed, checks_errored"


@query(f"WITH {_r()}, {_S} SELECT {_SCORE} FROM s")
def score_weighted(spark, d):
    return _scores(spark, d)


@query(f"WITH {_r()}, {_S} SELECT {_SCORE}, CAST(0.9 AS DOUBLE) AS sla_min, score >= 0.9 AND checks_errored = 0 AS sla_met FROM s")
def score_sla(spark, d):
    return scoring.with_sla(_scores(spark, d), _contracts(spark)).select(*_SCORE.split(", "), "sla_min", "sla_met")


@query(f"WITH {_r()}, {_S} SELECT {_SCORE} FROM s WHERE NOT (score >= 0.9 AND checks_errored = 0)")
def sla_breaches(spark, d):
    return scoring.breaches(scoring.with_sla(_scores(spark, d), _contracts(spark))).select(*_SCORE.split(", "))


@query(f"WITH {_r()}, {_S} SELECT run_at, round(avg(score), 4) AS score FROM s GROUP BY 1")
def score_trend(spark, d):
    return scoring.trend(_scores(spark, d))


@query(f"WITH {_r()}, {_S} SELECT 'sales' AS domain, run_at, round(avg(score), 4) AS score FROM s GROUP BY run_at")
def score_trend_by_domain(spark, d):
    return scoring.trend(_scores(spark, d).join(_contracts(spark).select("contract_id", "domain"), "contract_id"), ["domain"])


def _delta_sql(mode: str) -> str:
    return f"WITH {_r(mode)}, {_S}, m AS (SELECT run_window, round(score - lag(score) OVER (PARTITION BY contract_id ORDER BY run_at), 4) AS x FROM s) SELECT run_window, count(*) FILTER (WHERE x > 0) AS improved, count(*) FILTER (WHERE x < 0) AS worsened, max(x) AS best FROM m GROUP BY 1"


@query(f"SELECT * FROM ({_delta_sql('incremental')}) UNION ALL SELECT * FROM ({_delta_sql('cumulative')})")
def score_delta_by_window(spark, d):
    return scoring.deltas(_scores(spark, d)).unionByName(scoring.deltas(_scores(spark, d, "cumulative")))


@query(f"WITH {_r()} SELECT check_id, run_at, status, failed_rows FROM r QUALIFY row_number() OVER (PARTITION BY check_id ORDER BY run_at DESC) = 1")
def latest_per_check(spark, d):
    return scoring.latest(_results(spark, d), ["check_id"]).select("check_id", "run_at", "status", "failed_rows")


@query(f"WITH {_r()}, k AS (SELECT * FROM r WHERE NOT (check_id = 'sales.orders.price' AND run_at > DATE '2001-07-01')) SELECT check_id, run_at, run_at < (SELECT max(run_at) FROM k) AS stale FROM k QUALIFY row_number() OVER (PARTITION BY check_id ORDER BY run_at DESC) = 1")
def checks_stale(spark, d):
    kept = _results(spark, d).where("not (check_id = 'sales.orders.price' and run_at > DATE'2001-07-01')")
    return scoring.stale(kept).select("check_id", "run_at", "stale")


def _until(df: DataFrame) -> DataFrame:
    """Results up to the last day on which the price rule failed, as it seldom does."""
    last = df.where(_PRICE).agg(F.max("run_at").alias("_last"))
    return df.join(F.broadcast(last), F.col("run_at") <= F.col("_last")).drop("_last")  # one row


_PRICE = "(check_id = 'sales.orders.price' AND status = 'fail')"
_RU = _r().replace("r AS (SELECT *,", "r0 AS (SELECT *,") + f", r AS (SELECT * FROM r0 WHERE run_at <= (SELECT max(run_at) FROM r0 WHERE {_PRICE}))"


@query(f"WITH {_RU}, {_ST}, n AS (SELECT run_at, row_number() OVER (ORDER BY run_at DESC) AS n FROM (SELECT DISTINCT run_at FROM r)) SELECT a.contract_id, a.check_id, a.name, a.run_at FROM r a JOIN n ON a.run_at = n.run_at AND n.n = 1 LEFT JOIN st USING (check_id) LEFT JOIN (SELECT r.check_id, status AS was FROM r JOIN n ON r.run_at = n.run_at AND n.n = 2) b ON b.check_id = a.check_id WHERE a.status = 'fail' AND coalesce(state, 'open') <> 'accepted' AND coalesce(was, 'pass') <> 'fail'")
def newly_failing(spark, d):
    return scoring.newly_failing_vs_previous(_until(_results(spark, d)), _status(spark))


@query(f"WITH {_r()}, {_SINCE} SELECT check_id, since FROM si")
def failing_since(spark, d):
    return scoring.failing_since(_results(spark, d))


@query(f"WITH {_r()}, {_ST}, {_SINCE} SELECT check_id, coalesce(state, 'open') AS state, since, failed_rows FROM r LEFT JOIN st USING (check_id) LEFT JOIN si USING (check_id) WHERE run_at = (SELECT max(run_at) FROM r) AND status = 'fail'")
def open_failures(spark, d):
    return scoring.open_failures(_results(spark, d), _status(spark)).select("check_id", "state", "since", "failed_rows")


@query("""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN x <= 1 THEN 'new' WHEN x <= 7 THEN 'week' WHEN x <= 30 THEN 'month' ELSE 'older' END AS bucket FROM (SELECT DISTINCT DATE '2001-08-01' - CAST(o_orderdate AS DATE) + 1 AS x FROM orders)) GROUP BY 1""")
def aging_buckets(spark, d):
    days = _t(spark, d, "orders").select(F.col(ARRIVAL).cast("date").alias("since")).distinct()
    return days.groupBy(scoring.age_bucket(F.col("since"), F.lit("2001-08-01").cast("date")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_RU}, {_ST}, {_SINCE}, c AS (SELECT r.*, coalesce(state, 'open') AS state, since FROM r LEFT JOIN st USING (check_id) LEFT JOIN si USING (check_id) WHERE run_at = (SELECT max(run_at) FROM r)) SELECT CASE WHEN x <= 1 THEN 'new' WHEN x <= 7 THEN 'week' WHEN x <= 30 THEN 'month' ELSE 'older' END AS bucket, count(*) AS n FROM (SELECT run_at - since + 1 AS x FROM c WHERE status = 'fail' AND state <> 'accepted' AND since IS NOT NULL) GROUP BY 1")
def aging_open_failures(spark, d):
    return scoring.aging(_until(_results(spark, d)), _status(spark))


@query(f"WITH {_r()}, {_S}, {_ST}, {_SINCE}, c AS (SELECT r.*, coalesce(state, 'open') AS state, since FROM r LEFT JOIN st USING (check_id) LEFT JOIN si USING (check_id) WHERE run_at = (SELECT max(run_at) FROM r)) SELECT (SELECT count(DISTINCT contract_id) FROM s) AS contracts, (SELECT count(*) FROM s WHERE run_at = (SELECT max(run_at) FROM s) AND score >= 0.9) AS at_sla, count(*) AS checks, count(*) FILTER (WHERE status = 'fail') AS failing, count(*) FILTER (WHERE status = 'error') AS errored, count(*) FILTER (WHERE status = 'fail' AND since = run_at AND state <> 'accepted') AS newly_failing, count(*) FILTER (WHERE status = 'fail' AND state = 'accepted') AS accepted FROM c")
def kpis(spark, d):
    return scoring.kpis(_results(spark, d), scoring.with_sla(_scores(spark, d), _contracts(spark)), _status(spark))


@query(f"WITH {_r()} SELECT dimension, {_W} AS weight, count(*) AS total, count(*) FILTER (WHERE status = 'fail') AS failing, count(*) FILTER (WHERE status = 'error') AS errored FROM r WHERE run_at = (SELECT max(run_at) FROM r) GROUP BY 1")
def dimension_counts(spark, d):
    return scoring.dimensions(_results(spark, d))


@query(f"WITH {_r()} SELECT check_id, contract_id, dimension, failed_rows, total_rows FROM r WHERE run_at = (SELECT max(run_at) FROM r) AND status = 'fail' ORDER BY failed_rows DESC, check_id LIMIT 8")
def worst_failures(spark, d):
    return scoring.worst(_results(spark, d))


@query(f"WITH {_r()}, {_S}, n AS (SELECT *, row_number() OVER (ORDER BY run_at DESC) AS n FROM s) SELECT c.contract_id, c.title, 'sales' AS domain, a.score, a.checks_total, a.checks_failed, a.checks_errored, a.run_at, b.score AS previous FROM (VALUES ('sales.orders', 'Orders'), ('crm.customer', 'crm.customer')) c(contract_id, title) LEFT JOIN n a ON a.contract_id = c.contract_id AND a.n = 1 LEFT JOIN n b ON b.contract_id = c.contract_id AND b.n = 2")
def contract_overview(spark, d):
    return scoring.contract_overview(_contracts(spark), _scores(spark, d))


@query(f"WITH {_r()} SELECT contract_id, check_id, name, run_at FROM r WHERE status = 'fail' ORDER BY run_at DESC, failed_rows DESC, check_id LIMIT 20")
def recent_failures(spark, d):
    return _results(spark, d).where("status = 'fail'").orderBy(F.col("run_at").desc(), F.col("failed_rows").desc(), "check_id").limit(20).select("contract_id", "check_id", "name", "run_at")


@query(f"WITH {_r()}, {_S} SELECT 'sales.orders' AS contract_id, p AS property, promised, CASE p WHEN 'frequency' THEN (SELECT CAST(DATE '2001-08-03' - max(run_at) AS DOUBLE) FROM s) WHEN 'completeness' THEN CAST(1 AS DOUBLE) ELSE (SELECT avg(CASE WHEN checks_errored = 0 THEN 1.0 ELSE 0.0 END) FROM s) END AS measured, CASE p WHEN 'frequency' THEN (SELECT DATE '2001-08-03' - max(run_at) FROM s) <= promised ELSE true END AS kept FROM (VALUES ('frequency', CAST(1 AS DOUBLE)), ('completeness', CAST(0.95 AS DOUBLE)), ('availability', CAST(0.99 AS DOUBLE))) v(p, promised)")
def agreement_measured(spark, d):
    promises = spark.createDataFrame([("sales.orders", "frequency", "1", "d"), ("sales.orders", "completeness", "0.95", None), ("sales.orders", "availability", "0.99", None)], "contract_id string, property string, value string, unit string")
    return agreement.against(promises, agreement.measured(_results(spark, d), _scores(spark, d), "2001-08-03"))


@query(f"WITH {_r()} SELECT '//test/' || check_id AS test, '//test/' || check_id || '/run/' || CAST(run_at AS VARCHAR) AS run, CASE status WHEN 'pass' THEN 'SUCCESS' ELSE 'FAILED' END AS outcome, 'ASSERTION' AS category, CASE WHEN status = 'fail' THEN printf('%d/%d rows failed (%.2f%%) dimension=%s', failed_rows, total_rows, fail_ratio * 100, dimension) END AS reason FROM r")
def catalogue_test_runs(spark, d):
    return catalog.test_runs(_results(spark, d))


# --- profiles and samples


def _profile_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_count FROM {table}" for c in columns)


@query(_profile_sql("events", ["user_id", "event_type", "value", "props", "ts"]))
def column_profile(spark, d):
    return profile.column_profile(_t(spark, d, "events"), ["user_id", "event_type", "value", "props", "ts"], "events")


@query("""WITH p AS (SELECT CAST(ts AS DATE) AS run_at, 'user_id' AS column_name, count(*) AS rows, count(*) - count(user_id) AS nulls, count(DISTINCT user_id) AS distinct_count FROM events GROUP BY 1
UNION ALL SELECT CAST(ts AS DATE), 'event_type', count(*), count(*) - count(event_type), count(DISTINCT event_type) FROM events GROUP BY 1)
SELECT run_at, 'events' AS table_name, column_name, rows, nulls, distinct_count, lead(nulls) OVER w AS nulls_before, lead(rows) OVER w AS rows_before FROM p
WINDOW w AS (PARTITION BY column_name ORDER BY run_at DESC) QUALIFY row_number() OVER w = 1""")
def profile_vs_previous_day(spark, d):
    return profile.profile_change(profile.profile_by_day(_t(spark, d, "events"), ["user_id", "event_type"], "events", "ts"))


@query("SELECT c_custkey, '•••' AS c_name, c_acctbal FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 20")
def sample_failing_rows_masked(spark, d):
    return sample.failing_rows(_t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), rules.predicate("not_negative", "c_acctbal"), "c_custkey", ["c_name"])


@query("SELECT c_custkey, CASE WHEN n IS NOT NULL THEN '•••' END AS c_name FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS n FROM customer)")
def masked_view(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("c_name"))
    return sample.masked(rows, ["c_name"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000")
def replica_view(spark, d):
    """A replica's columns and rows: what is not listed never leaves the source."""
    return relations.snapshot(_t(spark, d, "orders"), ["o_orderkey", "o_orderstatus"], "o_orderstatus = 'O' and o_totalprice > 1000").drop("op")


# --- versions

_SEG = ["segment"]


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The customers' segments in twelve monthly snapshots; they move on in some months."""
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    months = spark.range(12).select(F.add_months(F.lit("1998-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.col("id").alias("m"))
    moved = F.floor((F.col("m") + F.col("c_custkey") % 7) / 5)
    return c.crossJoin(F.broadcast(months)).select("c_custkey", F.when((F.col("c_custkey") % 50 != 0) | (F.col("m") % 4 != 1), F.concat("c_mktsegment", moved.cast("string"))).alias("segment"), "day")  # 12 rows


_SNAP = """sn AS (SELECT c_custkey, CASE WHEN c_custkey % 50 <> 0 OR m % 4 <> 1 THEN c_mktsegment || CAST((m + c_custkey % 7) // 5 AS VARCHAR) END AS segment, CAST(DATE '1998-01-01' + to_months(CAST(m AS INTEGER)) AS DATE) AS day FROM customer, range(12) t(m)),
st0 AS (SELECT *, lag(segment) OVER w AS was, row_number() OVER w AS n FROM sn WINDOW w AS (PARTITION BY c_custkey ORDER BY day)),
st1 AS (SELECT c_custkey, segment, CASE WHEN n = 1 THEN DATE '0001-01-01' ELSE day END AS valid_from FROM st0 WHERE n = 1 OR was IS DISTINCT FROM segment),
dim AS (SELECT *, lead(valid_from) OVER (PARTITION BY c_custkey ORDER BY valid_from) AS valid_to FROM st1),
di AS (SELECT c_custkey, segment, valid_from, valid_to, valid_to IS NULL AS is_current FROM dim)"""


def _dimension(spark: SparkSession, d: str) -> DataFrame:
    return versions.from_snapshots(_snapshots(spark, d), "c_custkey", _SEG, "day")


@query(f"WITH {_SNAP} SELECT * FROM di")
def scd2_build(spark, d):
    return _dimension(spark, d)


@query(f"""WITH {_SNAP}, src AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS c_custkey, c_mktsegment || '1' AS segment FROM customer)
SELECT c_custkey, segment, valid_from, valid_to, is_current FROM di WHERE NOT is_current
UNION ALL SELECT di.c_custkey, di.segment, valid_from, valid_to, is_current FROM di LEFT JOIN src USING (c_custkey) WHERE is_current AND (src.c_custkey IS NULL OR src.segment IS NOT DISTINCT FROM di.segment)
UNION ALL SELECT di.c_custkey, di.segment, valid_from, DATE '1999-06-01', false FROM di JOIN src USING (c_custkey) WHERE is_current AND src.segment IS DISTINCT FROM di.segment
UNION ALL SELECT di.c_custkey, src.segment, DATE '1999-06-01', NULL, true FROM di JOIN src USING (c_custkey) WHERE is_current AND src.segment IS DISTINCT FROM di.segment
UNION ALL SELECT c_custkey, segment, DATE '0001-01-01', NULL, true FROM src WHERE c_custkey NOT IN (SELECT c_custkey FROM di)""")
def scd2_close_open(spark, d):
    key = F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey") + 1_000_000_000).otherwise(F.col("c_custkey"))  # a fifth is gone and a fifth is new
    source = _t(spark, d, "customer").select(key.alias("c_custkey"), F.concat("c_mktsegment", F.lit("1")).alias("segment"))
    return versions.close_and_open(_dimension(spark, d), source, "c_custkey", _SEG, "1999-06-01")


@query(f"WITH {_SNAP} SELECT o_orderkey, o_custkey, segment FROM orders o LEFT JOIN di ON di.c_custkey = o.o_custkey AND CAST(o_orderdate AS DATE) >= valid_from AND (valid_to IS NULL OR CAST(o_orderdate AS DATE) < valid_to)")
def asof_fact(spark, d):
    dim = _dimension(spark, d).withColumnRenamed("c_custkey", "o_custkey")
    return versions.as_of(_t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), dim, "o_custkey", "o_orderdate", _SEG).drop("o_orderdate")


@query(f"WITH {_SNAP} SELECT count(*) AS versions, count(DISTINCT c_custkey) AS keys, count(*) FILTER (WHERE is_current) AS current_versions, min(valid_from) AS first_from, max(valid_from) AS last_from FROM di")
def scd2_summary(spark, d):
    return versions.summary(_dimension(spark, d), "c_custkey")


@query(f"WITH {_SNAP} SELECT c_custkey, count(*) AS versions, max(valid_to) AS last_closed FROM di GROUP BY 1 HAVING count(*) > 1 ORDER BY last_closed DESC NULLS LAST, c_custkey LIMIT 100")
def scd2_changed_keys(spark, d):
    return versions.changed_keys(_dimension(spark, d), "c_custkey")


@query(f"WITH {_SNAP} SELECT c_custkey, valid_from, CASE WHEN row_number() OVER w > 1 AND lag(segment) OVER w IS DISTINCT FROM segment THEN 'segment' ELSE '' END AS changed FROM di WINDOW w AS (PARTITION BY c_custkey ORDER BY valid_from)")
def scd2_diff(spark, d):
    return versions.diff(_dimension(spark, d), "c_custkey", _SEG).select("c_custkey", "valid_from", F.array_join("changed", ",").alias("changed"))


@query(f"WITH {_SNAP}, o AS (SELECT c_custkey, valid_from, CASE WHEN c_custkey % 20 = 0 THEN CAST(valid_to + INTERVAL 40 DAY AS DATE) WHEN c_custkey % 30 = 1 AND valid_from < DATE '1990-01-01' THEN NULL ELSE valid_to END AS valid_to FROM di) SELECT c_custkey, valid_from, valid_to FROM o b WHERE EXISTS (SELECT 1 FROM o a WHERE a.c_custkey = b.c_custkey AND a.valid_from < b.valid_from AND coalesce(a.valid_to, DATE '9999-12-31') > b.valid_from)")
def scd2_overlaps(spark, d):
    endless = (F.col("c_custkey") % 30 == 1) & (F.col("valid_from") < "1990-01-01")  # spans all later versions
    end = F.when(F.col("c_custkey") % 20 == 0, F.date_add("valid_to", 40)).when(~endless, F.col("valid_to"))
    late = _dimension(spark, d).select("c_custkey", "valid_from", end.alias("valid_to"))
    return versions.overlaps(late, "c_custkey")


_STG = "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS o_custkey, CASE o_orderstatus WHEN 'P' THEN 'CANCELLED' ELSE o_orderstatus END AS status, o_totalprice, CAST(o_orderdate AS DATE) AS order_date FROM orders"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "CANCELLED").otherwise(F.col("o_orderstatus"))
    return _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("o_custkey"), status.alias("status"), "o_totalprice", F.col("o_orderdate").cast("date").alias("order_date"))


@query(f"SELECT o_orderkey, o_custkey, status FROM ({_STG}) WHERE o_custkey IS NOT NULL AND status <> 'CANCELLED'")
def stg_clean(spark, d):
    return versions.staged(_orders(spark, d), "o_custkey", "status").select("o_orderkey", "o_custkey", "status")


@query(f"SELECT order_date, status, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, max(order_date) AS loaded_at FROM ({_STG}) WHERE o_custkey IS NOT NULL AND status <> 'CANCELLED' GROUP BY 1, 2")
def mart_daily(spark, d):
    rows = versions.staged(_orders(spark, d), "o_custkey", "status").withColumn("amount", F.col("o_totalprice").cast(MONEY))
    return versions.revenue_daily(rows, ["order_date", "status"], "amount", "order_date").withColumn("revenue", F.col("revenue").cast("double"))


# --- change logs: events as a log of users, one stream a user


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    op = F.when(F.col("event_type") == "error", cdc.DELETE).when(F.col("event_type") == "signup", cdc.INSERT).when(F.col("event_type") == "view", cdc.BEFORE).otherwise(cdc.AFTER)
    return e.select(op.alias("op"), F.pmod("event_id", F.lit(40)).alias("source"), F.col("event_id").alias("seq"), "user_id", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value"))


_LOG = """lg AS (SELECT CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS op, event_id % 40 AS source, event_id AS seq, user_id, CASE WHEN event_id % 9 <> 0 THEN value END AS value FROM events),
lw AS (SELECT *, lag(op) OVER w AS wop, lag(user_id) OVER w AS wuser FROM lg WINDOW w AS (PARTITION BY source ORDER BY seq)),
it AS (SELECT seq, 1 AS part, user_id AS k, value, CASE WHEN op = 1 OR NOT coalesce(value > 5, false) THEN 'delete' ELSE 'upsert' END AS action FROM lw WHERE op <> 3
UNION ALL SELECT seq, 0, wuser, value, 'delete' FROM lw WHERE op = 4 AND wop = 3 AND wuser IS DISTINCT FROM user_id),
li AS (SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC, part DESC) = 1),
tg AS (SELECT range AS user_id, CAST(range AS DOUBLE) AS value FROM range(0, 200, 2))"""


def _intents(spark: SparkSession, d: str) -> DataFrame:
    return cdc.intents(_log(spark, d), ["user_id"], ["seq"], "value > 5", "source")


def _replica(spark: SparkSession) -> DataFrame:
    return spark.range(0, 200, 2).select(F.col("id").alias("user_id"), F.col("id").cast("double").alias("value"))


@query(f"WITH {_LOG} SELECT seq, part, k AS user_id, action FROM it")
def cdc_intents(spark, d):
    return _intents(spark, d).select("seq", "part", F.col("_key.user_id").alias("user_id"), "action")


@query(f"WITH {_LOG} SELECT user_id, value FROM tg WHERE user_id NOT IN (SELECT k FROM li) UNION ALL SELECT k, value FROM li WHERE action = 'upsert'")
def cdc_apply_filtered(spark, d):
    return cdc.apply(_replica(spark), _intents(spark, d), ["user_id"], ["seq"])


@query(f"WITH {_LOG} SELECT (SELECT count(*) FROM it WHERE action = 'upsert') AS upserts, (SELECT count(*) FROM it WHERE action = 'delete') AS deletes, count(*) FILTER (WHERE action = 'upsert' AND user_id IS NULL) AS inserted, count(*) FILTER (WHERE action = 'upsert' AND user_id IS NOT NULL) AS updated, count(*) FILTER (WHERE action = 'delete' AND user_id IS NOT NULL) AS deleted FROM li LEFT JOIN tg ON tg.user_id = li.k")
def cdc_net_counts(spark, d):
    return cdc.counts(_replica(spark), _intents(spark, d), ["user_id"], ["seq"])


@query("SELECT event_id, event_type FROM events WHERE event_id > (SELECT max(event_id) // 4 FROM events) AND event_id <= (SELECT max(event_id) // 4 * 3 FROM events)")
def cdc_changes_since(spark, d):
    events = _t(spark, d, "events").select("event_id", "event_type", F.lit(0).alias("seq"))
    quarter = events.agg(F.max("event_id")).first()[0] // 4
    return relations.changes(events, quarter, quarter * 3, "event_id").select("event_id", "event_type")


@query("SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderkey) AS number FROM orders")
def generated_numbers(spark, d):
    have = spark.range(1).select(F.lit(1000).cast("long").alias("number"))
    return cdc.generated(_t(spark, d, "orders").select("o_orderkey"), have, "number", "o_orderkey")


@query("""WITH x AS (SELECT user_id, event_id AS seq, event_type AS kind, value, lag(event_type) OVER w AS k, lag(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, seq, 'value' AS "column", CAST(CAST(b * 100 AS BIGINT) AS VARCHAR) AS before, CAST(CAST(value * 100 AS BIGINT) AS VARCHAR) AS after FROM x WHERE kind = 'click' AND k = 'view' AND CAST(b * 100 AS BIGINT) IS DISTINCT FROM CAST(value * 100 AS BIGINT)""")
def record_history(spark, d):
    kind = F.when(F.col("event_type") == "view", "UPDATE_BEFORE").when(F.col("event_type") == "click", "UPDATE_AFTER").otherwise(F.col("event_type"))
    log = _t(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"), F.round(F.col("value") * 100).cast("long").alias("value"))
    return agreement.paired(log, ["user_id"], "seq", "kind", ["value"])


# --- flows

FLOW = flows.parse({
    "id": "orders_to_hub", "from": "shop.orders", "to": "hub.order", "columns": {"number": "o_orderkey", "state": "o_orderstatus", "customer": "o_custkey"},
    "values": {"state": {"O": "open", "F": "finished"}}, "match": {"o_orderpriority": "2-HIGH"},
})
_STATE = "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'finished' END"


@query(f"SELECT o_orderkey AS number, {_STATE} AS state FROM orders")
def value_map(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("number"), flows.mapped("o_orderstatus", FLOW.values["state"]).alias("state"))


@query(f"SELECT o_orderkey AS number, {_STATE} AS state, o_custkey AS customer, CASE WHEN o_orderstatus IS NOT NULL AND {_STATE} IS NULL THEN 'state' ELSE '' END AS unmapped FROM orders WHERE o_orderpriority = '2-HIGH'")
def value_map_unmapped(spark, d):
    return flows.translate(_t(spark, d, "orders"), FLOW).withColumn("unmapped", F.array_join("_unmapped", ",")).drop("_unmapped")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus END AS o_orderstatus, o_custkey, '2-HIGH' AS o_orderpriority FROM orders WHERE o_orderpriority = '2-HIGH'")
def match_filter(spark, d):
    """A flow's rows there and back: what its map does not hold is lost, what it matches is filled in."""
    return flows.back(flows.translate(_t(spark, d, "orders"), FLOW), FLOW)


@query(f"SELECT 'shop' AS system, CASE WHEN o_orderkey % 2 = 0 THEN 'INSERT' ELSE 'UPDATE_AFTER' END AS row_kind, epoch_ms(o_orderdate) AS source_ms, 'number,state,customer' AS fields, CASE WHEN {_STATE} IS NULL THEN 'state' ELSE '' END AS unmapped, o_orderkey AS number, {_STATE} AS state, o_custkey AS customer FROM orders WHERE o_orderpriority = '2-HIGH'")
def flow_inbox(spark, d):
    rows = _t(spark, d, "orders").withColumn("row_kind", F.when(F.col("o_orderkey") % 2 == 0, "INSERT").otherwise("UPDATE_AFTER")).withColumn("source_ms", expressions.epoch_ms(F.col("o_orderdate")))
    return flows.inbox_rows(rows, FLOW)


_TOTALS = {"amount": "sum(amount)", "lines": "count(*)", "least": "min(amount)", "most": "max(amount)", "parts": "count(l_partkey)"}


def _lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey"))
    return _t(spark, d, "lineitem").select("l_orderkey", line.alias("line"), "l_partkey", F.col("l_extendedprice").cast(MONEY).alias("amount"))


_LN = "ln AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_suppkey) AS line, l_partkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem)"
_AGG = "CAST(sum(amount) AS DOUBLE) AS amount, count(*) AS lines, CAST(min(amount) AS DOUBLE) AS least, CAST(max(amount) AS DOUBLE) AS most, count(l_partkey) AS parts"


def _doubles(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in ("amount", "least", "most")})


@query(f"WITH {_LN} SELECT l_orderkey AS entry, {_AGG} FROM ln GROUP BY 1")
def flow_totals(spark, d):
    return _doubles(rollup.totals(_lines(spark, d), {"entry": "l_orderkey"}, _TOTALS))


@query(f"""WITH {_LN}, ch AS (SELECT l_orderkey, line, l_partkey, CASE WHEN line = 2 THEN amount + 1 ELSE amount END AS amount, CASE WHEN line = 1 THEN 'delete' ELSE 'upsert' END AS op FROM ln WHERE l_orderkey % 50 = 0 AND line <= 2),
af AS (SELECT l_orderkey, line, l_partkey, amount FROM ln WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.l_orderkey = ln.l_orderkey AND ch.line = ln.line) UNION ALL SELECT l_orderkey, line, l_partkey, amount FROM ch WHERE op = 'upsert'),
a AS (SELECT l_orderkey AS entry, {_AGG} FROM af GROUP BY 1), b AS (SELECT DISTINCT l_orderkey AS entry FROM ln WHERE l_orderkey % 50 = 0)
SELECT b.entry, a.amount, a.lines, a.least, a.most, a.parts, CASE WHEN a.lines IS NULL THEN 'delete' ELSE 'update' END AS action FROM b LEFT JOIN a USING (entry)""")
def flow_totals_recomputed(spark, d):
    lines = _lines(spark, d)
    ch = lines.where("l_orderkey % 50 = 0 and line <= 2").withColumn("amount", F.when(F.col("line") == 2, F.col("amount") + 1).otherwise(F.col("amount")).cast(MONEY))
    ch = ch.withColumn("op", F.when(F.col("line") == 1, "delete").otherwise("upsert")).withColumn("seq", F.lit(1))
    after, touched = rollup.apply_changes(lines, ch, ["l_orderkey", "line"])
    group = {"entry": "l_orderkey"}
    return _doubles(rollup.recompute(after, touched, rollup.totals(lines, group, _TOTALS), group, _TOTALS)).withColumnRenamed("_action", "action")


def _revisions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    changed = F.when(k % 3 == 0, "*").when(k % 3 == 1, ",c_acctbal,").otherwise(",c_name,")
    return _t(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), changed.alias("_changed"), F.when(k % 5 == 0, "shop").alias("_skip"))


@query("""WITH t AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 2 = 0),
s AS (SELECT c_custkey AS k, c_name || '!' AS n, c_acctbal + 1 AS b, c_custkey % 3 AS m FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN c_custkey IS NULL OR m IN (0, 2) THEN n ELSE c_name END AS c_name, CASE WHEN c_custkey IS NULL OR m IN (0, 1) THEN b ELSE c_acctbal END AS c_acctbal, c_mktsegment,
CASE WHEN c_custkey IS NULL THEN 'insert' WHEN k IS NOT NULL THEN 'update' END AS action FROM t FULL JOIN s ON c_custkey = k WHERE c_custkey IS NOT NULL OR m = 0""")
def merge_delivery(spark, d):
    target = _t(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    told = deliver.outgoing(_revisions(spark, d), "shop", ["c_name", "c_acctbal"], ["c_custkey"])
    return deliver.merge(target, told, ["c_custkey"], ["c_name", "c_acctbal"]).withColumnRenamed("_action", "action")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0")
def delete_delivery(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_name")
    return deliver.delete(c, c.where("c_custkey % 3 = 0"), ["c_custkey"])


@query("""WITH a AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 4 <> 0), b AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'add' WHEN a.c_custkey IS NULL THEN 'delete' ELSE 'change' END AS action, a.c_name, a.c_mktsegment FROM a FULL JOIN b ON a.c_custkey = b.c_custkey
WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_mktsegment <> b.c_mktsegment""")
def reconcile_lookup(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    have = c.where("c_custkey % 3 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "OTHER").otherwise(F.col("c_mktsegment")))
    return deliver.reconcile(c.where("c_custkey % 4 <> 0"), have, ["c_custkey"], ["c_name", "c_mktsegment"])


# --- golden records


@query("SELECT date_trunc('hour', ts) AS hour, event_type AS system, count(*) AS n FROM events GROUP BY 1, 2")
def hub_activity_hourly(spark, d):
    return agreement.activity(_t(spark, d, "events").withColumnRenamed("event_type", "system"), "ts")


@query("SELECT event_type AS system, arg_max(value, event_id) AS last, count(*) AS n FROM events GROUP BY 1")
def hub_latest_per_system(spark, d):
    return agreement.latest_by_system(_t(spark, d, "events").withColumnRenamed("event_type", "system"), "event_id", "value")


@query("SELECT user_id, event_type AS name, arg_max(value, ts) AS value, CAST(floor(epoch_us(max(ts)) / 1000) AS BIGINT) AS ms FROM events GROUP BY 1, 2")
def golden_merge_last_writer(spark, d):
    e = _t(spark, d, "events").select("user_id", F.col("event_type").alias("name"), "value", expressions.epoch_ms(F.col("ts")).alias("ms"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("system"))
    return golden.last_writer(e, "user_id", "name", "value", "ms", "system").drop("system")


ENTITY = golden.Entity(("name", "city", "tier"), {"crm": ("name", "tier"), "billing": None, "shop": ("name", "city")}, "crm", ("name",))


def golden_inbox(spark: SparkSession, d: str) -> DataFrame:
    """Events as edits of three systems; a user is a record."""
    e = _t(spark, d, "events")
    system = F.element_at(F.array(F.lit("crm"), F.lit("billing"), F.lit("shop")), (F.col("event_id") % 3 + 1).cast("int"))
    kind = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "view", "UPDATE_BEFORE").when(F.col("event_type") == "click", "POLL").otherwise("UPDATE_AFTER")
    label = F.concat(F.lit("v"), F.floor("value").cast("string"))
    row = F.when(system == "crm", F.to_json(F.struct(label.alias("name"), F.col("event_type").alias("tier")))).when(system == "shop", F.to_json(F.struct(label.alias("name"), F.col("props").alias("city")))).otherwise(F.to_json(F.struct(label.alias("name"), F.col("props").alias("city"), F.lit("x").alias("tier"))))
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), system.alias("system"), kind.alias("row_kind"), expressions.epoch_ms(F.col("ts")).alias("source_ms"), row.alias("row"), F.lit(None).cast("string").alias("unmapped"))


@query()
def golden_merge_full(spark, d):
    return golden.golden_records(golden.replay(golden_inbox(spark, d), ENTITY))


@query()
def golden_merge_outcomes(spark, d):
    return golden.replay(golden_inbox(spark, d), ENTITY).groupBy("system", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query()
def golden_conflicts(spark, d):
    return golden.conflicts(golden.replay(golden_inbox(spark, d), ENTITY))


@query("WITH p AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) SELECT user_id, event_id, event_type FROM p WHERE was IS DISTINCT FROM event_type")
def poll_semantics(spark, d):
    return golden.poll_changes(_t(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", ["event_type"])


@query("""WITH g AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS crm, CASE WHEN c_custkey % 7 = 0 THEN c_nationkey ELSE c_custkey END AS c_nationkey, c_mktsegment FROM customer),
r AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -c_custkey END AS crm, CASE WHEN c_custkey % 10 <> 0 THEN CASE WHEN c_custkey % 7 <> 1 THEN c_custkey ELSE c_nationkey END END AS c_nationkey, c_mktsegment FROM customer),
l AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(key) AS linked, bool_or(crm IS NOT NULL) AS taken FROM g GROUP BY 1, 2),
x AS (SELECT r.*, k.key AS known, n, linked, CASE WHEN k.key IS NULL THEN CASE WHEN r.c_nationkey IS NULL THEN 'unmatchable' WHEN n > 1 THEN 'ambiguous' WHEN taken THEN 'taken' END END AS held FROM r LEFT JOIN g k ON k.crm = r.crm LEFT JOIN l ON l.c_nationkey = r.c_nationkey AND l.c_mktsegment = r.c_mktsegment)
SELECT crm, c_nationkey, c_mktsegment, coalesce(known, CASE WHEN held IS NULL THEN linked END) AS key, held FROM x""")
def crosswalk_resolve(spark, d):
    c, k = _t(spark, d, "customer"), F.col("c_custkey")
    of = lambda shared: F.when(shared, F.col("c_nationkey")).otherwise(k)  # noqa: E731  links that many share, or one each
    records = c.select(k.alias("key"), F.when(k % 3 == 0, k).alias("crm"), of(k % 7 == 0).alias("c_nationkey"), "c_mktsegment")
    rows = c.select(F.when(k % 2 == 0, k).otherwise(-k).alias("crm"), F.when(k % 10 != 0, of(k % 7 == 1)).alias("c_nationkey"), "c_mktsegment")
    return golden.resolve(rows, records, golden.Crosswalk({"crm": "crm"}, ("c_nationkey", "c_mktsegment")), "crm")


# --- catalogue



@query("""WITH RECURSIVE e AS (SELECT c_custkey AS src, c_custkey // 3 AS dst FROM customer WHERE c_custkey > 0 UNION SELECT c_custkey // 3, c_custkey FROM customer WHERE c_custkey % 200 = 100),
w AS (SELECT src AS origin, dst AS node, 1 AS steps FROM e UNION SELECT origin, dst, steps + 1 FROM w JOIN e ON e.src = w.node WHERE steps < 24 AND dst <> origin) SELECT CAST(origin AS VARCHAR) AS origin, CAST(node AS VARCHAR) AS node, CAST(min(steps) AS INTEGER) AS steps FROM w GROUP BY 1, 2""")
def lineage_closure(spark, d):
    """What each customer's table reaches, each being made into that of a third of its key, some of them back again."""
    k = F.col("c_custkey")
    edge = lambda rows, src, dst: rows.select(src.cast("string").alias("src"), dst.cast("string").alias("dst"), F.lit("derived").alias("kind"))
    c = _t(spark, d, "customer")
    return catalog.downstream(edge(c.where("c_custkey > 0"), k, F.floor(k / 3)).unionByName(edge(c.where("c_custkey % 200 = 100"), F.floor(k / 3), k)))


@query("""WITH e AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN '//store/' || c_custkey WHEN c_custkey % 7 = 0 THEN 'lost.' || c_custkey ELSE 'crm.' || c_custkey // 2 END AS src, 'crm.' || c_custkey AS dst FROM customer), c AS (SELECT 'crm.' || c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0)
SELECT src, dst FROM e WHERE src NOT LIKE '//%' AND src NOT IN (SELECT id FROM c)""")
def lineage_unresolved(spark, d):
    """Edges of customers' tables from what is neither a contract nor an address."""
    k, c = F.col("c_custkey"), _t(spark, d, "customer")
    name = lambda of, key: F.concat(F.lit(of), key.cast("string"))
    src = F.when(k % 5 == 0, name("//store/", k)).when(k % 7 == 0, name("lost.", k)).otherwise(name("crm.", F.floor(k / 2)))
    return catalog.unresolved(c.select(src.alias("src"), name("crm.", k).alias("dst")), c.where("c_custkey % 3 <> 0").select(name("crm.", k).alias("contract_id"))).select("src", "dst")


def _catalogued(spark: SparkSession, d: str) -> DataFrame:
    """property_rows of a contract for each customer: its table `t` and its key, which refers to the customer's of a third of it; every fourth one is classified."""
    k = F.col("c_custkey")
    named = lambda of, key, tail="": F.concat(F.lit(of), key.cast("string"), F.lit(tail))
    refs = F.when(k % 2 == 0, F.array(named("t", F.floor(k / 3), ".id"))).otherwise(F.array().cast("array<string>"))
    c = _t(spark, d, "customer")
    return c.select(named("c", k).alias("contract_id"), named("t", k).alias("table_name"), F.lit("id").alias("column_name"), F.when(k % 4 == 0, "pii").alias("classification"), refs.alias("refs"), F.col("c_mktsegment").alias("domain"), k)


@query("""WITH e AS (SELECT c_custkey AS a, c_custkey // 3 AS b FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT a, b FROM e JOIN customer x ON x.c_custkey = a JOIN customer y ON y.c_custkey = b WHERE x.c_nationkey = y.c_nationkey)
SELECT 't' || a AS table_name, 't' || b AS other, 'to' AS direction FROM n UNION ALL SELECT 't' || b, 't' || a, 'from' FROM n""")
def fk_both_ways(spark, d):
    """Foreign keys between customers' tables, among those of one nation."""
    hosts = _t(spark, d, "customer").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("table_name"), F.col("c_nationkey").cast("string").alias("host"))
    return catalog.relations_of(catalog.foreign_keys(_catalogued(spark, d)), hosts)


@query("""SELECT table_name, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT 't' || k AS table_name, unnest(list_filter([CASE WHEN k % 3 <> 0 THEN 'under-contract' END, CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN 'domain:' || seg END, CASE WHEN k % 3 <> 0 AND k % 2 = 0 THEN 'engine:parquet' END,
CASE WHEN k % 3 <> 0 AND k % 7 = 0 THEN 'replicated' END, CASE WHEN k % 3 <> 0 AND k % 4 = 0 THEN 'has-classified-columns' END, CASE WHEN k % 6 < 4 THEN 'mine' END, CASE WHEN k % 6 < 4 THEN 'under-contract' END], lambda x: x IS NOT NULL)) AS tag FROM (SELECT c_custkey AS k, c_mktsegment AS seg FROM customer)) GROUP BY 1""")
def catalogue_tags(spark, d):
    """Tags that contracts give customers' tables beside those that people have put on."""
    props = _catalogued(spark, d).where("c_custkey % 3 <> 0")
    known = props.where("c_custkey % 5 <> 0").select("contract_id", "domain")
    made = catalog.tags(props, known, props.where("c_custkey % 2 = 0").select("table_name", F.lit("parquet").alias("engine")), props.where("c_custkey % 7 = 0"))
    have = _catalogued(spark, d).where("c_custkey % 6 < 4").select("table_name", F.array(F.lit("mine"), F.lit("under-contract")).alias("tags"))
    return catalog.merged_tags(have, made).select("table_name", F.array_join("tags", ",").alias("tags"))


@query("SELECT 'orders_to_hub' AS flow, 'state' AS target_column, * FROM (VALUES ('O', 'open'), ('F', 'finished')) v(from_value, to_value)")
def reference_values(spark, d):
    return catalog.value_maps(spark, [FLOW])


@query("SELECT source, CASE WHEN count(DISTINCT lang) = 1 THEN max(lang) END AS domain FROM documents GROUP BY 1")
def source_domains(spark, d):
    return catalog.source_domains(_t(spark, d, "documents").select("source", F.col("lang").alias("domain")))


@query("SELECT c_custkey AS key, 'name' AS name, c_name AS value FROM customer WHERE c_name <> '' UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer")
def catalogue_metadata(spark, d):
    entries = F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment", F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("empty"), F.lit(""))
    return catalog.metadata(_t(spark, d, "customer").select(F.col("c_custkey").alias("key"), entries.alias("m")), "key", "m")


# --- business tables


@query("SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders GROUP BY 1")
def bi_revenue_by_day(spark, d):
    return _t(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("revenue"))


@query("SELECT o_orderstatus AS status, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders GROUP BY 1")
def bi_by_status(spark, d):
    return _t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("revenue"))


@query("SELECT c_mktsegment AS segment, count(*) AS customers FROM customer GROUP BY 1")
def bi_customers_by_segment(spark, d):
    return _t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("customers"))


@query("SELECT CAST(o_orderdate AS DATE) AS day, n_name AS country, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
def bi_revenue_by_day_country(spark, d):
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("o_orderdate").cast("date").alias("day"), F.col("n_name").alias("country")).agg(F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("revenue"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.k') AS has_k FROM events")
def json_props(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.k").isNotNull().alias("has_k"))


# --- classification


@query("""WITH x AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + 1234567 AS VARCHAR), 10, '1') AS s FROM orders),
p AS (SELECT o_orderkey, s, [((CAST(s[CAST(j + 1 AS INTEGER)] AS INTEGER) + 9 - j) % 10) * 100 + j FOR j IN range(9)] AS l FROM x),
t AS (SELECT o_orderkey, s, list_sum([CASE WHEN v // 100 = 0 THEN 0 WHEN (v // 100) * pow(2, 9 - v % 100) % 9 = 0 THEN 9 ELSE (v // 100) * pow(2, 9 - v % 100) % 9 END FOR v IN l]) AS total FROM p)
SELECT o_orderkey, (10 - CAST(total AS INTEGER) % 10) % 10 = CAST(s[10] AS INTEGER) AS valid FROM t""")
def tax_number_check(spark, d):
    s = F.lpad((F.col("o_orderkey") * 7919 + 1_234_567).cast("string"), 10, "1")
    return _t(spark, d, "orders").select("o_orderkey", expressions.is_tax_number(s).alias("valid"))


@query("SELECT 'mails' AS table_name, c AS column_name, 'EMAIL_ADDRESS' AS kind, share, share >= 0.8 AS classified FROM (SELECT unnest(['contact', 'note']) AS c, unnest([avg(CASE WHEN c_custkey % 10 <> 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN c_custkey % 5 = 0 THEN 1.0 ELSE 0.0 END)]) AS share FROM customer)")
def pii_email_share(spark, d):
    k = F.col("c_custkey")
    mail = F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.example.com"))
    rows = _t(spark, d, "customer").select(F.when(k % 10 != 0, mail).otherwise("none").alias("contact"), F.when(k % 5 == 0, mail).otherwise("some words").alias("note"))
    return classify.shares(classify.long_values(rows, "mails", ["contact", "note"]))


_DIGIT = "CAST(substr(n, {i}, 1) AS INTEGER)"
_PRIVATE = f"""WITH k AS (SELECT c_custkey AS k, c_custkey % 7 AS m, c_custkey % 3 = 0 AS wrong, CAST(123456789 + c_custkey * 7919 AS VARCHAR) AS n, lpad(CAST(c_custkey AS VARCHAR), 22, '0') AS b FROM customer),
c AS (SELECT *, {' + '.join(_DIGIT.format(i=i) for i in (1, 3, 5, 7, 9))} AS odd, {' + '.join(_DIGIT.format(i=i) for i in (2, 4, 6, 8))} AS even,
  (10 - ({' + '.join(f"(CASE WHEN ({_DIGIT.format(i=i)} + {10 - i}) % 10 = 9 THEN 9 ELSE (({_DIGIT.format(i=i)} + {10 - i}) % 10 * {2 ** (10 - i)}) % 9 END)" for i in range(1, 10))}) % 10) % 10 AS tax,
  (10 - ({' + '.join(f"(CASE WHEN {_DIGIT.format(i=i)} * {2 if i % 2 else 1} > 9 THEN {_DIGIT.format(i=i)} * 2 - 9 ELSE {_DIGIT.format(i=i)} * {2 if i % 2 else 1} END)" for i in range(1, 10))} + 8) % 10) % 10 AS card,
  98 - CAST((b || '292700')::HUGEINT % 97 AS INTEGER) AS iban FROM k),
d AS (SELECT *, ((odd * 7 - even) % 10 + 10) % 10 AS tenth FROM c),
v AS (SELECT k, m, CASE m WHEN 0 THEN 'c' || k || '@mail.example.com' WHEN 1 THEN '10.' || k % 256 || '.0.' || CASE WHEN wrong THEN 999 ELSE k % 250 END WHEN 2 THEN 'TR' || lpad(CAST(CASE WHEN wrong THEN (iban + 1) % 97 ELSE iban END AS VARCHAR), 2, '0') || b
  WHEN 3 THEN '400000' || n || CASE WHEN wrong THEN (card + 1) % 10 ELSE card END WHEN 4 THEN n || CASE WHEN wrong THEN (tax + 1) % 10 ELSE tax END
  WHEN 5 THEN n || tenth || CASE WHEN wrong THEN (odd + even + tenth + 1) % 10 ELSE (odd + even + tenth) % 10 END ELSE '+90 (532) 123 45 ' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') END AS value, wrong AND m IN (1, 2, 3, 4, 5) AS nothing FROM d)"""


@query(f"""{_PRIVATE} SELECT k, length('note ' || k || ': ') AS "at", length('note ' || k || ': ' || value) AS until, ['EMAIL_ADDRESS', 'IP_ADDRESS', 'IBAN_CODE', 'CREDIT_CARD', 'TR_VKN', 'TR_NATIONAL_ID', 'PHONE_NUMBER'][m + 1] AS kind, value FROM v WHERE NOT nothing""")
def pii_spans(spark, d):
    """Seven kinds of personal values inside sentences; a third of those with check digits or octets have wrong ones and are none."""
    k, text = F.col("c_custkey"), F.col
    c = _t(spark, d, "customer").select(k.alias("k"), (k % 7).alias("m"), (k % 3 == 0).alias("wrong"), (k * 7919 + 123_456_789).cast("string").alias("n"), F.lpad(k.cast("string"), 22, "0").alias("b"))
    tail = lambda right: F.when(text("wrong"), (right + 1) % 10).otherwise(right).cast("string")
    digits = [F.substring("n", i, 1).cast("int") for i in range(1, 10)]
    odd, even = sum(digits[0::2]), sum(digits[1::2])
    tenth = F.pmod(odd * 7 - even, F.lit(10))
    tax = (10 - sum(F.when((x + 10 - i) % 10 == 9, 9).otherwise((x + 10 - i) % 10 * 2 ** (10 - i) % 9) for i, x in enumerate(digits, 1)) % 10) % 10
    twice = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
    card = (10 - (sum(twice(x) if i % 2 else x for i, x in enumerate(digits, 1)) + 8) % 10) % 10
    iban = 98 - (F.concat("b", F.lit("292700")).cast("decimal(38,0)") % 97).cast("int")
    value = (
        F.when(text("m") == 0, F.concat(F.lit("c"), "k", F.lit("@mail.example.com"))).when(text("m") == 1, F.concat(F.lit("10."), (text("k") % 256).cast("string"), F.lit(".0."), F.when(text("wrong"), 999).otherwise(text("k") % 250).cast("string")))
        .when(text("m") == 2, F.concat(F.lit("TR"), F.lpad(F.when(text("wrong"), (iban + 1) % 97).otherwise(iban).cast("string"), 2, "0"), "b")).when(text("m") == 3, F.concat(F.lit("400000"), "n", tail(card)))
        .when(text("m") == 4, F.concat("n", tail(tax))).when(text("m") == 5, F.concat("n", tenth.cast("string"), tail((odd + even + tenth) % 10))).otherwise(F.concat(F.lit("+90 (532) 123 45 "), F.lpad((text("k") % 100).cast("string"), 2, "0")))
    )
    note = F.concat(F.lit("note "), text("k").cast("string"), F.lit(": "), value, F.lit(" and what was said about it."))
    found = c.select("k", F.inline(classify.spans(note)))
    return found.select("k", F.col("at").cast("long").alias("at"), F.col("until").cast("long").alias("until"), "kind", "value")


@query("SELECT event_id, event_type, event_type || ': ' || printf('%d/%d rows failed (%.2f%%) dimension=%s', event_id % 7, 10, (event_id % 7) / 10 * 100, event_type) AS reason FROM events")
def failure_reason(spark, d):
    reason = expressions.failure_reason(F.col("event_id") % 7, F.lit(10), F.col("event_type"))
    return _t(spark, d, "events").select("event_id", "event_type", F.concat("event_type", F.lit(": "), reason).alias("reason"))


@query("SELECT event_id, event_type AS cause FROM events")
def root_cause(spark, d):
    trace = F.concat(F.lit("Error: outer\n  at a\nCaused by: middle\n  at b\nCaused by: "), F.col("event_type"), F.lit("\n  at c"))
    return _t(spark, d, "events").select("event_id", expressions.root_cause(trace).alias("cause"))


# --- streams: run over what is there, with their state and results in the shared folder


def _scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or where it is unset a local one of a local session, the warehouse's of a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = spark.sparkContext.master.split("[")[0] == "local"
        folder = f"{f'file://{tempfile.gettempdir()}' if local else spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{folder.rstrip('/')}/ledgerlark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A driver table as a stream of its files."""
    return spark.readStream.schema(_t(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _part_by_part(spark: SparkSession, parts: list[DataFrame], folder: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Append parts to a folder and let its stream take each of them, in as many files as it has, before the next one comes; the stream goes on from its checkpoint."""
    for p in parts:
        p.write.mode("append").parquet(folder)
        streams.run_once(lambda: start(spark.readStream.schema(parts[0].schema).parquet(folder)))


@query(SQL["flow_inbox"])
def flow_inbox_streamed(spark, d):
    at = _scratch(spark)
    rows = _stream(spark, d, "orders").withColumn("row_kind", F.when(F.col("o_orderkey") % 2 == 0, "INSERT").otherwise("UPDATE_AFTER")).withColumn("source_ms", expressions.epoch_ms(F.col("o_orderdate")))
    streams.run_once(lambda: streams.into_inbox(rows, FLOW, f"{at}/inbox", f"{at}/progress", once=True))
    return spark.read.parquet(f"{at}/inbox").drop("landed_at")


@query(f"""WITH {_LN} SELECT l_orderkey AS entry, CAST(sum(CASE WHEN line = 2 AND l_orderkey % 50 = 0 THEN amount + 1 ELSE amount END) AS DOUBLE) AS amount, count(*) AS lines
FROM ln WHERE NOT (l_orderkey % 50 = 0 AND line = 1) GROUP BY 1""")
def flow_totals_streamed(spark, d):
    at, group, sums = _scratch(spark), {"entry": "l_orderkey"}, {"amount": "sum(amount)", "lines": "count(*)"}
    lines = BucketedTable.create(_lines(spark, d), f"{at}/lines", ["l_orderkey", "line"], 8)
    totals = BucketedTable.create(rollup.states(lines.read(), group, sums), f"{at}/totals", ["entry"], 8)
    ch = lines.read().where("l_orderkey % 50 = 0 and line <= 2").withColumn("amount", F.when(F.col("line") == 2, F.col("amount") + 1).otherwise(F.col("amount")).cast(MONEY))
    ch = ch.withColumn("op", F.when(F.col("line") == 1, "delete").otherwise("upsert")).withColumn("seq", F.lit(1))
    ch.write.parquet(f"{at}/changes")
    changes = spark.readStream.schema(ch.schema).parquet(f"{at}/changes")
    streams.run_once(lambda: streams.keep_totals(changes, lines, totals, group, sums, f"{at}/progress", once=True))
    return rollup.shown(totals.read(), group, sums).withColumn("amount", F.col("amount").cast("double"))


_MOVED = """WITH o AS (SELECT o_orderkey AS id, o_custkey % 97 AS g, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_totalprice AS DECIMAL(15, 2)) END AS x FROM orders),
n AS (SELECT id, CASE WHEN id % 4 = 1 THEN g + 50 ELSE g END AS g, CASE WHEN id % 8 = 1 THEN x * 2 ELSE x END AS x FROM o WHERE id % 4 <> 0 AND g <> 7)"""


@query(f"{_MOVED} SELECT g AS entry, CAST(sum(x) AS DOUBLE) AS amount, count(*) AS lines, count(x) AS priced, CAST(min(x) AS DOUBLE) AS least, CAST(max(x) AS DOUBLE) AS most, CAST(avg(x) AS DOUBLE) AS mean FROM n GROUP BY 1")
def flow_totals_retracted(spark, d):
    """Group totals from states that take changes back, over three batches: lines deleted, moved to other groups and changed, a group emptied; half of the lines come by the stream."""
    at, group = _scratch(spark), {"entry": "g"}
    of = {"amount": "sum(x)", "lines": "count(*)", "priced": "count(x)", "least": "min(x)", "most": "max(x)", "mean": "avg(x)"}
    k, g = F.col("id"), F.col("g")
    x = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice").cast("decimal(15,2)"))
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 97).alias("g"), x.alias("x"))
    lines = BucketedTable.create(orders.where("id % 2 = 0"), f"{at}/lines", ["id"], 8)
    totals = BucketedTable.create(rollup.states(lines.read(), group, of), f"{at}/totals", ["entry"], 8)
    upsert = lambda df, seq: df.withColumn("op", F.lit("upsert")).withColumn("seq", F.lit(seq))
    delete = lambda df, seq: df.withColumn("op", F.lit("delete")).withColumn("seq", F.lit(seq))
    moved = orders.where("id % 4 = 1").select("id", (g + 50).alias("g"), F.when(k % 8 == 1, F.col("x") * 2).otherwise(F.col("x")).cast("decimal(15,2)").alias("x"))
    parts = [upsert(orders.where("id % 2 <> 0"), 1), delete(orders.where("id % 4 = 0"), 2).unionByName(upsert(moved, 3)), delete(orders.where("g = 7"), 4)]
    _part_by_part(spark, parts, f"{at}/changes", lambda changes: streams.keep_totals(changes, lines, totals, group, of, f"{at}/progress", once=True))
    return rollup.shown(totals.read(), group, of).select("entry", "lines", "priced", *[F.col(c).cast("double").alias(c) for c in ("amount", "least", "most", "mean")])


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS s FROM customer)
SELECT k, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN n || '!' ELSE n END AS name, CASE WHEN k % 2 = 0 THEN s END AS segment FROM c WHERE (k % 2 = 0 AND NOT (k % 3 = 0 AND k % 5 = 0) AND NOT (k % 3 = 1 AND k % 5 = 1)) OR (k % 2 <> 0 AND k % 7 = 0)""")
def deliveries_streamed(spark, d):
    """Golden revisions out to a bucketed table, three ways: merged or inserted, deleted with their record, deleted because nothing of what the flow carries is left."""
    at, k = _scratch(spark), F.col("k")
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    table = BucketedTable.create(c.where("k % 2 = 0"), f"{at}/target", ["k"], 8)
    told = lambda df, changed, rev, deleted=False: df.select("k", "name", "segment", F.lit(rev).alias("rev"), F.lit(changed).alias("_changed"), F.lit(None).cast("string").alias("_skip"), F.lit(deleted).alias("deleted"))
    own = c.withColumn("name", F.concat("name", F.lit("!")))
    none = c.withColumns({"name": F.lit(None).cast("string"), "segment": F.lit(None).cast("string")})
    parts = [
        told(own.where("k % 3 = 0 and k % 2 = 0"), ",name,", 1), told(c.where("k % 7 = 0 and k % 2 <> 0").withColumn("segment", F.lit(None).cast("string")), "*", 1),
        told(c.where("k % 3 = 0 and k % 5 = 0 and k % 2 = 0"), "*", 2, True), told(none.where("k % 3 = 1 and k % 5 = 1 and k % 2 = 0"), "*", 2), told(c.where("k % 3 = 2 and k % 2 <> 0 and k % 7 <> 0"), ",name,", 2),
    ]
    told_of = [parts[0].unionByName(parts[1]), parts[2].unionByName(parts[3]), parts[4]]
    _part_by_part(spark, told_of, f"{at}/revisions", lambda revisions: streams.out_to_table(revisions, table, "shop", ["name", "segment"], f"{at}/progress", once=True, match=["name", "segment"]))
    return table.read()


@query()
def golden_merge_streamed(spark, d):
    at, inbox = _scratch(spark), golden_inbox(spark, d)
    inbox.write.parquet(f"{at}/inbox")
    out = golden.stream(spark.readStream.schema(inbox.schema).parquet(f"{at}/inbox"), ENTITY)
    with streams.rocksdb(spark):
        streams.run_once(lambda: out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start())
    return golden.golden_records(spark.read.parquet(f"{at}/out"))


# --- what is left


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def row_kind_filter(spark, d):
    return relations.row_kinds(_t(spark, d, "events").select("event_id", "event_type"), include=["click", "view"], kind="event_type")


@query("""SELECT event_type AS contract_id, count(*) AS runs, CAST(sum(user_id) AS BIGINT) AS rows_read, CAST(sum(user_id % 7) AS BIGINT) AS upserted, CAST(sum(user_id % 3) AS BIGINT) AS deleted, max(event_id) AS last_run
FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 10) GROUP BY 1""")
def sync_status(spark, d):
    u = F.col("user_id")
    return relations.sync_status(_t(spark, d, "events").select(F.col("event_type").alias("contract_id"), F.col("event_id").alias("run_at"), u.alias("rows_read"), (u % 7).alias("upserted"), (u % 3).alias("deleted")))


@query("SELECT user_id, bool_and(value > 1) AS all_over, bool_or(value > 100) AS any_over, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def group_conditions(spark, d):
    v = F.col("value")
    return _t(spark, d, "events").groupBy("user_id").agg(F.bool_and(v > 1).alias("all_over"), F.bool_or(v > 100).alias("any_over"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("SELECT CAST(ts AS DATE) AS day, 'sales' AS flow, count(*) AS lines, count(DISTINCT user_id) AS entries, count(*) FILTER (WHERE event_type = 'purchase') AS landed FROM events GROUP BY 1")
def flow_counts(spark, d):
    return _t(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.lit("sales").alias("flow"), F.count(F.lit(1)).alias("lines"), F.count_distinct(F.col("user_id")).alias("entries"), F.count_if(F.col("event_type") == "purchase").alias("landed"))


@query("SELECT lower(c_mktsegment) AS segment, trim(c_name) AS name, strpos(c_name, '#') AS at, split_part(c_name, '#', 2) AS number, right(c_name, 3) AS tail, abs(c_acctbal) AS size, length(c_name) AS long FROM customer")
def scalar_functions(spark, d):
    n = F.col("c_name")
    return _t(spark, d, "customer").select(F.lower("c_mktsegment").alias("segment"), F.trim(n).alias("name"), F.instr(n, "#").alias("at"), F.split_part(n, F.lit("#"), F.lit(2)).alias("number"), F.right(n, F.lit(3)).alias("tail"), F.abs("c_acctbal").alias("size"), F.length(n).alias("long"))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, CAST(o_orderdate + INTERVAL 1 DAY AS DATE) AS next_day, epoch_ms(o_orderdate) AS ms, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders")
def date_functions(spark, d):
    o = F.col("o_orderdate")
    return _t(spark, d, "orders").select("o_orderkey", F.date_trunc("month", o).alias("month"), F.date_add(o.cast("date"), 1).alias("next_day"), expressions.epoch_ms(o).alias("ms"), F.date_diff(o.cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("days"))
