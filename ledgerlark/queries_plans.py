"""Queries of stores, refusals, deliveries and small inboxes, with the same rows in SQL; they join those of `queries`."""

from __future__ import annotations

import glob
import os
import shutil
import tempfile
import zipfile
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce
from pathlib import Path
from urllib.parse import urlsplit

import yaml
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlark.functions import expressions, rules
from ledgerlark.operators import agreement, catalog, cdc, deliver, profile, sample
from ledgerlark.plans import checks, flows, scoring
from ledgerlark.plans.results import ResultStore, RunStore, land, upserted
from ledgerlark.queries import _RESULT, ARRIVAL, CUSTOMERS, DAY, FLOW, ORDERS, _catalogued, _contracts, _intents, _LOG, _part_by_part, _r, _results, _scratch, _series, _t, query
from ledgerlark.sources import contracts, relations
from ledgerlark.streaming import crosswalk, golden
from ledgerlark.streaming import flows as streams


def _text(rows: list[tuple]) -> str:
    """Rows of text as SQL values."""
    quoted = lambda v: "NULL" if v is None else "'{}'".format(str(v).replace("'", "''"))
    return ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)


def _sentences(spark: SparkSession, found: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(k, s) for k, told in found.items() for s in told], "about string, sentence string")


# --- checks that cannot run, and parents outside the contract


@query(f"""SELECT 'broken' AS key, NULL::BIGINT AS failed, NULL::BIGINT AS total, true AS errored UNION ALL SELECT 'unplanned', NULL, NULL, true UNION ALL SELECT 'lost parent', NULL, NULL, true
UNION ALL SELECT 'customer', count(*) FILTER (WHERE o_custkey IS NULL), count(*), false FROM orders UNION ALL SELECT 'price', count(*) FILTER (WHERE o_totalprice < 0), count(*), false FROM orders
UNION ALL SELECT 'known', count(*) FILTER (WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)), count(*), false FROM orders""")
def checks_that_break(spark, d):
    """A rule that breaks while it runs, one that cannot be planned and one without its parent have an error; the others are measured."""
    made = [
        checks.rule("not_null", "orders", "o_custkey", key="customer"), checks.rule("not_negative", "orders", "o_totalprice", key="price"), checks.rule("not_null", "orders", "no_such_column", key="unplanned"),
        checks.Check("broken", "orders", "sql", "accuracy", "breaks", failing=F.col("o_orderstatus").cast("int") > 0),
        checks.rule("foreign_key", "orders", "o_custkey", {"table": "customer", "column": "c_custkey"}, key="known"), checks.rule("foreign_key", "orders", "o_custkey", {"table": "nowhere", "column": "k"}, key="lost parent"),
    ]
    orders = {"orders": _t(spark, d, "orders")}
    found = checks.measure(made, orders, {**orders, "customer": _t(spark, d, "customer")})
    return found.select("key", "failed", "total", F.col("error").isNotNull().alias("errored"))


@query(f"""SELECT count(*) FILTER (WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)) AS failed_rows, count(*) AS total_rows FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '{DAY}'""")
def foreign_parent_run(spark, d):
    """A contract's run reads a rule's parent table, which is not its own, whole."""
    rule = checks.rule("foreign_key", "orders", "o_custkey", {"table": "customer", "column": "c_custkey"}, key="parent")
    found = checks.run(ORDERS, relations.resolver(spark, {"type": "parquet", "path": d}), DAY, ARRIVAL, extra=[rule])
    return found.where("check_id = 'sales.orders.parent'").select("failed_rows", "total_rows")


@query("SELECT 'sales.orders.window_missing' AS check_id, 'error' AS status, 0::BIGINT AS failed_rows, 'general' AS check_type")
def window_missing(spark, d):
    """A day without any relation measures nothing and says so."""

    def read(table: str) -> DataFrame:
        raise LookupError(f"no relation {table}")

    return checks.run(ORDERS, read, DAY, ARRIVAL).select("check_id", "status", "failed_rows", "check_type")


@query("SELECT 'even' AS key, count(*) FILTER (WHERE o_orderkey % 2 <> 0) AS failed, count(*) AS total FROM orders")
def rule_plugin(spark, d):
    """A kind that a plugin brings is measured like the others."""
    if "even" not in rules.KINDS:
        rules.register(rules.RuleKind("even", lambda c, p: c % int(p["by"]) != 0, "conformity", "{column} must be a multiple of {by}", {"by": "number"}))
    return checks.measure([checks.rule("even", "orders", "o_orderkey", {"by": 2}, key="even")], {"orders": _t(spark, d, "orders")}).select("key", "failed", "total")


_KINDS = [
    ("not_null", "completeness", "the rule kind not_null exists already"), ("odd", "beauty", "odd: the dimension beauty has no weight"),
]


@query(f"SELECT * FROM (VALUES {_text(_KINDS)}) v(kind, dimension, refusal)")
def rule_plugins_refused(spark, d):
    rows = []
    for kind, dimension, _ in _KINDS:
        try:
            rules.register(rules.RuleKind(kind, lambda c, p: c.isNull(), dimension, "{column}", {}))
        except ValueError as e:
            rows.append((kind, dimension, str(e)))
    return spark.createDataFrame(rows, "kind string, dimension string, refusal string")


# --- stores


_MONTHLY = _r().replace("CAST(o_orderdate AS DATE)", "CAST(date_trunc('month', o_orderdate) AS DATE)")


@query(f"WITH {_MONTHLY} SELECT {', '.join(_RESULT)} FROM r WHERE run_at <> DATE '1998-03-01' OR check_id IN ('sales.orders.status', 'sales.orders.price')")
def store_replaces_day(spark, d):
    """A run puts its day in place of the last one: checks that it does not have are gone, other days stay. The runs are monthly."""
    store = ResultStore(spark, _scratch(spark))
    rows = checks.by_day("sales.orders", _t(spark, d, "orders").withColumn(ARRIVAL, F.date_trunc("month", ARRIVAL)), ARRIVAL, _series())
    store.replace_day("check_results", rows.select(*_RESULT))
    again = rows.where((F.col("run_at") == "1998-03-01") & F.col("check_id").isin("sales.orders.status", "sales.orders.price"))
    store.replace_day("check_results", again.select(*_RESULT))
    return store.read("check_results").select(*_RESULT)


# --- databases


def _database(spark: SparkSession, d: str) -> dict:
    """Orders in a database in the shared folder, as a contract's server with a read in parts.

    The database is open in the driver's JVM, whose engine imports the files that Spark writes; one process alone may write a Derby database.
    """
    folder = _scratch(spark)
    at = urlsplit(folder).path
    url = f"jdbc:derby:{at}/orders;create=true"
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    jvm = spark.sparkContext._jvm
    written = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    orders.write.options(timestampFormat=written, timestampNTZFormat=written, timeZone=jvm.java.util.TimeZone.getDefault().getID()).csv(f"{folder}/files")
    spark.createDataFrame([], orders.schema).write.format("jdbc").options(url=url, dbtable="orders").save()
    connection = jvm.java.sql.DriverManager.getConnection(url)
    try:
        load = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, 'ORDERS', ?, NULL, NULL, 'UTF-8', 0)")
        for path in sorted(glob.glob(f"{at}/files/*.csv")):
            load.setString(1, path)
            load.execute()
    finally:
        connection.close()
    return {"type": "jdbc", "url": url, "options": {"partitionColumn": "o_orderkey", "numPartitions": "4", "fetchsize": "5000"}}


def _published(spark: SparkSession, server: dict) -> dict:
    """The server with its database shut and in an archive beside it, from which any number of JVMs read at once."""
    at = server["url"].removeprefix("jdbc:derby:").split(";")[0]
    try:
        spark.sparkContext._jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{at};shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # what Derby says once a database is shut
            raise
    with zipfile.ZipFile(f"{at}.zip", "w", zipfile.ZIP_STORED) as archive:  # stored: a page is read without what comes before it
        for path in sorted(glob.glob(f"{at}/**", recursive=True)):
            archive.write(path, os.path.relpath(path, os.path.dirname(at)))
    shutil.rmtree(at)
    shutil.rmtree(f"{os.path.dirname(at)}/files")
    return server | {"url": f"jdbc:derby:jar:({at}.zip){os.path.basename(at)}"}


@query("""SELECT o_custkey % 5 AS part, count(*) AS orders, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-03-02 00:00:00' GROUP BY 1
UNION ALL SELECT -1, count(*), CAST(round(sum(o_totalprice), 2) AS DOUBLE) FROM orders""")
def jdbc_orders(spark, d):
    """A day's orders, whose window the database applies, and all of them, read in four parts of their key."""
    read = relations.resolver(spark, _published(spark, _database(spark, d)))
    total = F.round(F.sum("o_totalprice"), 2).alias("total")
    day = relations.windowed(read("orders"), "o_orderdate", "1998-03-01")
    return day.groupBy((F.col("o_custkey") % 5).alias("part")).agg(F.count(F.lit(1)).alias("orders"), total).unionByName(read("orders").agg(F.lit(-1).cast("long").alias("part"), F.count(F.lit(1)).alias("orders"), total))


# --- the crosswalk as a stream

_FAMILY = crosswalk.Rules(golden.Entity(("name", "segment", "last"), {"crm": ("name", "segment"), "shop": ("name", "segment"), "shop.orders": ("last",)}, "crm", ("name",)), ("name",))


def _walk_inbox(spark: SparkSession, d: str) -> list[DataFrame]:
    """Four parts, in order: states of orders under shop codes that nobody knows yet, customers of the crm, customers of the shop, and decisions on held customers.

    Every fiftieth customer has the same name, so all but the first of them wait for a person.
    """
    c, k = _t(spark, d, "customer"), F.col("c_custkey")
    name = F.when(k % 50 == 0, "shared").otherwise(F.col("c_name"))

    def part(rows: DataFrame, system: str, code: str, at: int, row: Column, kind: str = "INSERT") -> DataFrame:
        place = F.concat(F.lit(code), k.cast("string"))
        return rows.select(F.lit(system).alias("system"), place.alias("code"), (k + at).alias("seq"), F.lit(kind).alias("row_kind"), (k + at).alias("source_ms"), row.alias("row"), F.lit(None).cast("string").alias("unmapped"))

    newest = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("last"))
    own = F.to_json(F.struct(name.alias("name"), F.col("c_mktsegment").alias("segment")))
    return [
        part(newest.where("c_custkey % 3 = 0"), "shop.orders", "s", 0, F.to_json(F.struct("last"))), part(c, "crm", "c", 10_000_000, own),
        part(c.where("c_custkey % 2 = 0"), "shop", "s", 20_000_000, F.to_json(F.struct(name.alias("name"), F.lit("X").alias("segment")))),
        part(c.where("c_custkey % 100 = 0 and c_custkey > 0"), "crm", "c", 30_000_000, F.lit('{"key": null}'), crosswalk.LINK),
    ]


def _walked(settled: DataFrame) -> DataFrame:
    of = settled.where("rev is not null").groupBy("key").agg(*[F.max(F.when(F.col("system") == s, F.col("code"))).alias(s) for s in ("crm", "shop")])
    cell = lambda n: F.get_json_object("record", f"$.{n}").alias(n)
    return crosswalk.records(settled).join(of, "key").select(cell("name"), cell("segment"), cell("last"), "crm", "shop")


_WALKED = """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 0 THEN 'shared' ELSE c_name END AS name, c_mktsegment AS segment, c_custkey % 50 <> 0 OR c_custkey = 0 AS alone FROM customer),
o AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS last FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1)"""


@query(f"""{_WALKED} SELECT name, segment, CASE WHEN alone AND k % 2 = 0 THEN last END AS last, 'c' || k AS crm, CASE WHEN alone AND k % 2 = 0 THEN 's' || k END AS shop
FROM c LEFT JOIN o USING (k) WHERE alone OR k % 100 = 0""")
def crosswalk_streamed(spark, d):
    """From the inbox to golden records, a part a batch: part rows wait for their owner's row, held customers for a person's decision, and both are taken again."""
    at, parts = _scratch(spark), _walk_inbox(spark, d)

    def go_on(inbox: DataFrame) -> StreamingQuery:
        settled = crosswalk.stream(inbox, _FAMILY)
        return settled.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()

    with streams.rocksdb(spark):
        _part_by_part(spark, parts, f"{at}/inbox", go_on)
    out = crosswalk.stream(spark.readStream.schema(parts[0].schema).parquet(f"{at}/inbox"), _FAMILY)
    return _walked(spark.read.schema(out.schema).parquet(f"{at}/out"))


@query(f"""{_WALKED}, h AS (SELECT 'crm' AS system, 'c' || k AS code, 'taken' AS reason FROM c WHERE NOT alone AND k % 100 <> 0 UNION ALL SELECT 'shop', 's' || k, 'taken' FROM c WHERE NOT alone
UNION ALL SELECT 'shop.orders', 's' || k, 'part' FROM o WHERE k % 2 <> 0 OR (k % 50 = 0 AND k > 0)) SELECT * FROM h""")
def crosswalk_still_held(spark, d):
    """Rows that nobody has placed: orders of customers whose shop rows never came or wait themselves, and customers of a name that others have."""
    return crosswalk.still_held(crosswalk.replay(reduce(DataFrame.unionByName, _walk_inbox(spark, d)), _FAMILY))


# --- keys and foreign keys of all days at once

_KEYS = """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS cust, o_orderkey // 2 AS parent, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders), days AS (SELECT DISTINCT m FROM o),
c AS (SELECT c_custkey, DATE '1992-01-01' + CAST(c_custkey % 2400 AS INTEGER) AS since FROM customer WHERE c_custkey % 11 <> 0),
u AS (SELECT d.m, cust, count(*) AS n FROM days d JOIN o ON o.m <= d.m GROUP BY 1, 2),
k AS (SELECT m, 'cust.unique' AS id, count(*) FILTER (WHERE n > 1) AS failed, sum(n) AS total FROM u GROUP BY 1
  UNION ALL SELECT m, 'orders.field_primary_key', sum(CASE WHEN cust IS NULL OR n > 1 THEN n ELSE 0 END), sum(n) FROM u GROUP BY 1),
f AS (SELECT d.m, o.m AS day, o.cust IS NOT NULL AND c_custkey IS NULL AS lost, p.o_orderkey IS NULL AS gone FROM days d JOIN o ON o.m <= d.m LEFT JOIN c ON c_custkey = o.cust AND since <= d.m LEFT JOIN o p ON p.o_orderkey = o.parent AND p.m <= d.m)"""


def _key_checks() -> list:
    key = checks._no_duplicates("orders.field_primary_key", "orders", "field_primary_key", ("cust",), True)
    return [checks.rule("unique", "orders", "cust", key="cust.unique"), key, checks.rule("foreign_key", "orders", "cust", {"table": "customer", "column": "c_custkey"}, key="cust.foreign_key"), checks.rule("foreign_key", "orders", "parent", {"table": "orders", "column": "o_orderkey"}, key="parent.foreign_key"), checks.rule("not_null", "orders", "cust", key="cust.not_null")]


def _keys_by_day(spark: SparkSession, d: str, mode: str) -> DataFrame:
    k, m = F.col("o_orderkey"), F.date_trunc("month", "o_orderdate").alias("m")
    orders = _t(spark, d, "orders").select("o_orderkey", F.when(k % 9 != 0, F.col("o_custkey")).alias("cust"), F.floor(k / 2).alias("parent"), m)
    since = F.expr("date_add(DATE '1992-01-01', cast(c_custkey % 2400 AS int))")
    parents = {"customer": _t(spark, d, "customer").where("c_custkey % 11 <> 0").select("c_custkey", since.alias("since")), "orders": orders}
    rows = checks.by_day("sales", orders, "m", _key_checks(), mode, parents, {"customer": "since", "orders": "m"})
    return rows.select("run_at", F.substring("check_id", 7, 99).alias("check_id"), "failed_rows", "total_rows", "status")


@query(f"""{_KEYS}, a AS (SELECT * FROM k UNION ALL SELECT m, 'cust.foreign_key', count(*) FILTER (WHERE lost), count(*) FROM f GROUP BY 1 UNION ALL SELECT m, 'parent.foreign_key', count(*) FILTER (WHERE gone), count(*) FROM f GROUP BY 1
  UNION ALL SELECT d.m, 'cust.not_null', count(*) FILTER (WHERE cust IS NULL), count(*) FROM days d JOIN o ON o.m <= d.m GROUP BY 1)
SELECT m AS run_at, id AS check_id, CAST(failed AS BIGINT) AS failed_rows, CAST(total AS BIGINT) AS total_rows, CASE WHEN failed > 0 THEN 'fail' ELSE 'pass' END AS status FROM a""")
def keys_by_day_cumulative(spark, d):
    """Keys and foreign keys of every month and all before it, one parent being the table itself."""
    return _keys_by_day(spark, d, "cumulative")


@query(f"""{_KEYS}, a AS (SELECT * FROM k UNION ALL SELECT m, 'cust.foreign_key', count(*) FILTER (WHERE lost), count(*) FROM f WHERE day = m GROUP BY 1 UNION ALL SELECT m, 'parent.foreign_key', count(*) FILTER (WHERE gone), count(*) FROM f WHERE day = m GROUP BY 1
  UNION ALL SELECT m, 'cust.not_null', count(*) FILTER (WHERE cust IS NULL), count(*) FROM o GROUP BY 1)
SELECT m AS run_at, id AS check_id, CAST(failed AS BIGINT) AS failed_rows, CAST(total AS BIGINT) AS total_rows, CASE WHEN failed > 0 THEN 'fail' ELSE 'pass' END AS status FROM a""")
def keys_by_day_incremental(spark, d):
    """A month's own rows against the parents that were there by then; keys are of all rows up to it."""
    return _keys_by_day(spark, d, "incremental")


@query("""WITH o AS (SELECT o_orderkey, o_orderkey // 2 AS parent, o_orderkey % 5 = 0 AS today FROM orders WHERE o_orderkey % 7 <> 0)
SELECT count(*) FILTER (WHERE p.o_orderkey IS NULL) AS failed, count(*) AS total FROM o LEFT JOIN o p ON p.o_orderkey = o.parent WHERE o.today""")
def rule_foreign_key_to_itself(spark, d):
    """Children of the day only, parents of the whole table, which is the same one."""
    orders = _t(spark, d, "orders").where("o_orderkey % 7 <> 0").withColumn("parent", F.floor(F.col("o_orderkey") / 2))
    check = checks.rule("foreign_key", "orders", "parent", {"table": "orders", "column": "o_orderkey"}, key="parent")
    return checks.measure([check], {"orders": orders.where("o_orderkey % 5 = 0")}, {"orders": orders}).select("failed", "total")


@query(f"""WITH {_MONTHLY}, k AS (SELECT * FROM r WHERE run_at < DATE '1996-01-01'), n AS (SELECT run_at, check_id, CASE WHEN run_at = DATE '1995-05-01' THEN failed_rows + 1000 ELSE failed_rows END AS failed_rows FROM k WHERE run_at <> DATE '1995-03-01')
SELECT run_at, count(*) AS checks, CAST(sum(failed_rows) AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE failed_rows > 0) AS BIGINT) AS statuses FROM n GROUP BY 1""")
def store_runs_whole(spark, d):
    """Runs of months: one is run again with other rows, one again without any, and one breaks before its tables are all written; each shows as its last whole run left it."""
    store = RunStore(spark, _scratch(spark))
    rows = checks.by_day("sales.orders", _t(spark, d, "orders").withColumn(ARRIVAL, F.date_trunc("month", ARRIVAL)).where(F.col(ARRIVAL) < "1996-01-01"), ARRIVAL, _series()).select(*_RESULT).persist()
    of = lambda df: {"check_results": df, "check_status": df.where("failed_rows > 0").select("run_at", "check_id")}
    months = [str(r.run_at) for r in rows.select("run_at").distinct().orderBy("run_at").collect()]
    for m in months:  # of a year
        store.commit(m, "incremental", "sales.orders", of(rows.where(F.col("run_at") == m)))
    again = rows.where("run_at = '1995-05-01'").withColumn("failed_rows", F.col("failed_rows") + 1000)
    store.commit("1995-05-01", "incremental", "sales.orders", of(again))
    store.commit("1995-03-01", "incremental", "sales.orders", of(rows.limit(0)))
    try:
        store.commit("1995-04-01", "incremental", "sales.orders", {"check_results": rows.limit(1), "check_status": rows.select(F.raise_error(F.lit("broken")))})
    except PySparkException:
        pass
    rows.unpersist()
    told = store.read("check_status").groupBy("run_at").agg(F.count(F.lit(1)).alias("statuses"))
    found = store.read("check_results").groupBy("run_at").agg(F.count(F.lit(1)).alias("checks"), F.sum("failed_rows").alias("failed"))
    return found.join(told, "run_at", "left").na.fill(0, ["statuses"])


@query(f"""WITH {_r()}, w AS (SELECT check_id, run_at, status FROM r) SELECT check_id, arg_max(status, run_at) AS status, max(run_at) AS run_at FROM w GROUP BY 1""")
def store_last_word(spark, d):
    """Statuses are appended; of each check the last word counts."""
    store = ResultStore(spark, _scratch(spark))
    rows = _results(spark, d).select("check_id", "run_at", "status")
    store.append("check_status", rows.where(F.col("run_at") < DAY))
    store.append("check_status", rows.where(F.col("run_at") >= DAY))
    return store.last_word("check_status", ["check_id"], "run_at")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' GROUP BY 1")
def store_prune(spark, d):
    """Rows older than a moment are dropped from a store."""
    store = ResultStore(spark, _scratch(spark))
    store.append("inbox", _t(spark, d, "events").select("event_type", "ts"))
    store.prune("inbox", "ts", "2024-01-02")
    return store.read("inbox").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name || '!' AS c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 <> 0")
def store_upsert(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_name")
    return upserted(c, c.where("c_custkey % 2 = 0").withColumn("c_name", F.concat("c_name", F.lit("!"))), ["c_custkey"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 5")
def land_raw(spark, d):
    """A load lands in place of the last one."""
    path = _scratch(spark)
    rows = _t(spark, d, "nation").select("n_nationkey", "n_name")
    land(rows, path)
    land(rows.where("n_nationkey < 5"), path)
    return spark.read.parquet(path)


# --- contracts and flows from files, and what is refused


@query("SELECT * FROM (VALUES ('crm.customer', 'contract'), ('sales.orders', 'contract'), ('orders_to_hub', 'flow')) v(id, kind)")
def loaded_from_files(spark, d):
    """Contracts and flows of a folder, in order of file names."""
    contract = lambda c: {"id": c.id, "schema": [{"name": m.name, "properties": [{"name": p.name, "physicalType": p.type} for p in m.properties]} for m in c.models]}
    with tempfile.TemporaryDirectory() as folder:  # read on the driver
        for c in (ORDERS, CUSTOMERS):
            Path(folder, f"{c.id}.odcs.yaml").write_text(yaml.safe_dump(contract(c)), encoding="utf-8")
        Path(folder, "flows").mkdir()
        Path(folder, "flows", "sync.yaml").write_text(yaml.safe_dump({"id": FLOW.id, "from": FLOW.source, "to": FLOW.target, "columns": dict(FLOW.columns)}), encoding="utf-8")
        rows = [(c.id, "contract") for c in contracts.load_all(folder)] + [(f.id, "flow") for f in flows.load_all(f"{folder}/flows")]
    return spark.createDataFrame(rows, "id string, kind string")


def _contract(name: str, columns: str, **more) -> contracts.Contract:
    """A contract of one table; columns are names, with * for a key, ! for required and # for classified."""
    properties = [{"name": c.strip("*!#"), "physicalType": "bigint", "primaryKey": "*" in c, "required": "!" in c, **({"classification": "pii"} if "#" in c else {})} for c in columns.split()]
    return contracts.parse({"id": name, "schema": [{"name": name.split(".")[1], "properties": properties}], **more})


def _flow(**parts) -> flows.Flow:
    return flows.parse({"id": "f", "from": "a.s", "to": "b.t", **parts})


_SOURCE, _TARGET = _contract("a.s", "id* x secret#"), _contract("b.t", "id*! y! secret")
_REFUSED = [
    ("aggregate", "f: total must be one of sum, count, min, max, avg of a column"), ("aggregate", "f: nothing says what the rows are grouped by"),
    ("gap", "f: nothing fills y, which t needs"), ("job", "f: no job setting is called speed"), ("job", "f: rowsPerSecond must be between 1 and 1000000"),
    ("link", "f: links by z, which it does not carry"), ("mapping", "f: y has a value map but no source column"), ("mapping", "f: z is not a column of t"), ("mapping", "f: secret is classified pii, secret is not"),
    ("match", "f: matches x, which is not in the key of s"), ("match", "f: the key column id of s is neither matched nor mapped"), ("pair", "g: y does not come back"),
    ("replica", "s: the replica lacks the key column id"), ("replica", "s: the filter uses x, which is not in the key"), ("set", "f: no contract describes lost.t"),
    ("source", "crm.customer: is derived from lost.source, which nobody knows"), ("view", "s: oracle tables cannot be shown as views"), ("view", "s: secret is classified and would be shown"),
]


@query(f"SELECT * FROM (VALUES {_text(_REFUSED)}) v(about, sentence)")
def refusals(spark, d):
    """What is refused about flows, replicas and views before anything runs, a sentence each."""
    source, target = _SOURCE.models[0], _TARGET.models[0]
    return _sentences(spark, {
        "mapping": flows.mapping_problems(_flow(columns={"id": "id", "z": "x", "secret": "secret"}, values={"y": {"1": "2"}}), source, target),
        "gap": flows.gaps(_flow(columns={"id": "id"}), target), "job": flows.job_problems(_flow(job={"speed": 1, "rowsPerSecond": 0})),
        "match": flows.match_problems(_flow(match={"x": 1}), source), "pair": flows.pair_problems(_flow(columns={"id": "id", "y": "x"}), flows.parse({"id": "g", "from": "b.t", "to": "a.s", "columns": {"id": "id"}})),
        "aggregate": flows.aggregate_problems(_flow(aggregates={"total": "median(x)"}), source), "link": flows.link_problems(_flow(columns={"id": "id"}, linkBy=["z"]), target, {}),
        "replica": flows.replication_problems(source, ["x"], ["x"]), "view": flows.view_problems(source, ["secret"], "oracle"), "source": flows.unresolved([ORDERS, CUSTOMERS]),
        "set": flows.problems([flows.parse({"id": "f", "from": "a.s", "to": "lost.t"})], [_SOURCE, _TARGET]),
    })


@query("SELECT * FROM (VALUES ('b: no table is the authority'), ('b: the record has no key'), ('f: nothing can be written to the API behind b.t'), ('f: the API of a.s does not say its changedAt')) v(sentence)")
def refusals_hub_and_api(spark, d):
    hub = contracts.parse({"id": "b", "schema": [{"name": "t", "properties": [{"name": "id", "physicalType": "bigint"}]}], "customProperties": [{"property": "hub", "value": {"keys": {}}}]})
    lists = _contract("a.s", "id*", servers=[{"server": "x", "type": "api", "contentField": "rows"}])
    listed = _contract("b.t", "id*", customProperties=[{"property": "hub", "value": {}}])
    written = _contract("b.t", "id*", servers=[{"server": "x", "type": "api"}])
    found = flows.hub_problems(hub, []) + flows.api_problems(_flow(), lists, listed) + flows.api_problems(_flow(), None, written)
    return spark.createDataFrame([(s,) for s in found], "sentence string")


@query("SELECT * FROM (VALUES ('orders: o_comment is gone'), ('orders: o_custkey is int, not bigint')) v(sentence)")
def schema_drift(spark, d):
    """How a live table differs from what its contract declares."""
    live = _t(spark, d, "orders").withColumn("o_custkey", F.col("o_custkey").cast("int"))
    return spark.createDataFrame([(s,) for s in flows.drift(ORDERS.model("orders"), live)], "sentence string")


@query("SELECT * FROM (VALUES (false, false, true, 'fresh'), (true, false, true, 'resume'), (true, true, true, 'refuse'), (true, false, false, 'refuse')) v(checkpoint, drifted, log_reaches_back, action)")
def flow_resume(spark, d):
    cases = [(False, False, True), (True, False, True), (True, True, True), (True, False, False)]
    return spark.createDataFrame([(c, x, r, flows.resume(c, ["x is gone"] if x else [], r)) for c, x, r in cases], "checkpoint boolean, drifted boolean, log_reaches_back boolean, action string")


@query(f"WITH {_r()} SELECT 'sales.orders: o_orderstatus must be one of O, F failed on ' || max(run_at) AS problem FROM r WHERE check_id = 'sales.orders.status' AND run_at = (SELECT max(run_at) FROM r) AND status = 'fail' HAVING count(*) > 0")
def identity_unsound(spark, d):
    """A key whose newest uniqueness check failed cannot identify rows; the status rule stands in for one."""
    rows = _results(spark, d).withColumn("check_type", F.when(F.col("check_id") == "sales.orders.status", "field_unique").otherwise(F.col("check_type")))
    return spark.createDataFrame([(p,) for p in [flows.identity_problem(rows, "sales.orders")] if p], "problem string")


@query("""SELECT 'c' || c_custkey AS contract, CASE WHEN c_custkey % 5 = 0 THEN 't' || c_custkey || ', lineitem still being copied, nothing replicates' WHEN c_custkey % 7 = 0 THEN 'the apply job is not running' WHEN c_custkey % 11 = 0 THEN 'the source cannot be reached' END AS problem
FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0""")
def replication_status(spark, d):
    """Statuses of customers' replications, some of which do not tell whether they run."""
    k = F.col("c_custkey")
    copying = F.when(k % 5 == 0, F.array(F.concat(F.lit("t"), k.cast("string")), F.lit("lineitem")))
    running, reachable = F.when(k % 2 == 0, True), F.when(k % 3 == 0, True)
    rows = _t(spark, d, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("contract"), copying.alias("copying"), F.when(k % 7 == 0, False).otherwise(running).alias("streaming"), F.when(k % 11 == 0, False).otherwise(reachable).alias("reachable"))
    return streams.replication_problems(rows)


@query("SELECT since, since IS NULL OR since < (SELECT min(event_id) FROM events) - 1 AS resnapshot FROM (VALUES (NULL::BIGINT), (-5), (0), (1000)) v(since)")
def log_retention(spark, d):
    """A reader whose position the log no longer holds must begin anew."""
    log = _t(spark, d, "events").select(F.col("event_id").alias("lsn"))
    return spark.createDataFrame([(s, relations.must_resnapshot(log, s)) for s in (None, -5, 0, 1000)], "since long, resnapshot boolean")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def snapshot_then_changes(spark, d):
    """What lies in a folder is the snapshot, what arrives later the changes; one stream reads both, once."""
    folder, out = _scratch(spark), _scratch(spark)
    events = _t(spark, d, "events").select("event_id", "event_type")

    def read() -> None:
        rows = relations.snapshot_then_changes(spark, folder, events.schema)
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}/.at").trigger(availableNow=True).start().awaitTermination()

    events.where("event_id % 3 <> 0").write.parquet(folder)
    read()
    events.where("event_id % 3 = 0").write.mode("append").parquet(folder)
    read()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _run_dry(stream: DataFrame, at: str) -> StreamingQuery:
    """Start a stream into a folder, let it take what is there, batch by batch, and stop it."""
    q = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/progress").trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return q


@query("""WITH n AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IS NOT NULL), last AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS v, max(o_orderkey) AS lsn, bool_or(o_orderkey % 7 = 0 AND o_orderkey = m) AS gone
FROM n JOIN (SELECT o_custkey, max(o_orderkey) AS m FROM n GROUP BY 1) USING (o_custkey) GROUP BY 1)
SELECT c_custkey, coalesce(v, c_acctbal) AS balance, lsn AS changed_at, true AS in_small_batches FROM customer LEFT JOIN last ON o_custkey = c_custkey WHERE gone IS NOT true
UNION ALL SELECT o_custkey, v, lsn, true FROM last WHERE NOT gone AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def log_replicated(spark, d):
    """A replica from a snapshot of customers and a log in which each order sets its customer's balance and every seventh deletes the customer; the stream takes a sixth of the log a batch and is stopped and started halfway."""
    at = _scratch(spark)
    _t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance")).write.parquet(f"{at}/table")
    op = F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(4).cast("int").alias("op")
    log = _t(spark, d, "orders").where("o_custkey is not null").select(op, F.col("o_orderkey").alias("lsn"), F.lit(0).cast("long").alias("seq"), F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("balance"))
    rows, first, middle = log.agg(F.count(F.lit(1)), F.min("lsn"), F.percentile_approx("lsn", 0.5)).first()
    most = max(1, rows // 6)
    flow = replace(FLOW, job={"rowsPerSecond": most, "checkpointInterval": 1000})
    # The snapshot is taken at a position that the log has: one of a row that tells of nothing.
    mark = spark.range(1).select(F.lit(0).alias("op"), F.lit(-1 if first is None else first - 1).cast("long").alias("lsn"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("long").alias("c_custkey"), F.lit(None).cast("double").alias("balance"))
    mark.write.parquet(f"{at}/log")

    def run(more: DataFrame | None = None) -> list[int]:
        if more is not None:
            more.repartitionByRange(4, "lsn").write.mode("append").parquet(f"{at}/log")
        read = streams.change_log(spark, f"{at}/table", f"{at}/log", "c_custkey long, balance double", f"{at}/positions", flow)
        return [p.numInputRows for p in _run_dry(read, at).recentProgress]

    run()
    told = run(log.where(F.col("lsn") <= middle)) + run(log.where(F.col("lsn") > middle))
    now = cdc.replica(spark.read.parquet(f"{at}/rows").where("op > 0"), ["c_custkey"])
    return now.select("c_custkey", "balance", F.when(F.col("op") != 2, F.col("lsn")).alias("changed_at"), F.lit(max(told, default=0) <= most and sum(told) == rows).alias("in_small_batches"))


# --- failing rows of written SQL, profiles of all rows up to a day


@query("""SELECT 'joined' AS of, o_orderkey, o_custkey, NULL AS c_name, '•••' AS secret FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0
UNION ALL SELECT 'grouped', count(*), NULL, NULL, NULL FROM orders WHERE false UNION ALL SELECT 'named', o_orderkey, o_custkey, NULL, '•••' FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice < 0 OR c_custkey IS NULL""")
def sample_written_sql(spark, d):
    """All rows that written checks count, their classified columns masked, in whatever column a subquery puts them; a check of groups shows none."""
    rows = {}
    with checks.named({n: _t(spark, d, n) for n in ("orders", "customer")}):
        for of, text in {
            "joined": "SELECT count(*) FROM orders o JOIN (SELECT c_custkey, upper(c_name) AS secret, c_acctbal FROM customer) c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal < 0",
            "named": "WITH c AS (SELECT c_custkey, c_name AS secret FROM customer) SELECT count(o_orderkey) FROM orders LEFT JOIN c ON o_custkey = c_custkey WHERE o_totalprice < 0 OR c_custkey IS NULL",
            "grouped": "SELECT o_custkey, count(*) FROM orders WHERE o_totalprice > 0 GROUP BY 1",
        }.items():
            rows[of] = sample.failing_rows_of(spark.sql(text), ["c_name"], n=None)
    none = F.lit(None).cast("string")
    shown = [df.select(F.lit(of).alias("of"), "o_orderkey", "o_custkey", none.alias("c_name"), "secret") for of, df in rows.items() if df is not None]
    refused = spark.range(1).select(F.lit("grouped").alias("of"), F.lit(0).cast("long").alias("o_orderkey"), F.lit(None).cast("long").alias("o_custkey"), none.alias("c_name"), none.alias("secret"))
    return reduce(DataFrame.unionByName, shown + ([refused] if rows["grouped"] is None else []))


_PROFILED = ["user_id", "event_type", "value", "props"]
_UNTIL = " UNION ALL ".join(f"""SELECT run_at, 'events' AS table_name, '{c}' AS column_name, CAST(sum(n) OVER w AS BIGINT) AS rows, CAST(sum(missing) OVER w AS BIGINT) AS nulls, CAST(sum(new) OVER w AS BIGINT) AS distinct_count
FROM (SELECT CAST(ts AS DATE) AS run_at, count(*) AS n, count(*) - count({c}) AS missing FROM events GROUP BY 1) JOIN (SELECT CAST(ts AS DATE) AS run_at, count(DISTINCT CASE WHEN CAST(ts AS DATE) = f THEN {c} END) AS new FROM events LEFT JOIN (SELECT {c}, min(CAST(ts AS DATE)) AS f FROM events GROUP BY 1) USING ({c}) GROUP BY 1) USING (run_at) WINDOW w AS (ORDER BY run_at)""" for c in _PROFILED)


@query(_UNTIL)
def profile_until_day(spark, d):
    """The exact profile of all rows up to each day."""
    return profile.cumulative_exact(_t(spark, d, "events"), _PROFILED, "events", "ts")


@query(f"SELECT run_at, table_name, column_name, rows, nulls, true AS near FROM ({_UNTIL})")
def profile_until_day_sketched(spark, d):
    """The same from stored sketches of single days; a distinct count is near if it is within six standard errors of the exact one."""
    at, events = _scratch(spark), _t(spark, d, "events")
    profile.sketches(events, _PROFILED, "events", "ts").write.partitionBy("run_at").parquet(at)
    told = profile.cumulative(spark.read.parquet(at))
    exact = profile.cumulative_exact(events, _PROFILED, "events", "ts").select("run_at", "column_name", "distinct_count")
    near = F.abs(F.col("distinct_estimate") - F.col("distinct_count")) <= 6 * F.col("standard_error") * F.col("distinct_count")
    return told.join(exact, ["run_at", "column_name"]).select("run_at", "table_name", "column_name", "rows", "nulls", near.alias("near"))


# --- deliveries


@query("""WITH t AS (SELECT c_custkey, c_name, CASE c_custkey % 4 WHEN 3 THEN 'link twice ' || (c_custkey // 8) ELSE 'link ' || c_custkey END AS c_phone FROM customer), n AS (SELECT *, count(*) OVER (PARTITION BY c_phone) AS hits FROM t)
SELECT c_custkey, c_phone, CASE WHEN c_custkey % 4 = 0 THEN 'by key ' || c_custkey WHEN c_custkey % 4 = 1 THEN 'by link ' || c_custkey WHEN c_custkey % 4 = 3 AND hits = 1 THEN 'to two ' || c_custkey ELSE c_name END AS c_name,
CASE WHEN c_custkey % 4 < 2 OR c_custkey % 4 = 3 AND hits = 1 THEN 'update' END AS action FROM n""")
def merge_by_link(spark, d):
    """A row takes one delivery: that of its key before those by link, of these the newest; a link that two rows share finds none."""
    c = _t(spark, d, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey")
    # Of four customers, the first is delivered by key and by link at once, the second by link twice, the last by a link that it shares with another one.
    link = F.when(k % 4 == 3, F.concat(F.lit("link twice "), F.floor(k / 8))).otherwise(F.concat(F.lit("link "), k))
    target = c.withColumn("c_phone", link)
    row = lambda key, name: F.struct(key.alias("c_custkey"), F.concat(F.lit(name), k).alias("c_name"), link.alias("c_phone"))
    none = F.lit(None).cast("long")
    rows = F.when(k % 4 == 0, F.array(row(k, "by key "), row(none, "an other "))).when(k % 4 == 1, F.array(row(none, "by link "), row(none, "and again "))).when(k % 4 == 3, F.array(row(none, "to two "))).otherwise(F.array().cast("array<struct<c_custkey:bigint,c_name:string,c_phone:string>>"))
    told = target.select(F.inline(rows)).withColumn("_changed", F.lit(",c_name,")).withColumn("_link", F.lit(True)).withColumn("rev", F.when(F.col("c_name").startswith("by"), 2).otherwise(1))
    return deliver.merge(target, told, ["c_custkey"], ["c_name", "c_phone"], link_by=["c_phone"], order="rev").withColumnRenamed("_action", "action")


@query("SELECT count(*) FILTER (WHERE c_custkey % 3 <> 0 OR c_custkey % 2 <> 0) AS present, count(*) FILTER (WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0) AS emptied FROM customer")
def matches_split(spark, d):
    """Rows with any of a match flow's fields are written, rows without all of them are deletions."""
    k = F.col("c_custkey")
    c = _t(spark, d, "customer").select(F.when(k % 3 != 0, F.col("c_name")).alias("a"), F.when(k % 2 != 0, F.col("c_phone") if "c_phone" in _t(spark, d, "customer").columns else k).alias("b"))
    present, emptied = deliver.split_matches(c, ["a", "b"])
    return present.agg(F.count(F.lit(1)).alias("present")).crossJoin(emptied.agg(F.count(F.lit(1)).alias("emptied")))  # one row each


@query(f"WITH {_LOG} SELECT seq, k AS user_id FROM it WHERE action = 'delete' ORDER BY seq DESC, part DESC LIMIT 50")
def recent_deletions(spark, d):
    """The last 50 deletions of a replica."""
    gone = _intents(spark, d).where("action = 'delete'").select("seq", "part", F.col("_key.user_id").alias("user_id"))
    return agreement.newest(gone, ["seq", "part"], 50).select("seq", "user_id")


@query("SELECT run_at, failed_rows FROM (SELECT CAST(o_orderdate AS DATE) AS run_at, count(*) FILTER (WHERE NOT (o_orderstatus IN ('O', 'F'))) AS failed_rows FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 60) ORDER BY 1")
def check_history(spark, d):
    """A check's last 60 runs, the oldest first."""
    rows = _results(spark, d).where("check_id = 'sales.orders.status'").select("run_at", "failed_rows")
    return agreement.newest(rows, ["run_at"], 60).orderBy("run_at")


# --- golden records: a small inbox by hand

_INBOX = [
    ("1", 1, "crm", "INSERT", 1_000, {"name": "Ada", "tier": "gold"}), ("1", 2, "shop", "INSERT", 2_000, {"name": "Ada", "city": "Oslo"}), ("1", 3, "crm", "UPDATE_AFTER", 5_000, {"name": "Eva", "tier": "gold"}),
    ("1", 4, "shop", "UPDATE_AFTER", 4_000, {"name": "Ida", "city": "Oslo"}), ("2", 5, "shop", "INSERT", 1_000, {"name": "Bo", "city": "Rome"}), ("2", 6, "billing", "DELETE", 9_000, {"name": "Bo", "city": "Rome", "tier": None}),
    ("3", 7, "billing", "INSERT", 1_000, {"name": "Cy", "city": "Bonn", "tier": "new"}), ("3", 8, "crm", "UPDATE_AFTER", 1_500, {"name": "Cy", "tier": "new"}), ("3", 9, "crm", "UPDATE_BEFORE", 2_000, {"name": "Cy", "tier": "new"}), ("3", 10, "crm", "UPDATE_AFTER", 2_000, {"name": "Cy", "tier": "old"}),
]
_DECIDED = [(1, "created"), (2, "applied"), (3, "applied"), (4, "lost"), (5, "created"), (6, "deleted"), (7, "created"), (8, "echo"), (9, "before"), (10, "applied")]


def _small_inbox(spark: SparkSession, d: str, more: Sequence[tuple] = ()) -> DataFrame:
    """The rows above for every customer, whose records are named by its key."""
    import json

    cells = [F.struct(*[F.lit(v).alias(n) for v, n in zip((r[0], r[1], r[2], r[3], r[4], json.dumps(r[5])), ("of", "seq", "system", "row_kind", "source_ms", "row"), strict=True)]) for r in [*_INBOX, *more]]
    rows = _t(spark, d, "customer").select("c_custkey", F.inline(F.array(*cells)))
    return rows.select(F.concat_ws("-", "c_custkey", "of").alias("key"), F.col("seq").cast("long").alias("seq"), "system", "row_kind", F.col("source_ms").cast("long").alias("source_ms"), "row", F.lit(None).cast("string").alias("unmapped"))


_ENTITY = golden.Entity(("name", "city", "tier"), {"crm": ("name", "tier"), "billing": None, "shop": ("name", "city")}, "crm", ("name",))


@query(f"SELECT c_custkey || '-' || CASE {' '.join(f'WHEN CAST(seq AS INTEGER) = {r[1]} THEN {r[0]!r}' for r in _INBOX)} END AS key, CAST(seq AS BIGINT) AS seq, outcome FROM customer, (VALUES {_text(_DECIDED)}) v(seq, outcome)")
def golden_small_inbox(spark, d):
    """An edit wins by its commit time, an echo of a delivery is none, a full deletion ends a record."""
    return golden.replay(_small_inbox(spark, d), _ENTITY).select("key", "seq", "outcome")


@query("SELECT c_custkey || '-' || of AS key, name, city, tier FROM customer, (VALUES ('1', 'Eva', 'Oslo', 'gold'), ('3', 'Cy', 'Bonn', 'old')) v(of, name, city, tier)")
def golden_small_records(spark, d):
    kept = golden.golden_records(golden.replay(_small_inbox(spark, d), _ENTITY))
    return kept.select("key", F.json_tuple("record", "name", "city", "tier").alias("name", "city", "tier"))


@query("SELECT r.c_custkey AS held, g.c_custkey AS key FROM customer r JOIN customer g ON g.c_nationkey = r.c_nationkey AND g.c_mktsegment = r.c_mktsegment AND g.c_acctbal = r.c_acctbal")
def held_candidates(spark, d):
    """The records that a held row might be, by equal link columns."""
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    links = ["c_nationkey", "c_mktsegment", "c_acctbal"]
    return golden.candidates(c.withColumnRenamed("c_custkey", "held"), c.withColumnRenamed("c_custkey", "key"), links).select("held", "key")


# --- catalogue and expressions


@query("SELECT c_mktsegment AS domain, string_agg('t' || c_custkey, ',' ORDER BY 't' || c_custkey) AS tables FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1")
def tables_by_domain(spark, d):
    """Customers' tables by the domain of their contract; some contracts are unknown."""
    rows = _catalogued(spark, d)
    found = catalog.tables_by_domain(rows, rows.where("c_custkey % 5 <> 0").select("contract_id", "domain"))
    return found.select("domain", F.array_join("tables", ",").alias("tables"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment FROM customer")
def golden_lookup_table(spark, d):
    """Golden records as text, without bookkeeping and classified columns."""
    return catalog.lookup_table(_t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.lit(1).alias("_rev")), ["c_name"])


_N = "CAST(100000000 + c_custkey * 7919 % 800000000 AS VARCHAR)"
_D = ", ".join(f"CAST(substr(n, {i}, 1) AS INTEGER) AS d{i}" for i in range(1, 10))


@query(f"""WITH a AS (SELECT c_custkey, {_N} AS n FROM customer), b AS (SELECT c_custkey, n, {_D} FROM a),
c AS (SELECT *, (((d1 + d3 + d5 + d7 + d9) * 7 - (d2 + d4 + d6 + d8)) % 10 + 10) % 10 AS d10 FROM b), e AS (SELECT *, (d1 + d2 + d3 + d4 + d5 + d6 + d7 + d8 + d9 + d10) % 10 AS d11 FROM c)
SELECT c_custkey, c_custkey % 3 <> 0 AS valid FROM e""")
def citizen_number_check(spark, d):
    """Numbers with both check digits, a third of them with the last one off."""
    n = (F.lit(100_000_000) + F.col("c_custkey") * 7919 % 800_000_000).cast("string")
    digit = [F.substring(n, i, 1).cast("int") for i in range(1, 10)]
    tenth = F.pmod(sum(digit[::2]) * 7 - sum(digit[1::2]), F.lit(10))
    last = (sum(digit) + tenth + F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0)) % 10
    number = F.concat(n, tenth.cast("string"), last.cast("string"))
    return _t(spark, d, "customer").select("c_custkey", expressions.is_citizen_number(number).alias("valid"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 7.0 WHEN 1 THEN 1.0 / 24 WHEN 2 THEN 365.0 WHEN 3 THEN 1.0 END * (c_custkey % 40) AS days FROM customer""")
def service_periods(spark, d):
    """Periods of customers in units of several spellings; a month and no unit are unknown."""
    k = F.col("c_custkey")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("w", "Hours", " year ", "day", "month", None)]), (k % 6 + 1).cast("int"))
    return _t(spark, d, "customer").select("c_custkey", expressions.period_days((k % 40).cast("string"), unit).alias("days"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'SCHEMA_CHANGE' WHEN event_id % 4 = 0 THEN 'FRESHNESS_ANOMALY' WHEN event_id % 4 = 1 THEN 'VOLUME_ANOMALY' ELSE 'ASSERTION' END AS category FROM events""")
def check_categories(spark, d):
    """Events as checks of several types and dimensions, some without one."""
    k, kind = F.col("event_id"), F.col("event_type")
    check_type = F.when(kind == "click", "field_type").when(kind == "view", "field_is_present").when(kind == "error", "field_unique").otherwise("sql")
    dimension = F.when(k % 4 == 0, "timeliness").when(k % 4 == 1, "coverage").when(k % 4 == 2, "uniqueness")
    return _t(spark, d, "events").select("event_id", expressions.check_category(check_type, dimension).alias("category"))


@query(f"WITH {_r()} SELECT CAST(DATE '{DAY}' AS VARCHAR) AS day, count(DISTINCT check_id) AS failing FROM r WHERE run_at = DATE '{DAY}' AND status = 'fail'")
def alert_of_day(spark, d):
    """The day's alert: its first line and how many checks it is about; there is none without anything to say."""
    rows = _results(spark, d).where(F.col("run_at") == DAY)
    failing = rows.where("status = 'fail'").select("contract_id", F.col("check_id").alias("name"))
    none = spark.createDataFrame([], "contract_id string, score double, sla_min double, checks_errored long")
    told = scoring.message(DAY, 1, none, failing)
    quiet = scoring.message(DAY, 1, none, failing.limit(0))
    if quiet is not None:
        raise ValueError("a quiet day has an alert")
    n = 0 if told is None else told.count("sales.orders.") + int((told.split("(+") + ["0 "])[1].split(" ")[0] if "(+" in told else 0)
    return spark.createDataFrame([(DAY, n)], "day string, failing long")


@query(f"WITH {_r()} SELECT check_id, failed_rows FROM r WHERE run_at = DATE '{DAY}' AND check_id <> 'sales.orders.price' UNION ALL SELECT 'sales.orders.price', 7 FROM (SELECT 1)")
def second_pass(spark, d):
    """What a second pass measured anew stands in place of the first pass's rows."""
    first = _results(spark, d).where(F.col("run_at") == DAY).select("check_id", "failed_rows")
    again = spark.createDataFrame([("sales.orders.price", 7)], "check_id string, failed_rows long")
    return checks.replaced_by_key(first, again)


# --- the life of a crosswalk

_WALK = golden.Crosswalk({"shop": "code"}, ("name",), ("name",))


def _walk(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows of a shop, golden records, what the shop was sent, and tombstones. The shop's codes are the customers' keys with a minus.

    Rows of deleted records also have the name of a record that is there (k % 12 = 5), codes
    are of two deleted records of which the smaller key was deleted last, some deliveries are
    too old, and some rows that answer one lack their name.
    """
    k, c = F.col("c_custkey"), _t(spark, d, "customer")
    name = F.when(k % 4 == 0, "shared").otherwise(F.col("c_name"))
    said = F.when(k % 12 == 5, F.format_string("Customer#%09d", k - 2)).otherwise(name)
    rows = c.select((-k).alias("code"), F.when(k % 10 != 0, said).alias("name"), F.col("c_mktsegment").alias("segment"), F.when(k % 7 == 0, "DELETE").otherwise("INSERT").alias("row_kind"), (k * 1000 + golden.EXPECT_MS).alias("ms"))
    records = c.where("c_custkey % 6 <> 5").select(k.alias("key"), F.when(k % 3 == 0, -k).alias("code"), name.alias("name"))
    sent = c.where("c_custkey % 8 = 4").select(k.alias("key"), F.when(k % 5 == 1, k * 1000 - 1).otherwise(k * 1000 + 1).alias("ms"), F.inline(F.array(F.struct(F.lit("name").alias("field"), name.alias("value")), F.struct(F.lit("code2").alias("field"), k.cast("string").alias("value")))))
    gone = c.where("c_custkey % 6 = 5 and c_custkey % 4 <> 0").select((-k).alias("code"), F.inline(F.array(F.struct((k + 1_000_000_000).alias("key"), F.lit(9).alias("deleted_ms")), F.struct((k + 2_000_000_000).alias("key"), F.lit(5).alias("deleted_ms")))))
    return rows.withColumn("code2", (-F.col("code")).cast("string")), records, sent, gone


# Placing by the rules, in their order: known code; deleted record's code; the link, unless part or unmatchable; an awaited delivery; a deletion is only of what is known.
_CW = """w AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'shared' ELSE c_name END AS n FROM customer),
r AS (SELECT -k AS code, CASE WHEN k % 10 <> 0 THEN CASE WHEN k % 12 = 5 THEN printf('Customer#%09d', k - 2) ELSE n END END AS name, k, k % 7 = 0 AS del FROM w),
g AS (SELECT k AS key, CASE WHEN k % 3 = 0 THEN -k END AS code, n AS name FROM w WHERE k % 6 <> 5),
l AS (SELECT name, count(*) AS c, min(key) AS one, bool_or(code IS NOT NULL) AS taken FROM g GROUP BY 1),
a AS (SELECT r.code, r.k AS key FROM r JOIN g ON g.key = r.k WHERE r.k % 8 = 4 AND r.k % 5 <> 1 AND g.code IS NULL AND r.name IS NOT NULL),
x AS (SELECT r.code, del, q.key AS known, CASE WHEN r.k % 6 = 5 AND r.k % 4 <> 0 THEN r.k + 1000000000 END AS gone, a.key AS answers, one,
  CASE WHEN r.name IS NULL THEN 'part' WHEN c > 1 THEN 'ambiguous' WHEN taken THEN 'taken' END AS why FROM r LEFT JOIN g q ON q.code = r.code LEFT JOIN l ON l.name = r.name LEFT JOIN a ON a.code = r.code),
y AS (SELECT *, coalesce(known, gone, CASE WHEN NOT del AND why IS NULL THEN one END, CASE WHEN NOT del AND coalesce(why, 'new') <> 'part' THEN answers END) AS key FROM x),
p AS (SELECT code, key, CASE WHEN key IS NULL AND NOT del THEN why END AS held, key IS NULL AND del AS withdrawn FROM y)"""


@query(f"WITH {_CW} SELECT * FROM p")
def crosswalk_placed(spark, d):
    """Rows find their record by code, by a deleted record's code, by link, or as the answer to a delivery; the rest are new, held or withdrawn."""
    rows, records, sent, gone = _walk(spark, d)
    return golden.place(rows, records, _WALK, "shop", sent, ["name", "code2"], gone).select("code", "key", "held", "withdrawn")


@query(f"WITH {_CW} SELECT key, count(*) OVER (PARTITION BY name) = 1 AS linkable FROM g")
def crosswalk_linkable(spark, d):
    _, records, _, _ = _walk(spark, d)
    return golden.linkable(records, ["name"]).select("key", "linkable")


@query(f"""WITH {_CW}, h AS (SELECT code FROM p WHERE held IS NOT NULL), d AS (SELECT code, CASE WHEN code % 5 = 0 THEN NULL WHEN code % 7 = 0 THEN 5000000000 ELSE -code END AS key FROM h)
SELECT d.code, d.key, CASE WHEN d.key IS NOT NULL AND g.key IS NULL THEN 'no such record' WHEN g.code <> d.code THEN 'the record has another key' END AS refused FROM d LEFT JOIN g USING (key)""")
def crosswalk_linked(spark, d):
    """A person's decisions on held rows, and those that cannot stand."""
    rows, records, sent, gone = _walk(spark, d)
    held = golden.place(rows, records, _WALK, "shop", sent, ["name", "code2"], gone).where("held is not null").select("code", "held")
    code = F.col("code")
    decisions = held.select("code", F.when(code % 5 == 0, None).when(code % 7 == 0, 5_000_000_000).otherwise(-code).alias("key"))
    return golden.linked(held, decisions, records, "code").select("code", "key", "refused")


@query("""SELECT code, system, row_number() OVER (PARTITION BY code ORDER BY CAST(a IS NULL AS INTEGER) + CAST(b IS NULL AS INTEGER), system) AS nth FROM (
SELECT c_custkey // 3 AS code, c_name AS system, CASE WHEN c_custkey % 2 = 0 THEN 1 END AS a, CASE WHEN c_custkey % 3 = 0 THEN 1 END AS b FROM customer)""")
def crosswalk_replay_order(spark, d):
    """Held rows of one code, the owner's first."""
    k = F.col("c_custkey")
    held = _t(spark, d, "customer").select(F.floor(k / 3).alias("code"), F.col("c_name").alias("system"), F.when(k % 2 == 0, 1).alias("a"), F.when(k % 3 == 0, 1).alias("b"))
    return golden.replay_order(held, ["a", "b"], "code").select("code", "system", "nth")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '{"name":"' || c_name || '","segment":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' ELSE '{"name":"' || c_name || '"}' END AS row FROM customer""")
def inbox_declared(spark, d):
    """Only the fields that a flow declares are values, nulls among them."""
    k = F.col("c_custkey")
    inbox = _t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 2 == 0, "name,segment").otherwise("name").alias("fields"))
    return golden.declared(inbox, ["name", "segment"]).select("c_custkey", "row")


@query("SELECT c_custkey, CAST(seq AS BIGINT) AS seq, outcome FROM customer, (VALUES " + _text([x for x in _DECIDED if x[1] != "unchanged"] + [(12, "applied")]) + ") v(seq, outcome)")
def inbox_history(spark, d):
    """What changed nothing leaves no trace in the inbox."""
    more = [("1", n, "billing", "UPDATE_AFTER", ms, {"name": "Eva", "city": city, "tier": "gold"}) for n, ms, city in ((11, 5_000, "Oslo"), (12, 9_000, "Kiel"), (13, 9_500, "Kiel"))]
    found = golden.inbox_history(golden.replay(_small_inbox(spark, d, more), _ENTITY)).where("outcome <> 'echo' or seq < 11")
    return found.select(F.substring_index("key", "-", 1).cast("long").alias("c_custkey"), "seq", "outcome")


# --- jobs, their settings and what a catalogue shows of them


@query("SELECT * FROM (VALUES ('trigger', '10000 milliseconds'), ('maxOffsetsPerTrigger', '300'), ('slow', 'f: batch 7 took 90000 ms, more than 60000')) v(about, said)")
def flow_settings(spark, d):
    """A job's settings reach its stream: how often it runs, how many rows a batch may have, how long one may take."""
    flow = _flow(job={"checkpointInterval": 10_000, "rowsPerSecond": 30, "checkpointTimeout": 60_000})
    rows = [("trigger", streams.trigger(flow)["processingTime"]), *streams.reader_options(flow).items(), *(("slow", s) for s in streams.slow_batches(flow, {6: 5_000, 7: 90_000}))]
    return spark.createDataFrame(rows, "about string, said string")


@query("""WITH e AS (SELECT 'j' || c_nationkey AS job, 'in' AS direction, c_custkey AS k FROM customer UNION SELECT 'j' || c_nationkey, 'out', c_custkey // 3 FROM customer)
SELECT job, direction, CASE WHEN k % 5 <> 0 THEN 's' || k % 4 END AS server, string_agg('t' || k, ',' ORDER BY 't' || k) AS tables FROM e GROUP BY 1, 2, 3""")
def lineage_by_server(spark, d):
    """Customers' tables of a nation's job by server; a table that is on none is named all the same."""
    k, c = F.col("c_custkey"), _t(spark, d, "customer")
    name = lambda of, key: F.concat(F.lit(of), key.cast("string"))
    edges = c.select(name("t", k).alias("src"), name("t", F.floor(k / 3)).alias("dst"), name("j", F.col("c_nationkey")).alias("job"))
    tables = c.where("c_custkey % 5 <> 0").select(name("t", k).alias("table_name"), name("s", k % 4).alias("server"))
    return catalog.placed(edges, tables).select("job", "direction", "server", F.array_join("tables", ",").alias("tables"))


@query("SELECT 'sales.orders' AS contract_id, 'orders' AS table_name, 'finished orders cost something' AS title, 'select count(*) from orders where o_orderstatus = ''F'' and o_totalprice < 5000' AS query, 'consistency' AS dimension")
def rule_examples(spark, d):
    return catalog.query_examples(spark, [ORDERS, CUSTOMERS])


@query("SELECT * FROM (VALUES ('en', 'Contract quality 1998-03-02, 2 contracts', '- SLA missed: sales.orders, score 0.5000 is under 0.90'), ('tr', 'Sözleşme kalitesi 1998-03-02, 2 sözleşme', '- SLA kaçırıldı: sales.orders, score 0.5000 is under 0.90')) v(language, head, line)")
def alert_languages(spark, d):
    breached = spark.createDataFrame([("sales.orders", 0.5, 0.9, 0)], "contract_id string, score double, sla_min double, checks_errored long")
    new = spark.createDataFrame([], "contract_id string, name string")
    rows = [(x, *scoring.message(DAY, 2, breached, new, language=x).split("\n")) for x in ("en", "tr")]
    return spark.createDataFrame(rows, "language string, head string, line string")


# --- JSON objects, positions, pairs of counts


@query("""SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '","t":"' || event_type || '"}' AS merged, '{"k":"0"}' AS replaced, '{"t":"' || event_type || '"}' AS without FROM events""")
def json_merge_and_remove(spark, d):
    e = _t(spark, d, "events").withColumn("t", F.to_json(F.struct(F.col("event_type").alias("t"))))
    both = expressions.json_merged(F.col("props"), F.col("t"))
    return e.select("event_id", both.alias("merged"), expressions.json_merged(F.col("props"), F.lit('{"k": "0"}')).alias("replaced"), expressions.json_without(both, "k").alias("without"))


@query("""SELECT n_regionkey, '{' || string_agg('"' || n_name || '":"' || n_nationkey || '"', ',' ORDER BY n_name) || '}' AS nations FROM (SELECT DISTINCT n_regionkey, n_name, max(n_nationkey) OVER (PARTITION BY n_regionkey, n_name) AS n_nationkey FROM nation) GROUP BY 1""")
def json_objects_grouped(spark, d):
    return _t(spark, d, "nation").groupBy("n_regionkey").agg(expressions.json_object_of(F.col("n_name"), F.col("n_nationkey")).alias("nations"))


@query("SELECT (SELECT max(event_id) FROM events) AS position, count(*) AS n FROM orders WHERE o_totalprice > 1000")
def snapshot_position(spark, d):
    """A snapshot is taken after the log's position is read."""
    position, rows = relations.snapshot_at(_t(spark, d, "orders"), _t(spark, d, "events").select(F.col("event_id").alias("lsn")), ["o_orderkey"], "o_totalprice > 1000")
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("position", F.lit(position))


@query("SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS target_rows, (SELECT count(*) FROM orders WHERE o_orderstatus IS DISTINCT FROM 'O') AS missing UNION ALL SELECT 'part', (SELECT count(*) FROM part), NULL, (SELECT count(*) FROM part)")
def paired_counts(spark, d):
    orders = _t(spark, d, "orders")
    return relations.paired_counts(relations.row_counts({"orders": orders, "part": _t(spark, d, "part")}), relations.row_counts({"orders": orders.where("o_orderstatus = 'O'")}))


@query("SELECT c_name AS column_name, CAST(c_custkey AS INTEGER) AS column_id, c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS captured FROM customer")
def captured_columns(spark, d):
    """Customers as declared columns: the log lacks every third one, and every fifth one was dropped and made anew."""
    k, c = F.col("c_custkey").cast("int"), _t(spark, d, "customer")
    log = c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("column_name"), F.when(k % 5 == 0, k + 1_000_000).otherwise(k).alias("column_id"))
    return relations.captured(c.select(F.col("c_name").alias("column_name"), k.alias("column_id")), log)


@query("""WITH p AS (SELECT user_id, event_id, event_type, last_value(CASE WHEN event_id % 3 <> 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM events) SELECT user_id, event_id, event_type FROM p WHERE was IS DISTINCT FROM event_type""")
def polls_of_placed_rows(spark, d):
    """A held listing is not the next one's before image."""
    return golden.poll_changes(_t(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", ["event_type"], F.col("event_id") % 3 != 0)
