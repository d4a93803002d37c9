"""What a catalogue shows of contracts and flows: lineage, foreign keys, tags, reference values."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.plans.flows import Flow
from ledgerlark.sources.contracts import Contract

EDGE = "src string, dst string, kind string"


def lineage(spark: SparkSession, contracts: Iterable[Contract], flows: Iterable[Flow] = ()) -> DataFrame:
    """src, dst, kind: what contracts are derived from, and what flows carry where."""
    rows = [(d, c.id, "derived") for c in contracts for d in c.derived_from] + [(f.source, f.target, f"flow:{f.id}") for f in flows]
    return spark.createDataFrame(rows, EDGE)


def unresolved(edges: DataFrame, contracts: DataFrame) -> DataFrame:
    """Edges from something that is neither a contract nor a catalogue address."""
    return edges.where(~F.col("src").startswith("//")).join(contracts.select(F.col("contract_id").alias("src")), "src", "left_anti")


def downstream(edges: DataFrame) -> DataFrame:
    """origin, node, steps: everything that each node reaches, by the fewest steps, however many; cycles end.

    Every round extends only the pairs that the last one found, until it finds no new one.
    """
    context = edges.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = edges.sparkSession.conf.get("spark.checkpoint.dir", None)
        local = context.master.startswith("local[") or context.master == "local"
        context.setCheckpointDir(named or (tempfile.mkdtemp(prefix="ledgerlark-") if local else f"{edges.sparkSession.conf.get('spark.sql.warehouse.dir')}/checkpoints"))
    edges = edges.select("src", "dst").where("src <> dst").distinct()
    found = edges.select(F.col("src").alias("origin"), F.col("dst").alias("node"), F.lit(1).alias("steps"))
    new = found
    for step in count(2):
        ahead = new.join(edges, new["node"] == edges["src"]).select("origin", F.col("dst").alias("node")).where("origin <> node").distinct()
        new = ahead.join(found.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("steps", F.lit(step))
        new = new.checkpoint()  # else every round would work out all rounds before it
        if new.isEmpty():
            return found
        found = found.unionByName(new)


def placed(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """job, direction (in, out), server and tables of the flows' edges (src, dst, job): tables of one server stand together, those on no server under null. tables has table_name and server."""
    ends = edges.select("job", F.lit("in").alias("direction"), F.col("src").alias("table_name")).union(edges.select("job", F.lit("out"), "dst"))
    found = ends.distinct().join(tables.select("table_name", "server"), "table_name", "left")
    return found.groupBy("job", "direction", "server").agg(F.array_sort(F.collect_set("table_name")).alias("tables"))


def query_examples(spark: SparkSession, contracts: Iterable[Contract]) -> DataFrame:
    """A contract's hand-written rules as examples of queries on its tables, and the dimensions they are about."""
    rows = [(c.id, m.name, q.description, q.query, q.dimension) for c in contracts for m in c.models for q in m.quality]
    return spark.createDataFrame(rows, "contract_id string, table_name string, title string, query string, dimension string")


def foreign_keys(properties: DataFrame) -> DataFrame:
    """contract_id, table_name, column_name, to_table, to_column of every declared foreign key."""
    refs = properties.select("contract_id", "table_name", "column_name", F.explode("refs").alias("ref"))
    return refs.select("contract_id", "table_name", "column_name", F.regexp_extract("ref", r"^(.*)\.[^.]+$", 1).alias("to_table"), F.regexp_extract("ref", r"([^.]+)$", 1).alias("to_column"))


def relations_of(keys: DataFrame, hosts: DataFrame) -> DataFrame:
    """table_name, other, direction (to or from), among tables of the same host; hosts has table_name and host."""
    a, b = hosts.select(F.col("table_name"), "host"), hosts.select(F.col("table_name").alias("to_table"), F.col("host").alias("to_host"))
    near = keys.join(a, "table_name").join(b, "to_table").where("host = to_host")
    to = near.select("table_name", F.col("to_table").alias("other"), F.lit("to").alias("direction"))
    return to.unionByName(near.select(F.col("to_table").alias("table_name"), F.col("table_name").alias("other"), F.lit("from").alias("direction")))


def tags(properties: DataFrame, contracts: DataFrame, engines: DataFrame, replicated: DataFrame) -> DataFrame:
    """table_name, tags. engines has table_name and engine, replicated has table_name."""
    classified = properties.groupBy("contract_id", "table_name").agg(F.bool_or(F.col("classification").isNotNull()).alias("classified"))
    rows = classified.join(contracts.select("contract_id", "domain"), "contract_id", "left").join(engines, "table_name", "left")
    rows = rows.join(replicated.select("table_name").distinct().withColumn("copied", F.lit(True)), "table_name", "left")
    made = F.array_compact(F.array(
        F.lit("under-contract"), F.when(F.col("domain").isNotNull(), F.concat(F.lit("domain:"), "domain")), F.when(F.col("engine").isNotNull(), F.concat(F.lit("engine:"), "engine")),
        F.when(F.col("copied"), F.lit("replicated")), F.when(F.col("classified"), F.lit("has-classified-columns")),
    ))
    return rows.select("table_name", made.alias("tags"))


def merged_tags(have: DataFrame, ours: DataFrame) -> DataFrame:
    """Tags after ours are added; nobody's tags are taken away."""
    other = ours.select("table_name", F.col("tags").alias("_ours"))
    empty = F.array().cast("array<string>")
    return have.join(other, "table_name", "full_outer").select("table_name", F.array_sort(F.array_union(F.coalesce("tags", empty), F.coalesce("_ours", empty))).alias("tags"))


def source_domains(rows: DataFrame) -> DataFrame:
    """source, domain: the domain that all tables of a source share, null where they do not. rows has source and domain."""
    return rows.groupBy("source").agg(F.when(F.count_distinct("domain") == 1, F.max("domain")).alias("domain"))


def tables_by_domain(properties: DataFrame, contracts: DataFrame) -> DataFrame:
    rows = properties.select("contract_id", "table_name").distinct().join(contracts.select("contract_id", "domain"), "contract_id")
    return rows.groupBy("domain").agg(F.array_sort(F.collect_set("table_name")).alias("tables"))


def metadata(rows: DataFrame, key: str, entries: str) -> DataFrame:
    """A map column as rows of text: key, name, value; empty values left out."""
    out = rows.select(key, F.explode(entries).alias("name", "value"))
    return out.select(key, "name", F.col("value").cast("string").alias("value")).where("value is not null and value <> ''")


def lookup_table(golden: DataFrame, classified: Iterable[str]) -> DataFrame:
    """The golden records as text, without bookkeeping and classified columns."""
    hide = set(classified)
    return golden.select(*[F.col(c).cast("string").alias(c) for c in golden.columns if not c.startswith("_") and c not in hide])


def value_maps(spark: SparkSession, flows: Iterable[Flow]) -> DataFrame:
    rows = [(f.id, c, str(k), str(v).lower() if isinstance(v, bool) else str(v)) for f in flows for c, m in f.values.items() for k, v in m.items()]
    return spark.createDataFrame(rows, "flow string, target_column string, from_value string, to_value string")


def test_runs(results: DataFrame) -> DataFrame:
    """Check results as a catalogue's tests and runs, under names that stay."""
    from ledgerlark.functions.expressions import check_category, failure_reason

    outcome = F.when(F.col("status") == "pass", "SUCCESS").when(F.col("status") == "fail", "FAILED").otherwise("BROKEN")
    return results.select(
        F.concat(F.lit("//test/"), "check_id").alias("test"), F.concat(F.lit("//test/"), "check_id", F.lit("/run/"), F.col("run_at").cast("string")).alias("run"), outcome.alias("outcome"),
        check_category(F.col("check_type"), F.col("dimension")).alias("category"), F.when(F.col("status") == "fail", failure_reason(F.col("failed_rows"), F.col("total_rows"), F.col("dimension"))).alias("reason"),
    )
