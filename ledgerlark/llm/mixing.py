"""Mix sources to target weights by weighted fair queueing.

Every document joins its source's queue at a shuffled place and gets a virtual finish
time: the source's words up to and including it, divided by the source's target. All
queues then merge in the order of virtual time, and the merged stream ends where its
words reach the total budget. A source whose target exceeds its size is queued once
more behind itself, so a document is taken twice at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import BUCKET_ROWS, NOT_WHITE, hex_digits, running_total, stored

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds this share of all words, and no source more than CAP times its own.
BUDGET, CAP = 1.5, 2


def _queued(salt: str) -> list[Column]:
    """_size, a document's words, and _place, its shuffled place in the queue (by its text where it has no doc_id)."""
    return [
        F.coalesce(F.regexp_count("text", F.lit(NOT_WHITE)), F.lit(0)).cast("long").alias("_size"),
        F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))).alias("_place"),
    ]


def targets(sizes: DataFrame) -> DataFrame:
    """One row a source: source, source_size, n_docs, rank (1 on; null last), weight and target.

    `sizes` has source and _size. A source is held at CAP times its size, and what it
    leaves is shared by weight among the others: in rising order of size to weight, the
    first source that the shared level does not fill sets the level of all the rest.
    """
    by_name, by_fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("fill", "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    levels = (
        sizes.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight)
        .withColumn("fill", F.col("source_size") * CAP / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(0))))
        .withColumn("level", (F.col("total") * F.lit(BUDGET) - F.coalesce(F.sum(F.col("source_size") * CAP).over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("level", F.min_by(F.when(F.col("level") <= F.col("fill"), F.col("level")), F.when(F.col("level") <= F.col("fill"), F.struct("fill", "rank"))).over(Window.partitionBy(F.lit(0))))
    )
    target = F.least((F.col("source_size") * CAP).cast("double"), F.col("level") * F.col("weight"))
    return levels.select("source", "source_size", "n_docs", "rank", "weight", "total", target.alias("target"))


def _places(sizes: DataFrame) -> DataFrame:
    """One row a source: its targets, and the last places of its queue that the mix takes once and twice."""
    sources = stored(targets(sizes))
    rows = sources.agg(F.sum("n_docs")).first()[0] or 0
    same = sizes["source"].eqNullSafe(sources["source"])
    queued = sizes.join(sources, same).select("rank", "_place", "doc_id", "_size", "source_size", "target", "total")
    order = [F.col("_place"), F.col("doc_id"), F.col("_size")]
    queued = running_total(queued, ["rank"], F.substring("_place", 1, hex_digits(rows)), order, F.col("_size"), "before")
    once = (F.col("before") + F.col("_size")) / F.nullif(F.col("target"), F.lit(0.0))
    twice = (F.col("before") + F.col("_size") + F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0))
    queued = stored(queued.withColumn("once", once).withColumn("twice", twice))

    # The merged stream, in ranges of virtual time; only the range in which the budget ends is ordered inside.
    ranges = max(64, math.ceil(2 * rows / BUCKET_ROWS))
    stream = queued.select("rank", "_size", "total", F.explode(F.array("once", "twice")).alias("time")).where("time is not null")
    stream = stream.withColumn("range", F.floor(F.col("time") * ranges))
    up = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = stream.groupBy("range").agg(F.sum("_size").alias("words"), F.max("total").alias("total"))
    sums = sums.withColumn("offset", F.coalesce(F.sum("words").over(up), F.lit(0)))
    last = sums.where(F.col("offset") <= F.col("total") * F.lit(BUDGET)).agg(F.max("range").alias("range"), F.max("offset").alias("offset")).first()
    if last["range"] is None:  # no words at all
        taken_once = taken_twice = F.lit(False)
    else:
        inside = Window.partitionBy("range").orderBy("time", "rank").rowsBetween(Window.unboundedPreceding, -1)
        passed = F.lit(last["offset"]) + F.coalesce(F.sum("_size").over(inside), F.lit(0))
        fits = F.col("passed") * 2 + F.col("_size") <= F.col("total") * F.lit(2 * BUDGET)
        end = stream.where(F.col("range") == last["range"]).withColumn("passed", passed).where(fits).agg(F.max(F.struct("time", "rank")).alias("end")).first()["end"]
        time, rank = end or (last["range"] / ranges, 0)
        stop = F.struct(F.lit(time).alias("time"), F.lit(rank).alias("rank"))
        taken_once, taken_twice = (F.struct(F.col(x).alias("time"), F.col("rank")) <= stop for x in ("once", "twice"))
    place = F.struct("_place", "doc_id", "_size")
    ends = queued.groupBy("rank").agg(
        F.max(F.when(F.col("once").isNotNull() & taken_once, place)).alias("_once"), F.max(F.when(F.col("twice").isNotNull() & taken_twice, place)).alias("_twice")
    )
    return stored(sources.join(ends, "rank", "left").select("source", "source_size", "target", "_once", "_twice"))


def schedule(docs: DataFrame, salt: str = "mix") -> DataFrame:
    """One row a document: _doc, all columns of docs; size, source_size, target; and copies, how often (0 to 2) the mix takes it.

    docs has doc_id, text and source. Size is the number of words; null and blank texts
    count 0 and are not taken. A null source is a source of its own, the last. Repeated
    rows are documents of their own, though alike in place: ties of place, doc_id and size
    are taken or left together. Very long texts are counted whole. An empty table gives an
    empty mix. Reruns agree: the shuffle is a digest of doc_id (null: of the text) and
    `salt`. Per source only two queue places are kept, so texts are never shuffled. Columns
    of docs are kept apart in _doc, so their names cannot clash.
    """
    queue = docs.select(F.struct("*").alias("_doc"), "doc_id", "source", *_queued(salt))
    sizes = stored(queue.drop("_doc"))
    return _taken(queue, _places(sizes))


def _taken(queue: DataFrame, ends: DataFrame) -> DataFrame:
    place = F.struct("_place", "doc_id", "_size")
    copies = sum(F.when(place <= F.col(x), 1).otherwise(0) for x in ("_once", "_twice"))
    out = queue.join(ends.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left")
    out = out.withColumn("copies", F.when(F.col("_size") > 0, copies).otherwise(0)).withColumnRenamed("_size", "size")
    return out.drop("_source", "_place", "_once", "_twice")


def mix(docs: DataFrame, salt: str = "mix") -> DataFrame:
    """The mixed documents: docs' own columns, each row as often as the mix takes it."""
    out = schedule(docs, salt).where("copies > 0")
    return out.select("_doc", F.explode(F.sequence(F.lit(1), "copies"))).select("_doc.*")


def op1(docs: DataFrame) -> DataFrame:
    sizes = stored(docs.select("doc_id", "source", *_queued("mix")))
    return _taken(sizes, _places(sizes)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS place
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources
), filled AS (
  SELECT *, source_size * 2 / weight AS fill, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM weighted
), levels AS (
  SELECT *, (total * CAST(1.5 AS DOUBLE) - coalesce(CAST(sum(source_size * 2) OVER (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
            / CAST(sum(weight) OVER (ORDER BY fill, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM filled
), lvl AS (
  SELECT level FROM levels WHERE level <= fill ORDER BY fill, rank LIMIT 1
), aimed AS (
  SELECT source, rank, source_size, total, least(CAST(source_size * 2 AS DOUBLE), (SELECT level FROM lvl) * weight) AS target FROM levels
), queued AS (
  SELECT d.doc_id, d.size, d.place, a.rank, a.source_size, a.target, a.total,
         CAST(sum(d.size) OVER (PARTITION BY a.rank ORDER BY d.place, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM sized d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source
), stream AS (
  SELECT doc_id, place, rank, size, total, upto / nullif(target, 0) AS time FROM queued
  UNION ALL SELECT doc_id, place, rank, size, total, (upto + source_size) / nullif(target, 0) FROM queued
), merged AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY time, rank, place ROWS UNBOUNDED PRECEDING) AS BIGINT) AS passed FROM stream WHERE time IS NOT NULL AND size > 0
), taken AS (
  SELECT doc_id, place, rank, size, count(*) AS copies FROM merged WHERE (passed - size) * 2 + size <= total * 3 GROUP BY ALL
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(t.copies, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id AND q.place = t.place AND q.rank = t.rank AND q.size = t.size
"""
