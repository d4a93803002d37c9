"""Exact duplicates through a log-structured merge index of text digests.

Memtables of a bounded number of documents are flushed as runs: one row a digest, sorted
by digest. Compaction merges runs level by level and keeps of each digest the identifier
that ranks first. Every run has a filter of bounded size, which is probed before the run
is read: only digests that it lets through are joined. Hits receive byte verification.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BITMAP, WHITE, bit_is_set, stored

#: Documents that a memtable holds, and runs of one level that are merged into one of the next.
MEMTABLE_ROWS, FANOUT = 1 << 24, 8
#: A filter has 16 bits for each digest, but at most 2**27 (16 MB) on any input; beyond, more rows are compared, none fewer.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 27


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{WHITE}+", "")


def entries(docs: DataFrame) -> DataFrame:
    """One narrow row a document: _row, doc_id, digest and points (code points of the original text)."""
    return docs.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
        F.coalesce(F.char_length("text"), F.lit(0)).alias("points"),
    )


def _rank() -> Column:
    return F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "_row")


@dataclass(frozen=True)
class Run:
    """digest, first (the entry that ranks first) and n, sorted by digest; and its filter."""

    level: int
    rows: DataFrame
    bitmaps: DataFrame
    bits: int

    def may_hold(self, rows: DataFrame) -> DataFrame:
        """The rows whose digest the filter lets through; the filter is broadcast, 16 MB at most, so nothing is shuffled."""
        at = F.pmod(F.xxhash64("digest"), F.lit(self.bits)) + 1
        marked = rows.withColumn("_bucket", F.bitmap_bucket_number(at)).withColumn("_bit", F.bitmap_bit_position(at))
        found = marked.join(F.broadcast(self.bitmaps.withColumnRenamed("bucket", "_bucket")), "_bucket")
        return found.where(bit_is_set(F.col("bitmap"), F.col("_bit"))).select(*rows.columns)


def run_of(rows: DataFrame, n: int, level: int = 0) -> Run:
    """A run of stored rows with n digests, with its filter."""
    bits = min(MOST_FILTER_BITS, max(BITMAP, 1 << math.ceil(math.log2(FILTER_BITS * max(n, 1)))))
    at = F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1
    marks = rows.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    return Run(level, rows, stored(marks.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))), bits)


def flush(rows: DataFrame, memtable_rows: int = MEMTABLE_ROWS) -> tuple[DataFrame, int]:
    """The sorted runs of all memtables, and their number: run, digest, first and n."""
    runs = max(1, math.ceil(rows.count() / memtable_rows))
    of = F.pmod(F.xxhash64("_row"), F.lit(runs)) if runs > 1 else F.lit(0)
    filled = rows.groupBy(of.cast("long").alias("run"), "digest").agg(F.min(_rank()).alias("first"), F.count(F.lit(1)).alias("n"))
    return stored(filled, "run", "digest"), runs


def compact(runs: DataFrame, n: int, fanout: int = FANOUT) -> tuple[DataFrame, int]:
    """n runs merged fanout at a time, level by level, into one (digest, first, n), and the levels it took; of each digest the smallest identifier stays."""
    level = 0
    while n > 1:
        n, level = math.ceil(n / fanout), level + 1
        merged = runs.groupBy(F.floor(F.col("run") / fanout).alias("run"), "digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        runs = stored(merged, "run", "digest")
    return runs.drop("run"), level


@dataclass
class Index:
    """A log-structured merge index that batches are added to and looked up in."""

    memtable_rows: int = MEMTABLE_ROWS
    fanout: int = FANOUT
    runs: list[Run] = field(default_factory=list)

    def add(self, rows: DataFrame) -> None:
        """File entries. What the memtables flush is merged; runs gather until fanout of one level merge into the next."""
        merged, level = compact(*flush(rows, self.memtable_rows), self.fanout)
        self.runs.append(run_of(merged, merged.count(), level))
        while len(same := [r for r in self.runs if r.level == self.runs[-1].level]) >= self.fanout:
            both = same[0].rows
            for r in same[1:]:
                both = both.unionByName(r.rows)
            both = stored(both.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")), "digest")
            self.runs = [r for r in self.runs if r not in same] + [run_of(both, both.count(), same[0].level + 1)]

    def lookup(self, rows: DataFrame) -> DataFrame:
        """The entries whose digest is in the index, with first and n over all runs; a run is read for digests that its filter lets through only."""
        found = None
        for run in self.runs:
            hit = run.may_hold(rows).join(run.rows, "digest")
            found = hit if found is None else found.unionByName(hit)
        if found is None:
            return rows.limit(0).withColumn("first", _rank()).withColumn("n", F.lit(0).cast("long"))
        best = F.min("first").alias("first"), F.sum("n").alias("n")
        return found.groupBy(*rows.columns).agg(*best)


def dedup(docs: DataFrame, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space; null counts as empty, and
    very long texts are digested whole. Of equal texts the row with most code points, then
    the smallest doc_id stays (null ids rank last, of repeated rows one stays). An empty
    table gives no rows. Other columns of docs are not read.

    Digests that more than one document has are hits. Their run's filter picks the rows
    that are looked up, the others are alone; and it picks the texts of a second scan
    whose bytes are compared before any document is called a copy.
    """
    docs = docs.select("doc_id", "text")
    rows = stored(entries(docs))
    merged, _ = compact(*flush(rows, memtable_rows), fanout)
    shared = merged.where("n > 1")
    hits = run_of(shared, shared.count())
    told = ["doc_id", "digest", "_row", "points", "first", "n"]
    # A row that the filter stops is alone: it ranks first itself.
    at = F.pmod(F.xxhash64("digest"), F.lit(hits.bits)) + 1
    marked = rows.withColumn("bucket", F.bitmap_bucket_number(at)).withColumn("bit", F.bitmap_bit_position(at)).join(F.broadcast(hits.bitmaps), "bucket", "left")
    marked = marked.withColumn("may", F.coalesce(bit_is_set(F.col("bitmap"), F.col("bit")), F.lit(False))).drop("bucket", "bit", "bitmap")
    alone = marked.where("not may").select("doc_id", "digest", "_row", "points", _rank().alias("first"), F.lit(1).cast("long").alias("n"))
    looked_up = marked.where("may").join(shared, "digest", "left")
    looked_up = looked_up.select("doc_id", "digest", "_row", "points", F.coalesce("first", _rank()).alias("first"), F.coalesce("n", F.lit(1)).alias("n"))
    found = alone.select(*told).union(looked_up.select(*told))

    texts = docs.select(normalised(F.col("text")).alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    compared = hits.may_hold(texts).groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("rows"))
    unequal = stored(compared.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"))
    if not unequal.isEmpty():
        found = _apart(rows, merged, docs, unequal)
    return found.select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("_row") == F.col("first._row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def _apart(rows: DataFrame, index: DataFrame, docs: DataFrame, unequal: DataFrame) -> DataFrame:
    """The groups again, where different texts share a digest: those are told apart by their bytes."""
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm"), F.coalesce(F.char_length("text"), F.lit(0)).alias("points"), F.monotonically_increasing_id().alias("_row"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("norm", 256))).join(unequal, "digest", "left_semi")
    rank = F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    classes = texts.groupBy("digest", "norm").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
    told = texts.join(classes, ["digest", "norm"]).select("digest", "_row", "doc_id", "points", "first", "n")
    return rows.join(unequal, "digest", "left_anti").join(index, "digest").unionByName(told)


def op5(docs: DataFrame) -> DataFrame:
    return dedup(docs)


SQL = """
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm, length(coalesce(text, '')) AS points FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""
