"""Near-duplicates by SimHash fingerprints and multi-index hashing.

Two fingerprints that differ in at most 2 of 64 bits differ in at most one bit of one of
their two segments. Each segment has a table of its values. The Hamming ball of radius 1
around every value is looked up in it, the fingerprints of the values found are fetched,
and complete distances decide. Values that very many fingerprints share are split by the
other segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_text_batches, id_and_text, keyed, picked, stored

SHINGLE, MOST_BITS, SEGMENTS = 3, 2, 2
WIDTH = 64 // SEGMENTS
#: Comparisons of fingerprints that two segment values may lead to; with more, both segments together are the key.
LIST_PAIRS = 4096
#: Shingle hashes that are counted at a time, so a very long text needs no more memory than this.
BLOCK = 1 << 16


def hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """The 64-bit hashes of a text's shingles, BLOCK at a time; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(size, len(words))
    starts, stops = np.concatenate(([0], ends[: len(words) - size] + 1)).tolist(), ends[size - 1 :].tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    for i in range(0, len(stops), BLOCK):
        yield np.array([digest(view[a:b], 42) for a, b in zip(starts[i : i + BLOCK], stops[i : i + BLOCK], strict=True)], dtype="<u8")


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text; 0 for one without words."""
    counts, n = np.zeros(64, np.int64), 0
    for h in hashes(text, size):
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = pa.array([fingerprint(t.as_py()) for t in batch.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), marks], ["_row", "doc_id", "mark"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """_row, doc_id and mark (the fingerprint as a signed long) of docs with _row, doc_id and text."""
    bounded_text_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("_row", "doc_id", "text").mapInArrow(_fingerprints, f"_row long, doc_id {id_type}, mark long")


def _filed(marks: DataFrame) -> DataFrame:
    """mark, segment and value: the tables in which a fingerprint stands, one for each of its segments."""
    values = [F.shiftrightunsigned("mark", s * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)) for s in range(SEGMENTS)]
    return marks.select("mark", F.posexplode(F.array(*values)).alias("segment", "value"))


def _looked_up(table: DataFrame) -> DataFrame:
    """segment, value, other, and their counts n, m: the values in a segment's table that lie in the ball around a value, itself included.

    Of two values a bit apart the one without the bit asks, so each pair comes up once.
    """
    partitions = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unset = F.filter(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda b: F.getbit("value", b) == 0)
    ball = table.repartition(partitions, "segment", "value").select("segment", "value", "n", F.explode(unset).alias("bit"))
    asked = ball.select("segment", "value", "n", F.col("value").bitwiseOR(F.expr("shiftleft(1L, bit)")).alias("other"))
    found = asked.join(table.select("segment", F.col("value").alias("other"), F.col("n").alias("m")), ["segment", "other"])
    own = table.where("n > 1").select("segment", "value", F.col("value").alias("other"), "n", F.col("n").alias("m"))
    return own.union(found.select(*own.columns))


def links(marks: DataFrame) -> DataFrame:
    """a < b: pairs of different fingerprints (of marks: mark, distinct) within MOST_BITS bits that connect all that are.

    A bit ball of radius MOST_BITS / SEGMENTS around each segment's value is looked up in
    the segment's table; fingerprints of values found are fetched and compared whole. Where
    two values have so many fingerprints that comparing them takes more than LIST_PAIRS
    comparisons, their fingerprints are filed under both segments at once instead (see _crowded).
    """
    filed = stored(_filed(marks))
    table = stored(filed.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")))
    near = stored(_looked_up(table))
    few = near.where(F.col("n") * F.col("m") <= LIST_PAIRS)
    x = filed.select("segment", "value", F.col("mark").alias("x"))
    y = filed.select("segment", F.col("value").alias("other"), F.col("mark").alias("y"))
    fetched = few.select("segment", "value", "other").join(x, ["segment", "value"]).join(y, ["segment", "other"])
    apart = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    pairs = fetched.where((F.col("x") != F.col("y")) & (apart <= MOST_BITS)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    many = near.where(F.col("n") * F.col("m") > LIST_PAIRS).select("segment", F.explode(F.array("value", "other")).alias("value")).distinct()
    crowded = stored(filed.join(many, ["segment", "value"], "left_semi").select("mark").distinct())
    return pairs.union(_crowded(crowded)).distinct()


def _crowded(marks: DataFrame) -> DataFrame:
    """a < b: links among the fingerprints of crowded values, by the ball of radius 1 in one segment beside the other segment's value.

    Any two within 2 bits share such a value, and a value has 65 fingerprints at most. A
    list gives one pair for each member but the smallest: members are within 2 bits of
    each other, so these connect what all pairs would.
    """
    balls = [F.col("mark")] + [F.col("mark").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)]
    marks = marks.repartition(int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mark")  # each row becomes 65
    probes = marks.select("mark", F.explode(F.array(*balls)).alias("value"))
    lists = probes.groupBy("value").agg(F.min("mark").alias("a"), F.collect_list("mark").alias("members")).where(F.size("members") > 1)
    pairs = lists.select("a", F.explode("members").alias("b")).where("a < b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that each node of the pairs (a, b) is connected to.

    Every round hooks roots on the smallest neighbouring root, aggregated before it is
    shuffled, and halves the paths; the table of a round is written to the shared folder.
    """
    both = stored(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a")))
    roots = stored(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("root")))
    for _ in range(most_rounds):
        seen = both.join(roots.select(F.col("node").alias("y"), F.col("root").alias("near")), "y")
        seen = seen.join(roots.select(F.col("node").alias("x"), F.col("root").alias("own")), "x")
        hooks = seen.where("near < own").select(F.explode(F.array("x", "own")).alias("node"), "near").groupBy("node").agg(F.min("near").alias("near"))
        hooked = roots.join(hooks, "node", "left").select("node", F.least("root", "near").alias("root"))
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        done = roots.select("node", F.col("root").alias("was"))
        jumped = stored(hooked.join(above, "root").select("node", F.col("upper").alias("root")).join(done, "node"))
        roots = jumped.select("node", "root")
        if jumped.where("root <> was").isEmpty():
            return roots
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def group(docs: DataFrame) -> DataFrame:
    """_row, doc_id, mark, root and component_id of docs with _row, doc_id and text.

    root is the component's smallest fingerprint and tells components apart; ids may be null or repeated. component_id is the smallest doc_id reachable over links, its own included; null ids
    count only where a component has no other. Null and blank texts have fingerprint 0 and
    link like any other; of very long texts every shingle counts. Repeated rows and ties share
    their fingerprint, an empty table has no group, extra columns are not read.
    """
    found = stored(fingerprints(docs))
    marks = stored(found.groupBy("mark").agg(F.min("doc_id").alias("least")))
    roots = components(stored(links(marks.select("mark"))))
    named = marks.join(roots.withColumnRenamed("node", "mark"), "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.join(stored(named.join(ids, "root").select("mark", "root", "component_id")), "mark").select("_row", "doc_id", "mark", "root", "component_id")


def near_dedup(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame] = group) -> DataFrame:
    """docs with one document of each group (of _row, doc_id and root): the first row of its smallest doc_id."""
    rows = keyed(docs)
    groups = grouped(id_and_text(rows))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    stay = groups.groupBy("root").agg(first.alias("f")).select(F.col("f._row").alias("_row"))
    return picked(rows, stay).select("_doc.*")


def op7(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    return group(rows).select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")
