"""Near-duplicates by SimHash fingerprints and by the Jaccard similarity of five-word shingles, for the pipeline.

Rows whose fingerprints connect are together, as in op7_simhash; so are rows whose shingle
sets are near, which fingerprints alone tell too rarely. MinHash bands propose pairs of sets
and the complete sets decide. A band's list is compared with its best known member, the one
that is in the most and longest lists. Members of lists that this leaves in several
components are compared wherever they share a shingle that is rare enough for near sets: of
two such sets, the first common shingle in order of rarity has as many shingles behind it in
both as near sets of their sizes have in common. So none of their near pairs is missed, and
texts that share a passage or differ by edits of their own rarely meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from ._shared import bounded_text_batches, picked, stored
from .simhash import components, hashes

#: Words of a shingle; the similarity from which texts are near, as a fraction.
SHINGLE, PART, WHOLE = 5, 4, 5
#: At similarity 0.8 some band of two texts collides with a probability of 1 - (1 - 0.8 ** ROWS) ** BANDS, over 0.999996.
BANDS, ROWS = 32, 5
#: Numbers that a sketch holds at a time.
STEP = 160 * 1024


def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    times, plus = np.random.default_rng(n).integers(0, 1 << 32, (2, n, 1), dtype=np.uint32)
    return times | np.uint32(1), plus


_TIMES, _PLUS = _hashes(BANDS * ROWS)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles in order; a shorter text is one shingle, one without words has none."""
    return np.unique(np.concatenate([np.empty(0, "<u8"), *hashes(text, SHINGLE)]))


def bands(found: np.ndarray) -> list[int]:
    """A signed 64-bit value a band of a shingle set; none for an empty set."""
    if not len(found):
        return []
    low, high = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    step = STEP // len(low)
    for i in range(0, len(high), step):
        np.minimum(low, (high[i : i + step] * _TIMES + _PLUS).min(axis=1), out=low)
    digests = [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingle_set(t.as_py()) for t in batch.column("text")]
        marks = pa.array([xxhash.xxh3_128_digest(f.tobytes()) for f in found], pa.binary())
        sizes, values = pa.array([len(f) for f in found], pa.int64()), pa.array([bands(f) for f in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), marks, sizes, values], ["_row", "doc_id", "mark", "n", "bands"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingle_set(t.as_py()).view("<i8") for t in batch.column("text")]
        sizes = pa.array([len(f) for f in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("_row"), sizes, pa.array(found, pa.list_(pa.int64()))], ["node", "n", "found"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([shingle_set(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("_row"), found], ["node", "found"])


def near(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two shingle sets have the similarity asked for."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * WHOLE >= (len(x) + len(y) - both) * PART


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = zip(batch.column("x"), batch.column("y"), strict=True)
        yield batch.select(["a", "b"]).filter(pa.array([near(*(np.frombuffer(s.as_buffer(), "<u8") for s in pair)) for pair in sets], pa.bool_()))


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows of docs whose texts are near; stored."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct()
    sets = stored(picked(docs, nodes).select("_row", "text").mapInArrow(_sets, "node long, found binary"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")
    return stored(both.select("a", "b", "x", "y").mapInArrow(_decide, "a long, b long"))


def _may_be_near(n: str, m: str) -> Column:
    """Whether sets of these sizes can be near."""
    return F.least(n, m) * WHOLE >= F.greatest(n, m) * PART


def _listed(lists: DataFrame) -> DataFrame:
    """value, node, n, size and nth of lists (value, node, n) with several members: a text that many others come from is in more lists, and longer ones, than its copies, and comes first."""
    sizes = lists.groupBy("value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(lists.join(sizes, "value"))
    known = stored(members.groupBy("node").agg(F.sum("size").alias("known")))
    order = Window.partitionBy("value").orderBy(F.col("known").desc(), "node")
    return stored(members.join(known, "node").withColumn("nth", F.row_number().over(order)).select("value", "node", "n", "size", "nth"))


def _compared(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Links that the first member of each list has with the others."""
    first = members.where("nth = 1").select("value", F.col("node").alias("node2"), F.col("n").alias("n2"))
    pairs = members.where("nth > 1").join(first, "value").where(_may_be_near("n", "n2"))
    return verified(docs, stored(pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()))


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """node and root of the members of lists that have several components; stored."""
    rooted = stored(members.select("value", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    several = rooted.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("value")
    return stored(rooted.join(several, "value", "left_semi").select("node", "root").distinct())


def _rare(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """token, node, n, rest and root: the shingles of mixed rows (node, root) that may be the first that a near set has in common.

    Shingles are in order of rarity among these rows; `rest` counts a set's shingles from one
    on that other sets have too, itself included.
    """
    sets = picked(docs, mixed.select(F.col("node").alias("_row"))).select("_row", "text").mapInArrow(_shingles, "node long, n long, found array<long>")
    tokens = stored(sets.select("node", "n", F.explode("found").alias("token")))
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    behind = Window.partitionBy("node").orderBy(F.col("sets").desc(), F.col("token").desc())
    found = tokens.join(held, "token").withColumn("rest", F.row_number().over(behind)).where(F.col("rest") * WHOLE >= F.col("n") * PART)
    return stored(found.join(mixed, "node").select("token", "node", "n", "rest", "root"))


def _meeting(rare: DataFrame) -> DataFrame:
    """a < b: the pairs of different components that may be near, of _rare() rows.

    A shingle's rows of its largest component meet the others only, so a large component is not paired with itself.
    """
    sizes = rare.groupBy("token", "root").agg(F.count(F.lit(1)).alias("size"))
    most = sizes.groupBy("token").agg(F.max(F.struct("size", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    x = rare.join(most.select("token", F.col("most.root").alias("largest")), "token").where("root <> largest")
    y = rare.select("token", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "rest", "root")))
    once = (F.col("root2") == F.col("largest")) | (F.col("node") < F.col("node2"))
    enough = F.least("rest", "rest2") * (WHOLE + PART) >= (F.col("n") + F.col("n2")) * PART
    pairs = x.join(y, "token").where((F.col("root") != F.col("root2")) & once & enough)
    return stored(pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct())


def group(docs: DataFrame) -> DataFrame:
    """_row, doc_id and root of docs with _row, doc_id and text: rows have one root exactly when near texts connect them.

    Texts with equal shingle sets, blank and null ones among them, are near.
    """
    bounded_text_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = stored(docs.select("_row", "doc_id", "text").mapInArrow(_sketch, f"_row long, doc_id {id_type}, mark binary, n long, bands array<long>"))
    sets = stored(found.groupBy("mark").agg(F.min("_row").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")))

    members = _listed(sets.select(F.explode("bands").alias("value"), "node", "n"))
    links = _compared(docs, members)
    roots = components(links)
    mixed = _mixed(members, roots)
    if not mixed.isEmpty():
        roots = components(stored(links.union(verified(docs, _meeting(_rare(docs, mixed))))))

    named = sets.select("mark", "node").join(roots, "node", "left").select("mark", F.coalesce("root", "node").alias("root"))
    return found.join(stored(named), "mark").select("_row", "doc_id", "root")


def group_both(docs: DataFrame) -> DataFrame:
    """_row, doc_id and root of docs with _row, doc_id and text: rows have one root exactly when SimHash links, near texts or both connect them."""
    marks = simhash.group(docs).select("_row", F.col("root").alias("mark"))
    found = stored(group(docs).join(marks, "_row"))
    met = stored(found.select("mark", "root").distinct())
    several = met.groupBy("mark").agg(F.min("root").alias("a"), F.max("root").alias("high")).where("a < high").select("mark", "a")
    links = stored(met.join(several, "mark").where("a < root").select("a", F.col("root").alias("b")).distinct())
    roots = components(links).select(F.col("node").alias("root"), F.col("root").alias("upper"))
    return found.join(roots, "root", "left").select("_row", "doc_id", F.coalesce("upper", "root").alias("root"))
