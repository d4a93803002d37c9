"""Find benchmark passages in documents with a positional inverted index.

One scan of the documents stores the postings of all words of the benchmark: a list of
places for each document and word. Windows are looked up from their two rarest words, by
the number of postings: the words' lists, each moved back by the word's offset, are
intersected in every document, and what is left is intersected with the lists of all the
window's words. What every list holds is where the phrase starts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bit_is_set, bounded_text_batches, id_and_text, keyed, picked, stored

WINDOW, SHARE = 13, 20
#: The filter of wanted words: a fixed number of bits, whatever the benchmark's size. Words that it lets through by chance are dropped in the join.
FILTER_BITS = 1 << 23
#: Words whose answer a task remembers.
KNOWN = 200_000
#: A word with 1 / HOT of the terms' postings is joined in SALTS parts; there are HOT such at most.
HOT, SALTS = 1000, 64

#: A-Z in lower case; what is neither a digit, a letter nor beyond ASCII parts words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _bit(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) % FILTER_BITS


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = tokens(text)
            n = min(WINDOW, len(words))
            spans = {b" ".join(words[i : i + n]): None for i in range(len(words) - n + 1)} if words else {}
            if spans:
                yield pa.RecordBatch.from_pydict({"item_id": pa.array([item] * len(spans), batch.column("item_id").type), "window": [s.decode("utf-8", "surrogatepass") for s in spans]})


def windows(items: DataFrame) -> DataFrame:
    """item_id, window: the items' windows as words joined by spaces, each once an item."""
    id_type = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(_item_windows, f"item_id {id_type}, window string")


def _filter(words: DataFrame) -> np.ndarray:
    """FILTER_BITS bits as bytes; the executors set them, the driver joins their bounded parts."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {_bit(w.as_py().encode("utf-8", "surrogatepass")) for batch in batches for w in batch.column("word")}
        yield pa.RecordBatch.from_pydict({"bit": pa.array(sorted(seen), pa.int64())})

    bits = np.zeros(FILTER_BITS, bool)
    rows = words.mapInArrow(mark, "bit long").groupBy(F.floor(F.col("bit") / 32768).alias("part")).agg(F.collect_set(F.col("bit") % 32768).alias("bits"))
    for part in rows.toLocalIterator():  # FILTER_BITS values at most
        bits[np.array(part["bits"], np.int64) + part["part"] * 32768] = True
    return np.packbits(bits, bitorder="little")


def _wants(bits: np.ndarray):
    known: dict[bytes, bool] = {}

    def want(word: bytes) -> bool:
        if (got := known.get(word)) is None:
            if len(known) > KNOWN:
                known.clear()
            b = _bit(word)
            got = known[word] = bool(bits[b >> 3] >> (b & 7) & 1)
        return got

    return want


def postings(docs: DataFrame, words: DataFrame) -> DataFrame:
    """The index of docs for `words`: a row a document and word, with _row, word and at (the word's places), and a row a document without word, with doc_id and n_words."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter(words))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = _wants(bits.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            known = defaultdict(count().__next__)  # words by number
            codes = [np.fromiter(map(known.__getitem__, tokens(t.as_py())), np.int64) for t in batch.column("text")]
            sizes = np.array([len(c) for c in codes], np.int64)
            code, doc = np.concatenate(codes), np.repeat(np.arange(len(codes)), sizes)
            at = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            asked = np.fromiter(map(want, known), bool, len(known))[code] if len(code) else np.zeros(0, bool)
            code, doc, at = code[asked], doc[asked], at[asked]
            order = np.argsort(doc << 32 | code, kind="stable")
            code, doc, at = code[order], doc[order], at[order]
            heads = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))[: len(code)])
            lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(at)), pa.int32()), pa.array(at, pa.int32()))
            written = pa.array([w.decode("utf-8", "surrogatepass") for w in known], pa.string()).take(pa.array(code[heads]))
            rows, ids, n, none = batch.column("_row"), batch.column("doc_id"), len(codes), len(heads)
            yield pa.RecordBatch.from_arrays([rows, ids, pa.array(sizes), pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.int32()))], names)
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(doc[heads])), pa.nulls(none, ids.type), pa.nulls(none, pa.int64()), written, lists], names)

    names = ["_row", "doc_id", "n_words", "word", "at"]
    return docs.select("_row", "doc_id", "text").mapInArrow(read, f"_row long, doc_id {id_type}, n_words long, word string, at array<int>")


def index(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: the items' windows, the windows' two rarest terms by their number of postings, and the positional index of docs for all words of the items."""
    bounded_text_batches(docs.sparkSession)
    asked = stored(windows(items))
    placed = stored(asked.select("window").distinct().select("window", F.posexplode(F.split("window", " ")).alias("at", "word")))
    posted = stored(postings(docs, placed.select("word").distinct()))
    counts = posted.where("word is not null").groupBy("word").agg(F.sum(F.size("at")).alias("n"))
    rarest = Window.partitionBy("window").orderBy("n", "word", "at")
    terms = placed.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rank", F.row_number().over(rarest)).where("rank <= 2")
    return asked, stored(terms.select("window", F.size(F.split("window", " ")).alias("length"), "word", F.col("at").alias("offset"), "rank", "n")), posted


def _lists(terms: DataFrame, posted: DataFrame) -> DataFrame:
    """_row, window, length, rank and starts: where the window would start by each posting of a term.

    Postings of other words are left out by a bitmap of FILTER_BITS. Words that make up 1 / HOT
    of all postings, HOT at most, are spread over SALTS parts of the documents.
    """
    bit = F.pmod(F.xxhash64("word"), F.lit(FILTER_BITS)) + 1
    marks = terms.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("bit"))
    bitmaps = marks.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    lists = posted.where("word is not null").select("_row", "word", "at", F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("bit"))
    lists = lists.join(F.broadcast(bitmaps), "bucket").where(bit_is_set(F.col("bitmap"), F.col("bit"))).select("_row", "word", "at")
    counts = terms.select("word", "n").distinct()
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where((F.col("n") > 0) & (F.col("n") * HOT >= total)).select("word")
    hot = stored(hot.withColumn("hot", F.lit(True)))
    salted = lambda df: df.join(F.broadcast(hot), "word", "left")
    lists = salted(lists).withColumn("salt", F.when(F.col("hot"), F.pmod("_row", F.lit(SALTS))).otherwise(0)).drop("hot")
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    asked = salted(terms).withColumn("salt", F.explode(every.cast("array<long>"))).drop("hot")
    starts = F.filter(F.transform("at", lambda x: x - F.col("offset")), lambda x: x >= 0)
    return lists.join(asked, ["word", "salt"]).select("_row", "window", "length", "rank", starts.alias("starts")).where(F.size("starts") > 0)


def matches(terms: DataFrame, posted: DataFrame, slop: int = 0) -> DataFrame:
    """_row, window, length, start: where windows stand in documents, distinct.

    slop 0: exact phrases. The offset-adjusted lists of a window's two rarest terms are
    intersected in each document, and what is left with the lists of all its words. Above
    0: proximity, the two rarest words are in the document at their distance in the
    window, give or take slop; a one-word window needs its word.
    """
    lists = _lists(terms, posted)
    first, second = lists.where("rank = 1"), lists.where("rank = 2").select("_row", "window", F.col("starts").alias("others"))
    alone = first.where("length = 1").select("_row", "window", "length", F.explode("starts").alias("start"))
    first = first.where("length > 1")
    if slop:
        cell = lambda x: F.floor(x / (slop + 1))
        near = first.select("_row", "window", "length", F.explode("starts").alias("start")).withColumn("cell", F.explode(F.sequence(cell(F.col("start")) - 1, cell(F.col("start")) + 1)))
        other = second.select("_row", "window", F.explode("others").alias("start2")).withColumn("cell", cell(F.col("start2")))
        both = near.join(other, ["_row", "window", "cell"]).where(F.abs(F.col("start") - F.col("start2")) <= slop)
        return both.select(*alone.columns).union(alone).distinct()
    both = first.join(second, ["_row", "window"]).withColumn("starts", F.array_intersect("starts", "others")).where(F.size("starts") > 0)
    both = stored(both.select("_row", "window", "length", "starts"))
    words = both.select("_row", "window", "length", "starts", F.posexplode(F.split("window", " ")).alias("offset", "word"))
    held = picked(posted.where("word is not null").select("_row", "word", "at"), both.select("_row").distinct())
    kept = F.array_intersect("starts", F.transform("at", lambda x: x - F.col("offset")))
    agreed = words.join(held, ["_row", "word"]).select("_row", "window", "length", F.explode(kept).alias("start"))
    whole = agreed.groupBy("_row", "window", "length", "start").agg(F.count(F.lit(1)).alias("n")).where("n = length")
    return whole.select(*alone.columns).union(alone)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row a document of docs (_row, doc_id, text): _row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and blank texts have no words and are clean; very long texts are indexed whole.
    Items without words match nothing; repeated items count by their ids, null ids not at
    all. Repeated documents have rows of their own, ties do not arise, other columns of
    either table are not read. Either table may be empty.
    """
    asked, terms, posted = index(docs, items)
    found = stored(matches(terms, posted))
    so_far = Window.partitionBy("_row").orderBy("start", "end")
    spans = found.select("_row", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    reach = F.max("end").over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    hit = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(reach, F.lit(0))))).groupBy("_row").agg(F.sum("new").alias("n_hit"))
    ids = found.select("_row", "window").distinct().join(asked, "window").select("_row", F.col("item_id").cast("string").alias("item")).where("item is not null").distinct()
    ids = ids.groupBy("_row").agg(F.count("item").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    out = posted.where("word is null").select("_row", "doc_id", "n_words").join(hit, "_row", "left").join(ids, "_row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "_row", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * SHARE >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated documents."""
    rows = keyed(docs)
    return picked(rows, contamination(id_and_text(rows), items).where("contaminated"), keep=False).select("_doc.*")


def op8(docs: DataFrame, items: DataFrame) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    return contamination(rows, items).drop("_row")


SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark
), w AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM w), grams AS (
  SELECT r, i, n, array_to_string(ws[i : i + n - 1], ' ') AS g FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)
), hits AS (
  SELECT DISTINCT r, i, n, g FROM grams SEMI JOIN w USING (n, g)
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits JOIN w USING (n, g)) WHERE item IS NOT NULL GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
