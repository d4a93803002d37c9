"""Score documents with a stupid-backoff bigram model of the whole corpus, each without itself.

A corpus that scores its own documents has seen all their bigrams, so nothing would ever
back off; therefore a document is scored by the counts of all others. A bigram that
others hold scores log(count / count of its first word), any other
log(BACKOFF * count of its last word / all bigrams); no count above 0 is left out.

Words are told apart by 64-bit hashes. Bigrams go to buckets by their last word, or by
their first where the last is one of the corpus's most frequent words; where both are,
they stay spread, and the buckets' counts are summed. A block of documents sends each
bucket one row with all its bigrams. In its bucket a bigram is counted and joined to the
counts; partial sums then come together per document.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded_text_batches, stored

BACKOFF = 0.4
#: Bigrams of a bucket on average; words with 1 / HOT of all are frequent, and there are at most HOT such.
BUCKET_GRAMS, HOT = 3_000_000, 1000
#: Buckets at most; beyond, they grow.
MOST_BUCKETS = 50_000
#: Words that a batch counter holds before it hands them on.
COUNTER = 300_000


def tokens(text: str | None) -> list[bytes]:
    """A-Z in lower case, parted by ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hashes(words: list[bytes]) -> np.ndarray:
    """Spark's xxhash64 of words."""
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)).view(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (its hash), first (bigrams that it begins) and last (that it ends), over all documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, starts, ends = Counter(), Counter(), Counter()  # a document's last word begins no bigram, its first one ends none

        def out() -> pa.RecordBatch:
            words = list(held)
            columns = {"word": pa.array(_hashes(words))} | {n: pa.array([held[w] - c[w] for w in words], pa.int64()) for n, c in (("first", ends), ("last", starts))}
            held.clear(), starts.clear(), ends.clear()
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for text in batch.column("text"):
                if words := tokens(text.as_py()):
                    held.update(words)
                    starts[words[0]] += 1
                    ends[words[-1]] += 1
                    if len(held) > COUNTER:
                        yield out()
        if held:
            yield out()

    return docs.select("text").mapInArrow(read, "word long, first long, last long").groupBy("word").agg(F.sum("first").alias("first"), F.sum("last").alias("last"))


#: Kinds of packed entries: bigrams, those of two frequent words, and documents.
GRAMS, FREQUENT, DOCUMENTS = 0, 1, 2
_NUMBERS = ("kind", "times", "own_first", "own_last")


def _packed(doc_id: T.DataType) -> T.StructType:
    """Nothing is null and every reader takes all columns, so Spark shuffles them once."""
    lists = [("docs", T.ShortType()), *((n, T.IntegerType()) for n in _NUMBERS), ("ids", doc_id)]
    plain = [("bucket", T.IntegerType()), ("base", T.LongType()), ("firsts", T.StringType()), ("lasts", T.StringType())]
    return T.StructType([T.StructField(n, t, False) for n, t in plain] + [T.StructField(n, T.ArrayType(t), False) for n, t in lists])


def _pack(docs: DataFrame, n: int, hot: frozenset[int]) -> DataFrame:
    """Rows of a block of documents for a bucket: its bigrams as two texts of a word a line, with their document (after base), times there, and the times that their words begin and end one there.

    Sorted by last and first word, so the shuffle compresses. One more row of each block
    has its documents instead, with times their numbers of bigrams.
    """
    frequent = np.array(sorted(hot), np.int64)
    columns = ["bucket", "base", "firsts", "lasts", "docs", *_NUMBERS, "ids"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, names, known = batch.column("_row").to_numpy(), batch.column("doc_id"), defaultdict(count().__next__)  # words by number
            parts, long = [], []
            for i, text in enumerate(batch.column("text")):
                words = np.array(list(map(known.__getitem__, tokens(text.as_py()))), np.int64)
                long.append(max(len(words) - 1, 0))
                code, times = np.unique(words[:-1] << 32 | words[1:], return_counts=True)
                a, b = code >> 32, code & 0xFFFFFFFF
                sums = [_sums(words[:-1], a), _sums(words[1:], b)]
                parts.append((a, b, np.full(len(a), i), times, *sums))
            a, b, doc, times, own_a, own_b = (np.concatenate(c) for c in zip(*parts, strict=True))
            value = _hashes(list(known))
            spread = np.isin(value, frequent)
            both = spread[a] & spread[b]
            slot = np.where(both, (value[a] ^ value[b]) + rows[0], np.where(spread[b], value[a], value[b])) % n * 2 + both
            small = len(known) < 1 << 21
            order = np.argsort(slot << 42 | b << 21 | a) if small else np.lexsort((a, b, slot))
            slot = slot[order]
            heads = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])[: len(slot)])
            ends = pa.array(np.append(heads, len(order)).astype(np.int32))
            words = pa.array(list(known), pa.binary())
            lines = [pc.binary_join(pa.ListArray.from_arrays(ends, words.take(pa.array(x[order]))), b"\n").cast(pa.string()) for x in (a, b)]
            numbers = [(doc[order], np.int16), (slot % 2, np.int32), *((x[order], np.int32) for x in (times, own_a, own_b))]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(t))) for x, t in numbers]
            none = pa.ListArray.from_arrays(pa.array(np.zeros(len(heads) + 1, np.int32)), names.slice(0, 0))
            base = pa.array(np.full(len(heads), rows[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array((slot[heads] // 2).astype(np.int32)), base, *lines, *lists, none], columns)
            zeros, blank = [0] * len(rows), pa.array(["\n" * (len(rows) - 1)])
            own = [pa.array([(rows - rows[0]).tolist()], pa.list_(pa.int16())), *(pa.array([v], pa.list_(pa.int32())) for v in ([DOCUMENTS] * len(rows), long, zeros, zeros))]
            yield pa.RecordBatch.from_arrays([pa.array([int(rows[0]) % n], pa.int32()), pa.array([rows[0]], pa.int64()), blank, blank, *own, pa.array([names.to_pylist()], pa.list_(names.type))], columns)

    return docs.select("_row", "doc_id", "text").mapInArrow(pack, _packed(docs.schema["doc_id"].dataType))


def _sums(words: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How often each wanted word is among the words."""
    seen, n = np.unique(words, return_counts=True)
    return n[np.searchsorted(seen, wanted)] if len(wanted) else wanted


def _same(a: str, b: str) -> Column:
    """a = b, in a form that does not become a join key: joins look up two ints as one long, and the whole values decide."""
    return (F.col(a) <= F.col(b)) & (F.col(a) >= F.col(b))


def score(docs: DataFrame, buckets: int | None = None, hot_share: int = HOT, backoff: float = BACKOFF) -> DataFrame:
    """One row a document: doc_id, n_scored (its bigrams), log_score (their sum) and perplexity.

    Null, empty and one-word texts score no bigram: log_score 0, perplexity null. Very long
    texts are scored whole. Repeated rows are documents of their own, so each is scored by
    the counts of the others. A last word that no other document has counts as seen once.
    An empty table gives no rows; extra columns are not read.
    """
    spark = docs.sparkSession
    bounded_text_batches(spark)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # buckets place the rows of joins on bucket and more
    docs = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    seen_total = Observation()
    # A word that ends one bigram only needs no row: what is not among the others has a count of 1.
    words = stored(word_counts(docs).observe(seen_total, F.sum("last").alias("total")).where("first > 1 or last > 1"))
    total = seen_total.get["total"] or 0
    frequent = F.greatest("first", "last") * hot_share >= total
    hot = words.where(frequent).select("word", "last")
    known = frozenset(r["word"] for r in hot.collect())  # 2 * hot_share rows at most
    n = buckets or min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_GRAMS + 1))

    dealt = _pack(docs, n, known).repartitionById(n, "bucket")
    lists = [F.split("firsts", "\n").alias("first"), F.split("lasts", "\n").alias("last"), F.col("docs").alias("doc"), *(F.col(x).alias(x) for x in _NUMBERS), F.col("ids").alias("doc_id")]
    hashed = lambda df: df.withColumns({"first": F.xxhash64("first"), "last": F.xxhash64("last")})

    # Bigrams of one document only are never seen elsewhere. Counts of two frequent words come together from all buckets.
    counts = hashed(dealt.select("bucket", F.inline(F.arrays_zip(*lists, F.array("base").alias("base")))))
    counts = counts.groupBy("bucket", "kind", "first", "last").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("docs"))
    counts = counts.where(((F.col("docs") > 1) & (F.col("kind") == GRAMS)) | (F.col("kind") == FREQUENT)).repartition(n, "first")
    counts = counts.withColumn("n", F.sum("n").over(Window.partitionBy("first", "last")))
    words = words.select(F.col("word"), F.col("first").alias("begins"), F.col("last").alias("ends"))
    counts = counts.join(words.select(F.col("word").alias("first"), "begins"), "first")
    counts = counts.select(F.col("bucket").alias("b1"), F.col("first").alias("first1"), F.col("last").alias("last1"), "n", "begins")
    counts = counts.repartitionById(n, "b1").withColumn("h1", F.hash("first1", "last1")).hint("shuffle_hash")

    rare = words.where("ends > 1").join(F.broadcast(hot.select("word")), "word", "left_anti")
    ends = rare.select(F.pmod("word", F.lit(n)).cast("int").alias("b2"), F.col("word").alias("last2"), F.col("ends").alias("cold"))
    ends = ends.repartitionById(n, "b2").withColumn("h2", F.hash("last2")).hint("shuffle_hash")
    often = F.broadcast(hot.select(F.col("word").alias("last"), F.col("last").alias("often")))

    left = hashed(dealt.select("bucket", "base", F.inline(F.arrays_zip(*lists)))).withColumn("g", F.hash("first", "last")).withColumn("e", F.hash("last"))
    c = F.col
    scored = left.join(counts, (c("bucket") == c("b1")) & (c("g") == c("h1")) & _same("first", "first1") & _same("last", "last1"), "left")
    scored = scored.join(ends, (c("bucket") == c("b2")) & (c("e") == c("h2")) & _same("last", "last2"), "left").join(often, "last", "left")
    others = c("n") - c("times")
    held = F.when(others > 0, F.ln(others / (c("begins") - c("own_first"))))
    backed = F.ln(F.lit(backoff) * F.greatest(F.coalesce("cold", "often", F.lit(1)) - c("own_last"), F.lit(1)) / F.lit(max(total, 1)))
    real = c("kind") != DOCUMENTS
    part = F.when(real, F.coalesce(held, backed) * c("times")).otherwise(0.0)
    row = (c("base") + c("doc")).alias("_row")
    out = scored.groupBy(row).agg(F.max("doc_id").alias("doc_id"), F.max(F.when(~real, c("times"))).cast("long").alias("n_scored"), F.sum(part).alias("log_score"))
    return out.select("doc_id", "n_scored", "log_score", F.when(c("n_scored") > 0, F.exp(-c("log_score") / c("n_scored"))).alias("perplexity"))


def op6(docs: DataFrame) -> DataFrame:
    return score(docs)


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), g AS (
  SELECT r, ws[i] AS a, ws[i + 1] AS b FROM (SELECT r, ws, unnest(range(1, len(ws))) AS i FROM d)
), own AS (SELECT r, a, b, count(*) AS n FROM g GROUP BY r, a, b), own_a AS (SELECT r, a, sum(n) AS n FROM own GROUP BY r, a), own_b AS (SELECT r, b, sum(n) AS n FROM own GROUP BY r, b),
ab AS (SELECT a, b, sum(n) AS n FROM own GROUP BY a, b), fa AS (SELECT a, sum(n) AS n FROM own GROUP BY a), lb AS (SELECT b, sum(n) AS n FROM own GROUP BY b),
v AS (
  SELECT own.r, own.n, CAST(CASE WHEN ab.n > own.n THEN ln((ab.n - own.n) / (fa.n - own_a.n)) ELSE ln(CAST(0.4 AS DOUBLE) * greatest(lb.n - own_b.n, 1) / (SELECT count(*) FROM g)) END AS DOUBLE) AS s
  FROM own JOIN ab USING (a, b) JOIN fa USING (a) JOIN lb USING (b) JOIN own_a ON own.r = own_a.r AND own.a = own_a.a JOIN own_b ON own.r = own_b.r AND own.b = own_b.b
), s AS (SELECT r, sum(n) AS n, sum(s * n) AS s FROM v GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_scored, coalesce(s, CAST(0 AS DOUBLE)) AS log_score, exp(-s / n) AS perplexity FROM d LEFT JOIN s USING (r)
"""
