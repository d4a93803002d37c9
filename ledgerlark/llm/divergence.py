"""Audit how far the words of a language's sources lie apart: every pair of sources, and the terms that mark a source.

One pass counts terms; a posting list says in which sources of its language a term stands,
how often. A source's terms are filed by buckets of their count. The largest count of a
bucket and its smallest count in the language bound every value in it, so buckets are
evaluated best first until no bound of an unseen one reaches a source's k-th value. Values
of pairs are sums over the postings; what a pair's sources lack is added by number.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bounded_text_batches, stored

#: Documents that a term must have, marking terms that are returned, and what shares are counted in.
LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Terms that a counting task holds before it hands them on, and bytes of a text that are cut at a time.
HELD, BLOCK = 1 << 20, 1 << 24
#: Most groups (language, source). Their numbers are sent to all tasks; the result has a row for every pair of a language's.
MOST_GROUPS = 1 << 20

_CUT = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
_SPACED = bytes(32 if _CUT.match(bytes([c])) else c | 0x20 if c < 0x80 else c for c in range(256))


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, A-Z in lower case, a block at a time."""
    at, text = 0, text or b""
    while at < len(text):
        cut = _CUT.search(text, at + BLOCK)
        end = cut.start() if cut else len(text)
        yield text[at:end].translate(_SPACED).split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences) and docs (rows that hold it), summed over as many rows as HELD terms allow."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (uses, docs) in held.items():
            found = list(uses)
            for i in range(0, len(found), 1 << 16):
                part = found[i : i + (1 << 16)]
                group = [pa.repeat(pa.scalar(x, pa.string()), len(part)) for x in (lang, source)]
                numbers = [pa.array(np.fromiter(map(c.__getitem__, part), np.int64, len(part))) for c in (uses, docs)]
                yield pa.RecordBatch.from_arrays([*group, pa.array(part, pa.binary()), *numbers], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
            uses, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in terms(text.as_py()):
                uses.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(uses) for uses, _ in held.values()) > HELD:
            yield from out()
    yield from out()


def _read(docs: DataFrame) -> DataFrame:
    """lang, source and text, null as ''."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def postings(docs: DataFrame) -> DataFrame:
    """lang, term, uses (its occurrences in the language) and sources (source, n) of each kept term, sorted by language in its files."""
    bounded_text_batches(docs.sparkSession)
    found = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    counts = found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    lists = counts.groupBy("lang", "term").agg(F.sum("n").alias("uses"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return stored(lists.where(F.col("docs") >= LEAST_DOCS).drop("docs"), "lang")


def _p(n: str, total: str) -> str:
    """SQL for the share of n occurrences among `total` (occurrences and one for each kept term), in SCALE parts, from 1."""
    return f"1 + (cast({SCALE} as decimal(10, 0)) * cast({n} + 1 as decimal(20, 0))) div cast({total} as decimal(20, 0))"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _groups(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """lang, source, v (kept terms of the language), base and lang_base (occurrences and v together, of the source and of the language); every group that occurs."""
    langs = lists.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("uses").alias("lang_n"))
    own = lists.select("lang", F.inline("sources")).groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    rows = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0)
    return stored(rows.select("lang", "source", "v", (F.col("own_n") + F.col("v")).alias("base"), (F.col("lang_n") + F.col("v")).alias("lang_base")))


def marking_terms(lists: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value and rank: a source's terms that it uses more than its language does, the `top` of largest value.

    Buckets hold terms of the same bit length of their count. A round evaluates each
    source's next best buckets, up to `top` more terms and twice as many every round, and
    a source is done once the bounds of its unseen buckets are all below its last value.
    """
    each = lists.select("lang", "term", "uses", F.inline("sources"))
    filed = stored(each.withColumn("bucket", F.length(F.bin("n")).cast("int")), "lang", "source", "bucket")
    bound = F.expr(f"if(p > q, {_f('p', 'q')}, -1)")
    buckets = filed.groupBy("lang", "source", "bucket").agg(F.max("n").alias("most"), F.min("uses").alias("least"), F.count(F.lit(1)).alias("terms")).join(groups, ["lang", "source"])
    buckets = buckets.withColumn("p", F.expr(_p("most", "base"))).withColumn("q", F.expr(_p("least", "lang_base"))).withColumn("bound", bound).where("bound >= 0")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = stored(buckets.select("lang", "source", "bucket", "base", "lang_base", "bound", F.coalesce(F.sum("terms").over(best), F.lit(0)).alias("before")))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best_so_far, wanted, upto = None, buckets.where(F.col("before") < top), top
    while not wanted.isEmpty():
        wanted = stored(wanted)
        numbers = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # of 64
        chosen = filed.where(F.col("bucket").isin(numbers)).join(wanted.select("lang", "source", "bucket", "base", "lang_base"), ["lang", "source", "bucket"])
        shares = chosen.withColumn("p", F.expr(_p("n", "base"))).withColumn("q", F.expr(_p("uses", "lang_base"))).where("p > q")
        found = shares.select("lang", "source", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
        if best_so_far is not None:
            found = found.union(best_so_far.drop("rank"))
        best_so_far = stored(found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))
        last = best_so_far.where(F.col("rank") == top).select("lang", "source", F.col("value").alias("last"))
        seen = wanted.select("lang", "source", "bucket")
        buckets = stored(buckets.join(seen, ["lang", "source", "bucket"], "left_anti"))
        open_ = buckets.join(last, ["lang", "source"], "left").where("last is null or bound >= last").drop("last")
        first = Window.partitionBy("lang", "source").orderBy("before")
        open_, upto = open_.withColumn("_from", F.min("before").over(first)), upto * 2
        wanted = open_.where(F.col("before") < F.col("_from") + upto).drop("_from")
    if best_so_far is None:
        return groups.where("false").select("lang", "source", F.lit("").alias("item"), F.lit(0).cast("long").alias("value"), F.lit(0).alias("rank"))
    return best_so_far


class _Lang:
    """The numbers of a language's sources in order of their names."""

    def __init__(self, rows: list):
        self.names = [r.source for r in rows]
        self.place = {name: i for i, name in enumerate(self.names)}
        self.base = np.array([r.base for r in rows], np.int64)
        self.none = self.p(np.zeros(len(rows), np.int64), np.arange(len(rows)))  # the share of a term that the source lacks

    def p(self, n: np.ndarray, source: np.ndarray) -> np.ndarray:
        if n.size and int(n.max()) >= (1 << 63) // SCALE - 1:  # too large for a product of longs
            return np.array([1 + SCALE * (int(a) + 1) // int(b) for a, b in zip(n.ravel(), self.base[source].ravel(), strict=True)], np.int64).reshape(n.shape)
        return 1 + SCALE * (n + 1) // self.base[source]


def _value(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


_CELL = "lang string, source string, item string, value long"


def _cells(lang: str, of: _Lang, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = pa.array(of.names, pa.string())
    for i in range(len(of.names)):
        rows = [pa.repeat(pa.scalar(x, pa.string()), len(names)) for x in (lang, of.names[i])]
        yield pa.RecordBatch.from_arrays([*rows, names, pa.array(sums[i])], ["lang", "source", "item", "value"])


def _by_lang(batches: Iterator[pa.RecordBatch], langs: dict[str, _Lang], add) -> Iterator[pa.RecordBatch]:
    """Sums of a cell for each two sources, a language at a time (rows come sorted by it), to which add(of, rows, sums) adds."""
    now, sums = None, None
    for batch in batches:
        names = batch.column("lang")
        for lang in names.unique().to_pylist():
            if lang != now:
                if now is not None:
                    yield from _cells(now, langs[now], sums)
                now, sums = lang, np.zeros((len(langs[lang].names),) * 2, np.int64)
            add(langs[lang], batch.filter(pa.compute.equal(names, lang)), sums)
    if now is not None:
        yield from _cells(now, langs[now], sums)


def _places(of: _Lang, column: pa.Array) -> np.ndarray:
    found = column.dictionary_encode()
    known = np.array([of.place[x] for x in found.dictionary.to_pylist()], np.int64)
    return known[found.indices.to_numpy(zero_copy_only=False)]


def _add_postings(of: _Lang, rows: pa.RecordBatch, sums: np.ndarray) -> None:
    """What two sources that both have a term add beyond what each adds by itself; lists of the same length together."""
    lists = rows.column("sources")
    flat, starts = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    place, n = _places(of, flat.field("source")), flat.field("n").to_numpy(zero_copy_only=False)
    p, long = of.p(n, place), np.diff(starts)
    for size in np.unique(long[long > 1]):
        at = starts[:-1][long == size][:, None] + np.arange(size)
        where, have = place[at], p[at]
        for i in range(size):
            s, ps = where[:, i : i + 1], have[:, i : i + 1]
            more = _value(ps, have) - _value(ps, of.none[where]) - _value(of.none[s], have) + _value(of.none[s], of.none[where])
            np.add.at(sums, (np.broadcast_to(s, where.shape), where), more)


def _add_counts(of: _Lang, rows: pa.RecordBatch, sums: np.ndarray) -> None:
    """What `terms` terms that a source has n times add to its pairs, in both directions, as if the other had none of them."""
    place, n, terms_ = _places(of, rows.column("source")), rows.column("n").to_numpy(), rows.column("terms").to_numpy()
    p = of.p(n, place)
    for s, ps, m in zip(place, p, terms_, strict=True):
        sums[s] += m * (_value(ps, of.none) - _value(of.none[s], of.none))
        sums[:, s] += m * (_value(of.none, ps) - _value(of.none, of.none[s]))


def pairs(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source) and value: f summed over all kept terms of the language.

    A pair's sum is what it would be without any term, plus what each source's own counts
    change (terms of equal count at once), plus what the postings change where both have a
    term. A task holds a cell for each pair of one language at a time.
    """
    number = groups.count()
    if number > MOST_GROUPS:
        raise ValueError(f"{number} pairs of language and source; {MOST_GROUPS} at most")
    by: dict[str, list] = {}
    for r in groups.where("v > 0").select("lang", "source", "base").collect():
        by.setdefault(r.lang, []).append(r)
    langs = {lang: _Lang(sorted(rows, key=lambda r: r.source.encode("utf-8", "surrogatepass"))) for lang, rows in by.items()}
    counts = lists.select("lang", F.inline("sources")).groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms"))
    alone = counts.sortWithinPartitions("lang").mapInArrow(lambda batches: _by_lang(batches, langs, _add_counts), _CELL)
    both = lists.select("lang", "sources").mapInArrow(lambda batches: _by_lang(batches, langs, _add_postings), _CELL)
    parts = alone.union(both).groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38, 0)")).alias("part"))
    p0, q0 = _p("0", "base"), _p("0", "other")
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other"))
    every = groups.join(other, "lang").where("source <> item").withColumn("p", F.expr(f"if(v = 0, 1, {p0})")).withColumn("q", F.expr(f"if(v = 0, 1, {q0})"))
    found = every.join(parts, ["lang", "source", "item"], "left")
    return found.select("lang", "source", "item", (F.coalesce("part", F.lit(0).cast("decimal(38, 0)")) + F.col("v") * F.expr(_f("p", "q"))).cast("long").alias("value"))


def audit(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank of docs with lang, source and text.

    Null counts as ''. Groups without terms have pairs, of value 0 where the language keeps
    no term; texts of any length count whole; repeated rows are documents of their own; equal
    values rank by the item's bytes; an empty table has no rows; other columns are not read.
    """
    docs = _read(docs)
    lists = postings(docs)
    groups = _groups(docs, lists)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    near = pairs(lists, groups).withColumn("rank", F.row_number().over(ranked))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    marks = marking_terms(lists, groups, top)
    return near.withColumn("part", F.lit("pair")).select(*columns).union(marks.withColumn("part", F.lit("term")).select(*columns))


def op13(docs: DataFrame) -> DataFrame:
    return audit(docs)


SQL = rf"""
WITH d AS (SELECT row_number() OVER () r, coalesce(lang, '') lang, coalesce(source, '') source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') t FROM documents),
o AS (SELECT r, lang, source, unnest(t) term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*)::HUGEINT v, sum(n)::HUGEINT total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, l.v, coalesce(sum(c.n), 0)::HUGEINT total FROM g JOIN l USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + s.v) p, 1 + ({SCALE}::HUGEINT * (k.n + 1)) // (l.total + l.v) q
      FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(pairs.value, 0)::BIGINT value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM f
QUALIFY part = 'pair' OR rank <= {TOP}
"""
