"""Mixing, exact and near duplicates, decontamination: brute force and odd inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlark.llm import _shared, decontam, exact_dedup, mixing, simhash, similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, n int, first string"
W = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(W[(i * i + i // 7) % len(W)] for i in range(30_000))
ROWS = [
    (1, " ".join(W), "en", "b", 1), (2, "  ".join(W), "en", "a", 1), (3, " ".join(W).upper(), None, "a", None), (4, None, "en", None, 1),
    (5, "", "en", "a", 1), (6, " \t\n", "en", None, 1), (7, LONG, "en", "c", 1), (7, LONG, "en", "c", 1), (None, " ".join(W), "en", "b", 1),
    (8, "Σ один два", "ru", "b", 1), (9, " ".join(W[:19]), "en", "d", 1), (10, "solo", "en", "d", 1), (11, "the quick solo fox", "en", "\U0001F600", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in ROWS], SCHEMA)


def test_exact(docs):
    got = exact_dedup.op5(docs).collect()
    groups = defaultdict(list)
    for i, (d, t, *_) in enumerate(ROWS):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, i))
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == len(groups)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): sorted(v) for k, v in groups.items()}
    for r in got:
        best = by_sha[r.text_sha256]
        assert r.group_size == len(best) and r.keep_id == (None if best[0][1] else best[0][2])


def test_exact_tells_colliding_digests_apart(docs, monkeypatch):
    want = sorted(exact_dedup.op5(docs).select("doc_id", "keep_id", "group_size", "kept").collect(), key=str)
    sha2 = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: sha2(F.substring(sha2(c, n), 1, 1), n))
    got = exact_dedup.op5(docs).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(got, key=str) == want


def test_index_of_many_memtables_and_later_batches(docs):
    """Runs of three documents merged two at a time give what one run gives, and what is added later is found."""
    want = sorted(exact_dedup.dedup(docs).collect(), key=str)
    assert sorted(exact_dedup.dedup(docs, memtable_rows=3, fanout=2).collect(), key=str) == want
    index = exact_dedup.Index(memtable_rows=3, fanout=2)
    seen = []
    for part in range(4):
        batch = docs.where(F.col("doc_id") % 4 == part)
        found = {r.doc_id: r.known for r in index.lookup(exact_dedup.entries(batch)).select("doc_id", F.col("first.doc_id").alias("known")).collect()}
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
        for r in batch.collect():
            best = sorted((-len(t or ""), d) for d, t in seen if norm(t) == norm(r.text))
            assert found.get(r.doc_id) == (best[0][1] if best else None)
        seen += [(r.doc_id, r.text) for r in batch.collect()]
        index.add(exact_dedup.entries(batch))
    assert len(index.runs) < 4 and all(run.rows.groupBy("digest").count().where("count > 1").isEmpty() for run in index.runs)


def test_a_filter_is_probed_before_its_run(docs):
    index = exact_dedup.Index()
    index.add(exact_dedup.entries(docs))
    passed = index.runs[0].may_hold(docs.sparkSession.range(2000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")))
    assert passed.count() < 20


def test_exact_empty(docs):
    assert exact_dedup.op5(docs.limit(0)).count() == 0


def near_slowly(rows):
    marks = []
    for d, t, *_ in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        marks.append((d, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))))
    roots = list(range(len(marks)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i, (_, x) in enumerate(marks):
        for j in range(i):
            if (x ^ marks[j][1]).bit_count() <= 2:
                roots[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(marks):
        ids[find(i)].append(d)
    return Counter((d, f"{x:016x}", min((y for y in ids[find(i)] if y is not None), default=None)) for i, (d, x) in enumerate(marks))


def test_near(docs, spark):
    assert Counter(map(tuple, simhash.op7(docs).collect())) == near_slowly(ROWS)
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, _, c in near_slowly(ROWS)})
    assert simhash.op7(docs.limit(0)).count() == 0


def test_near_on_the_small_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, simhash.op7(docs).collect())) == near_slowly(rows)


def test_near_dedup_keeps_unrelated_texts_with_null_or_repeated_ids(spark):
    texts = [" ".join(W[i:] + W[:i]) + f" tail{i} end{i}" for i in range(0, 12, 2)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (1, texts[3]), (1, texts[4]), (2, texts[5]), (None, texts[0]), (None, texts[5])]
    assert len({x for _, x, _ in near_slowly(rows)}) == len(texts)
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter(rows[:6])


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))} if ws else set()


def test_the_stage_finds_every_near_copy(spark):
    rng = random.Random(1)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    for i in range(40):
        ws = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 60, 200, 700]))]
        for j in range(5):
            copy = list(ws)
            for _ in range(rng.randrange(1 + len(ws) // 40)):
                copy[rng.randrange(len(ws))] = f"new{rng.randrange(5000)}"
            rows.append((None if j == 3 else 100_000 + 10 * i + j, " ".join(copy)))
    sets = [shingles(t) for _, t in rows]
    near = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if (not x and not y) or (x and y and 5 * len(x & y) >= 4 * len(x | y))]
    roots = list(range(len(rows)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i, j in near:
        roots[find(i)] = find(j)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_row long, doc_id long, text string")
    got = {r._row: r.root for r in similar.group(docs).collect()}
    assert sum(sets[i] != sets[j] for i, j in near) > 40
    assert len({(got[i], find(i)) for i in got}) == len(set(got.values())) == len({find(i) for i in got})
    kept = simhash.near_dedup(docs, similar.group)
    assert kept.columns == docs.columns and len({find(r._row) for r in kept.collect()}) == kept.count() == len(set(got.values()))
    assert simhash.near_dedup(docs.limit(0), similar.group).count() == 0
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert stage(spark, docs, "").count() == kept.count()


@pytest.mark.parametrize("comparisons", [0, 50, 4096])
def test_links_and_components_by_brute_force(spark, monkeypatch, comparisons):
    monkeypatch.setattr(simhash, "LIST_PAIRS", comparisons)  # all values crowded, some, none
    marks = sorted({(c ^ (1 << a) ^ (1 << b)) & (1 << 64) - 1 for c in (0, 0xFFFF0000FFFF0000, 12345) for a in range(0, 64, 5) for b in range(0, 64, 7)})
    signed = [simhash._signed(m) for m in marks]
    pairs = simhash.links(spark.createDataFrame([(m,) for m in signed], "mark long"))
    roots = {r.node: r.root for r in simhash.components(pairs).collect()}
    slow = {m: m for m in signed}
    for _ in signed:
        new = {m: min(slow[k] for k in signed if ((k ^ m) & (1 << 64) - 1).bit_count() <= 2) for m in signed}
        if new == slow:
            break
        slow = new
    assert {m: roots.get(m, m) for m in signed} == slow


def test_segments_fetch_more_than_links(spark):
    """What the tables find is verified: candidates share a segment to within a bit, and most are no links."""
    rng = random.Random(3)
    marks = [simhash._signed(rng.getrandbits(8) << 32 | rng.getrandbits(32)) for _ in range(300)]
    df = spark.createDataFrame([(m,) for m in set(marks)], "mark long")
    table = simhash._filed(df).groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n"))
    found = simhash._looked_up(table).agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    real = sum(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a in set(marks) for b in set(marks) if a < b)
    assert found > 10 * real and simhash.links(df).count() == real


def test_components_of_a_long_path(spark):
    n = 300
    pairs = spark.range(n - 1).select(((F.col("id") * 7919) % n).alias("a"), (((F.col("id") + 1) * 7919) % n).alias("b"))
    assert {r.root for r in simhash.components(pairs).collect()} == {0}


def test_mix(docs):
    got = mixing.op1(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    total = sum(r["size"] for r in got)
    aims = {(r.source_size, r.target) for r in got}
    assert abs(sum(t for _, t in aims) - 1.5 * total) < 1 and all(t <= 2 * s for s, t in aims)
    assert sorted(map(str, mixing.op1(docs.repartition(3)).collect())) == sorted(map(str, got))
    assert mixing.mix(docs).columns == docs.columns
    words = mixing.mix(docs).select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words == sum(r.taken for r in got)
    assert mixing.op1(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    assert mixing.op1(docs.where("text is null or trim(text) = ''")).agg(F.sum("taken")).first()[0] == 0


def test_mix_comes_near_its_targets(spark):
    got = mixing.op1(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).groupBy("source_size", "target")
    for r in got.agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect():
        assert abs(r.t - r.target) <= 2 * r.m


def test_decontamination(docs, spark):
    items = [(100, " ".join(W[:15])), (101, "solo"), (102, None), (103, "  "), (9, " ".join(W[:15])), (104, "quick solo"), (None, "solo")]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n long")
    got = decontam.op8(docs, bench).collect()
    want = Counter()
    toks = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for d, t, *_ in ROWS:
        ws, hit, ids = toks(t), set(), set()
        for item, text in items:
            iw = toks(text)
            n = min(13, len(iw))
            grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if iw else set()
            for i in range(len(ws) - n + 1 if n else 0):
                if tuple(ws[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    ids |= {str(item)} - {"None"}
        want[(d, len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws))] += 1
    assert Counter(map(tuple, got)) == want
    assert decontam.op8(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontam.op8(docs, bench.limit(0)).collect())
    assert decontam.decontaminate(docs, bench).columns == docs.columns


def test_proximity(spark):
    docs = spark.createDataFrame([(0, 1, "red x x green blue"), (1, 2, "red green blue"), (2, 3, "blue x x x x x x x red")], "_row long, doc_id long, text string")
    asked, anchors, posted = decontam.index(docs, spark.createDataFrame([(1, "red green")], "item_id long, text string"))
    assert {r._row for r in decontam.matches(anchors, posted).collect()} == {1}
    assert {r._row for r in decontam.matches(anchors, posted, slop=2).collect()} == {0, 1}


@pytest.mark.parametrize("most", [0, 16_384])
@pytest.mark.parametrize("keep", [True, False])
def test_picked_rows_by_bitmap_and_by_join(docs, monkeypatch, most, keep):
    monkeypatch.setattr(_shared, "MOST_BITMAPS", most)
    rows = _shared.keyed(docs.repartition(3))
    marks = rows.where("_doc.doc_id % 2 = 0").select("_row")
    got = _shared.picked(rows, marks, keep).select("_row").collect()
    want = rows.where("_doc.doc_id % 2 = 0" if keep else "_doc.doc_id % 2 <> 0 or _doc.doc_id is null").select("_row").collect()
    assert sorted(got) == sorted(want)
