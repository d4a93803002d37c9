"""The pipeline's stages, each against its operator's rule on its own input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from ledgerlark.llm import decontam, mixing, quality

D = "/root/testdata/sf0.01"


def near_slowly(rows):
    """The smallest doc_id of each group of texts whose five-word shingle sets have a similarity of 0.8 or more, by comparing all pairs that share a shingle."""
    sets, holders = [], defaultdict(list)
    for i, r in enumerate(rows):
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets.append({tuple(ws[j : j + 5]) for j in range(max(len(ws) - 4, 1))} if ws else {()})
        for g in sets[-1]:
            holders[g].append(i)
    roots = list(range(len(rows)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    shared = Counter((i, j) for held in holders.values() for j in held for i in held if i < j)
    for (i, j), n in shared.items():
        if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
            roots[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return set(least.values())


def test_stages_of_odd_rows(spark):
    """Null, blank, repeated and long texts, null ids and more columns pass every stage."""
    rows = [(1, None, None, None, None, "k"), (2, "", "en", "a", 0, "k"), (None, " \n", "en", "a", 2, "k"), (3, "one two three", "en", "b", 13, "k"), (3, "one two three", "en", "b", 13, "k"), (4, "word " * 50_000, "en", "c", 250_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies string")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        assert out.columns[: len(docs.columns)] == docs.columns
        kept[name] = {(r.doc_id, r.text) for r in out.collect()}
    blank = [(1, None), (2, ""), (None, " \n")]
    assert kept["SimHash near-dedup"] == {(1, None), (3, "one two three"), (4, "word " * 50_000)}
    assert kept["benchmark decontamination"] == kept["sharding"] == {(i, t) for i, t, *_ in rows}
    assert not kept["mixing sources to target weights"] & set(blank)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    step = {}
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, D).write.parquet(f"file://{tmp_path}/{len(step)}")
        out = spark.read.parquet(f"file://{tmp_path}/{len(step)}")
        step[name] = (docs, out)
        if name != "sharding":
            assert out.columns == docs.columns
        docs = out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    given, kept = step["quality classifier"]
    assert ids(kept) == ids(quality.score(given, spark.read.parquet(f"{D}/labels.parquet")).where("keep"))
    given, kept = step["SimHash near-dedup"]
    assert ids(kept) == near_slowly(given.select("doc_id", "text").collect()) and kept.count() == len(ids(kept))
    given, kept = step["benchmark decontamination"]
    assert ids(kept) == ids(decontam.op8(given, spark.read.parquet(f"{D}/benchmark.parquet")).where("not contaminated"))
    given, kept = step["mixing sources to target weights"]
    want = Counter({r.doc_id: r.taken // r["size"] for r in mixing.op1(given).where("taken > 0").collect()})
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == want
    given, kept = step["sharding"]
    assert sorted(kept.select(*given.columns).collect()) == sorted(given.collect())
    sizes = Counter(r.shard for r in kept.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_run_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, D).count() > 0
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{D}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
