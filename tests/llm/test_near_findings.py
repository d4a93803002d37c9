"""What the third round's findings asked of the near-dedup stage."""

import random

import corpus_pipeline
from ledgerlark.llm import simhash, similar

STAGE = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_the_stage_links_by_fingerprints_too(spark):
    """What is said once beside what is said 300 times changes no fingerprint, but a third of the shingle set."""
    rng = random.Random(5)
    often = " ".join(words(rng, 21) * 300)
    texts = [often, f"{often} {' '.join(words(rng, 15))}", " ".join(words(rng, 40))]
    assert (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).bit_count() <= simhash.MOST_BITS
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "_row long, doc_id long, text string")
    assert len({r.root for r in similar.group(docs).collect()}) == 3
    assert sorted(r.doc_id for r in STAGE(spark, docs, "").collect()) == [0, 2]


def test_both_kinds_of_links_connect(spark):
    """0 and 1 by fingerprint, 1 and 2 by shingles, 3 and 4 by both; null and blank texts are one."""
    rng = random.Random(6)
    often, more = " ".join(words(rng, 21) * 300), words(rng, 15)
    apart = words(rng, 30) * 20
    texts = [often, f"{often} {' '.join(more)}", " ".join(often.split()[:42] + more), " ".join(apart), " ".join([*apart, "x"]), None, " \n"]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "_row long, doc_id long, text string")
    fingers, sets, both = ([{r._row: r.root for r in f(docs).collect()}[i] for i in range(7)] for f in (simhash.group, similar.group, similar.group_both))
    assert fingers[0] == fingers[1] != fingers[2] and sets[0] != sets[1] == sets[2]
    assert both[0] == both[1] == both[2] and both[3] == both[4] and both[5] == both[6] and len(set(both)) == 3


def test_copies_with_edits_of_their_own_do_not_meet_in_pairs(spark, monkeypatch):
    """A text's many copies, most of them too far edited to be near: the groups are brute force's, the pairs compared are fewer than ten a row."""
    rng, rows = random.Random(7), []
    base = words(rng, 150)
    for i in range(250):
        copy = list(base)
        for _ in range(rng.choice([1, 4, 5, 6, 8])):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        rows.append(copy)
        if i % 10 == 0:
            rows.append([*copy, "more"])  # near to its own source at least
        if i % 25 == 0:
            rows.append(copy[: len(copy) * 9 // 10])
    sets = [{tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} for ws in rows]
    roots = list(range(len(rows)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                roots[find(i)] = find(j)
    compared, verified = [], similar.verified
    monkeypatch.setattr(similar, "verified", lambda docs, pairs: compared.append(pairs.count()) or verified(docs, pairs))
    docs = spark.createDataFrame([(i, i, " ".join(ws)) for i, ws in enumerate(rows)], "_row long, doc_id long, text string")
    got = {r._row: r.root for r in similar.group(docs).collect()}
    assert len({find(i) for i in got}) > 50
    assert len({(got[i], find(i)) for i in got}) == len(set(got.values())) == len({find(i) for i in got})
    assert sum(compared) < 10 * len(rows)
