"""Whitening, archives and divergence: brute force and odd inputs."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import divergence, warc, whitening

# --- whitening


def by_hand(rows, components=16):
    """vec_id, component: the contract's values, with whole numbers as Python has them."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    xs = [(i, tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v)) for i, v in kept]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    off = np.array([[float(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(off.T @ off / n)
    order = np.argsort(-values)[:components]
    out = []
    for i, x in xs:
        row = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
        for k, j in enumerate(order, 1):
            out.append((i, k, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), abs(row @ vectors[:, j]) / values[j] ** 0.5, values[j] / values.sum()))
    return out


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, component int, _x string").repartition(3)


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(200, 20)) @ rng.normal(size=(20, 20))).tolist()
    rows = list(enumerate(base)) + [(900 + i, base[0]) for i in range(50)]
    odd = [(300, None), (301, []), (302, [None] * 20), (303, [float("nan")] + [0.0] * 19), (304, [float("inf")] * 20), (305, [1.0, 2.0]), (None, base[3]), (1, base[4]), (306, [1e30] * 20)]
    got = whitening.op11(vectors_of(spark, rows + odd)).collect()
    want = by_hand(rows + [(None, base[3]), (1, base[4])])
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g)[:4] == w[:4]
        assert abs(g.whitened) == pytest.approx(w[4], abs=1e-9) and g.explained == pytest.approx(w[5], rel=1e-9) and g.identity_error < 1e-9
    assert {r.vec_id for r in got} == {i for i, _ in rows} | {None}


def test_components_of_no_variance_and_empty_tables(spark):
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(10)]
    got = whitening.op11(vectors_of(spark, line)).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)
    assert whitening.op11(vectors_of(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    assert whitening.op11(vectors_of(spark, [])).count() == 0


def test_large_deviations_are_exact_or_null(spark):
    rows = [(i, [float(i % 7) * 100, float(i)]) for i in range(1000)] + [(1000, [3e7, 0.0])]
    for g, w in zip(sorted(whitening.op11(vectors_of(spark, rows)).collect(), key=lambda r: r[:2]), sorted(by_hand(rows)), strict=True):
        assert tuple(g)[:3] == w[:3] and g.deviation == (w[3] if w[3] < 1 << 63 else None)
    assert sum(r.deviation is None for r in whitening.op11(vectors_of(spark, rows)).collect()) == 2


# --- archives

SCHEMA = "page_id long, url string, html string, kind string, payload int"
LONG = "".join(random.Random(3).choices("abcdefgh \r\n", k=100_000))
PAGES = [
    (5, "http://a/ b\r\nX: y", "<p>" + "same " * 40, "x", 1), (3, "http://b", "<p>" + "same " * 40, "x", 1), (9, None, "<p>" + "same " * 40, "x", 1), (3, "http://b", "<p>" + "same " * 40, "x", 1),
    (1, "u", None, "x", 1), (2, "u", "", "x", 1), (4, "u", "short", "x", 1), (6, "u", "short", "x", 1), (7, "u", LONG, "x", 1), (8, "u", LONG, "x", 1), (10, "u", LONG + "ä€😀", "x", 1),
    (11, "http://x/WARC/1.1", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 30, "x", 1), (12, "u", "WARC/1." * 9000, "x", 1), (None, "u", "no id " * 30, "x", 1), (None, "u", "no id " * 30, "x", 1), (13, "u", "no id " * 30, "x", 1),
    (14, "u", "é" * 50, "x", 1), (15, "u", "é" * 50, "x", 1), (16, "u", "e" * 99, "x", 1), (17, "u", "e" * 99, "x", 1), (18, "u", "\r\n\r\n" * 9000, "x", 1), (19, "u", "0\r\n\r\n", "x", 1),
]


def test_pages_come_back_from_archives(spark):
    got = sorted((tuple(r) for r in warc.op12(spark.createDataFrame(PAGES, SCHEMA).repartition(3)).collect()), key=str)
    by, want = defaultdict(list), []
    for page_id, _, html, _, _ in PAGES:
        by[(html or "").encode()].append(page_id)
    for payload, ids in by.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            again = k > 0 and len(payload) >= 100
            want.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    assert got == sorted(want, key=str)
    assert warc.op12(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_payload_holds_the_marker_in_one_piece():
    for payload in (b"WARC/1." * 5000, b"x" * 8190 + b"WARC/1.1", b"WARC/1", b""):
        framed = warc.chunked(payload)
        assert warc.MARK not in framed and warc.dechunked(framed) == payload
    assert warc.dechunked(b"5\r\nabc") is None and warc.dechunked(b"x\r\n") is None and warc.dechunked(b"3;a=b\r\nabc\r\n0\r\n\r\n") == b"abc"


def archive(tmp_path, *records):
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in records))
    return str(tmp_path / "a.warc")


def test_other_archives(spark, tmp_path):
    body = b"HTTP/1.0 200 OK\nContent-Type: text/html\n\nWARC/1.0\r\nis text here"
    alone = b"WARC/1.0\nwarc-type: response\nWARC-Record-ID: <a>\nWARC-Payload-Digest: sha256:" + hashlib.sha256(body.split(b"\n\n")[1]).hexdigest().encode() + b"\nContent-Length: " + str(len(body)).encode() + b"\n\n" + body
    info = warc.record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<i>"}, b"software: x")
    part = lambda n, origin, block, **more: warc.record({"WARC-Type": "response" if n == 1 else "continuation", "WARC-Record-ID": f"<{origin}{n if n > 1 else ''}>", "WARC-Segment-Number": n} | ({"WARC-Segment-Origin-ID": f"<{origin}>"} if n > 1 else {}) | {"WARC-Segment-Total-Length": more.get("total")}, block)
    head = b"HTTP/1.1 200 OK\r\n\r\n"
    whole = [part(3, "s", b"ghi", total=len(head) + 9), part(1, "s", head + b"abc"), part(2, "s", b"def")]
    gap = [part(1, "g", head + b"abc"), part(3, "g", b"ghi", total=len(head) + 6)]
    wrong = [part(1, "w", head + b"abc"), part(2, "w", b"d", total=999)]
    orphan = [part(2, "o", b"d", total=5)]
    again = warc.record({"WARC-Type": "revisit", "WARC-Record-ID": "<r>", "WARC-Refers-To": "<s>"}, b"")
    lost = warc.record({"WARC-Type": "revisit", "WARC-Record-ID": "<l>", "WARC-Refers-To": "<none>"}, b"")
    cut = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<c>"}, b"x" * 50)[:-20]
    path = archive(tmp_path, info, alone, *whole, *gap, *wrong, *orphan, again, lost, cut)
    got = {r.record_id: r for r in warc.read(spark, path).collect()}
    assert got["<a>"].fault is None and got["<a>"].payload_bytes == len(b"WARC/1.0\r\nis text here")
    assert got["<s>"].payload_digest == hashlib.sha256(b"abcdefghi").hexdigest() == got["<r>"].payload_digest
    assert {k: r.fault for k, r in got.items() if r.fault} == {"<g>": "segments missing or repeated", "<w>": "length differs", "<o>": "no first segment", "<l>": "original missing", "<c>": "cut"}


# --- divergence


def audited(rows, top=200):
    """The contract by hand, with Python's whole numbers."""
    docs = [((lang or ""), (source or ""), [w for w in "".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text or "").split(" ") if w]) for _, text, lang, source in rows]
    in_docs, group, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        in_docs[lang].update(set(words))
        group[lang, source].update(words)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = {w for w, n in in_docs[lang].items() if n >= 3}
        own = {s: {w: group[lang, s][w] for w in kept} for s in sources}
        whole = {w: sum(own[s][w] for s in sources) for w in kept}
        p = {s: {w: 1 + 10**9 * (own[s][w] + 1) // (sum(own[s].values()) + len(kept)) for w in kept} for s in sources}
        q = {w: 1 + 10**9 * (whole[w] + 1) // (sum(whole.values()) + len(kept)) for w in kept}
        for s in sources:
            near = [(t, sum((p[s][w] - p[t][w]) ** 2 // p[t][w] for w in kept)) for t in sources if t != s]
            marks = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if own[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", near, len(near)), ("term", marks, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def corpus(seed=1, n=400):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefghijkl" for b in "mnopqrst"] + ["Ünï", "日本", "É", "e"]
    weight = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(r.choices(words, weight, k=r.randrange(1, 60))), r.choice(["en", "en", "de"]), f"s{r.randrange(5)}") for i in range(n)]
    return rows + [(None, None, None, None), (1, "", "en", "void"), (2, "A a.a\x00a-A aa1aa", None, "x"), (3, "123 ?!", "xx", "s1"), (4, "once", "xx", "s2"), (5, "hot " * 50_000, "en", "s1"), *[(6, "same words here", "fr", "a")] * 4, (7, "words only", "fr", "b"), (8, "", "fr", None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 3) for r in rows], "doc_id long, text string, lang string, source string, n long, term string, rank int").repartition(5)


def test_divergence_against_brute_force(spark):
    rows = corpus()
    assert sorted(tuple(r) for r in divergence.op13(frame(spark, rows)).collect()) == audited(rows)
    assert sorted(tuple(r) for r in divergence.audit(frame(spark, rows), top=3).collect()) == audited(rows, 3)
    assert divergence.op13(frame(spark, [])).count() == 0
    assert divergence.op13(frame(spark, [(1, "a b", "en", "s"), (2, None, "en", "t")])).collect() == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_texts_cut_in_blocks_and_counts_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 50)
    text = "Zebra-crossing é " * 40
    assert [w for part in divergence.terms(text.encode()) for w in part] == [w.encode() for w in ("zebra", "crossing", "é") * 40]
    rows = corpus(2, 60)
    counted = lambda held: (monkeypatch.setattr(divergence, "HELD", held), sorted(tuple(r) for r in divergence.op13(frame(spark, rows)).collect()))[1]
    assert counted(3) == counted(1 << 19) == audited(rows)


def test_shares_beyond_longs():
    of = divergence._Lang([type("R", (), {"source": "a", "base": 10**13})()])
    n = np.array([[10**12, 5]], np.int64)
    assert of.p(n, np.zeros_like(n)).tolist() == [[1 + 10**9 * (10**12 + 1) // 10**13, 1 + 10**9 * 6 // 10**13]]
    assert F.expr(divergence._p("n", "total")) is not None


# --- the classifier's calibration


def test_a_view_of_no_use_neither_teaches_nor_counts_against():
    from ledgerlark.llm import quality

    rng = np.random.default_rng(2)
    y = (rng.random(600) < 0.7).astype(float)
    good, noise = 4 * (y - 0.5) + rng.normal(size=600), rng.normal(size=600)
    assert quality._teaches(good, y) and not quality._teaches(noise, y) and not quality._teaches(np.zeros(600), y) and not quality._teaches(-good, y)
    fold = quality._folds(y)
    assert all(abs((y[fold == k] == v).sum() - (y == v).sum() / quality.FOLDS) <= 1 for k in range(quality.FOLDS) for v in (0, 1))
    x = np.column_stack([good, noise])
    by_fold = quality._unseen(x, y, fold, np.zeros((0, 2)), np.zeros(0))
    for k in range(quality.FOLDS):
        assert np.allclose(by_fold[fold == k], quality.fit(x[fold != k], y[fold != k]).logits(x[fold == k]))
    against = quality._combined(np.column_stack([good, -good + noise]), y)
    assert against.weights[0] > 0 and against.weights[1] == 0
    both = quality._combined(np.column_stack([good, good + noise]), y)
    assert (both.weights[:2] > 0).all()
