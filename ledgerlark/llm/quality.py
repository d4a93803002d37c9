"""Score documents' quality by co-training two views.

The text view sees what is written (kinds of characters, repetition, lengths of words and
lines), the metadata view what the table says of it (source, language, length). Each is a
logistic regression. In every round each view scores all unlabelled documents and hands
those it is surest of to the other as pseudo-labels, if it tells labelled documents that it
has not seen better than chance; in the end both are calibrated by scores of labelled
documents from views fitted without them, fold by fold, and combined.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded_text_batches, keyed, picked, stored

#: Bound of the labelled sample that the classifiers are fitted on, drawn by a digest of doc_id.
MOST_LABELLED = 20_000
#: Rounds of co-training; pseudo-labels that a view hands over in a round for each class, drawn from all that it is sure of; how sure it must be.
ROUNDS, HANDED, SURE = 2, 500, 0.95
KEEP = 0.5
#: Parts of the labelled sample, each scored by views that the others teach; and how many standard errors a view must be above chance to teach the other one.
FOLDS, ABOVE_CHANCE = 5, 3.0

_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
TEXT_WIDTH = len(_PUNCTUATION) + 14
SOURCE_BINS, LANG_BINS, LENGTH_BINS = 32, 8, 16
META_WIDTH = SOURCE_BINS + LANG_BINS + LENGTH_BINS + 1


def text_features(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    x, n = np.zeros(TEXT_WIDTH, np.float32), max(len(raw), 1)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    k = len(_PUNCTUATION)
    x[:k] = np.sqrt(count[_PUNCTUATION] / n)
    upper, lower = count[65:91].sum(), count[97:123].sum()
    words, lines = raw.split(), [s for s in raw.split(b"\n") if s.strip()]
    seen = Counter(words)
    m = max(len(words), 1)
    pairs = len(set(zip(words, words[1:], strict=False)))
    x[k:] = [
        upper / max(upper + lower, 1), count[48:58].sum() / n, count[128:].sum() / n, count[10] / n, (count[9:14].sum() + count[32]) / n, np.log1p(len(words)) / 10,
        len(seen) / m, max(seen.values(), default=0) / m, len(raw) / m / 10, sum(w[-1:] in b".,;:!?" for w in words) / m,
        pairs / max(m - 1, 1), len(set(lines)) / max(len(lines), 1), sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, float(not words),
    ]
    return x


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    m = np.zeros(META_WIDTH, np.float32)
    m[zlib.crc32(repr(source).encode()) % SOURCE_BINS] = 1
    m[SOURCE_BINS + zlib.crc32(repr(lang).encode()) % LANG_BINS] = 1
    size = 0 if n_chars is None or n_chars != n_chars else max(int(n_chars), 0)
    m[SOURCE_BINS + LANG_BINS + min(size.bit_length(), LENGTH_BINS - 1)] = 1
    m[-1] = np.log1p(size) / 10
    return m


@dataclass(frozen=True)
class View:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> View:
    """Logistic regression by Newton's method; the intercept is not held back."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-6, scale, 1)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, hold = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    hold[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + np.diag(hold), z.T @ (y - p) - hold * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return View(mean, scale, w)


@dataclass(frozen=True)
class Classifier:
    text: View
    meta: View
    mixed: View

    def scores(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logits(x), self.meta.logits(m)
        return tuple(1 / (1 + np.exp(-v)) for v in (a, b, self.mixed.logits(np.column_stack([a, b]))))


_FEATURES = "_row long, doc_id {0}, source string, lang string, n_chars long, x array<float>"


def features(docs: DataFrame) -> DataFrame:
    """_row, doc_id, the metadata columns and x, the text features, of every document of docs (which has a _row)."""
    bounded_text_batches(docs.sparkSession)
    kinds = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [text_features(t.as_py()) for t in b.column("text")]
            arrays = [b.column(c) for c in ("_row", "doc_id", "source", "lang", "n_chars")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(x, pa.list_(pa.float32()))], ["_row", "doc_id", "source", "lang", "n_chars", "x"])

    columns = docs.select("_row", "doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), "text")
    return columns.mapInArrow(read, _FEATURES.format(kinds))


def _stack(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack(rows["x"].to_list()).astype(float) if len(rows) else np.zeros((0, TEXT_WIDTH))
    m = [meta_features(*r) for r in zip(rows["source"], rows["lang"], rows["n_chars"], strict=True)]
    return x, np.stack(m).astype(float) if m else np.zeros((0, META_WIDTH))


def _frame(x: pd.Series, source: pd.Series, lang: pd.Series, n: pd.Series) -> pd.DataFrame:
    """The columns that _stack reads, missing values as None."""
    return pd.DataFrame({"x": x} | {k: v.astype(object).where(v.notna(), None) for k, v in (("source", source), ("lang", lang), ("n_chars", n))})


def _scored(data: DataFrame, text: View, meta: View) -> DataFrame:
    @F.pandas_udf("text double, meta double")
    def score(x: pd.Series, source: pd.Series, lang: pd.Series, n: pd.Series) -> pd.DataFrame:
        a, b = _stack(_frame(x, source, lang, n))
        return pd.DataFrame({"text": 1 / (1 + np.exp(-text.logits(a))), "meta": 1 / (1 + np.exp(-meta.logits(b)))})

    return data.withColumn("p", score("x", "source", "lang", "n_chars"))


def _plain(rows: list) -> pd.DataFrame:
    return pd.DataFrame([r.asDict() for r in rows], columns=["_row", "x", "source", "lang", "n_chars", "y"]).astype({"source": object, "lang": object, "n_chars": object})


def _drawn(rows: DataFrame, n: int, of: int) -> DataFrame:
    """n of about `of` rows by a digest of doc_id, so that half as many again reach the last task and not n from every partition."""
    u = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(float(1 << 63))
    return rows.withColumn("_u", u).where(F.col("_u") <= 1.5 * n / max(of, 1)).orderBy("_u", "_row").limit(n).drop("_u")


def _folds(y: np.ndarray) -> np.ndarray:
    """The fold of each document; every class is dealt out over all of them."""
    fold = np.zeros(len(y), int)
    for v in (0, 1):
        at = np.flatnonzero(y == v)
        fold[at] = np.arange(len(at)) % FOLDS
    return fold


def _unseen(x: np.ndarray, y: np.ndarray, fold: np.ndarray, more: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Logits of the labelled documents x, each from a view fitted on the other folds and the pseudo-labelled `more`."""
    out = np.zeros(len(y))
    for k in range(FOLDS):
        here = fold == k
        if here.any():
            out[here] = fit(np.vstack([x[~here], more]), np.concatenate([y[~here], told])).logits(x[here])
    return out


def _teaches(logits: np.ndarray, y: np.ndarray) -> bool:
    """Whether the scores rank good documents above bad ones by more than chance does (rank sums)."""
    good, bad = int(y.sum()), int((1 - y).sum())
    ranks = pd.Series(logits).rank().to_numpy()
    area = (ranks[y == 1].sum() - good * (good + 1) / 2) / (good * bad)
    return area - 0.5 > ABOVE_CHANCE * np.sqrt((good + bad + 1) / (12 * good * bad))


def _combined(logits: np.ndarray, y: np.ndarray) -> View:
    """The combining regression, in which no view counts against what it says: one of negative weight is left out."""
    used = np.ones(logits.shape[1])
    while True:
        view = fit(logits * used, y, 0.1)
        against = (view.weights[:-1] < 0) & (used > 0)
        if not against.any():
            return view
        used[against] = 0


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, handed: int = HANDED) -> tuple[Classifier | None, DataFrame]:
    """The classifier (None where a class has fewer than two labelled documents) and the stored features of all documents of docs (which has a _row).

    Labels of a doc_id are averaged; halves count as 1. A view hands over `handed`
    pseudo-labels a class and round at most, drawn from all documents that it is sure of,
    and none while it is no better than chance on documents that it has not seen.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    data = stored(features(docs).join(marks, "doc_id", "left"))
    wanted = ["_row", "x", "source", "lang", "n_chars", "y"]
    known = data.where("y is not null")
    held = _plain(_drawn(known, MOST_LABELLED, known.count()).select(*wanted).collect())
    y = held["y"].to_numpy(float)
    if min(int((y == v).sum()) for v in (0, 1)) < 2:
        return None, data
    fold, seen = _folds(y), _stack(held)
    taught = [held.iloc[:0], held.iloc[:0]]  # pseudo-labels that the text view and the metadata view have been told
    unseen: list[np.ndarray] = []
    view: list[View] = []
    for n in range(rounds + 1):
        more = [(_stack(t)[i], t["y"].to_numpy(float)) for i, t in enumerate(taught)]
        view = [fit(np.vstack([x, told]), np.concatenate([y, v])) for x, (told, v) in zip(seen, more, strict=True)]
        unseen = [_unseen(x, y, fold, *m) for x, m in zip(seen, more, strict=True)]
        teachers = [of for of, logits in zip(("text", "meta"), unseen, strict=True) if _teaches(logits, y)]
        if n == rounds or not teachers:
            break
        open_ = _scored(data.where("y is null"), *view)
        sides = [(of, at, v) for of in teachers for at, v in ((F.col(f"p.{of}") >= SURE, 1.0), (F.col(f"p.{of}") <= 1 - SURE, 0.0))]
        counts = open_.agg(*[F.count_if(at) for _, at, _ in sides]).first()
        sure = [_drawn(open_.where(at), handed, n).withColumn("y", F.lit(v)).select(F.lit(of).alias("of"), *wanted) for (of, at, v), n in zip(sides, counts, strict=True) if n]
        told = reduce(DataFrame.union, sure).collect() if sure else []  # at most 4 * handed rows
        new = [_plain([r for r in told if r["of"] == of]) for of in ("meta", "text")]
        grown = [pd.concat([old, got]).drop_duplicates("_row") if len(got) else old for old, got in zip(taught, new, strict=True)]
        if all(len(a) == len(b) for a, b in zip(taught, grown, strict=True)):
            break
        taught = grown
    return Classifier(*view, _combined(np.column_stack(unseen), y)), data


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, text_score, meta_score, quality and keep.

    Scores are probabilities of good quality; keep is quality of KEEP or more. Null and
    empty texts are scored by their features like any other, very long ones whole, repeated
    rows each by itself; ties do not arise. Without two labelled documents of each class
    nothing can be learned: scores are null and all documents are kept. An empty table
    gives no rows; other columns are not read.
    """
    model, data = train(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "source", "lang", "n_chars", "text"), labels)
    return _apply(data, model).select("doc_id", F.col("s.text").alias("text_score"), F.col("s.meta").alias("meta_score"), F.col("s.quality").alias("quality"), (F.col("s.quality") >= KEEP if model else F.lit(True)).alias("keep"))


def _apply(data: DataFrame, model: Classifier | None) -> DataFrame:
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in ("text", "meta", "quality")])
    if model is None:
        return data.withColumn("s", F.lit(None).cast(kind))

    @F.pandas_udf(kind)
    def all_scores(x: pd.Series, source: pd.Series, lang: pd.Series, n: pd.Series) -> pd.DataFrame:
        a, b = _stack(_frame(x, source, lang, n))
        return pd.DataFrame(dict(zip(("text", "meta", "quality"), model.scores(a, b), strict=True)))

    return data.withColumn("s", all_scores("x", "source", "lang", "n_chars"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, with all its columns, without those that the classifier rejects; their stored features are scored, so texts are read by Python once and not shuffled."""
    rows = keyed(docs)
    model, data = train(rows.select("_row", "_doc.doc_id", "_doc.source", "_doc.lang", "_doc.n_chars", "_doc.text"), labels)
    if model is None:
        return docs
    return picked(rows, _apply(data, model).where(F.col("s.quality") < KEEP), keep=False).select("_doc.*")
