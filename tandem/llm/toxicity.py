"""Toxicity (operator 7): cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 is not toxic, 1 toxic, 2 toxic in a text that is also labelled as of low quality (labels that say
nothing of quality give two grades). The model is P(grade > k | x) = sigmoid(w.x - t_k) with one weight vector for all
thresholds t_1 < t_2; the score is the expected severity, the sum of these probabilities.

Features of a document are its distinct words and their beginnings (inflected forms share them), each counted by the
distinct words that have it; a feature counts if it is tied to toxicity, for or against, beyond chance. A document's w.x
is a sum over its distinct words, so scoring looks up one number per distinct word.

The fit sees a bounded sample of labelled rows. Its texts stay on the executors: they count features, and turn texts
into sparse rows of the features that were chosen, which are what the driver collects.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.util import integral, slices, stored, tidy

SAMPLE_ROWS = 6000  # labelled rows that the model is fitted on, at most
MAX_FEATURES = 20_000
HELD = 5  # one in so many of these only sets the severity from which documents are rejected
PREFIXES = (3, 4, 5, 6)
LEAST_DOCUMENTS = 5  # in which a feature occurs
LEAST_Z = 5.0
RIDGE = 0.01
SLICE_BYTES = 4 << 20
CACHE_BYTES = 32 << 20  # of words and their weights, as held, that a task keeps
ENTRY_BYTES = 150  # of one word and its weight beside its letters

_SPLIT = re.compile(r"[\W_]+")


def words_of(text: str | None) -> set[str]:
    return set(_SPLIT.split(text.lower())) - {""} if text else set()


def features_of(word: str) -> list[str]:
    """The word, and its beginnings marked by a dash."""
    return [word, *(word[:n] + "-" for n in PREFIXES if n < len(word))]


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: np.ndarray
    reject: float  # expected severity from which a document is rejected

    def weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features_of(word))

    def severity(self, eta: np.ndarray) -> np.ndarray:
        return sigmoid(eta[:, None] - self.thresholds).sum(1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Sparse:
    """A matrix by its entries: row, column, value."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.shape[0])

    def transposed_times(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * d[self.row], self.shape[1])


def fit_ordinal(x: Sparse, grade: np.ndarray, grades: int, ridge: float, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of the cumulative-link model by gradient ascent with momentum (Adam)."""
    n, m = x.shape
    share = np.array([(grade > k).mean() for k in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    # thresholds as the first and the logarithms of the gaps
    p = np.concatenate([np.zeros(m), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    first, second = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        w, gaps = p[:m], np.exp(p[m + 1 :])
        t = p[m] + np.concatenate([[0.0], np.cumsum(gaps)])
        above = np.concatenate([np.ones((n, 1)), sigmoid(x.times(w)[:, None] - t), np.zeros((n, 1))], axis=1)
        rows = np.arange(n)
        hi, lo = above[rows, grade], above[rows, grade + 1]
        like = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / like, lo * (1 - lo) / like
        d_eta = d_hi - d_lo
        d_t = np.zeros((n, grades + 1))
        d_t[rows, grade] -= d_hi
        d_t[rows, grade + 1] += d_lo
        d_t = d_t[:, 1:grades].mean(0)
        slope = np.concatenate([x.transposed_times(d_eta) / n - ridge * w / np.sqrt(n), [d_t.sum()], np.cumsum(d_t[::-1])[::-1][1:] * gaps])
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        p = p + 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return p[:m], p[m] + np.concatenate([[0.0], np.cumsum(np.exp(p[m + 1 :]))])


def fit(features: list[str], rows: list[tuple[int, bool, list[int], list[int]]], grades: int) -> Model:
    """From the chosen features and, for each row of the sample, (grade, held, indices, counts). Held rows only set the
    severity from which documents are rejected; without any, all do."""
    grade, held = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

    def matrix(which: np.ndarray) -> Sparse:
        some = [rows[i] for i in which.tolist()]
        at = np.repeat(np.arange(len(some)), [len(r[2]) for r in some])
        col, value = (np.concatenate([np.array(r[k], np.int64) for r in some]) for k in (2, 3))
        return Sparse(at, col, value.astype(float), (len(some), len(features)))

    train = np.flatnonzero(~held)
    w, t = fit_ordinal(matrix(train), grade[train], grades, RIDGE)
    model = Model(dict(zip(features, w.tolist(), strict=True)), t, 0.5)
    judged = np.flatnonzero(held) if held.any() else train
    model.reject = best_cut(model.severity(matrix(judged).times(w)), (grade[judged] > 0).astype(int))
    return model


def best_cut(score: np.ndarray, toxic: np.ndarray) -> float:
    """The cut of highest balanced accuracy; of several, the middle of the widest gap between scores. Equal scores tell
    nothing apart: then nothing is rejected."""
    values = np.unique(score)
    if len(values) < 2:
        return np.inf
    cuts = (values[1:] + values[:-1]) / 2
    bad, good = np.sort(score[toxic == 1]), np.sort(score[toxic == 0])
    right = (1 - np.searchsorted(bad, cuts) / len(bad)) + np.searchsorted(good, cuts) / len(good)
    gap = np.where(right >= right.max() - 1e-12, values[1:] - values[:-1], -1)
    return float(cuts[gap.argmax()])


def feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents that are not toxic, toxic ones) of a task's rows."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, grade in zip(batch.column("body").to_pylist(), batch.column("grade").to_pylist(), strict=True):
            seen[grade > 0].update({f for w in words_of(text) for f in features_of(w)})
    names = sorted({*seen[0], *seen[1]})
    for a in range(0, len(names), 10_000):
        some = names[a : a + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([c[f] for f in some], pa.int64()) for c in seen)], ["feature", "n0", "n1"])


def vectors(index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(i for w in words_of(t) for f in features_of(w) if (i := index.get(f)) is not None) for t in batch.column("body").to_pylist()]
            lists = [pa.array([[c[i] for i in sorted(c)] if values else sorted(c) for c in counts], pa.list_(pa.int32())) for values in (False, True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grade"), batch.column("held"), *lists], ["id", "grade", "held", "cols", "counts"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", quality_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most sample_rows labelled documents, the first by a hash of their id; of several labels of one id the
    highest grade counts, of several texts the greatest. One in HELD of them, by another hash, calibrates the cut.

    Ids are whole numbers (ValueError else). A null label counts as none, a null quality as good. Without quality_col
    in labels there are two grades. Without rows of both classes nothing can be told apart (an empty table too): the
    model has no features and rejects nothing. Other columns don't matter, whatever their names."""
    integral(docs, id_col)
    worse = (F.coalesce(F.col(quality_col), F.lit(1)) == 0).cast("int") if quality_col in labels.columns else F.lit(0)
    grade = F.when(F.col(label_col) > 0, 1 + worse).otherwise(0)
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    picked = usable.select(F.col(id_col).cast("long").alias("id"), grade.alias("grade")).groupBy("id").agg(F.max("grade").alias("grade"))
    # the sample is bounded, so it is broadcast to the documents
    picked = F.broadcast(picked.orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    held = F.pmod(F.xxhash64("id", F.lit("held")), F.lit(HELD)) == 0
    sample = stored(texts.join(picked, "id").groupBy("id").agg(F.max("body").alias("body"), F.max("grade").alias("grade")).withColumn("held", held), "toxicity-sample")
    sizes, top = Counter(), 0
    for r in sample.groupBy("held", "grade").count().collect():
        sizes[r["held"], r["grade"] > 0] += r["count"]
        top = max(top, r["grade"])
    if not all(sizes[True, t] + sizes[False, t] for t in (True, False)):
        return Model({}, np.zeros(0), np.inf)
    apart = all(sizes[h, t] for h in (True, False) for t in (True, False))
    sample = sample.withColumn("held", F.col("held") & F.lit(apart))
    good, bad = (sizes[False, t] + (0 if apart else sizes[True, t]) for t in (False, True))
    share = bad / (good + bad)
    counted = sample.filter("not held").select("body", "grade").mapInArrow(tidy(feature_counts), "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n = F.col("n0") + F.col("n1")
    z = F.abs(F.col("n1") - n * F.lit(share)) / F.sqrt(n * F.lit(share * (1 - share)))
    best = counted.filter(n >= LEAST_DOCUMENTS).withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES)
    features = sorted(r["feature"] for r in best.select("feature").collect())
    index = {f: i for i, f in enumerate(features)}
    found = sample.mapInArrow(tidy(vectors(index)), "id long, grade int, held boolean, cols array<int>, counts array<int>").orderBy("id").collect()
    return fit(features, [(r["grade"], r["held"], r["cols"], r["counts"]) for r in found], top + 1)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Returns every row and column of docs with severity (double: expected grade), grade (int: the number of
    thresholds that the document more likely exceeds than not) and rejected (boolean); columns of docs with these names
    are replaced. Null and empty texts have no features: their severity is the model's for an empty document. Rows are
    scored each by itself, texts whole, however long."""
    docs = docs.drop("severity", "grade", "rejected")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, held = shared.value, {}, 0
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                eta = []
                for text in part.column(text_col).to_pylist():
                    words = words_of(text)
                    if new := words.difference(known):
                        size = sum(map(len, new)) + ENTRY_BYTES * len(new)
                        if held + size > CACHE_BYTES:
                            known, held, new = {}, 0, words
                        held += size
                        known.update((w, model.weight(w)) for w in new)
                    # added in order of size, so that equal texts get equal sums
                    eta.append(sum(sorted(filter(None, map(known.__getitem__, words)))))
                eta = np.array(eta, float)
                severity = model.severity(eta)
                grade = (eta[:, None] > model.thresholds).sum(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(severity), pa.array(grade, pa.int32()), pa.array(severity >= model.reject)], [*names, "severity", "grade", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, severity double, grade int, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", F.round("severity", 6).alias("severity"), "grade", "rejected")
