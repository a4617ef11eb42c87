"""Operator 3: toxicity by multiple-instance learning.

A document is a bag of sentences; only the document has a label. A sentence
scores sigmoid(b + sum of the weights of its distinct words), a document the
noisy-or of its sentences, 1 - prod(1 - p). Weights are trained through the
noisy-or, so blame settles on the sentences that explain a label, and the same
weights then locate those sentences.

A word's weight is the sum of the weights of its features: the word itself and
its beginnings of 3 to 7 letters, so inflected and unseen forms of a known
stem count. Features are chosen by their log-odds between labelled documents.

The classifier is fitted in one task on at most SAMPLE labelled documents,
chosen by a hash of the id (a documented bound); the model holds at most
FEATURES features, and only these reach the driver. All documents are scored,
whole.

Defined cases: null and empty text score 0; a label table without rows, or
with one class only, gives a model that scores 0; of several labels of an id
the highest counts; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import id_fold, prepare, table

SAMPLE = 6_000
FEATURES = 4_000
FOLDS = 5
#: Words whose weight a worker remembers; this bounds memory alone.
KNOWN = 100_000
#: A feature needs this many positive documents, this log-odds and this many standard errors.
LEAST_DOCS, LEAST_ODDS, LEAST_Z = 4, 1.5, 4.0
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def features(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in range(3, min(8, len(word) + 1)))]


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "known": {}}

    def word(self, w: str) -> float:
        if w not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[w] = sum(self.weights.get(f, 0.0) for f in features(w))
        return self.known[w]

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and score of each sentence with a word."""
        out = []
        for m in _SENTENCE.finditer(text):
            words = set(_WORD.findall(m[0].lower()))
            if words:
                z = self.bias + sum(map(self.word, words))
                out.append((m.start(), m.end(), 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))))
        return out


def fit(rows: list[tuple[str, int]], steps: int = 400, rate: float = 0.1, ridge: float = 0.02) -> Model:
    """Train on (text, label) documents by gradient ascent (Adam) on the noisy-or likelihood."""
    n = [sum(y == 0 for _, y in rows), sum(y == 1 for _, y in rows)]
    if not min(n):
        return Model({}, -30.0)
    counts = (Counter(), Counter())
    for text, y in rows:
        if y:
            counts[1].update({f for w in set(_WORD.findall(text.lower())) for f in features(w)})
    # Only features of enough positive documents can be chosen, so no others are held or counted.
    often = {f: f for f, a in counts[1].items() if a >= LEAST_DOCS}
    shapes: dict[str, tuple[str, ...]] = {}

    def shape(w: str) -> tuple[str, ...]:
        if w not in shapes:
            shapes[w] = tuple(often[f] for f in features(w) if f in often)
        return shapes[w]

    for text, y in rows:
        if not y:
            counts[0].update({f for w in set(_WORD.findall(text.lower())) for f in shape(w)})
    chosen = {}
    for f in often:
        a, b = counts[1][f], counts[0][f]
        odds = np.log((a + 0.5) / (n[1] - a + 0.5)) - np.log((b + 0.5) / (n[0] - b + 0.5))
        z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (n[1] - a + 0.5) + 1 / (n[0] - b + 0.5))
        if odds >= LEAST_ODDS and z >= LEAST_Z:
            chosen[f] = z
    names = sorted(sorted(chosen, key=lambda f: (-chosen[f], f))[:FEATURES])
    index = {f: i for i, f in enumerate(names)}
    owned: dict[str, list[int]] = {}
    # One row for each sentence that has a feature; the others of a bag all score sigmoid(bias).
    cells, sentence, bag, plain = [], [], [], np.zeros(len(rows))
    for d, (text, _) in enumerate(rows):
        for part in _SENTENCE.findall(text.lower()):
            words = set(_WORD.findall(part))
            for w in words:
                if w not in owned:
                    owned[w] = [index[f] for f in shape(w) if f in index]
            got = [i for w in words for i in owned[w]]
            if got:
                cells += got
                sentence += [len(bag)] * len(got)
                bag.append(d)
            elif words:
                plain[d] += 1
    cells, sentence, bag = (np.array(x, np.int64) for x in (cells, sentence, bag))
    y = np.array([y for _, y in rows])
    theta = np.zeros(len(names) + 1)
    theta[:-1], theta[-1] = 0.5, np.log(n[1] / n[0]) - 4
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, b = theta[:-1], theta[-1]
        z = np.clip(b + np.bincount(sentence, w[cells], len(bag)), -30, 30)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        none = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)), len(rows)) + plain * np.log1p(-p0)  # log of 1 - P
        whole = -np.expm1(none)
        push = np.where(y == 1, (1 - whole) / np.maximum(whole, 1e-6), -1.0)  # d log-likelihood / d z, over p
        by_sentence = push[bag] * p
        g = np.append(np.bincount(cells, by_sentence[sentence], len(names)) - ridge * len(rows) * w / 100, by_sentence.sum() + (push * plain).sum() * p0) / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0)  # features are evidence for, never against
    return Model({f: float(x) for f, x in zip(names, theta, strict=False) if x > 1e-3}, float(theta[-1]))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows: its weights, and the bias in a row without a feature."""
    model = fit([(t or "", int(y > 0)) for batch in batches for t, y in zip(batch.column("_t").to_pylist(), batch.column("_y").to_pylist(), strict=True)])
    yield pa.RecordBatch.from_arrays([pa.array([*model.weights, None], pa.string()), pa.array([*model.weights.values(), model.bias], pa.float64())], ["feature", "weight"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Model of the labelled rows outside the held-out fold; at most SAMPLE documents reach the one task that fits it, and at most FEATURES weights the driver."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_fold(F.col("doc_id"), FOLDS) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y"))
    order = [F.xxhash64("doc_id", F.lit(7)), F.col("doc_id")]
    ids = known.orderBy(*order).limit(SAMPLE)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("_t")).join(F.broadcast(ids), "doc_id").orderBy(*order, "_t").limit(SAMPLE)
    found = {r["feature"]: r["weight"] for r in rows.select("_t", "_y").coalesce(1).mapInArrow(_fitted, "feature string, weight double").collect()}
    bias = found.pop(None, -30.0)  # a table without rows may have no task
    return Model(found, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and the sentences that score at least a half: array of structs start, end, score (code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES entries at most
    schema = "doc_id bigint, score double, sentences array<struct<start:bigint,end:bigint,score:double>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        base = 1 / (1 + np.exp(-max(-30.0, model.bias)))
        for batch in batches:
            scores, where = [], []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                if any(map(model.word, set(_WORD.findall(text.lower())))):
                    parts = model.sentences(text)
                    clear = np.prod([1 - p for _, _, p in parts])
                    where.append([{"start": a, "end": b, "score": float(p)} for a, b, p in parts if p >= 0.5])
                else:
                    clear = (1 - base) ** sum(_WORD.search(m) is not None for m in _SENTENCE.findall(text))
                    where.append([])
                scores.append(float(min(1.0, max(0.0, 1 - clear))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(where, kind)], ["doc_id", "score", "sentences"])
        model.known.clear()  # a worker keeps the model for later tasks

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(scored, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (id_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("sentences").cast("bigint").alias("n_toxic_sentences"),
    )


def clean(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that do not score a half or more, with all their columns."""
    prepare(spark)
    model = train(docs, labels)
    shared = spark.sparkContext.broadcast(model)

    def toxic(batches):
        model = shared.value
        for batch in batches:
            keep = []
            for cell in batch.column("text"):
                text = cell.as_py() or ""
                if any(map(model.word, set(_WORD.findall(text.lower())))):
                    keep.append(np.prod([1 - p for _, _, p in model.sentences(text)]) > 0.5)
                else:
                    base = 1 / (1 + np.exp(-max(-30.0, model.bias)))
                    keep.append((1 - base) ** sum(_WORD.search(m) is not None for m in _SENTENCE.findall(text)) > 0.5)
            yield batch.filter(pa.array(keep, pa.bool_()))
        model.known.clear()

    return docs.mapInArrow(toxic, docs.schema)
