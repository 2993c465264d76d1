"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

Features are n-gram indicators (ngram.indicators), hashed to 2^BITS. The model is fitted on a sample of at most SAMPLE_ROWS labelled rows with SAMPLE_FEATURES features
together, those with the smallest hashes of doc_id, in one executor task: the driver gets only the weights. The features' class log-count ratios are r = log((p/|p|)/(q/|q|)), with p and q one plus the number of texts of a class that have
the feature. A text is the vector of the r of its features, scaled to length one; on it a linear hinge-loss model is fitted by dual coordinate
descent (Hsieh et al., 2008), with both classes weighted alike. A logistic curve turns margins into scores; it is fitted to margins of rows by
models of the other half of the sample.

Labels, lang, source and doc_id are never inputs of a score.

Cases: null text is empty (its score comes from the empty n-gram alone); labels that are null or neither 0 nor 1 are not learnt from; several labels
of a doc_id, and several texts, count as several rows, equal rows as one; very long texts are read whole, a slice each; rows of equal hashes are taken in the order of doc_id, label and
text's hash; with labels of one class or none every score is the share of label 1 (0.5 if none); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import Scratch, slices, spare
from tracewell.llm.ngram import indicators

BITS = 18
#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 16_000
#: Features of all those rows together, at most (four bytes each, and as many for their weights).
SAMPLE_FEATURES = 16_000_000
THRESHOLD = 0.3


_ORDER = ["hash", "doc_id", "label", "text_hash"]


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, feature = indicators(batch.column("text"), bits)
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(feature, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _ORDER), pa.array(np.diff(offsets)), lists], [*_ORDER, "n", "features"])

    return run


class Rows:
    """Features of rows, side by side, and their scaled values; a row's have length one."""

    def __init__(self, first: np.ndarray, feature: np.ndarray):
        self.first, self.feature = first, feature

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self, which: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for i in which.tolist():
            out[self.feature[self.first[i] : self.first[i + 1]]] += 1  # a row has a feature once
        return out

    def scale(self, scale: np.ndarray) -> None:
        self.value = scale.astype(np.float32)[self.feature]
        for a, b in zip(self.first.tolist(), self.first[1:].tolist()):
            v = self.value[a:b]
            v /= max(np.sqrt(np.dot(v, v)), 1e-12)

    def descend(self, which: np.ndarray, size: int, y: np.ndarray, cost: np.ndarray, epochs: int = 12) -> np.ndarray:
        """Weights of the L1-loss linear support vector machine on some rows, by dual coordinate descent."""
        w, alpha, order = np.zeros(size), np.zeros(len(self)), which.copy()
        rng = np.random.default_rng(0)
        for _ in range(epochs):
            rng.shuffle(order)
            most = 0.0
            for i in order.tolist():
                a, b = self.first[i], self.first[i + 1]
                f, v = self.feature[a:b], self.value[a:b]
                gradient = y[i] * (w[f] @ v) - 1
                new = min(max(alpha[i] - gradient, 0.0), cost[i])
                if new != alpha[i]:
                    most = max(most, abs(new - alpha[i]))
                    w[f] += ((new - alpha[i]) * y[i]) * v
                    alpha[i] = new
            if most < 1e-3:
                break
        return w

    def margins(self, which: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.array([w[self.feature[a:b]] @ self.value[a:b] for a, b in zip(self.first[which].tolist(), self.first[which + 1].tolist())])


def learn(rows: Rows, y: np.ndarray, bits: int) -> Model:
    """y: 1.0 or -1.0 of each row."""
    n1 = int((y > 0).sum())
    n0, size, every = len(y) - n1, 1 << bits, np.arange(len(y))
    if not n0 or not n1:
        share = n1 / len(y) if len(y) else 0.5
        return Model(bits, np.zeros(size), np.zeros(size), 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    zero, one = (rows.counts(np.flatnonzero(y == c), size) + 1 for c in (-1, 1))
    scale = np.log(one / one.sum()) - np.log(zero / zero.sum())
    rows.scale(scale)
    cost = np.where(y > 0, len(y) / (2 * n1), len(y) / (2 * n0))
    margins = np.zeros(len(y))
    for k in (0, 1):
        learnt, unseen = every[every % 2 != k], every[every % 2 == k]
        if len(set(y[learnt])) == 2:
            margins[unseen] = rows.margins(unseen, rows.descend(learnt, size, y, cost))
    a, b = _logistic(margins, y)
    return Model(bits, scale, rows.descend(every, size, y, cost), a, b)


def _learn(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The one task that holds the sample: at most SAMPLE_FEATURES features and SAMPLE_ROWS rows."""
        keys, sizes, parts, y = [], [], [], []
        for batch in batches:
            keys += zip(*(batch.column(c).to_pylist() for c in _ORDER))
            sizes.append(batch.column("n").to_numpy())
            y.append(np.where(batch.column("label").to_numpy() == 1, 1.0, -1.0))
            parts.append(batch.column("features").flatten().to_numpy().copy())
        order = np.array(sorted(range(len(keys)), key=lambda i: tuple((x is not None, x) for x in keys[i])), np.int64)  # whatever order the rows came in
        flat = np.concatenate([np.zeros(0, np.int32), *parts])
        parts.clear()
        size = np.concatenate([np.zeros(0, np.int64), *sizes])
        begin = (np.cumsum(size) - size)[order]
        first = np.concatenate([[0], np.cumsum(size[order])])
        feature = np.empty_like(flat)
        for at, a, b in zip(begin.tolist(), first.tolist(), first[1:].tolist()):
            feature[a:b] = flat[at : at + b - a]
        del flat
        model = learn(Rows(first, feature), np.concatenate([np.zeros(0), *y])[order], bits)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (model.scale.tobytes(), model.w.tobytes())] + [pa.array([x]) for x in (model.a, model.b)], ["scale", "w", "a", "b"])

    return run


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of the curve 1 / (1 + exp(-(a m + b))) by Newton steps, on Platt's smoothed targets."""
    pos, neg = int((y > 0).sum()), int((y <= 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - target) * m).sum() + 1e-3 * a, (p - target).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


class Model:
    """Weights on features, and the curve from margin to score."""

    def __init__(self, bits: int, scale: np.ndarray, w: np.ndarray, a: float, b: float):
        """w: of scaled features."""
        self.bits, self.scale, self.a, self.b = bits, scale.astype(np.float32), a, b
        self.w = (w * scale).astype(np.float32)

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, feature = indicators(texts, self.bits)
        n = len(texts)
        dot = np.bincount(row, self.w[feature], n)
        size = np.sqrt(np.bincount(row, self.scale[feature].astype(np.float64) ** 2, n))
        return 1 / (1 + np.exp(-np.clip(self.a * dot / np.maximum(size, 1e-12) + self.b, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", bits: int = BITS, sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES) -> Model:
    """labels: doc_id and the label column, only the rows to learn from.

    The texts aren't shuffled: the chosen doc_ids, at most sample_rows, are broadcast to them. The features of their texts go to a table in the shared folder; as a doc_id
    may have any number of texts, the sample is cut there by the rows' hashes and sizes, which the driver gets for at most sample_rows of them.
    """
    scratch = Scratch(documents.sparkSession, "quality")
    marked = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    chosen = marked.select(F.xxhash64("doc_id").alias("hash"), "doc_id", "label").orderBy("hash", "doc_id", "label").limit(sample_rows)
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("hash", F.col("doc_id").cast("string").alias("doc_id"), "label", F.xxhash64("text").alias("text_hash"), "text")
    found = scratch.write(rows.mapInArrow(_features(bits), "hash long, doc_id string, label int, text_hash long, n long, features array<int>"), "features")
    first = found.groupBy(*_ORDER).agg(F.min("n").alias("n")).orderBy(*_ORDER).limit(sample_rows).toArrow().to_pylist()
    upto, total = None, 0
    for row in first:
        total += row["n"]
        if total > sample_features and upto:
            break
        upto = [row[c] for c in _ORDER]
    if upto is None:
        return learn(Rows(np.zeros(1, np.int64), np.zeros(0, np.int32)), np.zeros(0), bits)
    inside, same = F.lit(False), F.lit(True)
    for c, x in zip(_ORDER, upto):  # in order, up to the last row taken
        inside, same = inside | (same & (F.col(c) < F.lit(x))), same & (F.col(c) == F.lit(x))
    sample = found.where(inside | same).dropDuplicates(_ORDER).repartition(1)
    got = sample.mapInArrow(_learn(bits), "scale binary, w binary, a double, b double").first()
    scratch.drop(found)
    model = Model(bits, np.frombuffer(got["scale"], np.float32), np.zeros(1 << bits), got["a"], got["b"])
    model.w = np.frombuffer(got["w"], np.float32)
    return model


def score(documents: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns `keep` (doc_id alone if None) and the score of every row (in the place of a column of that name)."""
    keep = [c for c in keep or ["doc_id"] if c != name]
    held = spare(keep, "text")
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2^BITS floats, twice
    schema = T.StructType([*documents.select(*keep).schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, held):
            scores = pa.array(shared.value.scores(batch.column(held)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), scores], schema.fieldNames())

    return documents.select(*keep, F.col("text").cast("string").alias(held)).mapInArrow(run, schema)


def training_rows(labels: DataFrame) -> DataFrame:
    """Rows that may be learnt from; the others are held out."""
    return labels.where(~held_out())


def held_out():
    """Whether crc32 of the doc_id as text leaves no remainder by 5; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
