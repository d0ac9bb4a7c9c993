"""Quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text: its words and word pairs, and one to three of their shapes (runs of capitals, small letters and
digits drawn together, other marks kept), with a marked token where a word repeats the one before. Each is hashed to
one of ``SLOTS`` weights and counts 1 / sqrt(number of words) for each occurrence; the score is the logistic of a
sparse dot product. Training passes ``EPOCHS`` times over at most ``TRAIN_ROWS`` labelled rows, as many of each label
where there are, corrected for that choice by the prior of all labelled rows; the model is a fixed 4 MB.

Defined cases: a text without words (null, empty, white space) gets the share of label 1 among the labelled rows, as
does every text where one label is missing altogether; several labels of a row: 1 counts if it is among them; a label
that isn't 1 is as good as 0; rows with a null label aren't learnt from; repeated rows are scored alike; columns besides key and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec
from ._labels import fold, sample, with_text
from ._store import bound_batches

SLOTS, TRAIN_ROWS, EPOCHS = 1 << 20, 6000, 4
ALPHA, BETA, L1, L2 = 0.2, 1.0, 0.02, 1.0
CUT = 0.5
U = np.uint64
CLASS = np.arange(256, dtype=np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[48:58], CLASS[128:] = 65, 97, 48, 97


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's shape."""
    size = ends - starts
    first = np.cumsum(size) - size
    at = np.repeat(starts - first, size) + np.arange(size.sum())
    c = CLASS[data[at]]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    new[first] = True
    rank = np.cumsum(new)
    place = np.minimum(rank - np.repeat(rank[first], size), 15)
    return _vec.mix(np.add.reduceat(np.where(new, _vec.BYTE[c] * _vec.PLACE[place], U(0)), first))


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, words) slots, five or six for each word, and where each document's words begin."""
    h, starts, ends, bounds = _vec.words(data, offs, fold=False)
    if not len(h):
        return np.zeros((6, 0), np.int32), bounds
    shape = _shapes(data, starts, ends)
    lead = np.zeros(len(h), bool)
    lead[bounds[:-1][bounds[:-1] < len(h)]] = True
    back = lambda x, far: np.where(far, U(7), np.roll(x, 1))
    second = lead | np.roll(lead, 1)
    one = back(shape, lead)
    two = np.where(second, U(7), np.roll(shape, 2))
    same = (h == back(h, lead)).astype(np.uint64)
    kinds = [h, _vec.mix(h + back(h, lead) * U(3)), shape ^ U(0x11), _vec.mix(shape + one * U(5)), _vec.mix(shape + one * U(7) + two * U(11)), _vec.mix(same + U(0x77))]
    return np.stack([(_vec.mix(k + U(i)) >> U(44)).astype(np.int32) for i, k in enumerate(kinds)]), bounds


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) to (label, slots, values)."""
    for batch in batches:
        for lo, hi, data, offs in _vec.slices(batch.column(0)):
            slots, bounds = features(data, offs)
            idx, val = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                keys, n = np.unique(slots[:, a:b], return_counts=True)
                idx.append(keys)
                val.append((n / np.sqrt(max(b - a, 1))).astype(np.float32))
            yield pa.record_batch([batch.column(1).slice(lo, hi - lo).cast(pa.int32()), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], names=["y", "idx", "val"])


def train(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """FTRL-proximal weights and bias."""
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    order = np.random.Generator(np.random.PCG64(5))
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            y, i, v = rows[k]
            i, v = np.append(i, SLOTS), np.append(v, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -30, 30))) - y) * v
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
    w = weights(np.arange(SLOTS + 1))
    return w[:-1].astype(np.float32), float(w[-1])


class Model:
    def __init__(self, weights: np.ndarray, bias: float, prior: float):
        self.weights, self.bias, self.prior = weights, bias, prior

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.prior)
        for lo, hi, data, offs in _vec.slices(column):
            slots, bounds = features(data, offs)
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            if len(some):
                dots = np.add.reduceat(self.weights[slots].sum(0, dtype=np.float64), bounds[:-1][some]) / np.sqrt(n[some])
                out[lo + some] = 1 / (1 + np.exp(-np.clip(dots + self.bias, -30, 30)))
        return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from labelled rows, but for those of held-out fold 1."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    marks = labels.select(F.col(key).alias("key"), (F.col(label) == 1).cast("int").alias("y")).where("key is not null and y is not null")
    marks = marks.groupBy("key").agg(F.max("y").alias("y")).where(fold(F.col("key"), 3) != 1)
    tally = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = tally.get(1, 0) / max(1, sum(tally.values()))
    flat = Model(np.zeros(SLOTS, np.float32), 0.0, share)
    flat.bias = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    if len(tally) < 2:
        return flat
    got = with_text(rows, sample(marks, "y", TRAIN_ROWS), bounded=True).select("text", "y").mapInArrow(_vectors, "y int, idx array<int>, val array<float>").toArrow()
    y = got["y"].to_numpy()
    if len(np.unique(y)) < 2:
        return flat
    cut = [c.combine_chunks() for c in (got["idx"], got["val"])]
    ends = cut[0].offsets.to_numpy()
    idx, val = (c.values.to_numpy() for c in cut)
    weights, bias = train([(int(y[k] == 1), idx[a:b], val[a:b]) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))])
    seen = (y == 1).mean()
    return Model(weights, bias + float(np.log(share / (1 - share)) - np.log(seen / (1 - seen))), share)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(shared.value.score(batch.column(1)))], names=["key", "score"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, fit(docs, labels)).withColumnRenamed("key", "doc_id")
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
