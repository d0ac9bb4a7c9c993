"""Language identification in two steps: the family first, then one language against another within it.

A text is folded to letters and gaps; its features are hashed byte pairs, triples and quadruples within and at the
edges of words, each counting 1 / their number. Families are told apart by linear support vector machines, one for each
two families; the languages of the chosen family by one for each two of them. Each pair's margin becomes a
probability, and a class gets the mean of its pairs. The score is the family's share times the language's.

Training takes at most ``TRAIN_ROWS`` rows, as many of each language where there are, by stochastic sub-gradient
steps (Pegasos); the model is a fixed 256 KB for each pair of families or sister languages.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if no language can be
learnt; one learnt language is predicted with score 1; of equally likely families or languages the first by name is
taken; of several languages of a key the first by name is learnt; repeated and long texts are ordinary; columns besides
key, text and language are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec
from ._labels import fold, sample, with_text
from ._store import bound_batches

#: Languages of a family. A language that no family lists is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "yi", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tk", "ky"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa", "ne", "si"),
    "semitic": ("ar", "he", "am", "mt"),
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
SLOTS, TRAIN_ROWS, EPOCHS, LAMBDA = 1 << 16, 4000, 5, 1e-4
U = np.uint64
TABLE = np.full(256, 32, np.uint8)
TABLE[97:123] = np.arange(97, 123)
TABLE[65:91] = np.arange(97, 123)
TABLE[128:] = np.arange(128, 256)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(3, bytes) slots of the n-gram that ends at each byte, and which bytes count (the n-gram has a letter and one document)."""
    s = TABLE[data].astype(np.uint32)
    n = len(s)
    prev = lambda k: np.concatenate((np.full(min(k, n), 32, np.uint32), s[: max(n - k, 0)]))
    a, b, c = prev(1), prev(2), prev(3)
    pair = a << np.uint32(8) | s
    triple = (b << np.uint32(16)) | pair
    fourth = (c << np.uint32(24)) | triple
    ok = (s != 32) | (a != 32)
    for k in range(3):
        edge = offs[:-1] + k
        ok[edge[edge < np.minimum(offs[1:], n)]] = False
    slots = [(x * np.uint32(m)) >> np.uint32(16) for x, m in ((pair, 0x9E3779B1), (triple, 0x85EBCA77), (fourth, 0xC2B2AE3D))]
    return np.stack(slots).astype(np.int32), ok


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in _vec.slices(batch.column(0)):
            slots, ok = features(data, offs)
            idx, val = [], []
            for a, b in zip(offs[:-1], offs[1:], strict=True):
                keys, n = np.unique(slots[:, a:b][:, ok[a:b]], return_counts=True)
                idx.append(keys)
                val.append((n / max(1, n.sum())).astype(np.float32))
            yield pa.record_batch([batch.column(1).slice(lo, hi - lo), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], names=["y", "idx", "val"])


def machine(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights, constant and slope of one support vector machine; inputs are scaled to length one for the steps."""
    w, scale, bias, t = np.zeros(SLOTS), 1.0, 0.0, 1
    order = np.random.Generator(np.random.PCG64(11))
    unit = [(i, v / (np.sqrt((v * v).sum()) + 1e-12), np.sqrt((v * v).sum()) + 1e-12) for i, v in rows]
    total, steps = np.zeros(SLOTS), 0
    for epoch in range(EPOCHS):
        for k in order.permutation(len(unit)):
            i, v, _ = unit[k]
            t += 1
            rate = 1 / (LAMBDA * (t + 1 / LAMBDA))
            margin = sign[k] * (scale * (w[i] @ v) + bias)
            scale *= 1 - rate * LAMBDA
            if margin < 1:
                w[i] += rate * sign[k] / scale * v
                bias += 0.1 * rate * sign[k]
        if epoch >= EPOCHS // 2:
            total += w * scale
            steps += 1
    w = total / max(steps, 1)
    # Scores use means of weights, so the length that a typical text has is put into the weights.
    length = float(np.median([s for *_, s in unit]))
    w = w / length
    margins = np.array([w[i] @ v for i, v in rows]) + bias
    return w.astype(np.float32), bias, 4.0 / max(1e-6, float(np.abs(margins).mean()))


class Model:
    """Machines for pairs of names; a level's names are the families, or the languages of one."""

    def __init__(self, levels: dict[str, list[str]], pairs: list[tuple[str, str]], machines: list[tuple[np.ndarray, float, float]]):
        self.levels, self.pairs = levels, pairs
        self.weights = np.stack([m[0] for m in machines], 1) if machines else np.zeros((SLOTS, 0), np.float32)
        self.bias, self.slope = np.array([m[1] for m in machines]), np.array([m[2] for m in machines])

    def shares(self, level: str, p: np.ndarray) -> np.ndarray:
        """p: each machine's probability of its first name."""
        names = self.levels[level]
        if len(names) == 1:
            return np.ones((len(p), 1))
        out = np.zeros((len(p), len(names)))
        for a, b in combinations(names, 2):
            q = p[:, self.pairs.index((a, b))]
            out[:, names.index(a)] += q
            out[:, names.index(b)] += 1 - q
        return out * 2 / (len(names) * (len(names) - 1))

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        langs, scores = np.full(len(column), "und", object), np.zeros(len(column))
        for lo, hi, data, offs in _vec.slices(column, 1 << 18):
            slots, ok = features(data, offs)
            letters = (TABLE[data] != 32).astype(np.int64)
            n = np.diff(offs)
            some = np.flatnonzero(n)
            if not len(some) or not self.levels:
                continue
            first = offs[:-1][some]
            has = np.add.reduceat(letters, first) > 0
            high = np.add.reduceat((data >= 128).astype(np.int64), first)
            low = np.add.reduceat(((TABLE[data] != 32) & (data < 128)).astype(np.int64), first)
            for k in np.flatnonzero((high > 0) & (low == 0)):  # are there letters among what isn't ASCII?
                d = some[k]
                has[k] = any(ch.isalpha() for ch in bytes(data[offs[d] : offs[d + 1]]).decode("utf-8", "replace"))
            counts = np.maximum(3 * np.add.reduceat(ok.astype(np.int64), first), 1)
            margins = np.empty((len(some), len(self.pairs)))
            for j in range(len(self.pairs)):
                w = self.weights[:, j]
                each = np.where(ok, w[slots[0]] + w[slots[1]] + w[slots[2]], np.float32(0))
                margins[:, j] = np.add.reduceat(each.astype(np.float64), first) / counts
            p = 1 / (1 + np.exp(-np.clip((margins + self.bias) * self.slope, -30, 30)))
            family = self.shares("", p)
            best = family.argmax(1)
            for f, name in enumerate(self.levels[""]):
                mine = np.flatnonzero((best == f) & has)
                within = self.shares(name, p[mine])
                pick = within.argmax(1)
                langs[lo + some[mine]] = np.array(self.levels[name], object)[pick]
                scores[lo + some[mine]] = family[mine, f] * within[np.arange(len(mine)), pick]
        return langs.tolist(), scores


def fit(docs: DataFrame, lang: str, key: str = "doc_id", text: str = "text") -> Model:
    """A model from the rows of ``docs`` (those that may be learnt from)."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    marks = docs.select(F.col(key).alias("key"), F.col(lang).alias("y")).where("key is not null and y is not null").groupBy("key").agg(F.min("y").alias("y"))
    got = with_text(rows, sample(marks, "y", TRAIN_ROWS), bounded=True).where("text is not null").select("text", "y").mapInArrow(_vectors, "y string, idx array<int>, val array<float>").toArrow()
    if not len(got):
        return Model({}, [], [])
    y = np.array(got["y"].to_pylist())
    cut = [c.combine_chunks() for c in (got["idx"], got["val"])]
    ends = cut[0].offsets.to_numpy()
    idx, val = (c.values.to_numpy() for c in cut)
    data = [(idx[a:b], val[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    family = np.array([FAMILY.get(x, x) for x in y])
    levels = {"": sorted(set(family))} | {f: sorted(set(y[family == f])) for f in set(family)}
    pairs, machines = [], []
    for level, names in levels.items():
        of = family if level == "" else y
        for a, b in combinations(names, 2):
            at = np.flatnonzero((of == a) | (of == b))
            pairs.append((a, b))
            machines.append(machine([data[k] for k in at], np.where(of[at] == a, 1.0, -1.0)))
    return Model(levels, pairs, machines)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["key", "lang_pred", "score"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = fold(F.col("doc_id"), 4) == 2
    out = predict(docs, fit(docs.where(~held), "lang")).withColumnRenamed("key", "doc_id")
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
