"""Benchmark decontamination: CGK embeddings, bit-sampling LSH and exact edit distance, over words.

A document leaks an item if some run of its words is within ``RATE`` of the item's words in edit distance (words are
folded runs of letters, digits and bytes beyond ASCII; in scripts without spaces each character is a word). The steps,
each of which can only drop what can't be a leak:

1. An item of m words that suffers k edits keeps one of k + 1 equal segments whole. A bitmap marks the items' word runs
   of that length (four words, fewer for short items); regions of documents around marked runs stay.
2. An item is covered by windows: of the power of two up to its length, ``WIDEST`` words at most, side by side, the last
   one at its end. One of them has no more than its share of the edits. Windows of these sizes start at every word of a
   region. A CGK random walk embeds both so that edit distance shows as Hamming distance: at step j the current word is
   put out, and a random bit of (j, word) says whether to move on. Each of ``REPEATS`` walks samples ``BITS`` places;
   equal samples make a key. A window's keys, thinned by a bitmap of the items' keys, are joined with the items' keys.
   With 20 % of the words edited an item is found with a probability of 0.99 or more, whatever its length.
3. Candidates are verified by the bit-parallel edit distance of the whole item against the region.

Items of fewer than five words allow no edit and are found by a hash of all their words; ``least_words`` leaves out
items that are too short to be evidence.

Only the two bitmaps travel to all executors (16 bits for each mark, 8 MB each at most); items are joined, so a large
benchmark is shuffled like any table.

Defined cases: null or empty texts and items leak nothing; repeated rows give one result; null ids are left out; of
equally good places the first counts; very long texts and items are ordinary; an empty table gives an empty result;
columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec
from ._store import Scratch

RATE, REPEATS, BITS, WIDEST = 0.2, 24, 3, 64
#: Bitmaps have 2 ** MAP_BITS bits, if not said otherwise, and 2 ** MOST_BITS at most.
MAP_BITS, MOST_BITS = 23, 26
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(1234))
WALK = _rng.integers(0, 2**64, REPEATS, dtype=np.uint64)
END = U(0x51ED270B35AE1F8D)


def edits(m: int) -> int:
    return int(RATE * m + 1e-9)


def run_length(m: int) -> int:
    """Words in a row that an item of m words must share with its leaks."""
    return min(4, m // (edits(m) + 1))


def window(m: int) -> int:
    """The size of the windows of an item of m words; 0 if it allows no edit."""
    return min(WIDEST, 1 << (m.bit_length() - 1)) if edits(m) else 0


def offsets(m: int) -> np.ndarray:
    """Where the windows of an item of m words begin."""
    w = window(m)
    return np.unique(np.append(np.arange(0, m - w + 1, w), m - w)) if w else np.zeros(1, np.int64)


def samples(size: int) -> np.ndarray:
    """(REPEATS, BITS) places of a walk over ``size`` words."""
    r = np.random.Generator(np.random.PCG64(size))
    return np.sort(np.stack([r.choice(2 * size, BITS, replace=False) for _ in range(REPEATS)]), axis=1)


def cgk_keys(tokens: np.ndarray, starts: np.ndarray, stops: np.ndarray, size: int) -> np.ndarray:
    """(starts, REPEATS) keys of the windows [start, start + size) cut at their stop."""
    padded = np.append(tokens, END)
    stops = np.minimum(starts + size, stops)
    out = np.empty((len(starts), REPEATS), np.uint64)
    for r, places in enumerate(samples(size)):
        at = starts.copy()
        key = np.full(len(starts), U(size * 64 + r))
        last = int(places[-1])
        for j in range(last + 1):
            word = np.where(at < stops, padded[np.minimum(at, len(tokens))], END)
            if j in places:
                key = _vec.mix(key + word)
            if j < last:
                at = at + ((word * (WALK[r] | U(1)) + U(j * 0x9E3779B97F4A7C15 % 2**64)) >> U(63)).astype(np.int64)
        out[:, r] = key
    return out


def _bits(h: np.ndarray, bits: int = MAP_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The two places that a hash marks in a bitmap of 2 ** bits bits."""
    return (h >> U(64 - bits)).astype(np.int64), (h >> U(64 - 2 * bits) & U((1 << bits) - 1)).astype(np.int64)


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    return _vec.mix(_vec.grams(h, n) + U(n))


def _short(h: np.ndarray, n: int) -> np.ndarray:
    """Keys of runs of n words that have to be equal."""
    return _vec.mix(_runs(h, n) + END)


def _items(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(item, text) to (item, m, tokens, marks, keys, offsets): keys of windows, and where in the item they begin."""
    for batch in batches:
        for lo, hi, data, offs in _vec.slices(batch.column(1)):
            h, _, _, bounds = _vec.units(data, offs)
            cols: list[list] = [[], [], [], [], [], []]
            for item, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                m = int(b - a)
                if item is None or m < least:
                    continue
                tokens, at = h[a:b], offsets(m)
                keys = cgk_keys(tokens, at, np.full(len(at), m), window(m)) if window(m) else _short(tokens, m)[:1, None]
                where = np.repeat(at, keys.shape[1])
                for c, v in zip(cols, (item, m, tokens.tobytes(), _vec.signed(_runs(tokens, run_length(m))).tolist(), _vec.signed(keys.ravel()).tolist(), where.tolist()), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["item", "m", "tokens", "marks", "keys", "offsets"])


def bitmap(hashes: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """A bitmap of a one-column table of 64-bit hashes, as 64-bit words: what reaches the driver is bounded by its size."""
    h = F.col(hashes.columns[0])
    places = [F.shiftrightunsigned(h, 64 - k * bits).bitwiseAND((1 << bits) - 1) for k in (1, 2)]
    rows = hashes.select(F.explode(F.array(*places)).alias("v")).selectExpr("shiftright(v, 6) AS at", "shiftleft(1L, CAST(v & 63 AS INT)) AS bit")
    found = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def has(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    bits = len(words).bit_length() + 5
    first, second = _bits(h, bits)
    out = (words[first >> 6] >> (first & 63).astype(np.uint64) & U(1)).astype(bool)
    at = second[out]
    out[out] = words[at >> 6] >> (at & 63).astype(np.uint64) & U(1)
    return out


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least_words: int = 1) -> DataFrame:
    """(id, item, edits, item_words, first_word, last_word) of every leaked item of a document, at its best place."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bench = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).mapInArrow(
        lambda batches: _items(batches, max(1, least_words)), "item bigint, m int, tokens binary, marks array<bigint>, keys array<bigint>, offsets array<bigint>"
    )
    bench = scratch.put(bench, "items")
    sizes = bench.agg(F.max("m"), F.collect_set("m"), F.sum(F.size("marks")), F.sum(F.size("keys"))).first()
    out_schema = "id bigint, item bigint, edits int, item_words int, first_word bigint, last_word bigint"
    if sizes[0] is None:
        return spark.createDataFrame([], out_schema)
    reach = sizes[0] + edits(sizes[0])
    lengths = sorted({run_length(m) for m in sizes[1]})
    classes, short = sorted({window(m) for m in sizes[1]} - {0}), sorted({m for m in sizes[1] if not window(m)})
    fit = lambda n: min(MOST_BITS, max(MAP_BITS, (16 * n).bit_length()))
    marks = spark.sparkContext.broadcast(bitmap(bench.select(F.explode("marks")), fit(sizes[2])))
    by_key = bench.select("item", F.explode(F.arrays_zip("keys", "offsets")).alias("k")).select("item", F.col("k.keys").alias("key"), F.col("k.offsets").alias("offset"))
    keyed = spark.sparkContext.broadcast(bitmap(by_key.select("key"), fit(sizes[3])))

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _vec.alone()
        for batch in batches:
            for lo, hi, data, offs in _vec.slices(batch.column(1)):
                h, _, _, bounds = _vec.units(data, offs)
                hits = [np.zeros(0, np.int64)]
                for n in lengths:
                    hits.append(np.flatnonzero(has(marks.value, _runs(h, n))))
                hits = np.unique(np.concatenate(hits))
                ids = batch.column(0).slice(lo, hi - lo)
                out: list[tuple] = []
                doc = np.searchsorted(bounds, hits, "right") - 1
                cuts = np.flatnonzero((np.diff(doc) > 0) | (np.diff(hits) > 2 * reach)) + 1
                for group in np.split(hits, cuts) if len(hits) else ():
                    d = int(np.searchsorted(bounds, group[0], "right") - 1)
                    a, b = max(bounds[d], group[0] - reach), min(bounds[d + 1], group[-1] + reach + 4)
                    key = ids[d].as_py()
                    if key is not None:
                        out.append((key, int(a - bounds[d]), h[a:b].tobytes()))
                yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["id", "at", "tokens"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, tokens = (batch.column(k).to_pylist() for k in range(3))
            size = np.array([len(t) // 8 for t in tokens], np.int64)
            lo = 0
            while lo < len(ids):  # about 32,000 words at a time
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(size[lo:]), 1 << 15, "right")) + lo)
                h = np.frombuffer(b"".join(tokens[lo:hi]), np.uint64)
                first = np.cumsum(size[lo:hi]) - size[lo:hi]
                of = np.repeat(np.arange(hi - lo), size[lo:hi])
                starts, stops = np.arange(len(h)), np.repeat(first + size[lo:hi], size[lo:hi])
                found = []
                for words in classes:
                    keys = cgk_keys(h, starts, stops, words)
                    w, r = np.nonzero(has(keyed.value, keys))
                    found.append((w, _vec.signed(keys[w, r])))
                for words in short:
                    keys = _short(h, words)
                    w = np.flatnonzero(has(keyed.value, keys) & (stops[: len(keys)] - starts[: len(keys)] >= words))
                    found.append((w, _vec.signed(keys[w])))
                w, k = (np.concatenate(c) for c in zip(*found, strict=True))
                own = of[w]
                yield pa.record_batch([pa.array(np.array(ids[lo:hi])[own]), pa.array(np.array(at[lo:hi])[own]), pa.array(w - first[own]), pa.array(k)], names=["id", "at", "start", "key"])
                lo = hi

    held = scratch.put(rows.mapInArrow(regions, "id bigint, at bigint, tokens binary"), "regions")
    near = held.mapInArrow(windows, "id bigint, at bigint, start bigint, key bigint").join(by_key, "key")
    begin = F.col("start") - F.col("offset")
    near = near.groupBy("id", "at", "item").agg(F.min(begin).alias("lo"), F.max(begin).alias("hi"))
    pairs = near.join(held.select("id", "at", F.col("tokens").alias("region")), ["id", "at"]).join(bench.select("item", "tokens"), "item")
    checked = pairs.select("id", "item", "at", "lo", "hi", "region", "tokens").mapInArrow(_verify, out_schema)
    best = F.min(F.struct("edits", "first_word", "last_word", "item_words")).alias("b")
    return checked.groupBy("id", "item").agg(best).select("id", "item", "b.edits", "b.item_words", "b.first_word", "b.last_word")


def best_place(item: list, text: list) -> tuple[int, int]:
    """(least edits, place after the last word) of an item within a text, by Myers' bit vectors; the first such place."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict = {}
    for i, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << i
    vp, vn, score, best = full, 0, m, (m, 0)
    for j, w in enumerate(text):
        x = peq.get(w, 0) | vn
        d0 = ((((x & vp) + vp) & full) ^ vp) | x
        hp, hn = vn | (full & ~(d0 | vp)), d0 & vp
        score += bool(hp & top) - bool(hn & top)
        if score < best[0]:
            best = (score, j + 1)
        hp, hn = hp << 1 & full, hn << 1 & full
        vp, vn = hn | (full & ~(d0 | hp)), hp & d0
    return best


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, item, at, lo, hi, region, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = np.frombuffer(tokens, np.uint64).tolist()
            m = len(words)
            a, b = max(0, lo - edits(m)), max(0, hi) + m + edits(m)
            text = np.frombuffer(region, np.uint64)[a:b].tolist()
            score, stop = best_place(words, text)
            if score <= edits(m):
                back, start = best_place(words[::-1], text[:stop][::-1])
                out.append((key, item, score, m, at + a + stop - start, at + a + stop))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["id", "item", "edits", "item_words", "first_word", "last_word"])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and an item that it leaks."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, items).withColumnsRenamed({"id": "doc_id", "item": "item_id"})
