"""Line deduplication by a segment-partition edit join.

Lines that are equal, or near each other, directly or through other lines, form a class; the first occurrence (by
document id, then line number) stays and every other one goes, wherever it stands. Two lines are near if their edit
distance is at most ``EDITS``, and at most one for each ``PER_EDIT`` code points of the shorter one: a line of fewer than
12 has only equals, one of fewer than 24 has neighbours at one edit. Blank lines always stay.

The join: a line of length l that allows e edits is cut into e + 1 segments of nearly equal size. Two lines within e edits
share a segment of the shorter one, at a place that the length difference and the multi-match bound confine. So a line
of length L probes, for each length L - EDITS .. L and each segment, the few substrings that can match it; its own
segments are among them. Keys name (segment, length, substring). Lines that share a key are tested by stars and blocks
(``_link``) with the banded bit-parallel edit distance, on whole lines. Keys that a sample of one row in a hundred shows
to be frequent are known to be shared, so their lines are dealt over many tasks.

Lines are equal if 128 bits of hash and their length agree; in the join, lines and keys go by 64 bits. Only keys and
hashes are shuffled; texts are fetched for lines that share a key. Defined cases: null texts have no lines; rows with a
null id keep all lines and are no first occurrences; rows that repeat an id are one document, of which a line number
stays where any of the rows has a first occurrence there; very long texts and lines are ordinary; an empty table stays
empty; columns besides id and text stay as they are, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec
from ._link import fetches, groups, link, spanning
from .decontaminate import bitmap, has
from ._store import Scratch

EDITS, PER_EDIT = 2, 12
#: How often a frequent key is in the sample at least, how many such keys are taken, and over how many tasks each is dealt.
HOT_LEAST, HOT_KEYS, HOT_PARTS = 100, 10_000, 64
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n + 1 of them."""
    if len(_powers[0]) <= n:
        for k, b in enumerate((BASE, pow(BASE, -1, 2**64))):
            out = np.ones(1 << max(20, n.bit_length()), np.uint64)
            size, step = 1, b
            while size < len(out):
                out[size : 2 * size] = out[:size] * U(step)
                size, step = 2 * size, step * step % 2**64
            _powers[k] = out
    return _powers[0], _powers[1]


class Lines:
    """The lines of a slice: document, number, first and last place (code points), a hash, and one more of equal width (``more``)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.text = data.tobytes().decode("utf-8", "replace")
        self.cps = cps = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        count = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        offs = count[offs]
        nl = np.flatnonzero(cps == 10)
        start = np.concatenate((offs[:-1], nl + 1))
        doc = np.concatenate((np.arange(len(offs) - 1), np.searchsorted(offs, nl, "right") - 1))
        order = np.lexsort((start, doc))
        self.start, self.doc = start[order], doc[order]
        last = np.append(self.doc[1:] != self.doc[:-1], True)
        self.stop = np.where(last, offs[self.doc + 1], np.append(self.start[1:], 0) - 1)
        first = np.searchsorted(self.doc, np.arange(len(offs) - 1))
        self.number = np.arange(len(self.doc)) - first[self.doc]
        power, _ = _power(len(cps))
        self.run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_vec.mix(cps.astype(np.uint64) + U(1)) * power[: len(cps)], dtype=np.uint64)))
        ink = np.concatenate(([0], np.cumsum(cps > 32)))
        size = self.stop - self.start
        use = np.flatnonzero((size > 0) & (ink[self.stop] > ink[self.start]))
        self.start, self.stop, self.doc, self.number, self.size = (x[use] for x in (self.start, self.stop, self.doc, self.number, size))
        self.hash = self.part(self.start, self.stop, U(0))

    @functools.cached_property
    def more(self) -> np.ndarray:
        """A second name of each line, from other values and places."""
        if not len(self.size):
            return self.hash
        inside = np.arange(self.size.sum()) + np.repeat(self.start - (np.cumsum(self.size) - self.size), self.size)
        place = inside - np.repeat(self.start, self.size)
        first = np.cumsum(self.size) - self.size
        values = (self.cps[inside].astype(np.uint64) + U(1)) * (_vec.PLACE[place & (len(_vec.PLACE) - 1)] + (place >> 14).astype(np.uint64) * U(2))
        return _vec.mix(np.add.reduceat(values, first) + self.size.astype(np.uint64) * U(0x9E3779B97F4A7C15))

    def part(self, a: np.ndarray, b: np.ndarray, salt: np.ndarray | np.uint64) -> np.ndarray:
        """Hashes of the places [a, b)."""
        _, inverse = _power(len(self.run))
        return _vec.mix((self.run[b] - self.run[a]) * inverse[a] + (b - a).astype(np.uint64) * U(0xC2B2AE3D27D4EB4F) + salt * U(0xD6E8FEB86659FD93))


def allowed(l: np.ndarray) -> np.ndarray:
    """The edits that a line of length l allows."""
    return np.minimum(EDITS, l // PER_EDIT)


def segments(l: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of segment i (from 0) of a line of length l: the longer segments come last."""
    small, longer = l // (edits + 1), l % (edits + 1)
    plain = edits + 1 - longer
    return i * small + np.maximum(0, i - plain), small + (i >= plain)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _vec.alone()
    for batch in batches:
        for lo, hi, data, offs in _vec.slices(batch.column(1)):
            x = Lines(data, offs)
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo).take(pa.array(x.doc)), pa.array(x.number.astype(np.int32)), pa.array(_vec.signed(x.hash)), pa.array(_vec.signed(x.more))], names=["doc", "line", "h", "g"])


class Unseen:
    """Drops hashes that the task has given out already; it forgets all when it holds too many, which only repeats some."""

    def __init__(self) -> None:
        self.held: set[int] = set()

    def first(self, h: np.ndarray) -> np.ndarray:
        names, at = np.unique(h, return_index=True)
        new = np.fromiter((x not in self.held for x in names.tolist()), bool, len(names))
        if len(self.held) > 100_000:
            self.held.clear()
        self.held.update(names[new].tolist())
        return at[new]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _vec.alone()
    seen = Unseen()
    for batch in batches:
        for _, _, data, offs in _vec.slices(batch.column(1)):
            x = Lines(data, offs)
            near = np.flatnonzero(x.size >= PER_EDIT)
            near = near[seen.first(x.hash[near])]
            size, start, name = x.size[near], x.start[near], x.hash[near]
            keys, names = [], []
            for less in range(EDITS + 1):
                l = size - less
                may = allowed(l)
                for e in range(max(less, 1), EDITS + 1):
                    use = np.flatnonzero(may == e)
                    if not len(use):
                        continue
                    long, here, at, own = size[use], l[use], start[use], name[use]
                    for i in range(e + 1):
                        place, width = segments(here, i, e)
                        lo = np.maximum(np.maximum(place - i, place + less - (e - i)), 0)
                        hi = np.minimum(np.minimum(place + i, place + less + (e - i)), long - width)
                        for k in range(2 * e + 1):
                            ok = lo + k <= hi
                            if ok.any():
                                a = (at + lo + k)[ok]
                                keys.append(x.part(a, a + width[ok], (here[ok] * (EDITS + 1) + i + 1).astype(np.uint64)))
                                names.append(own[ok])
            if keys:
                yield pa.record_batch([pa.array(_vec.signed(np.concatenate(keys))), pa.array(_vec.signed(np.concatenate(names)))], names=["key", "id"])


def _shared(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, id): those whose key other ids have too, or is in ``hot``, each once. One row is held."""
    last: tuple[int, int, bool] | None = None  # key, id, and whether it is known to be shared

    def out(key: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(key), pa.array(name)], names=["key", "id"])

    for batch in batches:
        key, name = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        if last is not None:
            key, name = np.append(last[0], key), np.append(last[1], name)
        new = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]))
        key, name = key[new], name[new]
        same = key[1:] == key[:-1]
        meets = np.append(same, False) | np.append(False, same)
        if len(hot):
            meets |= hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        if last is not None:
            meets[0] |= last[2]
        keep = np.flatnonzero(meets[:-1])
        yield out(key[keep], name[keep])
        last = int(key[-1]), int(name[-1]), bool(meets[-1])
    if last is not None and last[2]:
        yield out(np.array([last[0]]), np.array([last[1]]))


def within(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which pairs of lines are near each other: the banded bit-parallel edit distance, for all pairs step by step."""
    out = np.zeros(len(left), bool)
    if not len(left):
        return out
    swap = [len(a) < len(b) for a, b in zip(left, right, strict=True)]
    one = [b if s else a for a, b, s in zip(left, right, swap, strict=True)]
    two = [a if s else b for a, b, s in zip(left, right, swap, strict=True)]
    n1, n2 = np.array([len(x) for x in one]), np.array([len(x) for x in two])
    most = allowed(n2)
    able = np.flatnonzero(n1 - n2 <= most)
    able = able[np.argsort(n1[able], kind="stable")]
    lo = 0
    while lo < len(able):
        hi = lo + 1
        while hi < len(able) and (hi - lo + 1) * int(n1[able[hi]] + 2 * EDITS + 1) <= 2_000_000:
            hi += 1
        part = able[lo:hi]
        out[part] = _banded([one[k] for k in part], [two[k] for k in part]) <= most[part]
        lo = hi
    return out


def _banded(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Distances, exact up to EDITS. ``one`` holds the longer line of each pair. The band's 2 * EDITS + 1 diagonals are the top bits of a word."""
    n1, n2 = np.array([len(x) for x in one]), np.array([len(x) for x in two])
    wide = int(n1.max()) + 2 * EDITS + 1
    a, b = np.full((len(one), wide + EDITS), 0xFFFFFFFF, np.uint32), np.full((len(one), wide), 0xFFFFFFFE, np.uint32)
    for k, (x, y) in enumerate(zip(one, two, strict=True)):
        a[k, EDITS : EDITS + len(x)] = x
        b[k, : len(y)] = y
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    full, top = U(0xFFFFFFFFFFFFFFFF), U(1 << 63)
    vp = np.full(len(one), full << U(63 - EDITS))
    vn = np.zeros(len(one), np.uint64)
    dist = np.full(len(one), EDITS)
    mask = np.full(len(one), U(1 << 62))
    dead = EDITS + n2 - (n1 - EDITS)
    for i in range(int(n2.max())):
        live = i < n2
        x = np.zeros(len(one), np.uint64)
        for d in range(2 * EDITS + 1):  # bit 63 - d stands for place i + EDITS - d of the longer line
            x |= (a[i + 2 * EDITS - d] == b[i]).astype(np.uint64) << U(63 - d)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        slant = i < n1 - EDITS
        step = np.where(slant, ((d0 & top) == 0).astype(np.int64), ((hp & mask) != 0).astype(np.int64) - ((hn & mask) != 0))
        dist = np.where(live, dist + step, dist)
        mask = np.where(slant, mask, mask >> U(1))
        vp, vn = np.where(live, hn | ~((d0 >> U(1)) | hp), vp), np.where(live, (d0 >> U(1)) & hp, vn)
        if i % 16 == 15 and (dist > dead).all():
            break
    return dist


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, salt, role, id, text), each group's pivot first, to links."""
    group, pivot = None, None
    for batch in batches:
        ends, left, right = [], [], []
        for a, salt, role, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if role == 0:
                group, pivot = (a, salt), _codes(text)
            elif group == (a, salt):
                ends.append((a, key))
                left.append(pivot)
                right.append(_codes(text))
        ok = within(left, right)
        yield pa.record_batch([pa.array([e[k] for e, y in zip(ends, ok, strict=True) if y], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lo, hi, block, of, id, text) to links; pairs whose letter pairs differ too much in parity aren't compared."""
    held: list[list[tuple]] = []
    pairs = 0
    for rows in groups(batches, 3):
        held.append(rows)
        pairs += len(rows) * len(rows)
        if pairs > 400_000:
            yield _settle(held)
            held, pairs = [], 0
    yield _settle(held)


def _settle(held: list[list[tuple]]) -> pa.RecordBatch:
    """Tests the pairs of many groups at once."""
    out: list[tuple[int, int]] = []
    rows = [r for g in held for r in g]
    if rows:
        text = np.frombuffer("".join([r[6] for r in rows]).encode("utf-32-le", "replace"), np.uint32)
        n = np.array([len(r[6]) for r in rows])
        first = np.cumsum(n) - n
        two = np.zeros(len(text), np.uint64)
        two[:-1] = U(1) << (_vec.mix(text[1:].astype(np.uint64) << U(32) | text[:-1].astype(np.uint64)) & U(63))
        two[first + n - 1] = 0
        marks = np.bitwise_xor.reduceat(two, first)
        of, block, name = (np.array([r[k] for r in rows]) for k in (4, 3, 5))
        left, right, group, at = [], [], [], 0
        for k, g in enumerate(held):
            m = len(g)
            i, j = np.triu_indices(m, 1) if m > 2 else (np.zeros(m - 1, np.int64), np.ones(m - 1, np.int64))
            if g[0][1] != g[0][2]:
                use = block[at + i] != block[at + j]
                i, j = i[use], j[use]
            left.append(at + i)
            right.append(at + j)
            group.append(np.full(len(i), k))
            at += m
        i, j, group = np.concatenate(left), np.concatenate(right), np.concatenate(group)
        # An edit changes at most four letter pairs.
        use = (of[i] != of[j]) & (np.abs(n[i] - n[j]) <= EDITS) & (np.bitwise_count(marks[i] ^ marks[j]) <= 4 * EDITS)
        i, j, group = i[use], j[use], group[use]
        lo, hi = np.minimum(name[i], name[j]), np.maximum(name[i], name[j])
        _, once, back = np.unique(np.stack((lo, hi), 1), axis=0, return_index=True, return_inverse=True)
        ok = within([text[first[x] : first[x] + n[x]] for x in i[once]], [text[first[x] : first[x] + n[x]] for x in j[once]])[back.ravel()]
        i, j, group = i[ok], j[ok], group[ok]
        for k in np.unique(group):
            mine = group == k
            places, local = np.unique(np.concatenate((i[mine], j[mine])), return_inverse=True)
            linked = np.zeros((len(places), len(places)), bool)
            half = len(local) // 2
            linked[local[:half], local[half:]] = True
            out += [(int(name[places[x]]), int(name[places[y]])) for x, y in spanning(of[places], linked | linked.T)]
    return pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, dropped): the numbers (from 0, ascending) of the lines that go, for documents that lose any."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    placed = scratch.put(rows.mapInArrow(_occurrences, "doc bigint, line int, h bigint, g bigint"), "placed")
    hot = _hot(rows)
    salt = F.when(F.col("key").isin(hot.tolist()), F.pmod(F.xxhash64("id"), F.lit(HOT_PARTS))).otherwise(0) if len(hot) else F.lit(0)
    keyed = rows.mapInArrow(_keys, "key bigint, id bigint").repartition("key", *([salt] if len(hot) else [])).sortWithinPartitions("key", "id")
    members = keyed.mapInArrow(lambda batches: _shared(batches, hot), "key bigint, id bigint")
    members = scratch.put(members.distinct() if len(hot) else members, "members")
    wanted = members.select("id").distinct()
    bits = spark.sparkContext.broadcast(bitmap(wanted))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Unseen()
        for batch in batches:
            for _, _, data, offs in _vec.slices(batch.column(1)):
                x = Lines(data, offs)
                at = np.flatnonzero((x.size >= PER_EDIT) & has(bits.value, x.hash))
                at = at[seen.first(x.hash[at])]
                yield pa.record_batch([pa.array(_vec.signed(x.hash[at])), pa.array([x.text[x.start[k] : x.stop[k]] for k in at], pa.string())], names=["id", "text"])

    body = rows.mapInArrow(texts, "id bigint, text string").join(wanted, "id", "left_semi").dropDuplicates(["id"])
    body = scratch.put(body, "texts")

    def star(pairs: DataFrame) -> DataFrame:
        held = body.join(fetches(pairs), "id").select("id", "text", F.explode("wants").alias("w")).select("w.*", "id", "text")
        return held.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(_star, "a bigint, b bigint").distinct()

    def blocks(wants: DataFrame) -> DataFrame:
        held = body.join(wants, "id").select("id", "text", F.explode("wants").alias("w")).select("w.*", "id", "text")
        return held.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_blocks, "a bigint, b bigint").distinct()

    classes = link(members, star, blocks, scratch)
    scratch.drop("members", "links", "texts")
    # First occurrences: of equal lines, then of classes. What isn't one goes; places are compared, of which none is frequent.
    at = F.struct("doc", "line")
    classes = classes.unionByName(classes.select(F.col("component").alias("node"), "component").distinct())
    each = placed.groupBy("h", "g").agg(F.min(at).alias("first")).join(classes, F.col("h") == F.col("node"), "left")
    each = scratch.put(each.select("component", "first"), "each")
    firsts = each.where("component is null").select("first.*").unionByName(each.where("component is not null").groupBy("component").agg(F.min("first").alias("first")).select("first.*"))
    gone = placed.select("doc", "line").join(firsts, ["doc", "line"], "left_anti")
    return gone.groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("dropped"))


def _hot(rows: DataFrame) -> np.ndarray:
    """Keys that are frequent in a sample of the rows and have several lines there, sorted: at most ``HOT_KEYS``, the most frequent."""
    keys = rows.sample(0.01, 7).mapInArrow(_keys, "key bigint, id bigint")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("x"), F.max("id").alias("y"))
    found = counts.where((F.col("n") >= HOT_LEAST) & (F.col("x") != F.col("y"))).orderBy(F.col("n").desc(), "key").limit(HOT_KEYS)
    return np.sort(found.select("key").toArrow()["key"].to_numpy())


def cut(text: str | None, gone: list[int] | None) -> str | None:
    if text is None or gone is None:
        return text
    gone = set(gone)
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its repeated lines; documents of which no line is left go, all columns stay."""
    gone = duplicate_lines(docs, id_col, text_col).select(F.col("doc").alias("_tarn_doc"), F.col("dropped").alias("_tarn_dropped"))
    kept = docs.join(gone, F.col(id_col).cast("long") == F.col("_tarn_doc"), "left").drop("_tarn_doc")
    whole = F.col("_tarn_dropped").isNull()
    kept = kept.where(whole | (F.size("_tarn_dropped") < F.size(F.split(F.col(text_col), "\n", -1))))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, dropped = batch.columns
            columns[at] = pa.array([cut(t, g) for t, g in zip(columns[at].to_pylist(), dropped.to_pylist(), strict=True)], pa.string())
            yield pa.record_batch(columns, names=batch.schema.names[:-1])

    return kept.mapInArrow(run, docs.schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of lines, and which of them go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    gone = duplicate_lines(docs)
    lines = docs.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).alias("n_lines"))
    out = lines.join(gone, F.col("doc_id") == F.col("doc"), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
