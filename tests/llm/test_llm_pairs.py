"""Operators on pairs and searches against brute force, on small fixtures and the smallest tables."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import decontaminate, lines, minhash, vectors

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class Classes:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    w = WORD.findall((text or "").encode().translate(FOLD))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_documents(rows):
    sets = {i: shingles(t) for i, t in rows}
    c = Classes(sets)
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                c.join(a, b)
    return {i: (len(s), c.root(i), c.root(i) == i) for i, s in sets.items()}


def mutated(r, words, share):
    return [r.choice(["new", "other", "word", w + "x"]) if r.random() < share else w for w in words]


def corpus(seed=0):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(400)]
    rows = []
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 150))]
        for _ in range(r.randint(1, 12)):
            rows.append(" ".join(mutated(r, base, r.choice([0, 0.005, 0.02, 0.05]))))
    # Many copies of one text that differ from each other more than from it.
    base = [r.choice(vocabulary) for _ in range(200)]
    rows += [" ".join(mutated(r, base, 0.02)) for _ in range(60)]
    rows += ["", None, "   \t\n", "one", "One", "a b c d", "A  b\nc d", "a b c d e", "x " * 3000, "x " * 3001]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [0, 1])
def test_minhash_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_documents(rows)


def test_minhash_compares_blocks_of_a_large_bucket(spark, monkeypatch):
    from tarn.llm import _link

    monkeypatch.setattr(_link, "BLOCK", 8)
    rows = corpus(2)
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_documents(rows)


def test_query_op1(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.op1_minhash(spark, SF).collect()}
    assert got == brute_documents(rows)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def edited(r, text, n):
    s = list(text)
    for _ in range(n):
        p, kind = r.randrange(len(s)), r.randrange(3)
        if kind == 0:
            s[p] = r.choice("xyzé")
        elif kind == 1:
            del s[p]
        else:
            s.insert(p, r.choice("xyzé"))
    return "".join(s)


def test_short_documents_at_the_threshold_are_all_found(spark):
    r = random.Random(12)
    rows = []
    for k in range(400):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice((7, 10, 15, 19)))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, *(f"x{r.randrange(10**6)}" for _ in range((len(words) - 4) // 3))]))]
    got = {x.id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d] == d - d % 2 for d in got) and len(got) == 800


def test_banded_distance():
    r = random.Random(3)
    pairs = [(a := "".join(r.choice("abcé ") for _ in range(r.randint(5, 70))), edited(r, a, r.randint(0, 4))) for _ in range(800)]
    got = lines.within([lines._codes(a) for a, _ in pairs], [lines._codes(b) for _, b in pairs])
    assert got.tolist() == [distance(a, b) <= min(2, min(len(a), len(b)) // 12) for a, b in pairs]


def brute_lines(rows):
    places = collections.defaultdict(list)
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            if line.strip():
                places[line].append((d, k))
    names = sorted(places)
    c = Classes(names)
    for k, a in enumerate(names):
        for b in names[:k]:
            most = min(2, min(len(a), len(b)) // 12)
            if most and abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                c.join(a, b)
    first = {}
    for x in names:
        first[c.root(x)] = min([*places[x], first.get(c.root(x), (1 << 60, 0))])
    gone = collections.defaultdict(list)
    for x in names:
        for d, k in places[x]:
            if (d, k) != first[c.root(x)]:
                gone[d].append(k)
    return {d: sorted(v) for d, v in gone.items()}


@pytest.mark.parametrize("block", [256, 4])
def test_lines_equal_brute_force(spark, monkeypatch, block):
    from tarn.llm import _link

    monkeypatch.setattr(_link, "BLOCK", block)
    r = random.Random(4)
    base = ["".join(r.choice("abcdeé ") for _ in range(r.randint(5, 45))) for _ in range(25)]
    rows = []
    for d in range(60):
        rows.append((d, "\n".join(edited(r, x, r.choice([0, 0, 1, 2, 3])) if len(x) > 8 else x for x in r.sample(base, r.randint(0, 5)))))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, " " * 30 + "\n" + " " * 30), (104, "long" * 5000 + "\n" + "long" * 5000)]
    got = {x.doc: list(x.dropped) for x in lines.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


def test_edit_bounds_follow_the_length(spark):
    r = random.Random(6)
    rows = []
    for n in (1, 2, 3, 11, 12, 13, 14, 23, 24, 25, 26, 60):
        for _ in range(6):
            x = "".join(r.choice("abcdefghijkl") for _ in range(n))
            rows += [x, *(edited(r, x, k) for k in (1, 2, 3) if n > 3)]
    rows = [(d, x) for d, x in enumerate(rows)]
    got = {x.doc: list(x.dropped) for x in lines.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows) and len(got) > 60


def test_frequent_keys_are_dealt_over_tasks(spark, monkeypatch):
    r = random.Random(7)
    rows = [(d, "2026-11-26 a log line begins alike, always " + "".join(r.choice("abcdefgh") for _ in range(21))) for d in range(3000)]
    rows += [(3000 + d, edited(r, rows[d][1], 1)) for d in range(0, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    real = lines._hot
    monkeypatch.setattr(lines, "HOT_LEAST", 3)
    monkeypatch.setattr(lines, "_hot", lambda rows: seen.append(real(rows)) or seen[-1])
    with_hot = {x.doc: list(x.dropped) for x in lines.duplicate_lines(df).collect()}
    assert len(seen[0])
    monkeypatch.setattr(lines, "_hot", lambda rows: np.zeros(0, np.int64))
    without = {x.doc: list(x.dropped) for x in lines.duplicate_lines(df).collect()}
    assert with_hot == without and len(without) >= 60


def test_a_second_name_tells_lines_apart():
    def names(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return lines.Lines(data, np.array([0, len(data)])).more.tolist()

    long = "x" * 40_000
    a = names(f"{long}a\n{long}b\nab\nba\nab\n{long}a")
    assert len(set(a)) == 4 and a[0] == a[5] and a[2] == a[4]


def test_cut_lines_keep_columns(spark):
    long = "a line that is long enough to count"
    df = spark.createDataFrame([(1, f"{long}\nown line of one\n\nshort", "en"), (2, f"{long}x\nown line of two", "de"), (3, long, None), (4, None, "fr"), (None, long, "es")], "doc_id long, text string, dropped string")
    got = {(r.doc_id, r.text, r.dropped) for r in lines.dedup_lines(df).collect()}
    assert got == {(1, f"{long}\nown line of one\n\nshort", "en"), (2, "own line of two", "de"), (4, None, "fr"), (None, long, "es")}


def test_query_op8(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in lines.op8_line_dedup(spark, SF).collect()}
    assert {d: r.n_lines for d, r in got.items()} == {d: len(t.split("\n")) for d, t in rows}
    # Edits are rare here: equality gives all but a few, which the brute force over the candidates must explain.
    exact = collections.defaultdict(list)
    seen = set()
    for d, t in sorted(rows):
        for k, line in enumerate(t.split("\n")):
            if line.strip():
                if line in seen:
                    exact[d].append(k)
                seen.add(line)
    assert all(set(v) <= set(got[d].dropped) for d, v in exact.items())


def tokens(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", text.encode().translate(FOLD))


def test_leaks_equal_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(n))) for k, n in enumerate([5, 6, 8, 9, 12, 15, 20, 33, 64, 90] * 2)]
    items += [(100, None), (101, ""), (102, "too short to count")]
    docs, planted = [], {}
    for d in range(160):
        filler = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        words = []
        if d % 2:
            k, text = items[r.randrange(20)]
            words = text.split()
            for _ in range(r.randint(0, decontaminate.edits(len(words)))):
                p, kind = r.randrange(len(words)), r.randrange(3)
                if kind == 0:
                    words[p] = r.choice(vocabulary)
                elif kind == 1:
                    del words[p]
                else:
                    words.insert(p, r.choice(vocabulary))
        at = r.randint(0, len(filler))
        docs.append((d, " ".join(filler[:at]) + "\n" + ", ".join(words).upper() + ". " + " ".join(filler[at:])))
    docs += [(900, None), (901, ""), (None, items[7][1])]
    want = {}
    for d, t in docs:
        for k, text in items[:20]:
            if d is not None and t is not None:
                e, _ = decontaminate.best_place(tokens(text), tokens(t))
                if e <= decontaminate.edits(len(tokens(text))):
                    want[d, k] = e
    got = {(x.id, x.item): x for x in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k: v.edits for k, v in got.items()} == want and len(want) > 60
    x = got[next(iter(want))]
    assert x.last_word - x.first_word <= x.item_words + x.edits


def test_items_of_every_length_are_found_at_the_largest_number_of_edits(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(3000)]
    items, docs = [], []
    for m in (5, 7, 10, 16, 31, 64, 127, 128, 200, 300, 500, 1000):
        for _ in range(40):
            words = [r.choice(vocabulary) for _ in range(m)]
            items.append((len(items), " ".join(words)))
            for _ in range(decontaminate.edits(m)):
                p, kind = r.randrange(len(words)), r.randrange(3)
                words[p : p + (kind != 2)] = [r.choice(vocabulary)] if kind != 1 else []
            docs.append((len(docs), " ".join([*(r.choice(vocabulary) for _ in range(20)), *words, *(r.choice(vocabulary) for _ in range(20))])))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {x.id for x in decontaminate.leaks(*frames).collect() if x.id == x.item}
    found = [sum(k in got for k in range(lo, lo + 40)) for lo in range(0, len(items), 40)]
    assert min(found) >= 38 and sum(found) >= 0.985 * len(items)


def test_short_items_and_unspaced_scripts(spark):
    items = [(1, "Yes"), (2, "two words"), (3, "今天天气很好我们去公园"), (4, "天"), (5, "one two three four")]
    docs = [(1, "oh yes!"), (2, "two other words"), (3, "听说今天天气很好我们去学校了"), (4, "X two words, 日本"), (5, "one two three, and four"), (6, "ONE, two three-four")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    pairs = lambda **k: {(x.id, x.item, x.edits) for x in decontaminate.leaks(*frames, **k).collect()}
    assert pairs() == {(1, 1, 0), (3, 3, 2), (3, 4, 0), (4, 2, 0), (6, 5, 0)}
    assert pairs(least_words=5) == {(3, 3, 2)}


def test_query_op5(spark):
    docs, items = (duckdb.sql(f"select * from '{SF}/{t}.parquet'").fetchall() for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.op5_decontaminate(spark, SF).collect()}
    exact = {(d[0], k) for d in docs for k, text in items if b" ".join(tokens(text)) in b" ".join(tokens(d[1]))}
    assert exact <= got
    for d, k in got - exact:
        text = dict(items)[k]
        assert decontaminate.best_place(tokens(text), tokens({x[0]: x[1] for x in docs}[d]))[0] <= decontaminate.edits(len(tokens(text)))


def brute_vectors(rows):
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    c, n = Classes([i for i, _ in rows]), collections.Counter()
    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.95:
                n[a] += 1
                n[b] += 1
                c.join(a, b)
    return {i: (n[i], c.root(i), c.root(i) == i) for i, _ in rows}


def cloud(seed, many=500, dims=24):
    r = np.random.default_rng(seed)
    base = r.standard_normal((many, dims))
    rows = [v for v in base]
    for k in range(40):
        rows += [base[k] + r.standard_normal(dims) * s for s in (0.01, 0.1, 0.2)]
    rows += [base[0] + r.standard_normal(dims) * 0.02 for _ in range(120)] + [base[1]] * 30
    return [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(rows)]


@pytest.mark.parametrize("block", [2048, 64])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "LEAF", 40)
    rows = cloud(1) + [(10_000, None), (10_001, []), (10_002, [0.0] * 24), (10_003, [float("nan")] + [1.0] * 23), (10_004, [None] + [1.0] * 23), (10_005, [1.0, 2.0]), (10_006, [2.0, 4.0]), (10_007, [float("inf")] * 24)]
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == brute_vectors(rows)


def test_large_leaves_are_split_again_and_links_stay(spark, monkeypatch):
    """Planted pairs at a cosine of 0.951 or more, and a group of a third of the rows around one vector."""
    for name, value in {"SAMPLE": 400, "LEAF": 60, "LARGE": 480}.items():
        monkeypatch.setattr(vectors, name, value)
    r = np.random.default_rng(3)
    n, dims = 9000, 32
    x = r.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]

    def near(v, cosine):
        noise = r.standard_normal(v.shape)
        noise -= (noise * v).sum(1)[:, None] * v
        noise /= np.linalg.norm(noise, axis=1)[:, None]
        return cosine * v + np.sqrt(1 - cosine**2) * noise

    x[1000:2000] = near(x[:1000], 0.951)
    x[6000:] = near(np.repeat(x[5999:6000], 3000, 0), 0.97)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    seen = []
    real = vectors._split
    monkeypatch.setattr(vectors, "_split", lambda placed, *a: seen.append((placed, real(placed, *a))) or seen[-1][1])
    got = vectors.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas().sort_values("id")
    assert got.n_links.sum() >= 0.97 * linked.sum() and got.n_links.sum() <= linked.sum()
    assert (got.component_id.to_numpy()[1000:2000] == np.arange(1000)).mean() > 0.98
    largest = [df.select(F.explode("places").alias("p")).where("size(array(p)) = 1").groupBy("p").count().agg(F.max("count")).first()[0] for df in seen[0]]
    assert largest[1] < largest[0]


def test_query_op9(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.op9_embedding_dedup(spark, SF).collect()}
    assert got == brute_vectors(rows)


def test_short_lines_that_repeat_go(spark):
    rows = [(1, "Les.\n\nx\n "), (2, "x\nLes.\nUnd \u00e4be."), (3, "\n \nLes\nUnd \u00e4be.")]
    got = {r.doc: list(r.dropped) for r in lines.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: [0, 1], 3: [3]}
