"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns: each has a defined result everywhere."""

import pytest

import corpus_pipeline
from tarn.llm import decontaminate, langid, lines, minhash, pieces, quality, secrets, tokenstore, toxicity, vectors

SCHEMA = "doc_id long, text string, lang string, id long, key string, n int, of long, component long, kept string, score string, dropped string, node long, y string, names string"
LONG = "word number after another word in one long text " * 4000


def model(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def rows_of(spark, rows):
    extra = (7, "k", 1, 2, 3, "x", "s", "d", 4, "y", "nm")
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return rows_of(spark, [(1, None, None), (2, "", "en"), (3, " \t\n", None), (4, LONG, "en"), (4, LONG, "en"), (5, LONG, "de"), (None, LONG, "de"), (None, None, None), (6, "été 123 !!", "fr"), (7, "1234 5678", None)])


@pytest.fixture(scope="module")
def none(spark):
    return rows_of(spark, [])


def labels(spark, rows=((2, 1, 0), (4, 0, 1), (5, 1, 0), (None, 1, 1), (6, None, None), (2, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_minhash(odd, none):
    got = sorted(((r.id, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (4, 4, True), (5, 4, False), (6, 6, True), (7, 7, True), (None, None, True), (None, None, True)], key=str)
    assert minhash.near_duplicates(none).count() == 0


def test_lines(odd, none):
    got = {r.doc: list(r.dropped) for r in lines.duplicate_lines(odd).collect()}
    assert got == {5: [0]}
    kept = lines.dedup_lines(odd)
    assert kept.columns == odd.columns and kept.count() == 9
    assert lines.duplicate_lines(none).count() == 0 and lines.dedup_lines(none).count() == 0


def test_classifiers(spark, odd, none):
    for docs, n in ((odd, 10), (none, 0)):
        for marks in (labels(spark), labels(spark, ())):
            q = quality.score(docs, quality.fit(docs, marks)).collect()
            t = toxicity.score(docs, toxicity.fit(docs, marks)).collect()
            assert len(q) == len(t) == n and all(0 <= r.score <= 1 for r in q + t)
        got = langid.predict(docs, langid.fit(docs, "lang")).collect()
        assert len(got) == n and all(0 <= r.score <= 1 for r in got)
        assert all(r.lang_pred == "und" for r in got if r.key in (1, 2, 3, 7))
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(none, "lang")).collect()} == {"und"}
    kept = toxicity.keep_ordinary(odd, toxicity.fit(odd, labels(spark)))
    assert kept.columns == odd.columns and kept.count() <= 10


def test_leaks(spark, odd, none):
    items = spark.createDataFrame([(1, "after another word in one long text word number after"), (2, None), (None, "a b c d e f g h"), (1, "after another word in one long text word number after")], "item_id long, text string")
    assert {(r.id, r.item, r.edits) for r in decontaminate.leaks(odd, items).collect()} == {(4, 1, 0), (5, 1, 0)}
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(odd, items.where("false")).count() == 0


def test_secrets(odd, none, tmp_path):
    assert secrets.scan(odd, "doc_id", "text", f"file://{tmp_path}/a").count() == 10
    assert secrets.scan(none, "doc_id", "text", f"file://{tmp_path}/b").count() == 0


def test_tokens(spark, odd, none, tmp_path):
    for k, (docs, n) in enumerate(((odd, 10), (none, 0))):
        rows = pieces.encode(docs, model("piece_bpe_32k.model")).collect()
        assert len(rows) == n and all(r.round_trip for r in rows)
        tokenstore.write(docs, f"file://{tmp_path}/{k}", model("byte_bpe_50k.json"), end=2)
        back = tokenstore.read_back(spark, f"file://{tmp_path}/{k}").orderBy("start").collect()
        assert len(back) == n and all(r.verified for r in back)
        assert [r.start for r in back] == [sum(x.n_tokens for x in back[:i]) for i in range(n)]


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [-0.0, 1.0], "x"), (3, [0.0, 1.0], "y"), (None, [1.0, 0.0], "z"), (4, None, None)]
    got = sorted(((r.id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, name string")).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 2, True), (3, 1, 2, False), (4, 0, 4, True), (None, 0, None, True)], key=str)
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline_stages(spark, odd, tmp_path):
    sf = f"file://{tmp_path}/sf"
    columns = odd.columns
    for docs in (odd, odd.where("false")):
        docs.write.mode("overwrite").parquet(f"{sf}/documents.parquet")
        labels(spark).write.mode("overwrite").parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string").write.mode("overwrite").parquet(f"{sf}/benchmark.parquet")
        cur = spark.read.parquet(f"{sf}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, cur, sf)
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
            out.write.mode("overwrite").parquet(f"{sf}/out{k}")
            cur = spark.read.parquet(f"{sf}/out{k}")
        assert set(cur.columns) >= {"doc_id", "ids"}


def test_stages_drop_what_they_name_and_nothing_else(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    every = {r.doc_id for r in docs.select("doc_id").collect()}
    leaked = {r.id for r in decontaminate.leaks(docs, items).collect()}
    assert {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, sf).select("doc_id").collect()} == every - leaked and leaked
    kept = {r.id for r in minhash.near_duplicates(docs).where("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, sf).select("doc_id").collect()} == kept
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    calm = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    bad, good = {d for d, y in marks.items() if y == 1}, {d for d, y in marks.items() if y == 0}
    assert len(bad & calm) < 0.15 * len(bad) and len(good & calm) > 0.95 * len(good)


def test_pipeline_equals_brute_force(spark):
    """What the scores keep, then lines, groups, leaks and ids by the plain versions."""
    import sentencepiece
    from test_llm_pairs import brute_documents, brute_lines, tokens

    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_toxic(spark, docs, sf).collect())
    gone = brute_lines(rows)
    cut = [(d, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone.get(d, ())))) for d, t in rows if len(gone.get(d, ())) < len(t.split("\n"))]
    groups = brute_documents(cut)
    cut = [(d, t) for d, t in cut if groups[d][2]]
    names = [tokens(r.text) for r in items.collect()]
    leak = lambda t: any(decontaminate.best_place(n, tokens(t))[0] <= decontaminate.edits(len(n)) for n in names)
    library = sentencepiece.SentencePieceProcessor(model_file=model("piece_bpe_32k.model"))
    want = {d: library.encode(t) for d, t in cut if not leak(t)}
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf).collect()} == want
