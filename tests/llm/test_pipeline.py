"""The pipeline's stages over a small corpus: columns, effects and order."""

import random

import corpus_pipeline
import pyarrow as pa


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: rng.choice(["sun", "tree", "house", "river", "walk", "stone"]) + str(rng.randint(0, 99))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    item = text(30)
    rows = [(i, text(80), "en", "s", 0) for i in range(120)]
    rows += [(200 + i, text(60).upper().replace(" ", "!! "), "en", "s", 0) for i in range(40)]
    rows += [(300, rows[5][1], "en", "s", 0), (301, text(40) + " " + item + " " + text(40), "en", "s", 0), (302, None, None, None, None), (303, "", "en", "s", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(200 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen.append(docs)
    for x in seen[:-1]:
        assert x.columns == columns
    ids = [{r.doc_id for r in x.collect()} for x in seen[:-1]]
    assert not any(200 <= i < 240 for i in ids[0]) and set(range(120)) <= ids[0]
    assert ids[1] == ids[0]
    assert 5 in ids[2] and 300 not in ids[2] and set(range(120)) <= ids[2]
    assert ids[3] == ids[2] - {301}
    packed = {r.doc_id for r in seen[-1].collect()}
    assert packed == ids[3] - {302, 303}
    assert sorted(map(str, corpus_pipeline.run(spark, d).collect())) == sorted(map(str, seen[-1].collect()))


def test_pipeline_on_nothing(spark, tmp_path):
    """Empty tables of every kind go through all stages."""
    d = str(tmp_path)
    for name, columns in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.parquet(f"{d}/{name}.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_pipeline_on_null_and_repeated_ids(spark, tmp_path):
    """Without labels or items nothing is rejected; rows of no or one doc_id are judged by their own texts."""
    d = str(tmp_path)
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (5, a), (5, b), (None, a), (None, None), (6, None)]
    spark.createDataFrame([(*r, None, None, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    for name, columns in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.parquet(f"{d}/{name}.parquet")
    packed = sorted(((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, d).collect()), key=str)
    assert packed == [(1, 30), (5, 30), (None, 30)]


def test_batches_for_python_are_small(spark):
    """A stage cuts the session's batches; a session with smaller ones keeps them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    docs = spark.range(0, 60, 1, 1).selectExpr("id AS doc_id", "concat(id, ' ', repeat('word ', 100000)) AS text")
    try:
        spark.conf.set(key, str(64 << 20))
        out = corpus_pipeline.best_fit_packing(spark, docs, "")
        assert max(r.n for r in docs.mapInArrow(size, "n long").collect()) < corpus_pipeline.BATCH_BYTES + 1_000_000
        assert out.count() == out.select("doc_id", "piece").distinct().count() and out.select("doc_id").distinct().count() == 60
        spark.conf.set(key, "100000")
        corpus_pipeline.best_fit_packing(spark, docs, "")
        assert spark.conf.get(key) == "100000"
    finally:
        spark.conf.set(key, before)
