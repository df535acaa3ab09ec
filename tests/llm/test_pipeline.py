from pyspark.sql import functions as F

import corpus_pipeline

from .test_operators import EDGE, WORD, words


def test_stages(spark, tmp_path):
    texts = [*EDGE, *[words(80, k, 10**6) + "\n" + words(9, k) for k in range(30)], words(80, 3, 10**6) + "\n" + words(9, 3) + " tail", "spam " * 50]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id for r in docs.collect()})
        assert docs.filter(F.length("text") != F.col("n_chars")).isEmpty()
    clean = set(range(len(EDGE), len(EDGE) + 30))
    assert clean <= seen[0] and len(texts) - 1 not in seen[0]
    assert clean <= seen[1] and clean <= seen[2] and len(texts) - 2 not in seen[2]
    assert seen[3] <= seen[2]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.exact and r.n_tokens == len(r.ids) for r in out)
    assert sum(len(WORD.findall(r.text)) for r in docs.collect()) > 0
    assert len(out) == docs.count()


def test_stages_on_repeated_rows_and_empty_tables(spark, tmp_path):
    """A repeated row counts once from near-dedup on; an empty table gives empty results; clashing names do no harm."""
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    t = words(60, 1, 10**6)
    rows = [(1, t, "en", "s", 9), (1, t, "en", "s", 9), (2, words(60, 2, 10**6), "en", None, 9), (None, words(60, 3, 10**6), "en", "s", 9), (3, None, None, None, None)]
    for name, some in (("rows", rows), ("none", [])):
        spark.createDataFrame(some, shape).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert all(r.exact for r in out)
        assert {r.doc_id for r in out} <= {1, 2, None} and bool(out) == bool(some)
    docs = spark.createDataFrame(rows, shape).withColumns({c: F.lit("x") for c in ("kept", "slot", "words", "__mark", "host_rate")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == corpus_pipeline.COLUMNS and out.count() >= 1


def test_mix_is_written_in_the_order_of_slots(spark, tmp_path):
    from reportloom.llm import mixing

    rows = [(k, words(100 + k, k), "en", f"s{k % 3}", 0) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    slots = {r.doc_id: r.first_slot for r in mixing.report(docs).collect()}
    once = {}
    for r in corpus_pipeline.mix(spark, docs, "").collect():
        once.setdefault(r.doc_id, len(once))
    assert sorted(once, key=once.get) == sorted(once, key=lambda k: slots[k])


def test_null_and_empty_texts_stage_by_stage(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    t = words(60, 1, 10**6)
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, t, "en", None, 9), (3, t, "en", None, 9), (4, words(60, 2, 10**6), "en", "s", 9)]
    docs = spark.createDataFrame(rows, shape)
    ids = lambda out: sorted(r.doc_id for r in out.collect())
    assert ids(corpus_pipeline.quality(spark, docs, "")) == [3, 3, 4]
    assert ids(corpus_pipeline.lines(spark, docs, "")) == [1, 2, 3, 3, 4]
    assert ids(corpus_pipeline.near_copies(spark, docs, "")) == [1, 3, 4]
    assert not {1, 2} & set(ids(corpus_pipeline.mix(spark, docs, "")))
    ids_of = {r.doc_id: r.ids for r in corpus_pipeline.encode(spark, docs, "").collect()}
    assert ids_of[1] is None and ids_of[2] == [] and ids_of[3]
