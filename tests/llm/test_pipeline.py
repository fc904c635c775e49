from pyspark.sql import functions as F

import corpus_pipeline as C
from veridix.llm import simhash as S


def test_stages_on_nulls_copies_and_leaks(spark, tmp_path):
    words = [f"wort{i}" for i in range(400)]
    text = lambda a, n: " ".join(words[(a * 37 + i * 11) % 400] for i in range(n))
    leak = "Seven grey owls sat on the wall. They saw the red fox run home."
    docs = [(i, text(i, 60 + i)) for i in range(12)] + [(20, text(3, 63)), (21, text(1, 40) + " " + leak + " " + text(2, 30)), (22, None), (23, "")]
    df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in docs] + [(None, "no id", None, None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = [r["doc_id"] for r in C.run(spark, str(tmp_path)).select("doc_id").distinct().collect()]
    groups = {}
    sets = {i: S.shingle_set(t) for i, t in docs}
    for i in sorted(sets):
        groups[i] = min(j for j in sets if S.jaccard(sets[i], sets[j]) >= 0.8)
    want = {i for i in sets if groups[i] == i} - {21}
    assert set(out) == want | {None}
    empty = df.limit(0)
    for name, stage in C.STAGES:
        got = stage(spark, empty, str(tmp_path))
        assert got.count() == 0
        if name != "packing":
            assert got.columns == C.COLUMNS
            empty = got


def test_the_sessions_batch_size_stays(spark, docs):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    S.simhash_components(docs).count()
    assert spark.conf.get(key) == before


def test_an_id_with_two_texts_is_judged_by_text(spark, tmp_path):
    leak = "Seven grey owls sat on the wall. They saw the red fox run home."
    other = " ".join(f"wort{i}" for i in range(50))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(1, leak, "en", "s", 9), (1, other, "en", "s", 9), (None, leak, "en", "s", 9), (2, None, "en", "s", 0)], schema)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = C.decontaminate(spark, df.withColumn("text_id", F.lit("clash")), str(tmp_path))
    assert got.columns == C.COLUMNS and sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, other), (2, None)]
