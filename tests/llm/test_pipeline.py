import corpus_pipeline
from test_lines import brute
from brute import components, simhash
from test_packing import check

from quire.llm import quality


def test_stages_hold_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, sf_dir).cache()
    verdict = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    rows = kept.collect()
    assert kept.columns == docs.columns and {r.doc_id for r in rows} == {d for d, k in verdict.items() if k}
    lines = corpus_pipeline.drop_repeated_lines(spark, kept, sf_dir).cache()
    want = brute([(r.doc_id, r.text) for r in rows])
    assert lines.columns == docs.columns and {r.doc_id: r.text for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    one = corpus_pipeline.drop_near_duplicates(spark, lines, sf_dir).cache()
    fp = {i: simhash(t) for i, t in want.items()}
    groups = components(fp, lambda x, y: (fp[x] ^ fp[y]).bit_count() <= 4)
    left = {r.doc_id: r.text for r in one.collect()}
    assert one.columns == docs.columns and left.keys() == {i for i, g in groups.items() if i == g}
    packed = corpus_pipeline.pack_sequences(spark, one, sf_dir).collect()
    check(packed, list(left.items()), 1024)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    check(whole, list(left.items()), 1024)
    assert {tuple(r)[:5] for r in whole} == {tuple(r)[:5] for r in packed}


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "best_fit_packing"]


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    text = "The old harbour lay quiet under a pale morning sky while fishermen mended their nets and spoke of storms that had come from the north during many a winter before."
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, text, "en", None, 9), (3, text, "en", None, 9), (None, text + " and an end of its own", None, "b", 1), (4, text, "fr", "a", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as piece", "'x' as quality_prob", "true as kept").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({r.sequence_id for r in out}) == 1  # texts without words are rejected; the only line of document 4 goes, so its end mark is left
    assert sorted((r.doc_id or 0, r.length > 1) for r in out) == [(0, True), (3, True), (3, True), (4, False)]
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
