"""What keeps work in step with the input: tables are made when read, texts are cut once, indexes move no postings."""

import random

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import citations, fts, grams, topk
from quire.sources import corpus as c


def test_tables_that_nobody_reads_are_not_made(spark, sf_dir):
    made = []

    def store(name, df):
        made.append(name)
        return df

    k = c.indexed(c.from_testdata(spark, sf_dir, store), store)
    assert citations.footnotes(k.findings).count() and k.documents.count() and k.summaries.count() and made == []
    changed = k.with_tables(documents=k.documents.limit(3))
    assert changed.has("postings") and not k.with_tables(chunks=k.documents).has("postings") and made == []
    assert changed.document_tags.columns and k.document_tags is changed.document_tags and made == ["chunks", "document_tags"]


def test_index_parts_come_by_chunks_and_move_no_postings(spark, monkeypatch):
    monkeypatch.setattr(fts, "PART_CHUNKS", 7)
    rng = random.Random(2)
    rows = [(i, "document", i, " ".join(rng.choice(["That", "école", "x1", "zu"]) for _ in range(rng.randint(0, 9))) or None, rng.choice([None, "That Part", ""])) for i in range(50)]
    chunks = spark.createDataFrame(rows, "chunk_id long, source_kind string, source_id long, text string, section_heading string")
    table = fts.in_order(fts.postings(fts.dealt(chunks, 7)), dealt=True)
    want = sorted((t, h, i, p, len(tx.py_tokens(b or "")) + len(tx.py_tokens(e or ""))) for i, _, _, b, e in rows for h, x in ((False, b), (True, e)) for p, t in enumerate(tx.py_tokens(x or "")))
    got = [(r.term, r.in_heading, r.chunk_id, r.place, r.doc_len) for r in table.collect()]
    assert sorted(got) == want
    parts = table.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high")).orderBy("low").collect()
    assert len(parts) > 3 and all(a.high < b.low for a, b in zip(parts, parts[1:]))
    assert table._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1


def test_blocks_of_chunks_are_those_of_postings(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_IDS", 8)
    rows = [(i, "document", i, f"that with {'that ' * (i % 4)} w{i % 3}" if i % 9 else None, "that head" if i % 5 == 0 else None) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id long, source_kind string, source_id long, text string, section_heading string")
    made = topk.blocks_of(chunks)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, topk.blocks(fts.postings(chunks)).collect()))
    assert made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1


def test_an_index_of_some_trigrams_names_the_same_chunks(spark):
    rows = [(i, "document", i, t) for i, t in enumerate([None, "", "MIT License", "apache licence", "Licen", "a mit license", "İMIT", "x" * 50])]
    chunks = spark.createDataFrame(rows, "chunk_id long, source_kind string, source_id long, text string")
    plan = grams.plan_of("(MIT|Apache) Licen[cs]e")
    some = grams.postings(chunks, grams.grams_of(plan))
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, grams.postings(chunks).where(F.col("gram").isin(grams.grams_of(plan))).collect()))
    assert grams.candidates(some, plan).count() == grams.candidates(grams.postings(chunks), plan).count() == 3
    assert grams.postings(chunks, []).count() == 0


def test_pieces_across_runs(spark):
    text = "".join(random.Random(1).choice("ab \né𝒳") for _ in range(2000))
    bare = text.strip()
    for size, overlap in ((10, 3), (4, 0)):
        cut = [bare[i * (size - overlap) :][:size].strip() for i in range(max(0, -(-(len(bare) - size) // (size - overlap))) + 1)]
        got = spark.createDataFrame([(text,)], "t string").select(tx.chunk_pieces(F.col("t"), size, overlap).alias("p")).first().p
        assert len(cut) > 3 * tx.RUN and [(x.chunk_index, x.text) for x in got] == list(enumerate(x for x in cut if x))


def test_long_texts_are_cut_in_linear_time(spark):
    """Half a million characters in 700 pieces; each used to trim the whole text again."""
    import time

    long = spark.range(1).select(F.repeat(F.lit("word and "), 55_000).alias("t"))
    began = time.time()
    assert long.select(F.size(tx.chunk_pieces(F.col("t"))).alias("n")).first().n == 707
    assert time.time() - began < 10
