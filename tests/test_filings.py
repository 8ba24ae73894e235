"""Filings by byte ranges: the same rows as from whole texts for every size of the ranges, for marks in any order and place."""

import random

import pytest
from pyspark.sql import functions as F

from quire.sources import files, filings

PARTS = ["<DOCUMENT>", "</DOCUMENT>", "<TEXT>", "</TEXT>", "\n<TYPE>10-K\n", "\n<FILENAME>a.htm\n", "word é ", "<DOCUMENT", "<XBRL>", "</XBRL>", "DOCUMENT>", "\n"]


def write(folder, texts):
    for i, t in enumerate(texts):
        (folder / f"f {i:02}.txt").write_bytes(t if isinstance(t, bytes) else t.encode())
    return str(folder)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(7)
    texts = ["".join(rng.choices(PARTS, [4, 4, 3, 3, 2, 2, 4, 1, 1, 1, 1, 1], k=rng.randint(0, 60))) for _ in range(12)]
    whole = "".join(f"<DOCUMENT>\n<TYPE>EX-{i}\n<TEXT>\nbody {i}\n</TEXT>\n</DOCUMENT>\n" for i in range(40))
    return write(tmp_path_factory.mktemp("filings"), [*texts, "", "</DOCUMENT>" * 3 + "<DOCUMENT>" * 3, whole, b"<DOCUMENT><TEXT>\xff\xc3</TEXT></DOCUMENT>"])


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_give_what_whole_texts_give(spark, folder, size):
    if size == 1:  # a task for each byte would be many: the last files only
        folder = f"{folder}/f 1[2-5].txt"
        whole = files.collect(spark, [folder]).where("length < 60")
    else:
        whole = files.collect(spark, [folder])
    want = files.split_envelope(whole.select("path", files.read_text(F.col("content")).alias("text")))
    assert rows(filings.inner_documents(whole.select("path", "length"), size)) == rows(want)
    assert size == 1 or want.count() > 45


@pytest.mark.parametrize("block", [11, 13, 1 << 20])
def test_marks_across_blocks(folder, block, monkeypatch):
    import glob

    monkeypatch.setattr(filings, "BLOCK", block)
    for path in sorted(glob.glob(f"{folder}/*")):
        data = open(path, "rb").read()
        want = []
        for m in filings.MARK.finditer(data):
            if not want or want[-1][1] != (not m[1]):
                want.append((m.start(), not m[1]))
        with filings.opened(path) as f:
            assert filings.marks_within(f, 0, len(data)) == want
        if want:  # a mark belongs to the range in which it begins
            at = want[-1][0]
            with filings.opened(f"file:{path}") as f:
                assert filings.marks_within(f, at, at + 1)[:1] == [want[-1]] and filings.marks_within(f, at + 1, at + 2) == []


def test_listing_twice_none_and_other_columns(spark, folder):
    listing = filings.listed(spark, [folder])
    want = rows(filings.inner_documents(listing, 64))
    assert rows(filings.inner_documents(listing.union(listing).withColumn("position", F.lit(1)).withColumn("marks", F.lit(2)), 64)) == want
    assert filings.inner_documents(listing.where("false")).count() == 0


def test_new_files_as_a_stream(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    text = "<DOCUMENT><TYPE>\n</TYPE><TEXT>one {}</TEXT></DOCUMENT>"

    def run():
        stream = filings.listed_stream(spark, str(source)).writeStream.foreachBatch(lambda b, n: filings.inner_documents(b, 32).write.mode("overwrite").parquet(f"{target}/batch={n}"))
        stream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    (source / "a.txt").write_text(text.format("a"))
    run()
    (source / "b.txt").write_text(text.format("b") * 2)
    run()
    assert sorted((r.batch, r.position, r.body) for r in spark.read.parquet(target).collect()) == [(0, 0, "one a"), (1, 0, "one b"), (1, 1, "one b")]


def test_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(bytearray(b"a\xff\xc3b"),), (bytearray("é".encode()),), (None,)], "c binary")
    assert [r[0] for r in df.select(files.read_text(F.col("c"))).collect()] == ["a��b", "é", None]
