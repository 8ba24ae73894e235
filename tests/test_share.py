"""Publishing and taking in files by content."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.sources import corpus as c
from quire.sources import routes, share


def test_files_are_published_once_and_verified(spark, tmp_path):
    contents = [b"one", b"two" * 1000, b"", b"\x00\xff"]
    hashes = [hashlib.sha256(x).hexdigest() for x in contents]
    archive, folder, taken = (str(tmp_path / n) for n in ("archive", "published", "taken"))
    routes.archive(spark.createDataFrame([*zip(hashes, map(bytearray, contents)), ("unused", bytearray(b"x"))], "file_hash string, content binary"), archive)
    tables = {n: spark.createDataFrame([], s) for n, s in c.SCHEMAS.items() if n not in ("meta", "ingests")}
    docs = lambda n: spark.createDataFrame([(i, hashes[i], f"/a/{i}.txt") for i in range(n)] + [(9, "no file", None), (8, None, None), (7, hashes[0], "/b/again.txt")], "document_id long, file_hash string, file_path string")
    images = spark.createDataFrame([(1, hashes[3], "/i/3.png")], "image_id long, file_hash string, file_path string")
    corpus = c.Corpus(**tables).with_tables(documents=docs(2), images=images)
    with pytest.raises(EngineError) as e:
        share.take_in_files(spark, folder, taken)
    assert e.value.code == "MISSING_ARTIFACT"
    first = share.publish_files(corpus, archive, folder)
    assert {(r.file_hash, r.name, r.length, r.digest) for r in first.collect()} == {(hashes[0], "0.txt", 3, hashes[0]), (hashes[1], "1.txt", 3000, hashes[1]), (hashes[3], "3.png", 2, hashes[3])}
    copied = lambda: spark.read.parquet(f"{folder}/files").groupBy("batch").count().agg(F.array_sort(F.collect_list("count"))).first()[0]
    assert copied() == [3]
    assert share.publish_files(corpus.with_tables(documents=docs(3)), archive, folder).count() == 4 and copied() == [1, 3]
    assert share.take_in_files(spark, folder, taken) == 4 == share.take_in_files(spark, folder, taken)
    assert {(r.file_hash, bytes(r.content)) for r in spark.read.parquet(taken).collect()} == set(zip(hashes, contents))
    # a file that has been changed, and one that is gone
    batches = [d for d in os.listdir(f"{folder}/files") if d.startswith("batch=")]
    rows = [(r.file_hash, bytes(r.content)) for r in spark.read.parquet(f"{folder}/files").collect()]
    bad = [(h, bytearray(b"tampered" if h == hashes[1] else x)) for h, x in rows if h != hashes[0]]
    for b in batches:
        os.rename(f"{folder}/files/{b}", f"{folder}/{b}-old")
    spark.createDataFrame(bad, "file_hash string, content binary").withColumn("part", F.concat(F.lit("h"), F.substring("file_hash", 1, 2))).write.partitionBy("part").parquet(f"{folder}/files/batch=x")
    with pytest.raises(EngineError) as e:
        share.take_in_files(spark, folder, str(tmp_path / "other"))
    assert e.value.code == "BROKEN_ARTIFACT" and e.value.extra == {"missing": [hashes[0]], "broken": [hashes[1]]} and not os.path.exists(tmp_path / "other")


def test_contents_are_moved_once_whatever_they_are_compared_with(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "file_hash string, content binary")
    given = frame([("aa1", bytearray(b"1")), ("aa1", bytearray(b"1")), ("aa2", bytearray(b"2")), ("bb3", None), ("bb4", bytearray(b"4")), (None, bytearray(b"5"))])
    hashes = lambda *names: spark.createDataFrame([(n,) for n in names], "file_hash string")
    found = lambda *others: sorted(((r.file_hash or "", r.content and bytes(r.content), r.part) for r in routes.once_by_part(given, *others).collect()))
    assert found() == [("", b"5", None), ("aa1", b"1", "haa"), ("aa2", b"2", "haa"), ("bb3", None, "hbb"), ("bb4", b"4", "hbb")]
    assert found(hashes("aa1", "other"), hashes("aa1", "aa2", "aa2", "bb3", "absent")) == [("aa2", b"2", "haa"), ("bb3", None, "hbb")]
    assert found(None, hashes()) == []
    made = routes.once_by_part(given, hashes("aa1"), hashes("aa2"))
    made.collect()
    assert made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1


def test_a_broken_copy_beside_a_right_one_is_refused(spark, tmp_path):
    digest = hashlib.sha256(b"x").hexdigest()
    rows = [(digest, bytearray(x), "hx") for x in (b"x", b"y", b"x", b"z")]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], share.FILE).write.partitionBy("part").parquet(str(tmp_path / f"files/batch={i}"))
    spark.createDataFrame([(digest, "x.txt", 1, digest)], "file_hash string, name string, length long, digest string").write.parquet(str(tmp_path / "manifest/v=1"))
    with pytest.raises(EngineError) as e:
        share.take_in_files(spark, str(tmp_path), str(tmp_path / "taken"))
    assert e.value.extra == {"missing": [], "broken": [digest]}
