import hashlib
import re

import pytest
from brute import TEXTS
from pyspark.sql import functions as F

from quire.llm import exact


def brute(docs):
    """docs: (doc_id, text); one tuple per row."""
    plain = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in docs]
    out = []
    for (i, _), t in zip(docs, plain):
        group = [j for (j, _), u in zip(docs, plain) if t == u]
        keep = min((j for j in group if j is not None), default=None)
        out.append((i, keep, len(group), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(i + 1, t) for i, t in enumerate(TEXTS)] + [(100, "one  two\tthree\nfour"), (101, " one two"), (102, "one two"), (103, "one two "), (104, " one two"), (None, "one"), (None, "no id"), (None, "no id"), (105, "again"), (105, "again"), (106, "again")]


def test_copies_equal_the_plain_statement(spark):
    df = spark.createDataFrame([(i, t, "x", 1, True) for i, t in ROWS], "doc_id long, text string, digest string, group_size int, kept boolean")
    assert sorted(map(tuple, exact.copies(df).collect()), key=repr) == brute(ROWS)
    left = exact.dedup(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id is not None) == sorted((i, t) for i, t in ROWS if (i, ) in {(r[0],) for r in brute(ROWS) if r[3] and r[0] is not None})
    assert exact.copies(df.limit(0)).count() == 0 and exact.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("share", [1 / 1024, 0.5, 0.0])
def test_rows_do_not_depend_on_what_is_heavy(spark, monkeypatch, share):
    monkeypatch.setattr(exact, "HEAVY_SHARE", share)
    df = spark.range(3000, numPartitions=7).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("t"), (F.col("id") % 100).cast("string"))).otherwise(F.col("id").cast("string")).alias("text"))
    docs = [(r.doc_id, r.text) for r in df.collect()]
    first, size = {}, {}
    for i, t in docs:
        first.setdefault(t, i)
        size[t] = size.get(t, 0) + 1
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.copies(df).collect()}
    assert got == {i: (first[t], size[t], first[t] == i) for i, t in docs}


def test_the_summary_names_every_frequent_key(spark):
    df = spark.range(60_000, numPartitions=9).select(F.when(F.col("id") % 300 < 2, F.col("id") % 300).otherwise(F.col("id") + 1000).alias("k"))
    maybe, total = exact.candidates(df, "k")
    found = {r.item for r in maybe.collect()}
    hot = {r.h for r in spark.range(2).select(F.xxhash64("id").alias("h")).collect()}
    assert total == 60_000 and hot <= found and len(found) <= exact.COUNTERS


def test_no_python_on_the_main_path(spark, sf_dir):
    from quire.llm import queries

    plan = queries.QUERIES["op13_exact"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
