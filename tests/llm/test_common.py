import os
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import common
from quire.sources import tables


def test_a_cluster_without_a_shared_folder_is_refused():
    context = types.SimpleNamespace(master="spark://x:7077", applicationId="a", getConf=dict, getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        tables.shared_folder(types.SimpleNamespace(sparkContext=context, conf={}))
    context.getConf = lambda: {"spark.checkpoint.dir": "hdfs://x"}
    assert tables.shared_folder(types.SimpleNamespace(sparkContext=context, conf={})) == "hdfs://x"


def test_joins_with_hot_keys_give_the_rows_of_a_plain_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    many = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 400).alias("k"), "id")
    one = many.groupBy("k").agg(F.count("*").alias("n")).where("k <> 11").withColumn("v", F.col("k") * 2)
    got = common.spread_join(many, one, ["k"], "n", 1000)
    assert sorted(map(tuple, got.select("k", "id", "v").collect())) == sorted(map(tuple, many.join(one, "k").select("k", "id", "v").collect()))


def test_components_of_hubs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 130)] + [(200, 300), (300, 200), (300, 300), (None, 5)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(40), 0), **dict.fromkeys(range(100, 131), 100), 200: 200, 300: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scratch_tables_go_and_results_stay(spark):
    with common.scratch(spark, keep=1):
        first = common.stored(spark.range(3))
        last = common.stored(first.where("id > 0"))
        path = first.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path) and last.count() == 2


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = [b"one two  three", b"", b"x" * 5000 + b" y " + b"z" * 300, "é日 ü".encode()]
    want = common.Words(texts).hashes()
    for block in (1, 7, 64, 4096):
        monkeypatch.setattr(common, "HASH_BLOCK", block)
        monkeypatch.setattr(common, "_word_powers", [])
        assert (common.Words(texts).hashes() == want).all()
    assert len(np.unique(want)) == len(want)
