"""Derived tables that later steps read again, in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import zlib

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session (one machine, as in tests) without one gets a temporary folder, a cluster is refused."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="quire-")
    return _own[sc.applicationId]


def folder_of(spark: SparkSession, source: str) -> str:
    """The folder of the tables that this application derives from ``source``."""
    return f"{shared_folder(spark)}/quire-{spark.sparkContext.applicationId}-{zlib.crc32(source.encode()):08x}"


def store_of(spark: SparkSession, source: str):
    """A function ``(name, frame)`` that writes a table derived from ``source`` for this application and gives it back."""
    folder = folder_of(spark, source)

    def store(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return store
