"""Findings as files, model references, and blind copies of a leaderboard."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.functions import text as tx
from quire.operators import citations


def finding_files(findings: DataFrame) -> DataFrame:
    """``(finding_id, file_name, content)``: markdown with front matter, citations made inert."""
    quoted = lambda c: F.to_json(F.struct(F.coalesce(F.col(c), F.lit("")).alias("v")))
    field = lambda c: F.concat(F.lit(f"{c}: "), F.regexp_extract(quoted(c), r"(?s)^\{\"v\":(.*)\}$", 1))
    plain = citations.inert(findings)
    content = F.concat_ws("\n", F.lit("---"), field("title"), field("description"), F.lit("---"), F.lit(""), F.col("body"))
    return plain.select("finding_id", F.concat(tx.slug(F.col("title")), F.lit("-"), F.col("finding_id").cast("string"), F.lit(".md")).alias("file_name"), content.alias("content"))


def read_finding_files(df: DataFrame, content: str = "content") -> DataFrame:
    """``title``, ``description`` and ``body`` of such files; null title where the front matter is missing."""
    inner = F.regexp_extract(content, r"(?s)^---\n(.*?)\n---\n", 1)
    value = lambda c: F.get_json_object(F.concat(F.lit('{"v":'), F.regexp_extract("__head", rf'(?m)^{c}: ("(?:[^"\\]|\\.)*")$', 1), F.lit("}")), "$.v")
    out = df.withColumn("__head", inner)
    body = F.regexp_replace(content, r"(?s)^---\n.*?\n---\n\n?", "")
    return out.select(*df.columns, F.when(F.col("__head") != "", value("title")).alias("title"), value("description").alias("description"), body.alias("body"))


def parse_model(ref: str) -> tuple[str, str]:
    """Provider and model of ``provider/model``, cut at the first slash."""
    m = re.fullmatch(r"([^/]+)/(.+)", ref)
    if not m:
        raise EngineError("USAGE_ERROR", f"{ref!r} is no provider/model")
    return m[1], m[2]


def model_slug(ref: Column) -> Column:
    return F.regexp_replace(ref, "[:/]", "-")


def slug_clashes(refs: DataFrame, ref: str = "ref") -> DataFrame:
    """Slugs that several references share."""
    return refs.select(F.col(ref).alias("ref")).distinct().groupBy(model_slug(F.col("ref")).alias("slug")).agg(F.count("*").alias("n")).where("n > 1")


def blind(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """``rows`` with a label that does not tell the key: the place of its seeded digest; the same for a seed every time."""
    from pyspark.sql import Window as W

    keys = rows.select(key).distinct()  # as many as there are models
    labels = keys.withColumn("label", F.concat(F.lit("model-"), F.row_number().over(W.orderBy(F.sha2(F.concat(F.col(key), F.lit(f":{seed}")), 256))).cast("string")))
    return rows.join(F.broadcast(labels), key).drop(key)
