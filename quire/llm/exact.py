"""Exact duplicates, with a split for heavy hitters.

Texts are equal when they are identical after each run of white space is one blank; the
SHA-256 of that form stands for a text. A third of all rows may carry one digest, so a
Misra-Gries summary (the counters of Spark's frequent-items sketch, merged in two levels) names the
digests that may be frequent, a pass over the stored digests counts those exactly, and the
ones that are frequent indeed - the winners, of which there can be few - are broadcast and leave
without a shuffle. All other digests are grouped by an ordinary one. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored, without_ids

#: White space that is not one blank already.
BLANKS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
#: A digest with more than this share of all rows is heavy: there are fewer than 1 / HEAVY_SHARE, which bounds what is broadcast.
HEAVY_SHARE = 1 / 1024
#: Items that a summary tracks; any digest with over 7 / 16384 of the rows is then among its candidates.
COUNTERS = 8192
#: Summaries of the first level of merging.
SUMMARIES = 64


def normalised(text: Column) -> Column:
    """A text with each run of ``[\\x20\\x09-\\x0D]`` as one blank; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def digest(text: Column) -> Column:
    """The SHA-256 of a text's UTF-8, 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def candidates(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``(item)``, hashes of the keys that may be heavy (COUNTERS at most), and the number of all rows."""
    own = rows.select(F.xxhash64(key).alias("item"), (F.spark_partition_id() % SUMMARIES).alias("summary"))
    level = own.groupBy("summary").agg(F.expr(f"approx_top_k_accumulate(item, {COUNTERS})").alias("state"), F.count("*").alias("n"))
    merged = level.groupBy((F.col("summary") * 0).alias("all")).agg(F.expr(f"approx_top_k_combine(state, {COUNTERS})").alias("state"), F.sum("n").alias("n"))  # no group of no rows, which have no sketch
    whole = stored(merged.select(F.expr(f"approx_top_k_estimate(state, {COUNTERS}).item").alias("items"), "n"))
    total = whole.first()
    return whole.select(F.explode("items").alias("item")), total["n"] if total else 0


def grouped(rows: DataFrame, key: str, doc_id: str) -> DataFrame:
    """``rows`` with ``keep_id`` (the smallest ``doc_id`` with that key) and ``group_size``.

    ``rows`` are read several times, so they should be a stored table.
    """
    maybe, total = candidates(rows, key)
    firsts = lambda df: df.groupBy(key).agg(F.min(doc_id).alias("keep_id"), F.count("*").alias("group_size"))
    counted = firsts(rows.withColumn("item", F.xxhash64(key)).join(F.broadcast(maybe), "item", "left_semi"))
    winners = F.broadcast(stored(counted.where(F.col("group_size") > max(1.0, total * HEAVY_SHARE))))
    rest = rows.join(winners.select(key), key, "left_anti")
    return rows.join(winners, key).unionByName(rest.join(firsts(rest), key))


def copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` (hex).

    A null text is empty and equals empty and only them, not blank ones (a blank text is one blank). Of equal texts the row with the
    smallest doc_id stays; rows that share text and doc_id are one document and stay or go together. Null ids are
    larger than any other: such a row stays only where no row of its group has an id, and ``keep_id`` is null then.
    Texts of any length are digested whole where they are read and never moved; an empty table gives no rows; other columns are ignored.
    """
    rows = stored(df.select(F.col(doc_id).alias("doc_id"), digest(normalised(F.col(text))).alias("digest")))
    out = grouped(rows, "digest", "doc_id")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df`` without the documents whose text a smaller doc_id has; rows with a null id stay."""
    gone = stored(copies(df, doc_id, text).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(doc_id)).distinct())
    return without_ids(df, gone, doc_id)
