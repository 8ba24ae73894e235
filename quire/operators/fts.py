"""Full-text matching on a positional index, and BM25.

The index is a table of postings: a row for each token of a chunk's body or heading, in parts by ranges of
chunks, each sorted by term, so that a query reads the pages of its own terms only. A phrase is an equality join
of its terms' postings on chunk and place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Chunks whose postings make a part of the index: some 3 million of them.
PART_CHUNKS = 20_000
POSTING = ["term", "in_heading", "chunk_id", "source_kind", "source_id", "doc_len", "place"]
POSTING_SCHEMA = "term string, in_heading boolean, chunk_id long, source_kind string, source_id long, doc_len int, place int"


def search_phrases(query: str) -> list[list[str]]:
    """Each blank-separated word is a phrase of its own (it may hold several tokens); all must be found."""
    return [t for t in (tx.py_tokens(w.replace('"', "")) for w in query.split()) if t]


def scan_phrases(query: str, mode: str = "phrase") -> list[list[str]]:
    """One phrase of the whole query, or all of its words in any order (``terms``)."""
    words = query.replace('"', " ").split()
    groups = [" ".join(words)] if mode == "phrase" else words
    return [t for t in map(tx.py_tokens, groups) if t]


def postings(chunks: DataFrame) -> DataFrame:
    """The postings of chunks; ``doc_len`` is the number of tokens of body and heading together."""
    both = chunks.select("chunk_id", "source_kind", "source_id", tx.tokens(F.col("text")).alias("body"), tx.tokens(F.col("section_heading")).alias("head"))
    sized = both.select("chunk_id", "source_kind", "source_id", F.concat("body", "head").alias("__all"), F.size("body").alias("__n"))
    each = sized.select("chunk_id", "source_kind", "source_id", "__n", F.size("__all").alias("doc_len"), F.posexplode("__all").alias("__at", "term"))
    heading = F.col("__at") >= F.col("__n")
    return each.withColumns({"in_heading": heading, "place": F.when(heading, F.col("__at") - F.col("__n")).otherwise(F.col("__at"))}).select(*POSTING)


def dealt(chunks: DataFrame, most: int = PART_CHUNKS) -> DataFrame:
    """Chunks dealt by ranges of their numbers, so few to a part that its postings are sorted in memory: texts move once, postings never."""
    return chunks.repartitionByRange(chunks.count() // most + 1, "chunk_id")


def in_order(table: DataFrame, few: bool = False, dealt: bool = False) -> DataFrame:
    """Postings sorted by term within each part, ready to be written; those of ``dealt`` chunks stay where they are, ``few`` make one part, others are dealt by ranges of (term, chunk).

    A term has rows in every part of dealt chunks; readers find them by the pages' bounds, as a part is sorted.
    """
    table = table.coalesce(1) if few else table if dealt else table.repartitionByRange("term", "chunk_id")
    return table.sortWithinPartitions("term", "in_heading", "chunk_id", "place")


def statistics(chunks: DataFrame, table: DataFrame) -> DataFrame:
    """One row: the number of chunks and of tokens in the whole index."""
    return chunks.agg(F.count("*").alias("n_all")).join(F.broadcast(table.agg(F.count("*").alias("len_all"))))  # a row each


def hits(table: DataFrame, phrase: list[str], in_heading: bool = False) -> DataFrame:
    """``(chunk_id, source_kind, source_id, doc_len, f)``: chunks that hold the phrase and how often it begins there; overlapping ones count."""
    own = table.where(F.col("in_heading") == in_heading)
    found = own.where(F.col("term") == phrase[0]).drop("term", "in_heading")
    for i, term in enumerate(phrase[1:], 1):
        found = found.join(own.where(F.col("term") == term).select("chunk_id", (F.col("place") - i).alias("place")), ["chunk_id", "place"], "left_semi")
    return found.groupBy("chunk_id").agg(*[F.first(c).alias(c) for c in ("source_kind", "source_id", "doc_len")], F.count("*").cast("double").alias("f"))


def holding(table: DataFrame, phrases: list[list[str]], in_heading: bool = False) -> DataFrame:
    """``(chunk_id, source_kind, source_id)`` of chunks that hold every phrase; no phrase at all is held by none."""
    if not phrases:
        return table.where("false").select("chunk_id", "source_kind", "source_id")
    legs = [hits(table, p, in_heading).select("chunk_id", "source_kind", "source_id") for p in phrases]
    return reduce(lambda a, b: a.join(b.select("chunk_id"), "chunk_id", "left_semi"), legs)


def idf(n_all: Column, n: Column) -> Column:
    """The weight of what ``n`` of all chunks hold; never zero or less."""
    raw = F.log((n_all - n + 0.5) / (n + 0.5))
    return F.when(raw <= 0, LEAST_IDF).otherwise(raw)


def bm25(table: DataFrame, stats: DataFrame, phrases: list[list[str]], within) -> DataFrame:
    """``(chunk_id, score)``, higher is better, of chunks that hold all phrases and pass ``within`` (a function of a frame with source_kind and source_id).

    The statistics are those of the whole index; rows of numbers are broadcast.
    """
    if not phrases:
        return table.where("false").select("chunk_id", F.lit(0.0).alias("score"))
    legs = [hits(table, p) for p in phrases]
    out = within(legs[0]).withColumnRenamed("f", "f0").join(F.broadcast(stats))  # one row
    for i, leg in enumerate(legs):
        out = out.join(F.broadcast(leg.agg(F.count("*").alias(f"n{i}"))))  # one row
        if i:
            out = out.join(leg.select("chunk_id", F.col("f").alias(f"f{i}")), "chunk_id")
    avg = F.col("len_all").cast("double") / F.col("n_all")
    score = F.lit(0.0)
    for i in range(len(legs)):
        f, n = F.col(f"f{i}"), F.col(f"n{i}")
        score = score + idf(F.col("n_all"), n) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("doc_len") / avg))
    return out.select("chunk_id", score.alias("score"))
