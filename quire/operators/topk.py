"""The best by BM25 without reading all postings of frequent terms.

Chunk numbers are cut into fixed ranges, the blocks. For each term a block has the number of chunks that
hold it, the largest frequency and the smallest length among them, which bound any score in the block from
above. Blocks are read in order of their bounds until the k-th best score found rules out the rest.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import fts

#: Chunk numbers of a block: some 40 sources, whatever their kinds, since a source has 100,000 numbers for each of four kinds.
BLOCK_IDS = 1 << 24
SCHEMA = "term string, block long, n long, most double, shortest int"
#: Blocks of the first round; each further round that finds too few has FACTOR times as many.
ROUND, FACTOR = 16, 8
#: Blocks up to which a round looks at their numbers, and runs of neighbours up to which it names them in a filter that reaches the scan; more are joined.
NAMED_BLOCKS, NAMED_RUNS = 4096, 32
#: Bounds and scores are sums of doubles, so a bound counts as a little more than it is.
SLACK = 1e-9


def block_of(chunk_id: Column) -> Column:
    return F.floor(chunk_id / BLOCK_IDS).cast("long")


def blocks(postings: DataFrame) -> DataFrame:
    """``(term, block, n, most, shortest)`` of all bodies."""
    per = postings.where(~F.col("in_heading")).groupBy("term", "chunk_id").agg(F.count("*").cast("double").alias("f"), F.first("doc_len").alias("doc_len"))
    return per.groupBy("term", block_of(F.col("chunk_id")).alias("block")).agg(F.count("*").alias("n"), F.max("f").alias("most"), F.min("doc_len").alias("shortest"))


def blocks_of(chunks: DataFrame) -> DataFrame:
    """The same from the chunks themselves: their texts move once, a block to one part, and all is counted there."""
    own = chunks.select(block_of(F.col("chunk_id")).alias("block"), "chunk_id", "text", "section_heading").repartition(chunks.count() // fts.PART_CHUNKS + 1, "block")
    cut = own.select("block", "chunk_id", tx.tokens(F.col("text")).alias("body"), F.size(tx.tokens(F.col("section_heading"))).alias("head"))
    each = cut.select("block", "chunk_id", (F.size("body") + F.col("head")).alias("doc_len"), F.explode("body").alias("term"))
    per = each.groupBy("block", "chunk_id", "term").agg(F.count("*").cast("double").alias("f"), F.first("doc_len").alias("doc_len"))
    return per.groupBy("block", "term").agg(F.count("*").alias("n"), F.max("f").alias("most"), F.min("doc_len").alias("shortest")).select("term", "block", "n", "most", "shortest")


def in_order(table: DataFrame, dealt: bool = False) -> DataFrame:
    """Blocks sorted within each part, ready to be written; those that were ``dealt`` already stay where they are."""
    return (table if dealt else table.repartitionByRange("term", "block")).sortWithinPartitions("term", "block")


@dataclass(frozen=True)
class Found:
    """``rows`` (chunk_id, score) and how many blocks hold all terms, and how many of them were read."""

    rows: DataFrame
    blocks: int
    read: int


def _part(idf: float, f: Column, length: Column, average: float) -> Column:
    return F.lit(idf) * f * (fts.K1 + 1) / (f + fts.K1 * (1 - fts.B + fts.B * length / F.lit(average)))


def best(postings: DataFrame, stats: DataFrame, table: DataFrame, terms: list[str], within, k: int) -> Found:
    """The ``k`` best chunks that hold all terms (single tokens) and pass ``within``, by the same scores as ``fts.bm25``.

    ``table`` are the blocks of the postings. No term at all finds nothing, a term twice counts twice. At most k chunks
    of a round, and the numbers of a round's blocks up to NAMED_BLOCKS, reach the driver.
    """
    spark = postings.sparkSession
    none = spark.createDataFrame([], "chunk_id long, score double")
    different = sorted(set(terms))
    own = table.where(F.col("term").isin(different))
    df = {r["term"]: r["df"] for r in own.groupBy("term").agg(F.sum("n").alias("df")).collect()} if terms else {}
    if not terms or len(df) < len(different):
        return Found(none, 0, 0)
    size = stats.first()
    average = size["len_all"] / size["n_all"]
    idf = {t: spark.range(1).select(fts.idf(F.lit(size["n_all"]), F.lit(n))).first()[0] for t, n in df.items()}
    times = {t: terms.count(t) for t in different}
    weight = F.create_map(*[F.lit(x) for t in different for x in (t, idf[t] * times[t])])[F.col("term")]
    most = weight * F.col("most") * (fts.K1 + 1) / (F.col("most") + fts.K1 * (1 - fts.B + fts.B * F.col("shortest") / F.lit(average)))
    bounds = own.groupBy("block").agg(F.sum(most).alias("bound"), F.count("*").alias("__terms")).where(F.col("__terms") == len(different)).select("block", (F.col("bound") * (1 + SLACK)).alias("bound")).cache()
    total, read, limit = bounds.count(), 0, ROUND
    have: list = []

    def scored(some: DataFrame) -> list:
        return [tuple(r) for r in some.orderBy(F.desc("score"), "chunk_id").limit(k).collect()]

    def round_of(where: DataFrame, n: int) -> DataFrame:
        """Scores of the chunks of some blocks."""
        rows = postings.where(~F.col("in_heading") & F.col("term").isin(different))
        runs: list[list[int]] = []
        for b in sorted(r[0] for r in where.select("block").collect()) if n <= NAMED_BLOCKS else ():
            if runs and b == runs[-1][1] + 1:
                runs[-1][1] = b
            else:
                runs.append([b, b])
        if n <= NAMED_BLOCKS and len(runs) <= NAMED_RUNS:
            rows = rows.where(reduce(lambda x, y: x | y, [F.col("chunk_id").between(x * BLOCK_IDS, (y + 1) * BLOCK_IDS - 1) for x, y in runs], F.lit(False)))
        else:
            rows = rows.withColumn("block", block_of(F.col("chunk_id"))).join(where.select("block"), "block", "left_semi")
        counts = [F.count_if(F.col("term") == t).cast("double").alias(f"f{i}") for i, t in enumerate(different)]
        held = rows.groupBy("chunk_id").agg(*[F.first(c).alias(c) for c in ("source_kind", "source_id", "doc_len")], *counts)
        held = within(held.where(reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in range(len(different))])))
        place = {t: i for i, t in enumerate(different)}
        score = reduce(lambda a, b: a + b, [_part(idf[t], F.col(f"f{place[t]}"), F.col("doc_len"), average) for t in terms], F.lit(0.0))
        return held.select("chunk_id", score.alias("score"))

    def together(more: list) -> list:
        return sorted(have + more, key=lambda r: (-r[1], r[0]))[:k]

    order = [F.desc("bound"), F.col("block")]
    try:
        while read < total:
            if len(have) == k:  # what may still enter is read in one round
                left = bounds.orderBy(*order).offset(read).where(F.col("bound") >= have[-1][1])
                n = left.count()
                if n:
                    have = together(scored(round_of(left, n)))
                read += n
                break
            n = min(limit, total - read)
            have = together(scored(round_of(bounds.orderBy(*order).offset(read).limit(n), n)))
            read, limit = read + n, limit * FACTOR
    finally:
        bounds.unpersist()
    return Found(spark.createDataFrame(have, "chunk_id long, score double") if have else none, total, read)
