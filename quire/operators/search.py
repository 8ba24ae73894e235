"""Ranked search: a full-text leg and a nearest-neighbour leg, fused by reciprocal rank."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.functions import text as tx
from quire.functions import vectors
from quire.operators import fts
from quire.operators.reads import chunk_names, neighbours
from quire.operators.scope import Scope, chunks_in, memory_enabled, memory_wall, within
from quire.sources.corpus import Corpus

RRF_K = 60
DEFAULT_KINDS = ["document", "image"]
MODES = ["full-text", "semantic"]


def overfetch(limit: int) -> int:
    """What each leg hands to the fusion; a chunk beyond it counts for nothing there."""
    return max(5 * limit, 50)


def _ranked(df: DataFrame, leg: str, *order) -> DataFrame:
    """Ranks from 1 in a leg already cut to its top rows."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(*order))).select("chunk_id", "rank", F.lit(leg).alias("leg"))


def full_text(corpus: Corpus, query: str, scope: Scope, kinds: list[str], k: int, session_id: int | None = None) -> DataFrame:
    """``(chunk_id, score)``: the k best by BM25 within scope and what the session may see; statistics come from the whole index."""
    table, stats = corpus.index()
    seen = lambda rows: memory_wall(corpus, within(corpus, rows, scope, kinds), session_id)
    return fts.bm25(table, stats, fts.search_phrases(query), seen).orderBy(F.desc("score"), "chunk_id").limit(k)


def nearest(corpus: Corpus, vector: list[float], scope: Scope, kinds: list[str], k: int, session_id: int | None = None) -> DataFrame:
    """``(chunk_id, distance)``: the k nearest by Euclidean distance among the chunks in scope, not after them."""
    own = memory_wall(corpus, chunks_in(corpus, scope, kinds), session_id).select("chunk_id")
    near = corpus.embeddings.join(own, "chunk_id", "left_semi").select("chunk_id", vectors.l2(F.col("embedding"), vectors.literal(vector)).alias("distance"))
    return near.orderBy("distance", "chunk_id").limit(k)


def fuse(text_leg: DataFrame | None, vector_leg: DataFrame | None, limit: int, k: int = RRF_K) -> DataFrame:
    """``(chunk_id, score, rank)`` by the sum of 1 / (k + rank); ties go to the full-text leg's order."""
    legs = []
    if text_leg is not None:
        legs.append(_ranked(text_leg, "fts", F.desc("score"), "chunk_id"))
    if vector_leg is not None:
        legs.append(_ranked(vector_leg, "vec", "distance", "chunk_id"))
    both = legs[0] if len(legs) == 1 else legs[0].unionByName(legs[1])
    score = F.sum(1.0 / (k + F.col("rank"))).alias("score")
    out = both.groupBy("chunk_id").agg(score, F.min(F.when(F.col("leg") == "fts", F.col("rank"))).alias("fts_rank"), F.min(F.when(F.col("leg") == "vec", F.col("rank"))).alias("vec_rank"))
    order = [F.desc("score"), F.asc_nulls_last("fts_rank"), F.asc_nulls_last("vec_rank")]
    return out.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def query_vector(query: str, embed) -> list[float]:
    """The query's vector by ``embed`` (a callable: text to floats); whatever goes wrong there is EMBED_FAILED."""
    try:
        vector = [float(x) for x in embed(query)]
    except Exception as wrong:  # a model may fail in any way
        raise EngineError("EMBED_FAILED", f"the query could not be embedded: {wrong}") from wrong
    if not vector or not all(map(math.isfinite, vector)):
        raise EngineError("EMBED_FAILED", "the model gave no finite vector")
    return vector


def search(corpus: Corpus, query: str, scope: Scope, vector: list[float] | None = None, kinds: list[str] | None = None, limit: int = 20, brief: bool = False, modes: list[str] | None = None, embed=None, session_id: int | None = None) -> DataFrame:
    """Ranked hits with their place: rank, ids, score (raw and as a share of the best), file or title, page, text or preview.

    ``modes``: full-text and semantic, both where a vector (or ``embed``, a model that makes one) is at hand.
    A session without memory sees no findings at all here.
    """
    if not query.strip():
        raise EngineError("EMPTY_QUERY", "the query is empty")
    modes = modes or (["full-text", "semantic"] if vector is not None or embed is not None else ["full-text"])
    if unknown := [m for m in modes if m not in MODES]:
        raise EngineError("USAGE_ERROR", f"no mode {unknown[0]!r}", known=MODES)
    if "semantic" in modes and vector is None:
        if embed is None:
            raise EngineError("EMBED_FAILED", "no model to embed the query with")
        vector = query_vector(query, embed)
    kinds = [x for x in (kinds or DEFAULT_KINDS) if x != "finding" or (scope.ids is None and memory_enabled(corpus, session_id))]
    k = overfetch(limit)
    legs = full_text(corpus, query, scope, kinds, k) if "full-text" in modes else None, nearest(corpus, vector, scope, kinds, k) if "semantic" in modes else None
    hits = fuse(*legs, limit)
    best = F.max("score").over(W.partitionBy(F.lit(1)))
    hits = hits.withColumn("normalized_score", F.col("score") / best)  # at most ``limit`` rows
    named = chunk_names(corpus, corpus.chunks.join(F.broadcast(hits), "chunk_id"))
    text = tx.preview(F.col("text"), tx.BRIEF_CHARS) if brief else F.col("text")
    cols = ["rank", "chunk_id", "source_kind", "source_id", "score", "normalized_score", "source_name", "page_number"]
    document = F.when(F.col("source_kind") == "document", F.col("source_id")).alias("document_id")
    return named.select(*cols, document, text.alias("text")).orderBy("rank")


def with_context(corpus: Corpus, hits: DataFrame, n: int) -> DataFrame:
    """Chunks within ``n`` places of each hit in the same source: ``(hit_id, chunk_id, distance, text)``."""
    if not 0 <= n <= 5:
        raise EngineError("USAGE_ERROR", "context is 0 to 5")
    return neighbours(corpus, hits.select("chunk_id"), n)
