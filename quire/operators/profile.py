"""Corpus profile and document lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.operators.scope import Scope, chunks_in
from quire.sources.corpus import Corpus

LARGEST = 10


def _docs(corpus: Corpus, scope: Scope) -> DataFrame:
    return corpus.documents if scope.ids is None else corpus.documents.join(scope.ids, "document_id", "left_semi")


def _summaries(corpus: Corpus, scope: Scope) -> DataFrame:
    return corpus.summaries if scope.ids is None else corpus.summaries.join(scope.ids, "document_id", "left_semi")


def totals(corpus: Corpus, scope: Scope) -> DataFrame:
    """Documents, tokens and chunks (documents' and images') of the slice."""
    docs = _docs(corpus, scope).agg(F.count("*").alias("documents"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    chunks = chunks_in(corpus, scope, ["document", "image"]).agg(F.count("*").alias("chunks"))
    return docs.crossJoin(chunks)  # a row each


def date_range(corpus: Corpus, scope: Scope) -> DataFrame:
    return _summaries(corpus, scope).agg(F.min("authored_date").alias("first"), F.max("authored_date").alias("last"), F.count("authored_date").alias("dated"))


def documents_by_year(corpus: Corpus, scope: Scope) -> DataFrame:
    return _summaries(corpus, scope).where("authored_date is not null").groupBy(F.substring("authored_date", 1, 4).alias("year")).agg(F.count("*").alias("n")).orderBy("year")


def content_mix(corpus: Corpus, scope: Scope) -> DataFrame:
    """Chunks by content type; none is a group of its own."""
    return chunks_in(corpus, scope, ["document", "image"]).groupBy("content_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("content_type"))


def chunk_length(corpus: Corpus, scope: Scope) -> DataFrame:
    """Nearest-rank median and 90th percentile, and the longest."""
    size = F.length("text")
    lengths = chunks_in(corpus, scope, ["document"]).select(size.cast("long").alias("n"))
    return lengths.agg(F.expr("percentile_disc(0.5) within group (order by n)").alias("median"), F.expr("percentile_disc(0.9) within group (order by n)").alias("p90"), F.max("n").alias("longest"))


def tag_facet(corpus: Corpus, scope: Scope) -> DataFrame:
    """Documents by tag: all tags over the whole corpus, only those that occur in a slice."""
    held = corpus.document_tags if scope.ids is None else corpus.document_tags.join(scope.ids, "document_id", "left_semi")
    counts = held.groupBy("tag_id").agg(F.count("*").alias("n"))
    out = corpus.tags.join(counts, "tag_id", "left" if scope.ids is None else "inner")
    return out.select("name", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "name")


def summary_coverage(corpus: Corpus, scope: Scope) -> DataFrame:
    """Documents with a real summary, and those that still need one (containers of sections do not)."""
    docs = _docs(corpus, scope).select("document_id")
    real = corpus.summaries.where("model <> 'backfill'").select("document_id", F.lit(1).alias("real"))
    parents = corpus.documents.select(F.col("parent_document_id").alias("document_id"), F.lit(1).alias("parent")).where("document_id is not null").distinct()
    joined = docs.join(real, "document_id", "left").join(parents, "document_id", "left")
    return joined.agg(F.count("real").alias("summarized"), F.count_if(F.col("real").isNull() & F.col("parent").isNull()).alias("unsummarized"))


def largest(corpus: Corpus, scope: Scope, n: int = LARGEST) -> DataFrame:
    return _docs(corpus, scope).join(corpus.summaries.select("document_id", "title", "model"), "document_id", "left").select("document_id", "file_name", F.when(F.col("model") != "backfill", F.col("title")).alias("title"), "token_count").orderBy(F.desc_nulls_last("token_count"), "document_id").limit(n)


def list_documents(corpus: Corpus, scope: Scope, sort: str = "id", limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Documents with title, dates, chunk and image counts; by id, title (without case) or newest first with undated ones last."""
    own = corpus.chunks.where("source_kind = 'document'").groupBy(F.col("source_id").alias("document_id")).agg(F.count("*").alias("chunk_count"))
    shown = corpus.document_images.groupBy("document_id").agg(F.countDistinct("image_id").alias("image_count"))
    real = F.col("model") != "backfill"
    named = corpus.summaries.select("document_id", F.when(real, F.col("title")).alias("title"), F.when(real, F.col("description")).alias("description"), "authored_date", real.alias("real"))
    out = _docs(corpus, scope).join(named, "document_id", "left").join(own, "document_id", "left").join(shown, "document_id", "left")
    created = F.col("created_at") if "created_at" in out.columns else F.lit(None).cast("timestamp").alias("created_at")
    out = out.select("document_id", "file_name", "title", "description", "authored_date", created, F.coalesce("real", F.lit(False)).alias("has_summary"), "page_count", "token_count", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("image_count", F.lit(0)).alias("image_count"))
    orders = {"id": ["document_id"], "title": [F.lower(F.coalesce("title", "file_name")), "document_id"], "date": [F.desc_nulls_last("authored_date"), "document_id"]}
    if sort not in orders:
        raise EngineError("USAGE_ERROR", f"cannot sort by {sort!r}")
    out = out.orderBy(*orders[sort])
    return out.offset(offset).limit(limit) if limit is not None else out


def value_chips(corpus: Corpus, tag_names: list[str]) -> DataFrame:
    """``(document_id, name, value, chunk_id)`` of value tags among the names."""
    named = corpus.tags.where(F.col("name").isin(tag_names) & F.col("value_type").isNotNull()).select("tag_id", "name")
    return corpus.document_tags.join(named, "tag_id").select("document_id", "name", "value", "chunk_id")


def chunk_counts(corpus: Corpus) -> DataFrame:
    return corpus.chunks.groupBy("source_kind").agg(F.count("*").alias("n"))
