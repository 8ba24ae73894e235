"""Views for readers: findings with what they cite, chunks among their neighbours, documents and tags in detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.reads import chunk_names, neighbours
from quire.sources.corpus import Corpus

DEFAULT_KINDS = ["document", "finding", "image"]
MOST_ROWS, MOST_CONTEXT = 500, 5


def clamp(limit: int | None, context: int | None) -> tuple[int, int]:
    """Parameters of a request within their bounds."""
    return max(1, min(limit or 20, MOST_ROWS)), max(0, min(context or 0, MOST_CONTEXT))


def resolved_citations(corpus: Corpus) -> DataFrame:
    """``(finding_id, chunk_id, source_kind, source_id, source_name)`` for each citation of a chunk that exists."""
    cited = corpus.finding_citations.join(corpus.chunks.select("chunk_id", "source_kind", "source_id"), "chunk_id")
    return chunk_names(corpus, cited).select("finding_id", "chunk_id", "source_kind", "source_id", "source_name")


def chunk_view(corpus: Corpus, chunk_id: int) -> DataFrame:
    """A chunk with two neighbours on each side, the chunk itself marked."""
    around = neighbours(corpus, corpus.spark.createDataFrame([(chunk_id,)], "chunk_id long"), 2)
    return around.select("chunk_id", "chunk_index", "text", (F.col("distance") == 0).alias("is_target"))


def tagged_documents(corpus: Corpus, name: str) -> DataFrame:
    """Documents that carry a tag, by title or else file name, without regard to case."""
    own = corpus.document_tags.join(corpus.tags.where(F.col("name") == name).select("tag_id"), "tag_id", "left_semi")
    titles = corpus.summaries.select("document_id", F.when(F.col("model") != "backfill", F.col("title")).alias("title"))
    out = own.select("document_id", "value").join(corpus.documents.select("document_id", "file_name"), "document_id").join(titles, "document_id", "left")
    label = F.coalesce("title", "file_name")
    return out.select("document_id", label.alias("label"), "value").orderBy(F.lower("label"), "document_id")


def findings_index(corpus: Corpus) -> DataFrame:
    """Findings, newest first, with their session's name and model, whether the session said the model itself, and their citations' number."""
    counts = corpus.finding_citations.groupBy("finding_id").agg(F.count("*").alias("citation_count"))
    held = corpus.sessions.columns
    session = corpus.sessions.select("session_id", F.col("name").alias("session_name"), *[F.col(c) if c in held else F.lit(None).cast("string").alias(c) for c in ("model", "run_key")])
    out = corpus.findings.join(session, "session_id").join(counts, "finding_id", "left")
    newest = ["created_at"] if "created_at" in corpus.findings.columns else []
    out = out.withColumn("model_set_by_llm", F.col("run_key").isNotNull() & F.col("model").isNotNull()).withColumn("citation_count", F.coalesce("citation_count", F.lit(0)))
    return out.orderBy(*[F.desc_nulls_last(c) for c in newest], F.desc("finding_id")).select("finding_id", "title", "description", *newest, "session_name", "model", "model_set_by_llm", "citation_count")


def document_detail(corpus: Corpus) -> DataFrame:
    """Each document with its summary and its tags, an array of (tag_id, name, description) by name without regard to case."""
    named = corpus.document_tags.select("document_id", "tag_id").join(corpus.tags.select("tag_id", "name", "description"), "tag_id")
    row = F.struct(F.lower("name").alias("k"), "tag_id", "name", "description")
    tags = named.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda t: F.struct(t["tag_id"].alias("tag_id"), t["name"].alias("name"), t["description"].alias("description"))).alias("tags"))
    out = corpus.documents.select("document_id", "file_name", "page_count").join(corpus.summaries.select("document_id", "title", "description", F.col("text").alias("summary_text"), "model"), "document_id", "left").join(tags, "document_id", "left")
    return out.withColumn("tags", F.coalesce("tags", F.array().cast(out.schema["tags"].dataType)))


def used_tags(corpus: Corpus) -> DataFrame:
    counts = corpus.document_tags.groupBy("tag_id").agg(F.count("*").alias("doc_count"))
    return corpus.tags.join(counts, "tag_id").select("name", "doc_count").orderBy(F.desc("doc_count"), "name")


def enriched(corpus: Corpus, hits: DataFrame) -> DataFrame:
    """Document hits with title, description and link."""
    real = F.col("model") != "backfill"
    text = corpus.summaries.select("document_id", F.when(real, F.col("title")).alias("title"), F.when(real, F.col("description")).alias("description"))
    return hits.join(text, "document_id", "left").withColumn("href", F.concat(F.lit("/documents/"), F.col("document_id").cast("string")))


def image_locators(corpus: Corpus, hits: DataFrame) -> DataFrame:
    """Hits on images with the image's file and whether it has been described."""
    images = corpus.images.select(F.lit("image").alias("source_kind"), F.col("image_id").alias("source_id"), F.col("file_hash").alias("image_hash"), F.col("analysis_json").isNotNull().alias("captioned"))
    return hits.join(images, ["source_kind", "source_id"], "left")


def corpus_info(corpus: Corpus) -> DataFrame:
    """``(name, n)``: rows of the main tables."""
    out = None
    for n in ("documents", "summaries", "findings", "images", "chunks", "tags"):
        one = getattr(corpus, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
