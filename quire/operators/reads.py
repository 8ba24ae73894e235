"""Reads: chunks by document, by id and around a chunk; whole documents; names and places of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.operators.scope import memory_enabled, memory_wall
from quire.sources.corpus import Corpus


def by_document(corpus: Corpus, document_id: int, limit: int = 50, offset: int = 0) -> DataFrame:
    own = corpus.chunks.where((F.col("source_kind") == "document") & (F.col("source_id") == document_id))
    return own.orderBy("chunk_index").offset(offset).limit(limit)


def by_ids(corpus: Corpus, ids: list[int], session_id: int | None = None) -> DataFrame:
    """Chunks in the order asked for, each once; ``found`` is false for numbers that are no chunk, or one that the session may not see."""
    asked = corpus.spark.createDataFrame([(i, p) for p, i in enumerate(dict.fromkeys(ids))], "chunk_id long, position int")
    seen = memory_wall(corpus, corpus.chunks.where(F.col("chunk_id").isin(list(dict.fromkeys(ids)))), session_id)
    return F.broadcast(asked).join(seen, "chunk_id", "left").withColumn("found", F.col("source_kind").isNotNull()).orderBy("position")


def neighbours(corpus: Corpus, ids: DataFrame, n: int) -> DataFrame:
    """Chunks of the same source whose index is within ``n`` of a given chunk's: an equality join with a bound on the difference."""
    place = corpus.chunks.join(ids, "chunk_id", "left_semi").select(F.col("chunk_id").alias("hit_id"), "source_kind", "source_id", F.col("chunk_index").alias("hit_index"))
    near = corpus.chunks.join(place, ["source_kind", "source_id"])
    distance = F.col("chunk_index") - F.col("hit_index")
    return near.where(F.abs(distance) <= n).select("hit_id", "chunk_id", "chunk_index", distance.alias("distance"), "text").orderBy("hit_id", "chunk_index")


def around(corpus: Corpus, chunk_id: int, window: int = 3) -> DataFrame:
    return neighbours(corpus, corpus.spark.createDataFrame([(chunk_id,)], "chunk_id long"), window)


def document_texts(corpus: Corpus, separator: str = "\n\n") -> DataFrame:
    """``(document_id, text)``: each document's chunks in order."""
    return corpus.chunks.where("source_kind = 'document'").groupBy(F.col("source_id").alias("document_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), separator).alias("text"))


def read_document(corpus: Corpus, document_id: int, full: bool = False, max_tokens: int | None = None) -> DataFrame:
    """A document's summary, or its whole text unless that is too large."""
    row = corpus.documents.where(F.col("document_id") == document_id).select("token_count").first()
    if row is None:
        raise EngineError("DOCUMENT_NOT_FOUND", f"no document {document_id}")
    if full and max_tokens is not None and (row["token_count"] or 0) > max_tokens:
        raise EngineError("DOCUMENT_TOO_LARGE", f"document has {row['token_count']} tokens", max_read_tokens=max_tokens)
    one = corpus.documents.where(F.col("document_id") == document_id).select("document_id", "file_name")
    real = corpus.summaries.withColumn("is_stub", F.col("model") == "backfill").select("document_id", "authored_date", *[F.when(~F.col("is_stub"), F.col(c)).alias(c) for c in ("title", "description", "text")])
    out = one.join(real, "document_id", "left")
    return out.drop("text").join(document_texts(corpus), "document_id", "left") if full else out


def image_anchors(corpus: Corpus) -> DataFrame:
    """The first document and page of each image (null page first) and how many other documents show it."""
    return corpus.document_images.groupBy(F.col("image_id").alias("source_id")).agg(F.min(F.struct("document_id", "page_number")).alias("a"), (F.countDistinct("document_id") - 1).alias("others")).select("source_id", "a.document_id", "a.page_number", "others")


def chunk_names(corpus: Corpus, chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``source_name``: the file, ``summary of`` it, the finding's title, or the image's first place."""
    files = corpus.documents.select("document_id", "file_name")
    image = image_anchors(corpus).join(files, "document_id")
    label = F.concat(F.lit("image in "), "file_name", F.when(F.col("page_number").isNotNull(), F.concat(F.lit(", p."), F.col("page_number").cast("string"))).otherwise(""), F.when(F.col("others") > 0, F.concat(F.lit(" (+"), F.col("others").cast("string"), F.lit(" other docs)"))).otherwise(""))
    names = files.select(F.lit("document").alias("source_kind"), F.col("document_id").alias("source_id"), F.col("file_name").alias("source_name"))
    names = names.unionByName(corpus.summaries.join(files, "document_id").select(F.lit("summary").alias("source_kind"), F.col("summary_id").alias("source_id"), F.concat(F.lit("summary of "), "file_name").alias("source_name")))
    names = names.unionByName(corpus.findings.select(F.lit("finding").alias("source_kind"), F.col("finding_id").alias("source_id"), F.col("title").alias("source_name")))
    names = names.unionByName(image.select(F.lit("image").alias("source_kind"), "source_id", label.alias("source_name")))
    return chunks.join(names, ["source_kind", "source_id"], "left")


def chunk_locations(corpus: Corpus, chunks: DataFrame) -> DataFrame:
    """``(chunk_id, document_id, file_name, page, authored_date)`` of each chunk, by its kind; nulls for findings."""
    image = image_anchors(corpus)
    owner = corpus.documents.select(F.lit("document").alias("source_kind"), F.col("document_id").alias("source_id"), "document_id", F.lit(None).cast("int").alias("at_page"))
    owner = owner.unionByName(corpus.summaries.select(F.lit("summary").alias("source_kind"), F.col("summary_id").alias("source_id"), "document_id", F.lit(None).cast("int").alias("at_page")))
    owner = owner.unionByName(image.select(F.lit("image").alias("source_kind"), "source_id", "document_id", F.col("page_number").alias("at_page")))
    out = chunks.join(owner, ["source_kind", "source_id"], "left").join(corpus.documents.select("document_id", "file_name"), "document_id", "left").join(corpus.summaries.select("document_id", "authored_date"), "document_id", "left")
    return out.select("chunk_id", "document_id", "file_name", F.coalesce("page_number", "at_page").alias("page"), "authored_date")


def findings_list(corpus: Corpus, session_id: int | None = None) -> DataFrame:
    """Findings, newest first, with their session's name and number of citations; a session without memory sees its own."""
    counts = corpus.finding_citations.groupBy("finding_id").agg(F.count("*").alias("citation_count"))
    own = corpus.findings
    if not memory_enabled(corpus, session_id):
        own = own.where(F.col("session_id") == session_id)
    out = own.join(corpus.sessions.select("session_id", F.col("name").alias("session_name")), "session_id", "left").join(counts, "finding_id", "left")
    return out.select("finding_id", "session_name", "title", F.coalesce("citation_count", F.lit(0)).alias("citation_count")).orderBy(F.desc("finding_id"))


def tags_per_document(corpus: Corpus) -> DataFrame:
    """``(document_id, tags)``: names with values in one text, by name without regard to case."""
    named = corpus.document_tags.join(corpus.tags.select("tag_id", "name"), "tag_id")
    label = F.concat("name", F.when(F.col("value").isNotNull(), F.concat(F.lit("="), "value")).otherwise(""))
    return named.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), label.alias("label")))), lambda x: x["label"]), ", ").alias("tags"))


def audit_tail(corpus: Corpus, n: int) -> DataFrame:
    """The last ``n`` log rows, oldest of them first."""
    if n < 1:
        raise EngineError("USAGE_ERROR", "at least one row")
    return corpus.audit_logs.orderBy(F.desc("audit_log_id")).limit(n).orderBy("audit_log_id")
