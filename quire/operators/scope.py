"""Scopes: the documents that a request is about, as a frame of ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.functions import text as tx
from quire.sources.corpus import Corpus


@dataclass(frozen=True)
class Scope:
    """``ids`` (one column, document_id) is None where all documents are meant; ``excluded_null_dated`` counts what date bounds left out for want of a date."""

    ids: DataFrame | None
    excluded_null_dated: DataFrame
    echo: dict


def dated(corpus: Corpus) -> DataFrame:
    """``(document_id, authored_date)`` of all documents; null without a summary or without a date in it."""
    return corpus.documents.select("document_id").join(corpus.summaries.select("document_id", "authored_date"), "document_id", "left")


def resolve(corpus: Corpus, tags: list[str] | None = None, in_documents: list[int] | None = None, file_like: list[str] | None = None, date_from: str | None = None, date_to: str | None = None, include_nulls: bool = False) -> Scope:
    """Tag (any of) and id list and file name (any of) and inclusive date bounds, all of which must hold.

    Dates are compared as text, which their strict shape allows. Unknown tags and false dates are refused.
    """
    for bound in (date_from, date_to):
        if bound is not None and not tx.is_date(bound):
            raise EngineError("INVALID_DATE", f"{bound!r} is no date YYYY-MM-DD")
    echo = {k: v for k, v in {"tag": tags, "in_documents": in_documents, "file_like": file_like, "from": date_from, "to": date_to, "include_nulls": include_nulls or None}.items() if v}
    ids = corpus.documents.select("document_id")
    if tags:
        known = {r["name"]: r["tag_id"] for r in corpus.tags.where(F.col("name").isin(tags)).select("name", "tag_id").collect()}  # as many as named
        if missing := [t for t in tags if t not in known]:
            raise EngineError("TAG_NOT_FOUND", f"no tag {missing[0]!r}", tags=missing)
        ids = ids.join(corpus.document_tags.where(F.col("tag_id").isin(list(known.values()))), "document_id", "left_semi")
    if in_documents is not None:
        wanted = corpus.spark.createDataFrame([(i,) for i in dict.fromkeys(in_documents)], "document_id long")
        ids = ids.join(wanted, "document_id", "left_semi")
    if file_like:
        ids = ids.join(corpus.documents.where(tx.like_any(F.col("file_name"), file_like)), "document_id", "left_semi")
    nothing = corpus.spark.createDataFrame([(0,)], "excluded_null_dated long")
    if date_from or date_to:
        with_date = ids.join(dated(corpus), "document_id", "left")
        if not include_nulls:
            nothing = with_date.agg(F.count_if(F.col("authored_date").isNull()).alias("excluded_null_dated"))
        inside = F.lit(True)
        if date_from:
            inside = inside & (F.col("authored_date") >= date_from)
        if date_to:
            inside = inside & (F.col("authored_date") <= date_to)
        ids = with_date.where(F.coalesce(inside, F.lit(include_nulls))).select("document_id")
    elif not (tags or in_documents is not None or file_like):
        return Scope(None, nothing, echo)
    return Scope(ids, nothing, echo)


def within(corpus: Corpus, rows: DataFrame, scope: Scope, kinds: list[str]) -> DataFrame:
    """Rows (of chunks or postings, by source_kind and source_id) of the kinds that belong to the scope's documents: their own, their summaries' and their images'; findings fall away under any scope."""
    rows = rows.where(F.col("source_kind").isin(kinds))
    if scope.ids is None:
        return rows
    sources = [
        ("document", scope.ids.select(F.col("document_id").alias("source_id"))),
        ("summary", corpus.summaries.join(scope.ids, "document_id", "left_semi").select(F.col("summary_id").alias("source_id"))),
        ("image", corpus.document_images.join(scope.ids, "document_id", "left_semi").select(F.col("image_id").alias("source_id")).distinct()),
    ]
    wanted = None
    for kind, ids in sources:
        if kind in kinds:
            part = ids.withColumn("source_kind", F.lit(kind))
            wanted = part if wanted is None else wanted.unionByName(part)
    return rows.join(wanted, ["source_kind", "source_id"], "left_semi") if wanted is not None else rows.where("false")


def chunks_in(corpus: Corpus, scope: Scope, kinds: list[str]) -> DataFrame:
    return within(corpus, corpus.chunks, scope, kinds)


def memory_enabled(corpus: Corpus, session_id: int | None) -> bool:
    """Whether a session sees what others found; no session, or an unknown one, does."""
    if session_id is None:
        return True
    row = corpus.sessions.where(F.col("session_id") == session_id).select("memory_enabled").first()
    return row is None or bool(row["memory_enabled"])


def memory_wall(corpus: Corpus, chunks: DataFrame, session_id: int | None) -> DataFrame:
    """Chunks that a session may see: one without memory sees findings of its own only."""
    if memory_enabled(corpus, session_id):
        return chunks
    own = corpus.findings.where(F.col("session_id") == session_id).select(F.col("finding_id").alias("source_id"))
    return chunks.where("source_kind <> 'finding'").unionByName(chunks.where("source_kind = 'finding'").join(own, "source_id", "left_semi").select(chunks.columns))
