"""Exhaustive scans of document chunks: rows, histograms, captures, and why nothing was found."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.functions import regexes
from quire.functions import text as tx
from quire.operators import fts, grams
from quire.operators.scope import Scope, dated, within
from quire.sources.corpus import Corpus

#: Matches that a report counts, and seconds that a request with a pattern may take, unless told otherwise.
MATCH_CAP, DEADLINE = 100_000, 5.0
BRIEF = ["document_id", "file_name", "chunk_id", "page_number", "authored_date"]
ALL = ["document_id", "chunk_id", "chunk_index", "file_name", "authored_date", "page_number", "section_heading", "text", "text_length"]


def _phrases(query: str, mode: str) -> list[list[str]]:
    if not query.strip():
        raise EngineError("EMPTY_QUERY", "the query is empty")
    return fts.scan_phrases(query, mode)


def matches(corpus: Corpus, query: str, scope: Scope, mode: str = "phrase", heading_like: list[str] | None = None, body_matches: str | None = None) -> DataFrame:
    """Document chunks whose body holds the query, with their file name and date.

    The index names the chunks, the scope thins them, and only those are read.
    """
    found = within(corpus, fts.holding(corpus.index()[0], _phrases(query, mode)), scope, ["document"])
    if body_matches and corpus.has("grams") and (plan := grams.plan_of(regexes.unslash(body_matches, "INVALID_FILTER_REGEX"))) is not None:
        found = found.join(grams.candidates(corpus.grams, plan), "chunk_id", "left_semi")
    hit = corpus.chunks.where("source_kind = 'document'").join(found.select("chunk_id"), "chunk_id", "left_semi")
    hit = hit.where(_passes(heading_like, body_matches))
    named = hit.withColumnRenamed("source_id", "document_id").join(corpus.documents.select("document_id", "file_name"), "document_id")
    return named.join(corpus.summaries.select("document_id", "authored_date"), "document_id", "left").withColumn("text_length", F.length("text"))


def _passes(heading_like: list[str] | None, body_matches: str | None) -> Column:
    out = tx.like_any(F.col("section_heading"), heading_like) if heading_like else F.lit(True)
    if body_matches:
        out = out & F.col("text").rlike(regexes.java(regexes.unslash(body_matches, "INVALID_FILTER_REGEX")))
    return out


def body_candidates(corpus: Corpus, pattern: str, scope: Scope) -> tuple[DataFrame, bool]:
    """Document chunks within scope that may match ``/pattern/``, and whether the trigram index has named them (else they are all of the scope's)."""
    plan = grams.plan_of(regexes.unslash(pattern, "INVALID_FILTER_REGEX")) if corpus.has("grams") else None
    own = corpus.chunks.where("source_kind = 'document'")
    if plan is None:
        return within(corpus, own, scope, ["document"]), False
    named = grams.candidates(corpus.grams.where("source_kind = 'document'"), plan)
    return within(corpus, own.join(named, "chunk_id", "left_semi"), scope, ["document"]), True


def body_scan(corpus: Corpus, pattern: str, scope: Scope) -> DataFrame:
    """``(document_id, chunk_id, chunk_index, value)`` of document chunks whose body matches ``/pattern/``: no words are asked for, the whole first match is the value."""
    rx = regexes.java(regexes.unslash(pattern, "INVALID_FILTER_REGEX"))
    hit = body_candidates(corpus, pattern, scope)[0].where(F.col("text").rlike(rx))
    return hit.select(F.col("source_id").alias("document_id"), "chunk_id", "chunk_index", F.regexp_extract("text", rx, 0).alias("value"))


def body_report(corpus: Corpus, pattern: str, scope: Scope) -> DataFrame:
    """One row: document chunks within scope, candidates among them, and how many match."""
    rx = regexes.java(regexes.unslash(pattern, "INVALID_FILTER_REGEX"))
    every = within(corpus, corpus.chunks.where("source_kind = 'document'"), scope, ["document"]).agg(F.count("*").alias("chunks"))
    maybe, _ = body_candidates(corpus, pattern, scope)
    return every.join(F.broadcast(maybe.agg(F.count("*").alias("candidates"), F.count_if(F.col("text").rlike(rx)).alias("matched"))))  # a row each


def ordered(df: DataFrame, sort: str = "document") -> DataFrame:
    """By document and place, or oldest first with undated ones last."""
    place = ["document_id", "chunk_index"]
    return df.orderBy(F.asc_nulls_last("authored_date"), *place) if sort == "date" else df.orderBy(*place)


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(limit)


def rows(corpus: Corpus, query: str, scope: Scope, sort: str = "document", limit: int = 50, offset: int = 0, preview: int | None = tx.PREVIEW_CHARS, returning: list[str] | None = None, **filters) -> DataFrame:
    """One page of matching chunks, text as a preview."""
    fields = returning_fields(returning, ALL) if returning else ALL
    found = page(ordered(matches(corpus, query, scope, **filters), sort), limit, offset)
    if preview:
        found = found.withColumn("text", tx.preview(F.col("text"), preview))
    return found.select(*fields)


def returning_fields(asked: list[str], known: list[str]) -> list[str]:
    out = list(dict.fromkeys(asked))
    if unknown := [f for f in out if f not in known]:
        raise EngineError("UNKNOWN_RETURNING_FIELD", f"no field {unknown[0]!r}", known=known)
    return out


def total(corpus: Corpus, query: str, scope: Scope, **filters) -> DataFrame:
    return matches(corpus, query, scope, **filters).agg(F.count("*").alias("total"), F.countDistinct("document_id").alias("documents"))


def within_seconds(spark, seconds: float, fetch):
    """``fetch()`` (a function that runs jobs), which is cancelled and refused as CAPTURE_TIMEOUT after so many seconds.

    Patterns of users may be slow on a large corpus; the jobs of this call are a group of their own, so no others are stopped.
    """
    sc, tag = spark.sparkContext, f"deadline-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    sc.addJobTag(tag)
    timer.start()
    try:
        return fetch()
    except Exception as wrong:
        if late.is_set():
            raise EngineError("CAPTURE_TIMEOUT", f"the pattern took more than {seconds:g} s; narrow the scope or simplify it") from wrong
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def count_by_document(corpus: Corpus, query: str, scope: Scope, sort: str = "n", **filters) -> DataFrame:
    """Matches by document: most first, or oldest document first with undated ones last."""
    if sort == "date":
        counts = matches(corpus, query, scope, **filters).groupBy("document_id", "file_name", "authored_date").agg(F.count("*").alias("n"), F.min("chunk_id").alias("chunk_id"))
        return counts.orderBy(F.asc_nulls_last("authored_date"), "document_id")
    return matches(corpus, query, scope, **filters).groupBy("document_id", "file_name").agg(F.count("*").alias("n"), F.min("chunk_id").alias("chunk_id")).orderBy(F.desc("n"), "document_id")


def count_by_regex(corpus: Corpus, query: str, pattern: str, scope: Scope, cap: int | None = MATCH_CAP, **filters) -> DataFrame:
    """Histogram of the first group over every match in matching chunks.

    The report counts the first ``cap`` matches in document order and ``truncated`` says that there were so many;
    with ``cap=None`` it counts all of them. A group that took no part in a match counts for nothing, an empty one counts.
    """
    rx = regexes.unslash(pattern)
    regexes.group_names(rx)
    found = matches(corpus, query, scope, **filters).select("document_id", "chunk_index", F.posexplode(regexes.matches(F.col("text"), rx)).alias("pos", "value"))
    first = found if cap is None else found.orderBy("document_id", "chunk_index", "pos").limit(cap)
    out = first.groupBy("value").agg(F.count("*").alias("n"))
    # the histogram itself tells how many matches there were: its rows sum up to them
    reached = F.lit(False) if cap is None else F.sum("n").over(W.partitionBy(F.lit(1))) >= cap
    return out.withColumn("truncated", reached).orderBy(F.desc("n"), "value")


def count_by_file_name(corpus: Corpus, pattern: str) -> DataFrame:
    """Histogram of a capture in file names over the whole corpus, one per document."""
    field, _, rx = pattern.partition(":")
    if field != "file_name":
        raise EngineError("INVALID_COUNT_BY_FIELD", f"cannot count by {field!r}", known=["file_name"])
    rx = regexes.unslash(rx)
    regexes.group_names(rx)
    return corpus.documents.select(regexes.first(F.col("file_name"), rx).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def extract(corpus: Corpus, query: str, patterns: list[str], scope: Scope, limit: int | None = None, offset: int = 0, **filters) -> DataFrame:
    """A row for each matching chunk with a column for each group: its first match, or null."""
    cols = regexes.columns([regexes.unslash(p) for p in patterns], {"document_id", "chunk_id", "chunk_index", "file_name"})
    found = ordered(matches(corpus, query, scope, **filters))
    out = found.select("document_id", "chunk_id", "chunk_index", "file_name", *[regexes.first(F.col("text"), p, g).alias(c) for c, p, g in cols])
    return page(out, limit, offset) if limit else out


def diagnosis(corpus: Corpus, query: str, scope: Scope, mode: str = "phrase", heading_like: list[str] | None = None, body_matches: str | None = None) -> DataFrame:
    """Why a scan found nothing: counts with filters, in scope, anywhere, in headings; and the verdict."""
    phrases, index = _phrases(query, mode), corpus.index()[0].where("source_kind = 'document'")
    base = corpus.chunks.where("source_kind = 'document'").join(fts.holding(index, phrases).select("chunk_id"), "chunk_id", "left_semi")
    if scope.ids is not None:
        base = base.join(scope.ids.select(F.col("document_id").alias("source_id"), F.lit(True).alias("in_scope")), "source_id", "left")
    else:
        base = base.withColumn("in_scope", F.lit(True))
    inside = F.coalesce("in_scope", F.lit(False))
    counts = base.agg(F.count_if(inside & _passes(heading_like, body_matches)).alias("matched"), F.count_if(inside).alias("in_scope"), F.count("*").alias("anywhere"))
    counts = counts.join(F.broadcast(fts.holding(index, phrases, in_heading=True).agg(F.count("*").alias("in_headings"))))  # a row each
    verdict = F.when(F.col("matched") > 0, "found").when(F.col("in_scope") > 0, "filtered_out").when(F.col("anywhere") > 0, "out_of_scope").when(F.col("in_headings") > 0, "heading_only").otherwise("absent")
    return counts.withColumn("verdict", verdict)


__all__ = ["count_by_document", "count_by_file_name", "count_by_regex", "dated", "diagnosis", "extract", "matches", "ordered", "page", "rows", "total"]
