"""JSON envelopes of the named requests: rows of one page, totals, the scope's echo, and errors by code."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.functions import text as tx
from quire.operators import citations, profile, reads, scan, scope, search, tags
from quire.sources.corpus import Corpus

ID_COLUMNS = {"document_id": "document", "chunk_id": "chunk", "finding_id": "finding", "image_id": "image", "summary_id": "summary"}


def with_tagged_ids(df: DataFrame) -> DataFrame:
    """Numbers of things as ``kind:number``; ``source_id`` by its row's kind. The last projection of a page."""
    for c, kind in ID_COLUMNS.items():
        if c in df.columns:
            df = df.withColumn(c, tx.tagged(kind, F.col(c)))
    return df.withColumn("source_id", F.concat("source_kind", F.lit(":"), F.col("source_id").cast("string"))) if {"source_id", "source_kind"} <= set(df.columns) else df


def _tagged(row: dict) -> dict:
    return {("id" if k == "document_id" else k): f"document:{v}" if k == "document_id" else v for k, v in row.items()}


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in with_tagged_ids(df).toJSON().collect()]


def hint(offset: int, shown: int, total: int) -> str | None:
    return f"Showing {offset + 1}-{offset + shown} of {total}; ask for offset {offset + shown} for more." if offset + shown < total else None


def answer(request, *args, **kwargs) -> dict:
    """A request's result, or its error as an envelope; what nobody foresaw is INTERNAL_ERROR."""
    try:
        return request(*args, **kwargs)
    except EngineError as refused:
        return refused.envelope()
    except Exception as wrong:  # an envelope is owed whatever happens
        return EngineError("INTERNAL_ERROR", f"{type(wrong).__name__}: {wrong}").envelope()


#: Fields of a document by tier.
TIERS = {
    "brief": ["document_id", "file_name", "title"],
    "default": ["document_id", "file_name", "title", "description", "authored_date", "created_at", "has_summary", "image_count"],
    "verbose": ["document_id", "file_name", "title", "description", "authored_date", "created_at", "has_summary", "image_count", "page_count", "token_count", "chunk_count"],
}
#: Tokens of a document that is read whole without force.
MOST_TOKENS = 100_000


def list_documents_request(corpus: Corpus, tier: str = "default", sort: str = "id", limit: int = 50, offset: int = 0, returning: list[str] | None = None, **scope_args) -> dict:
    """A page of documents in a tier's (or the named) fields, with the values of value tags in the filter."""
    fields = scan.returning_fields(returning, [*TIERS["verbose"], "tag_values"]) if returning else TIERS[tier]
    valued_asked = "tag_values" in fields if returning else tier != "brief"
    plain = [f for f in fields if f != "tag_values"]
    where = scope.resolve(corpus, **scope_args)
    shown = profile.list_documents(corpus, where, sort, limit, offset).select(*dict.fromkeys(["document_id", *plain])).collect()  # one page
    rows = [{k: r[k] if k in plain else None for k in fields} for r in shown]
    if scope_args.get("tags") and valued_asked:
        chips = profile.value_chips(corpus, scope_args["tags"]).where(F.col("document_id").isin([r["document_id"] for r in shown])).collect()
        valued = [r["name"] for r in corpus.tags.where(F.col("name").isin(scope_args["tags"]) & F.col("value_type").isNotNull()).orderBy("name").collect()]
        held = {(c["document_id"], c["name"]): {"value": c["value"], "chunk_id": c["chunk_id"] and f"chunk:{c['chunk_id']}"} for c in chips}
        if valued:
            for r, row in zip(shown, rows):
                row["tag_values"] = {n: held.get((r["document_id"], n), {"value": None, "chunk_id": None}) for n in valued}
    total = (corpus.documents if where.ids is None else where.ids).count()
    out = {"documents": [_tagged(r) for r in rows], "total": total, "offset": offset, "limit": limit, "filters": where.echo}
    if said := hint(offset, len(rows), total):
        out["hint"] = said
    return out


def describe_request(corpus: Corpus, **scope_args) -> dict:
    """The profile of a slice: totals, dates, years, content, lengths, tags, coverage, largest documents."""
    where = scope.resolve(corpus, **scope_args)
    one = lambda f: f(corpus, where).first().asDict()
    many = lambda f: _rows(f(corpus, where))
    return {
        "totals": one(profile.totals), "dates": one(profile.date_range), "by_year": many(profile.documents_by_year), "content": many(profile.content_mix), "chunk_length": one(profile.chunk_length),
        "tags": many(profile.tag_facet), "summaries": one(profile.summary_coverage), "largest": many(profile.largest), "filters": where.echo,
    }


def read_document_request(corpus: Corpus, document_id: int, summary: bool = False, full: bool = False, force: bool = False, most_tokens: int = MOST_TOKENS) -> dict:
    """A document's summary and whole text; one of them if only that is asked for. A large text needs ``force``."""
    want_full = full or not summary
    row = reads.read_document(corpus, document_id, full=want_full, max_tokens=None if force else most_tokens).first()
    about = corpus.documents.where(F.col("document_id") == document_id).select("file_name", "token_count").first()
    told = corpus.summaries.where((F.col("document_id") == document_id) & (F.col("model") != "backfill")).select("text").first()
    document = {"id": f"document:{document_id}", "file_name": about["file_name"], "token_count": about["token_count"], "authored_date": row["authored_date"]}
    return {"document": document, "summary": told["text"] if told and (summary or not full) else None, "full_text": row["text"] if want_full else None}


#: Fields of a chunk.
CHUNK_FIELDS = ["chunk_id", "chunk_index", "section_heading", "page_number", "content_type", "text", "text_length"]


def _chunk_rows(df: DataFrame, preview: int | None, order: str = "chunk_index") -> list[dict]:
    sized = df.withColumn("text_length", F.length("text"))
    if preview:
        sized = sized.withColumn("text", tx.preview(F.col("text"), preview))
    return _rows(sized.orderBy(order).select(*CHUNK_FIELDS))


def read_chunks_request(corpus: Corpus, document_id: int | None = None, chunks: list[str] | None = None, around: int | None = None, window: int = 3, limit: int = 50, offset: int = 0, preview: int | None = None, session_id: int | None = None) -> dict:
    """Chunks of a document, by id, or around one; what a session without memory may not see is missing, or refused as the centre of a window."""
    if sum(x is not None for x in (document_id, chunks, around)) != 1:
        raise EngineError("USAGE_ERROR", "ask for a document, for chunks or for a place")
    own = F.col("chunk_id")
    if document_id is not None:
        if not corpus.documents.where(F.col("document_id") == document_id).limit(1).count():
            extra = {"hint": f"chunk:{document_id} is a chunk"} if corpus.chunks.where(own == document_id).limit(1).count() else {}
            raise EngineError("DOCUMENT_NOT_FOUND", f"no document {document_id}", **extra)
        total = corpus.chunks.where((F.col("source_kind") == "document") & (F.col("source_id") == document_id)).count()
        return {"document_id": f"document:{document_id}", "total": total, "offset": offset, "chunks": _chunk_rows(reads.by_document(corpus, document_id, limit, offset), preview)}
    if chunks is not None:
        found = reads.by_ids(corpus, tx.parse_ids(chunks, "chunk"), session_id).cache()
        try:
            missing = [r["chunk_id"] for r in found.where("not found").orderBy("position").collect()]
            out = {"chunks": _chunk_rows(reads.chunk_names(corpus, found.where("found")), preview, "position"), "missing": [f"chunk:{i}" for i in missing]}
        finally:
            found.unpersist()
        if missing and (also := [r[0] for r in corpus.documents.where(F.col("document_id").isin(missing)).select("document_id").collect()]):
            out["hint"] = "these are documents: " + ", ".join(f"document:{i}" for i in sorted(also))
        return out
    row = corpus.chunks.where(own == around).select("source_kind", "source_id").first()
    if row is None:
        raise EngineError("CHUNK_NOT_FOUND", f"no chunk {around}")
    if row["source_kind"] == "finding":
        _may_read(corpus, row["source_id"], session_id)
    near = reads.around(corpus, around, window).select("chunk_id")
    return {"around": f"chunk:{around}", "chunks": _chunk_rows(corpus.chunks.join(near, "chunk_id", "left_semi"), preview)}


def _may_read(corpus: Corpus, finding_id: int, session_id: int | None) -> None:
    foreign = corpus.findings.where((F.col("finding_id") == finding_id) & ~F.col("session_id").eqNullSafe(F.lit(session_id).cast("long")))
    if not scope.memory_enabled(corpus, session_id) and foreign.limit(1).count():
        raise EngineError("MEMORY_OFF", "a session without memory reads its own findings only", foreign_finding_ids=[f"finding:{finding_id}"])


def list_findings_request(corpus: Corpus, session_id: int | None = None, limit: int = 50, offset: int = 0) -> dict:
    found = reads.findings_list(corpus, session_id)
    return {"findings": _rows(found.offset(offset).limit(limit)), "total": found.count()}


def read_finding_request(corpus: Corpus, finding_id: int, session_id: int | None = None) -> dict:
    """A finding with the places it cites, outside references, and markers whose targets are gone."""
    own = corpus.findings.where(F.col("finding_id") == finding_id)
    row = own.first()
    if row is None:
        raise EngineError("FINDING_NOT_FOUND", f"no finding {finding_id}")
    _may_read(corpus, finding_id, session_id)
    cited = citations.edges(own).join(corpus.chunks.select("chunk_id", "source_kind", "source_id"), "chunk_id")
    linked = citations.finding_links(own).join(corpus.findings.select(F.col("finding_id").alias("linked_id")), "linked_id", "left_anti")
    return {
        "finding_id": f"finding:{finding_id}", "session_id": row["session_id"], "title": row["title"], "description": row["description"], "body": row["body"],
        "citations": _rows(reads.chunk_names(corpus, cited).orderBy("position").select("chunk_id", "source_kind", "source_id", "source_name")),
        "external_citations": _rows(citations.external(own).orderBy("position").select("scheme", "ref")),
        "dangling_citations": [f"chunk:{r[0]}" for r in citations.edges(own).join(corpus.chunks, "chunk_id", "left_anti").orderBy("position").select("chunk_id").collect()],
        "dangling_finding_links": [f"finding:{r[0]}" for r in linked.orderBy("position").select("linked_id").collect()],
    }


def extract_request(corpus: Corpus, tag: str, chunks: list[str]) -> dict:
    """What a value tag finds in the named chunks: values to store, conflicts, captures that are no value, chunks without one or that are none."""
    row = tags.named(corpus.tags, tag)
    if row["value_type"] is None:
        raise EngineError("NOT_A_VALUE_TAG", f"tag {tag!r} takes no values")
    ids = tx.parse_ids(chunks, "chunk")
    own = corpus.chunks.where(F.col("chunk_id").isin(ids) & (F.col("source_kind") == "document"))
    found = tags.extract_values(own.select(F.col("source_id").alias("document_id"), "chunk_id", "chunk_index", "text"), row["pattern"], row["value_type"])
    known = {r[0] for r in own.select("chunk_id").collect()}  # as many as named
    return {k: _rows(v) for k, v in found.items()} | {"missing": [f"chunk:{i}" for i in ids if i not in known]}


def tags_request(corpus: Corpus) -> dict:
    counts = tags.doc_counts(corpus.tags, corpus.document_tags)
    return {"tags": _rows(counts.join(corpus.tags.select("tag_id", "description"), "tag_id").orderBy(F.lower("name")))}


def capture_request(corpus: Corpus, query: str, pattern: str, deadline: float = scan.DEADLINE, cap: int | None = scan.MATCH_CAP, **scope_args) -> dict:
    """The histogram of a pattern's first group over matching chunks, within a deadline."""
    where = scope.resolve(corpus, **scope_args)
    report = scan.count_by_regex(corpus, query, pattern, where, cap)
    rows = scan.within_seconds(corpus.spark, deadline, lambda: _rows(report))
    return {"counts": [{"value": r["value"], "n": r["n"]} for r in rows], "truncated": any(r["truncated"] for r in rows), "filters": where.echo}


def scan_request(corpus: Corpus, query: str, sort: str = "document", limit: int = 50, offset: int = 0, mode: str = "phrase", heading_like: list[str] | None = None, body_matches: str | None = None, brief: bool = False, returning: list[str] | None = None, **scope_args) -> dict:
    if brief and returning:
        raise EngineError("RETURNING_NOT_APPLICABLE", "a brief answer has fields of its own")
    fields = scan.returning_fields(returning, scan.ALL) if returning else scan.BRIEF if brief else scan.ALL
    where = scope.resolve(corpus, **scope_args)
    filters = {"mode": mode, "heading_like": heading_like, "body_matches": body_matches}
    found = scan.matches(corpus, query, where, **filters).cache()
    try:
        total = found.count()
        shown = scan.page(scan.ordered(found, sort), limit, offset).withColumn("text", tx.preview(F.col("text"), tx.PREVIEW_CHARS)).select(*fields)
        out = {"total": total, "results": _rows(shown), "filters": where.echo, "excluded_null_dated": where.excluded_null_dated.first()[0]}
    finally:
        found.unpersist()
    if not total:
        out["diagnosis"] = scan.diagnosis(corpus, query, where, **filters).first().asDict()
    if said := hint(offset, len(out["results"]), total):
        out["hint"] = said
    return out


def search_request(corpus: Corpus, query: str, vector: list[float] | None = None, limit: int = 20, brief: bool = False, kinds: list[str] | None = None, modes: list[str] | None = None, embed=None, session_id: int | None = None, **scope_args) -> dict:
    where = scope.resolve(corpus, **scope_args)
    hits = search.search(corpus, query, where, vector, kinds, max(1, min(limit, 500)), brief, modes, embed, session_id)
    walled = "finding" in (kinds or []) and not scope.memory_enabled(corpus, session_id)
    return {"results": _rows(hits), "filters": where.echo, "memory_excluded": walled}


#: Requests by name, as the command line knows them.
REQUESTS = {
    "scan": scan_request, "search": search_request, "capture": capture_request, "list_documents": list_documents_request, "describe": describe_request, "read_document": read_document_request,
    "read_chunks": read_chunks_request, "list_findings": list_findings_request, "read_finding": read_finding_request, "extract": extract_request, "tags": tags_request,
}
