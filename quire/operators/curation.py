"""Changes as pure transforms: summaries, dates, findings, sessions, ledgers. Each gives the table that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.functions import text as tx
from quire.operators import citations, models
from quire.sources.corpus import Corpus, chunk_id
from quire.sources.store import Change

FAILURE_CAP = 3
#: Unknown targets that a refusal names.
NAMED = 50
SECRET_PARTS = ("key", "token", "secret", "password")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old, keys, "left_anti"), allowMissingColumns=True)


def save_summaries(summaries: DataFrame, new: DataFrame) -> DataFrame:
    """New summaries replace a document's old one; where they have no date, the old date stays."""
    prior = summaries.select("document_id", F.col("authored_date").alias("prior"))
    carried = new.join(prior, "document_id", "left").withColumn("authored_date", F.coalesce("authored_date", "prior")).drop("prior")
    return upsert(summaries, carried.select([c for c in summaries.columns if c in carried.columns]), ["document_id"])


def save_date(summaries: DataFrame, document_id: int, date: str | None) -> DataFrame:
    if date is not None and not tx.is_date(date):
        raise EngineError("INVALID_DATE", f"{date!r} is no date YYYY-MM-DD")
    if not summaries.where(F.col("document_id") == document_id).limit(1).count():
        raise EngineError("NO_SUMMARY", f"document {document_id} has no summary")
    return summaries.withColumn("authored_date", F.when(F.col("document_id") == document_id, F.lit(date)).otherwise(F.col("authored_date")))


def file_date(pattern: str, x: Column | None = None) -> Column:
    from quire.functions import regexes

    names = regexes.group_names(pattern)
    return regexes.first(F.col("file_name") if x is None else x, pattern, names.index("date") + 1 if "date" in names else 1)


def backfill_dates(corpus: Corpus, pattern: str, overwrite: bool = False, subject: str = "file_name") -> DataFrame:
    """What dates in file names (or paths) would do: ``(document_id, raw, date, outcome)``.

    ``outcome``: unmatched, invalid, insert (a stub summary), update, keep.
    """
    found = corpus.documents.select("document_id", file_date(pattern, F.col(subject)).alias("raw")).withColumn("date", tx.authored_date(F.col("raw")))
    have = corpus.summaries.select("document_id", "authored_date", F.lit(True).alias("has"))
    outcome = F.when(F.col("raw").isNull(), "unmatched").when(F.col("date").isNull(), "invalid").when(F.col("has").isNull(), "insert").when(F.col("authored_date").isNull() | F.lit(overwrite), "update").otherwise("keep")
    return found.join(have, "document_id", "left").select("document_id", "raw", "date", outcome.alias("outcome"))


def backfill_counts(plan: DataFrame) -> DataFrame:
    """One row: matched, unmatched, invalid, inserted, updated."""
    is_ = lambda *o: F.count_if(F.col("outcome").isin(*o))
    return plan.agg(is_("invalid", "insert", "update", "keep").alias("matched"), is_("unmatched").alias("unmatched"), is_("invalid").alias("invalid"), is_("insert").alias("inserted"), is_("update").alias("updated"))


def apply_backfill(summaries: DataFrame, plan: DataFrame) -> DataFrame:
    """The summaries after a plan: dates updated, and stubs (empty texts, so no chunks) for documents that had none.

    A stub's number follows from its document's, above all numbers in use.
    """
    new = plan.where("outcome = 'update'").select("document_id", F.col("date").alias("new_date"))
    dated = summaries.join(new, "document_id", "left").withColumn("authored_date", F.coalesce("new_date", "authored_date")).select(summaries.columns)
    top = summaries.agg(F.coalesce(F.max("summary_id"), F.lit(0)).alias("top"))
    stubs = plan.where("outcome = 'insert'").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("document_id") + 1).alias("summary_id"), "document_id", *[F.lit("").alias(c) for c in ("title", "description", "text")], F.lit("backfill").alias("model"), F.col("date").alias("authored_date"))  # the top is one row
    return dated.unionByName(stubs, allowMissingColumns=True)


def probe_dates(corpus: Corpus, pattern: str, examples: int = 5, field: str = "file_name", sample: int | None = None) -> DataFrame:
    """How well a pattern finds dates in file names or bodies: one row of counts, rate, examples and whether to suggest it.

    A body is its document's chunks in order, parted by blanks. ``sample`` documents, the first by id, are probed (all by
    default); a probe of bodies never suggests a backfill, which reads names only.
    """
    if field == "body":
        body = corpus.chunks.where("source_kind = 'document'").groupBy(F.col("source_id").alias("document_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), " ").alias("subject"))
        probed = corpus.documents.select("document_id", "file_name").join(body, "document_id")
    elif field == "file_name":
        probed = corpus.documents.select("document_id", "file_name", F.col("file_name").alias("subject"))
    else:
        raise EngineError("USAGE_ERROR", f"cannot probe {field!r}", known=["file_name", "body"])
    if sample is not None:
        probed = probed.orderBy("document_id").limit(sample)
    found = probed.withColumn("raw", file_date(pattern, F.col("subject"))).withColumn("date", tx.authored_date(F.col("raw"))).withColumn("hit", F.col("raw").isNotNull())
    # the first few of each kind by id
    few = found.where("hit").orderBy("document_id").limit(examples).unionByName(found.where("not hit").orderBy("document_id").limit(examples))
    shown = lambda cond, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("document_id", what.alias("x"))))), lambda x: x["x"]), "|")
    few = few.agg(shown(F.col("hit"), F.col("raw")).alias("matched_examples"), shown(~F.col("hit"), F.col("file_name")).alias("unmatched_examples"))
    counts = found.agg(F.count("*").alias("population"), F.count("raw").alias("matched"), F.count("date").alias("normalized_ok"))
    rate = F.when(F.col("population") > 0, F.bround(F.col("matched") / F.col("population"), 4)).otherwise(0.0)
    out = counts.withColumn("invalid", F.col("matched") - F.col("normalized_ok")).withColumn("match_rate", rate)
    return out.withColumn("suggest", (F.col("match_rate") >= 0.9) & F.lit(field == "file_name")).crossJoin(few)  # a row each


def save_finding(corpus: Corpus, finding: DataFrame, embed: str | None = None) -> Corpus:
    """The corpus with findings (finding_id, session_id, title, description, body), their chunks and citation edges; faulty bodies are refused."""
    return finding_saved(corpus, finding, embed).applied(corpus)


def finding_saved(corpus: Corpus, finding: DataFrame, embed: str | None = None) -> Change:
    """What saving findings adds: with ``embed``, the name of a registered model, vectors of their chunks too."""
    if bad := citations.errors(finding).limit(1).collect():
        raise EngineError(bad[0]["code"], f"finding {bad[0]['finding_id']}")
    lost = citations.dangling(finding, corpus.chunks).where("kind = 'chunk'").select("target_id").distinct().orderBy("target_id").limit(NAMED).collect()
    if lost:
        raise EngineError("UNKNOWN_CITATIONS", f"no chunk {lost[0]['target_id']}", unknown_chunk_ids=[r["target_id"] for r in lost])
    known = corpus.findings.select(F.col("finding_id").alias("linked_id")).unionByName(finding.select(F.col("finding_id").alias("linked_id")))
    gone = citations.finding_links(finding).join(known, "linked_id", "left_anti").select("linked_id").distinct().orderBy("linked_id").limit(NAMED).collect()
    if gone:
        raise EngineError("UNKNOWN_FINDING_LINKS", f"no finding {gone[0]['linked_id']}", unknown_finding_ids=[r["linked_id"] for r in gone])
    pieces = finding.select("finding_id", F.inline(tx.chunk_pieces(F.col("body"))))
    chunks = pieces.select(chunk_id("finding", F.col("finding_id"), F.col("chunk_index")).alias("chunk_id"), F.lit("finding").alias("source_kind"), F.col("finding_id").alias("source_id"), F.col("chunk_index").cast("int").alias("chunk_index"), "text")
    added = {"findings": finding, "chunks": chunks, "finding_citations": citations.edges(finding).select("finding_id", "chunk_id")}
    return Change(added | _vectors(chunks, embed))


def _vectors(chunks: DataFrame, embed: str | None) -> dict[str, DataFrame]:
    return {"embeddings": models.embed(chunks.select("chunk_id", "text"), embed, "chunk_id")} if embed else {}


def delete_findings(corpus: Corpus, ids: DataFrame) -> Corpus:
    """Without these findings, their chunks and vectors, and citations from or to them."""
    return findings_deleted(corpus, ids).applied(corpus)


def findings_deleted(corpus: Corpus, ids: DataFrame) -> Change:
    gone = _chunks_of(corpus, "finding", ids.select("finding_id"))
    own, to = (corpus.finding_citations.join(x, k, "left_semi").select("finding_id", "chunk_id") for x, k in ((ids, "finding_id"), (gone, "chunk_id")))
    return Change(removed={"findings": ids.select("finding_id"), "chunks": gone, "embeddings": gone, "finding_citations": own.unionByName(to)})


def _chunks_of(corpus: Corpus, kind: str, ids: DataFrame) -> DataFrame:
    """``(chunk_id)`` of the chunks of some sources (one column) of a kind."""
    return corpus.chunks.where(F.col("source_kind") == kind).join(ids.toDF("source_id"), "source_id", "left_semi").select("chunk_id")


def delete_counts(corpus: Corpus, ids: DataFrame) -> DataFrame:
    """One row: what deleting these findings takes with it (findings, chunks, citations from them and to them)."""
    gone = corpus.chunks.where("source_kind = 'finding'").join(ids.select(F.col("finding_id").alias("source_id")), "source_id", "left_semi").select("chunk_id")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(corpus.findings.join(ids, "finding_id", "left_semi"), "findings").crossJoin(count(gone, "chunks"))
    out = out.crossJoin(count(corpus.finding_citations.join(ids, "finding_id", "left_semi"), "citations"))
    return out.crossJoin(count(corpus.finding_citations.join(ids, "finding_id", "left_anti").join(gone, "chunk_id", "left_semi"), "incoming_citations"))  # a row each


def edit_finding(corpus: Corpus, finding: DataFrame, embed: str | None = None) -> Corpus:
    """The finding's new body in place of the old; it must not cite itself."""
    return finding_edited(corpus, finding, embed).applied(corpus)


def finding_edited(corpus: Corpus, finding: DataFrame, embed: str | None = None) -> Change:
    if citations.cites_own(finding, corpus.chunks).limit(1).count():
        raise EngineError("CITES_OWN_CHUNKS", "a finding cannot cite its own chunks")
    return _in_place(corpus, findings_deleted(corpus, finding.select("finding_id")), finding, embed)


def _in_place(corpus: Corpus, gone: Change, finding: DataFrame, embed: str | None) -> Change:
    """A finding in place of others; what it cites is looked for in the corpus without them."""
    return Change(finding_saved(gone.applied(corpus), finding, embed).added, gone.removed)


def merge_findings(corpus: Corpus, into: DataFrame, sources: list[int], embed: str | None = None) -> Corpus:
    """One finding in place of itself and others."""
    return findings_merged(corpus, into, sources, embed).applied(corpus)


def findings_merged(corpus: Corpus, into: DataFrame, sources: list[int], embed: str | None = None) -> Change:
    target = into.select("finding_id").first()["finding_id"]
    if target in sources:
        raise EngineError("TARGET_IN_SOURCES", "the target is among the sources")
    ids = corpus.spark.createDataFrame([(i,) for i in [*sources, target]], "finding_id long")
    if citations.edges(into).join(_chunks_of(corpus, "finding", ids), "chunk_id", "left_semi").limit(1).count():
        raise EngineError("CITES_MERGED_CHUNKS", "the merged body cites chunks that go")
    return _in_place(corpus, findings_deleted(corpus, ids), into, embed)


def delete_chunks_for(chunks: DataFrame, kind: str, ids: DataFrame) -> DataFrame:
    """Without the chunks of some sources of a kind; the token index is derived, so nothing else is to be rebuilt."""
    return chunks.join(ids.select(F.lit(kind).alias("source_kind"), F.col("source_id")), ["source_kind", "source_id"], "left_anti")


def start_session(sessions: DataFrame, row: DataFrame) -> DataFrame:
    """Get or create: a row whose run_key (or, without one, name) is known changes nothing."""
    keyed = row.where("run_key is not null").join(sessions, "run_key", "left_anti")
    named = row.where("run_key is null").join(sessions, "name", "left_anti")
    return sessions.unionByName(keyed, allowMissingColumns=True).unionByName(named, allowMissingColumns=True)


def set_provenance(sessions: DataFrame, session_id: int, model: str | None = None, harness: str | None = None) -> DataFrame:
    """What a session says of its model and harness; what is not given stays."""
    own = F.col("session_id") == session_id
    for name, said in (("model", model), ("harness", harness)):
        sessions = sessions.withColumn(name, F.when(own, F.coalesce(F.lit(said).cast("string"), F.col(name))).otherwise(F.col(name)))
    return sessions


def log_call(audit_logs: DataFrame, session_id: int, tool: str, args: dict, ms: int, error: str | None = None) -> DataFrame:
    """The audit log with one more call; a refused call is logged with its code."""
    import json

    top = audit_logs.agg((F.coalesce(F.max("audit_log_id"), F.lit(0)) + 1).alias("audit_log_id"))
    said = json.dumps({k: v for k, v in args.items() if v is not None}, sort_keys=True, default=str)
    row = top.select("audit_log_id", F.lit(session_id).cast("long").alias("session_id"), F.lit(tool).alias("tool_name"), F.lit(said).alias("args_json"), F.lit(f"error: {error}" if error else None).cast("string").alias("result_summary"), F.lit(ms).cast("long").alias("duration_ms"), F.current_timestamp().alias("created_at"))
    return audit_logs.unionByName(row, allowMissingColumns=True)


def end_session(sessions: DataFrame, session_id: int, at: str) -> DataFrame:
    return sessions.withColumn("ended_at", F.when(F.col("session_id") == session_id, F.coalesce("ended_at", F.lit(at).cast("timestamp"))).otherwise(F.col("ended_at")))


def record_failures(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The failure ledger after new failures (file_hash, stage, error, last_attempt): attempts add up, the latest error stays."""
    both = ledger.select("file_hash", "stage", "error", "attempts", "last_attempt").unionByName(new.withColumn("attempts", F.lit(1)).select("file_hash", "stage", "error", "attempts", "last_attempt"))
    return both.groupBy("file_hash", "stage").agg(F.max_by("error", "last_attempt").alias("error"), F.sum("attempts").cast("int").alias("attempts"), F.max("last_attempt").alias("last_attempt"))


def clear_failures(ledger: DataFrame, done: DataFrame) -> DataFrame:
    """The ledger without units ``(file_hash, stage)`` that have succeeded since."""
    return ledger.join(done, ["file_hash", "stage"], "left_anti")


def retryable(ledger: DataFrame, cap: int = FAILURE_CAP) -> DataFrame:
    return ledger.where(F.col("attempts") < cap).orderBy("last_attempt", "file_hash", "stage")


def failed_totals(ledger: DataFrame, cap: int = FAILURE_CAP) -> DataFrame:
    return ledger.agg(F.count("*").alias("failed"), F.count_if(F.col("attempts") >= cap).alias("capped"))


def config_drift(before: Column, after: Column) -> Column:
    """Keys of two string maps whose values differ, as ``key: old -> new``, without secrets."""
    keys = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))
    plain = F.filter(keys, lambda k: ~F.lower(k).rlike("|".join(SECRET_PARTS)))
    changed = F.filter(plain, lambda k: ~F.try_element_at(before, k).eqNullSafe(F.try_element_at(after, k)))
    return F.transform(changed, lambda k: F.concat(k, F.lit(": "), F.coalesce(F.try_element_at(before, k), F.lit("none")), F.lit(" -> "), F.coalesce(F.try_element_at(after, k), F.lit("none"))))


def needs_summary(corpus: Corpus) -> DataFrame:
    """Documents without a summary that have text: chunks of their own or of their images."""
    own = corpus.chunks.where("source_kind = 'document'").select(F.col("source_id").alias("document_id"))
    shown = corpus.document_images.join(corpus.chunks.where("source_kind = 'image'").select(F.col("source_id").alias("image_id")), "image_id", "left_semi").select("document_id")
    return corpus.documents.select("document_id").join(corpus.summaries, "document_id", "left_anti").join(own.unionByName(shown), "document_id", "left_semi")


def uncaptioned(corpus: Corpus) -> DataFrame:
    """Images without analysis, with the first page of each document that shows them."""
    return corpus.document_images.join(corpus.images.where("analysis_json is null"), "image_id", "left_semi").groupBy("document_id", "image_id").agg(F.min("page_number").alias("page_number"))


def summary_input(corpus: Corpus) -> DataFrame:
    """What a summariser reads: a document's chunks and its images' in page order, images marked, pages unknown first."""
    page = F.coalesce("page_number", F.lit(-1))
    own = corpus.chunks.where("source_kind = 'document'").select(F.col("source_id").alias("document_id"), page.alias("page"), F.lit(0).alias("kind"), F.col("source_id").alias("of"), "chunk_index", "text")
    links = corpus.document_images.select("document_id", F.col("image_id").alias("source_id"), page.alias("page"))
    label = F.when(F.col("page") >= 0, F.concat(F.lit("[Image on page "), F.col("page").cast("string"), F.lit("] "), "text")).otherwise(F.concat(F.lit("[Image] "), "text"))
    shown = links.join(corpus.chunks.where("source_kind = 'image'").drop("page_number"), "source_id").select("document_id", "page", F.lit(1).alias("kind"), F.col("source_id").alias("of"), "chunk_index", label.alias("text"))
    order = F.struct("page", "kind", "of", "chunk_index", "text")
    return own.unionByName(shown).groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["text"]), "\n\n").alias("text"))


def ingest_rates(timings: DataFrame, documents: DataFrame, wall_seconds: float) -> DataFrame:
    """One row: documents, pages, and both by the second of the whole run's wall clock (0 for none)."""
    own = timings.select("document_id").distinct().join(documents.select("document_id", "page_count"), "document_id", "left")
    rate = lambda c: F.bround(F.col(c) / wall_seconds, 4) if wall_seconds else F.lit(0.0)
    return own.agg(F.count("*").alias("docs"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages")).select("docs", "pages", rate("docs").alias("docs_per_s"), rate("pages").alias("pages_per_s"))


def stage_timings(timings: DataFrame) -> DataFrame:
    """Seconds by stage of an ingest: total, share of all, mean per document. ``timings``: (document_id, stage, seconds)."""
    per = timings.groupBy("stage").agg(F.sum("seconds").alias("total"), F.countDistinct("document_id").alias("documents"))
    whole = timings.agg(F.sum("seconds").alias("whole"))
    return per.crossJoin(whole).select("stage", "total", (F.col("total") / F.col("whole") * 100).alias("pct"), (F.col("total") / F.col("documents")).alias("mean"))  # the sum is one row


def numbered(df: DataFrame, name: str, start: Column, by: str = "file_hash") -> DataFrame:
    """``df`` with a dense number from ``start`` (a column of one row's worth, the same everywhere) in the order of ``by``, a hex digest.

    Rows are numbered within the 256 classes of the digest's first byte, and classes by their counts, so no task sees all rows.
    """
    first = F.substring(by, 1, 2)
    counts = df.groupBy(first.alias("__class")).agg(F.count("*").alias("__n"))
    base = counts.select("__class", (F.sum("__n").over(W.orderBy("__class")) - F.col("__n")).alias("__base"))  # 256 rows at most
    nth = F.row_number().over(W.partitionBy(first).orderBy(by)) - 1
    out = df.withColumn("__nth", nth).withColumn("__class", first).join(F.broadcast(base), "__class")
    return out.withColumn(name, (start + F.col("__base") + F.col("__nth")).cast("long")).drop("__class", "__nth", "__base")


def _next(table: DataFrame, name: str) -> Column:
    """The number after the largest in use."""
    return F.lit((table.agg(F.max(name)).first()[0] or 0) + 1)


def persist_parse(corpus: Corpus, parsed: DataFrame, chunks: DataFrame, images: DataFrame | None = None, embed: str | None = None) -> Corpus:
    """The corpus with parsed files: documents, their chunks, and rows for their images, which are not described yet.

    ``parsed`` has file_hash and what else documents have; sections name their container by ``parent_hash``. ``chunks`` and
    ``images`` name their document by file_hash. A document whose hash is known is not taken in again, nor are its chunks; images are
    one by image_hash. Files that were parsed leave the failure ledger.
    """
    return parse_persisted(corpus, parsed, chunks, images, embed).applied(corpus)


def parse_persisted(corpus: Corpus, parsed: DataFrame, chunks: DataFrame, images: DataFrame | None = None, embed: str | None = None) -> Change:
    new = parsed.dropDuplicates(["file_hash"]).join(corpus.documents.select("file_hash"), "file_hash", "left_anti")
    new = numbered(new, "document_id", _next(corpus.documents, "document_id"))
    ids = new.select("file_hash", "document_id")
    if "parent_hash" in new.columns:
        parents = ids.unionByName(corpus.documents.select("file_hash", "document_id")).select(F.col("file_hash").alias("parent_hash"), F.col("document_id").alias("parent_document_id"))
        new = new.join(parents, "parent_hash", "left").drop("parent_hash")
    rows = chunks.join(ids, "file_hash").select(chunk_id("document", F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), F.lit("document").alias("source_kind"), F.col("document_id").alias("source_id"), *[c for c in chunks.columns if c != "file_hash"])
    added = {"documents": new, "chunks": rows} | _vectors(rows, embed)
    if images is not None:
        shown = images.join(ids, "file_hash")
        fresh = shown.select(F.col("image_hash").alias("file_hash"), *[c for c in ("file_path", "width", "height") if c in images.columns]).dropDuplicates(["file_hash"])
        fresh = numbered(fresh.join(corpus.images.select("file_hash"), "file_hash", "left_anti"), "image_id", _next(corpus.images, "image_id"))
        known = _appended(corpus.images, fresh).select(F.col("file_hash").alias("image_hash"), "image_id")
        added |= {"images": fresh, "document_images": shown.join(known, "image_hash").select("document_id", "image_id", "page_number", "image_index_on_page").distinct()}
    return Change(added, {"failed_ingests": parsed.select("file_hash", F.lit("parse").alias("stage"))})


def persist_captions(corpus: Corpus, captions: DataFrame, embed: str | None = None) -> Corpus:
    """The corpus with descriptions ``(image_id, analysis_json, analysis_model, text, content_type)`` of images that had none; a repeat changes nothing.

    A description with a text is a chunk. Images that were described leave the failure ledger, by whichever document they were.
    """
    return captions_persisted(corpus, captions, embed).applied(corpus)


def captions_persisted(corpus: Corpus, captions: DataFrame, embed: str | None = None) -> Change:
    own = captions.dropDuplicates(["image_id"]).join(corpus.images.where("analysis_json is null").select("image_id"), "image_id", "left_semi")
    filled = own.select("image_id", *[F.col(c) for c in ("analysis_json", "analysis_model") if c in corpus.images.columns])
    images = corpus.images.drop("analysis_json", "analysis_model").join(filled, "image_id")
    rows = own.where("trim(text) <> ''").select(chunk_id("image", F.col("image_id"), F.lit(0)).alias("chunk_id"), F.lit("image").alias("source_kind"), F.col("image_id").alias("source_id"), F.lit(0).alias("chunk_index"), "text", "content_type")
    done = corpus.images.join(captions.select("image_id"), "image_id", "left_semi").select("file_hash", F.lit("caption").alias("stage"))
    return Change({"images": images, "chunks": rows} | _vectors(rows, embed), {"images": own.select("image_id"), "failed_ingests": done})


def persist_summaries(corpus: Corpus, new: DataFrame, embed: str | None = None) -> Corpus:
    """The corpus with new summaries (summary_id, document_id, title, description, text, model, authored_date) in place of old ones, and their chunks likewise."""
    return summaries_persisted(corpus, new, embed).applied(corpus)


def summaries_persisted(corpus: Corpus, new: DataFrame, embed: str | None = None) -> Change:
    old = corpus.summaries.join(new.select("document_id"), "document_id", "left_semi")
    gone = _chunks_of(corpus, "summary", old.select("summary_id"))
    rows = new.select("summary_id", F.inline(tx.chunk_pieces(F.col("text"))))
    rows = rows.select(chunk_id("summary", F.col("summary_id"), F.col("chunk_index")).alias("chunk_id"), F.lit("summary").alias("source_kind"), F.col("summary_id").alias("source_id"), F.col("chunk_index").cast("int").alias("chunk_index"), "text")
    done = corpus.documents.join(new.select("document_id"), "document_id", "left_semi").select("file_hash", F.lit("summary").alias("stage"))
    added = {"summaries": save_summaries(old, new), "chunks": rows}
    return Change(added | _vectors(rows, embed), {"summaries": old.select("summary_id"), "chunks": gone, "embeddings": gone, "failed_ingests": done})


def _appended(table: DataFrame, rows: DataFrame) -> DataFrame:
    """A table with rows that may lack some of its columns; what else they have is left out."""
    return table.unionByName(rows.select(*[c for c in rows.columns if c in table.columns]), allowMissingColumns=True)
