"""Requests that change a stored corpus: each refuses what it must, commits once, and answers with what has been done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import api
from quire.errors import EngineError
from quire.functions import text as tx
from quire.operators import citations, curation, fanout, reads, tags
from quire.sources.corpus import Corpus
from quire.sources.store import Change, Store

FINDING = "finding_id long, session_id long, title string, description string, body string"
#: How often a change is made anew when another writer has committed meanwhile.
TRIES = 5
#: The model of a summary that a person wrote.
BY_HAND = "author"


def committed(store: Store, change: Callable[[Corpus], tuple[Change, Callable[[Corpus], dict]]]) -> dict:
    """Make a change of the newest version and commit it, from the start again if another commit came between; the answer is read from the version that follows."""
    for left in range(TRIES - 1, -1, -1):
        made, answer = change(store.corpus())
        try:
            version = store.commit(made)
        except EngineError as refused:
            if refused.code != "COMMIT_CONFLICT" or not left:
                raise
            continue
        return answer(store.corpus(version))
    raise AssertionError("unreachable")


def _filled(text: str | None, code: str, what: str) -> str:
    if text is None or not text.strip():
        raise EngineError(code, f"a {what} must not be empty")
    return text


def _finding(corpus: Corpus, finding_id: int, session_id: int | None) -> dict:
    row = corpus.findings.where(F.col("finding_id") == finding_id).first()
    if row is None:
        raise EngineError("FINDING_NOT_FOUND", f"no finding {finding_id}", missing_finding_ids=[finding_id])
    api._may_read(corpus, finding_id, session_id)
    return row.asDict()


def _row(corpus: Corpus, **values) -> DataFrame:
    return corpus.spark.createDataFrame([tuple(values[c.split()[0]] for c in FINDING.split(", "))], FINDING)


def _told(corpus: Corpus, finding_id: int, **more) -> dict:
    """A finding as its requests answer: texts, its chunks, and what it cites."""
    own = corpus.findings.where(F.col("finding_id") == finding_id)
    row = own.first()
    chunks = corpus.chunks.where((F.col("source_kind") == "finding") & (F.col("source_id") == finding_id)).orderBy("chunk_index").select("chunk_id")
    cited = citations.edges(own).join(corpus.chunks.select("chunk_id", "source_kind", "source_id"), "chunk_id")
    session = corpus.sessions.where(F.col("session_id") == row["session_id"]).first()
    return {
        "finding_id": f"finding:{finding_id}", "session_id": row["session_id"], "model": session and session["model"], "harness": session and session["harness"],
        "title": row["title"], "description": row["description"], "body": row["body"], "chunk_ids": [f"chunk:{r[0]}" for r in chunks.collect()],
        "citations": api._rows(reads.chunk_names(corpus, cited).orderBy("position").select("chunk_id", "source_kind", "source_id", "source_name")),
        "external_citations": api._rows(citations.external(own).orderBy("position").select("scheme", "ref")),
    } | more


def save_finding(store: Store, title: str, description: str, body: str, session_id: int | None = None, embed: str | None = None) -> dict:
    _filled(title, "EMPTY_TITLE", "title")
    _filled(description, "EMPTY_DESCRIPTION", "description")

    def change(corpus: Corpus):
        number = (corpus.findings.agg(F.max("finding_id")).first()[0] or 0) + 1
        new = _row(corpus, finding_id=number, session_id=session_id, title=title, description=description, body=body)
        return curation.finding_saved(corpus, new, embed), lambda after: _told(after, number)

    return committed(store, change)


def edit_finding(store: Store, finding_id: int, title: str | None = None, description: str | None = None, body: str | None = None, session_id: int | None = None, embed: str | None = None) -> dict:
    """New texts for a finding; chunks, vectors and citations are made anew only where the body is."""
    if title is None and description is None and body is None:
        raise EngineError("NOTHING_TO_UPDATE", "give a title, a description or a body")

    def change(corpus: Corpus):
        old = _finding(corpus, finding_id, session_id)
        new = old | {k: _filled(v, f"EMPTY_{k.upper()}", k) for k, v in (("title", title), ("description", description), ("body", body)) if v is not None}
        if body is not None:
            made = curation.finding_edited(corpus, _row(corpus, **new), embed)
        else:
            kept = corpus.findings.where(F.col("finding_id") == finding_id).withColumns({c: F.lit(new[c]) for c in ("title", "description")})
            made = Change({"findings": kept}, {"findings": kept.select("finding_id")})
        return made, lambda after: _told(after, finding_id)

    return committed(store, change)


def merge_findings(store: Store, into: int, from_ids: list[int], body: str, title: str | None = None, description: str | None = None, session_id: int | None = None, embed: str | None = None) -> dict:
    """One finding with a new body in place of itself and others."""
    sources = list(dict.fromkeys(from_ids))

    def change(corpus: Corpus):
        if into in sources:
            raise EngineError("TARGET_IN_SOURCES", "the target is among the sources")
        known = {r[0] for r in corpus.findings.where(F.col("finding_id").isin([into, *sources])).select("finding_id").collect()}  # as many as named
        if missing := [i for i in [*sources, into] if i not in known]:
            raise EngineError("FINDING_NOT_FOUND", f"no findings {missing}", missing_finding_ids=missing)
        for i in sources:
            _finding(corpus, i, session_id)
        new = _finding(corpus, into, session_id) | {"body": body}
        new |= {k: _filled(v, f"EMPTY_{k.upper()}", k) for k, v in (("title", title), ("description", description)) if v is not None}
        return curation.findings_merged(corpus, _row(corpus, **new), sources, embed), lambda after: _told(after, into, merged_from=[f"finding:{i}" for i in sources])

    return committed(store, change)


def delete_finding(store: Store, finding_id: int, session_id: int | None = None) -> dict:
    def change(corpus: Corpus):
        old = _finding(corpus, finding_id, session_id)
        ids = corpus.spark.createDataFrame([(finding_id,)], "finding_id long")
        n = curation.delete_counts(corpus, ids).first()
        said = {"status": "deleted", "finding_id": f"finding:{finding_id}", "title": old["title"], "removed_chunks": n["chunks"], "removed_citations": n["citations"], "incoming_citations": n["incoming_citations"]}
        return curation.findings_deleted(corpus, ids), lambda _: said

    return committed(store, change)


def _document(corpus: Corpus, document_id: int) -> None:
    if not corpus.documents.where(F.col("document_id") == document_id).limit(1).count():
        raise EngineError("DOCUMENT_NOT_FOUND", f"no document {document_id}")


def save_summary(store: Store, document_id: int, title: str, description: str, text: str, authored_date: str | None = None, embed: str | None = None) -> dict:
    """A summary in place of a document's old one, whose date stays if none is given."""
    for value, what in ((title, "title"), (description, "description"), (text, "text")):
        _filled(value, f"EMPTY_{what.upper()}", what)

    def change(corpus: Corpus):
        _document(corpus, document_id)
        number = (corpus.summaries.agg(F.max("summary_id")).first()[0] or 0) + 1
        date = authored_date if authored_date is not None and tx.is_date(authored_date) else None
        new = corpus.spark.createDataFrame([(number, document_id, title, description, text, BY_HAND, date)], "summary_id long, document_id long, title string, description string, text string, model string, authored_date string")
        chunks = lambda after: [f"chunk:{r[0]}" for r in after.chunks.where((F.col("source_kind") == "summary") & (F.col("source_id") == number)).orderBy("chunk_index").select("chunk_id").collect()]
        return curation.summaries_persisted(corpus, new, embed), lambda after: {"summary_id": f"summary:{number}", "document_id": f"document:{document_id}", "chunk_ids": chunks(after)}

    return committed(store, change)


def save_date(store: Store, document_id: int, date: str | None = None, clear: bool = False) -> dict:
    if clear == (date is not None):
        raise EngineError("USAGE_ERROR", "give a date, or clear it")

    def change(corpus: Corpus):
        if date is not None and not tx.is_date(date):
            raise EngineError("INVALID_DATE", f"{date!r} is no date YYYY-MM-DD")
        _document(corpus, document_id)
        own = corpus.summaries.where(F.col("document_id") == document_id)
        old = own.first()
        new = curation.save_date(own, document_id, date)
        said = {"document_id": f"document:{document_id}", "old_authored_date": old and old["authored_date"], "new_authored_date": date}
        return Change({"summaries": new}, {"summaries": own.select("summary_id")}), lambda _: said

    return committed(store, change)


def backfill_dates(store: Store, pattern: str, overwrite: bool = False) -> dict:
    """Dates from file names for documents without one (or, with ``overwrite``, for all), as counts."""

    def change(corpus: Corpus):
        plan = curation.backfill_dates(corpus, pattern, overwrite)
        after = corpus.with_tables(summaries=curation.apply_backfill(corpus.summaries, plan))
        said = curation.backfill_counts(plan).first().asDict()
        return Change.between(corpus, after, "summaries"), lambda _: said

    return committed(store, change)


# ---- tags


def add_tag(store: Store, name: str, description: str, value_type: str | None = None, pattern: str | None = None, embed: Callable | None = None) -> dict:
    """A new tag, or the one that it would repeat."""
    made: dict = {}

    def change(corpus: Corpus):
        kind, rows = tags.add(corpus.tags, name, description, value_type, pattern, embed)
        if kind == "conflict":
            found = rows.first()
            made.update(status="conflict", existing={"tag_id": found["tag_id"], "name": found["name"], "description": found["description"], "similarity": found["similarity"]})
            return Change(), lambda _: made
        new = rows.join(corpus.tags.select("tag_id"), "tag_id", "left_anti")
        row = new.first()
        return Change({"tags": new}), lambda _: {"status": "created", "tag_id": row["tag_id"], "name": row["name"], "description": row["description"]}

    return committed(store, change)


def rename_tag(store: Store, old: str, new: str) -> dict:
    name = new.strip()
    if not any(c.isascii() and c.isalnum() for c in name):
        raise EngineError("EMPTY_NORMALIZED_NAME", "a tag's name needs a letter or digit")

    def change(corpus: Corpus):
        row = tags.named(corpus.tags, old)
        renamed = tags.rename(corpus.tags, row["tag_id"], name).where(F.col("tag_id") == row["tag_id"])
        said = {"status": "renamed", "tag_id": row["tag_id"], "old_name": row["name"], "new_name": name}
        return Change({"tags": renamed}, {"tags": renamed.select("tag_id")}), lambda _: said

    return committed(store, change)


def delete_tag(store: Store, tag: str) -> dict:
    def change(corpus: Corpus):
        row = tags.named(corpus.tags, tag)
        held = corpus.document_tags.where(F.col("tag_id") == row["tag_id"]).select("document_id", "tag_id")
        said = {"status": "deleted", "tag_id": row["tag_id"], "name": row["name"], "removed_assignments": held.count()}
        return Change(removed={"tags": corpus.tags.where(F.col("tag_id") == row["tag_id"]).select("tag_id"), "document_tags": held}), lambda _: said

    return committed(store, change)


def merge_tags(store: Store, source: str, target: str) -> dict:
    def change(corpus: Corpus):
        left, held, counts = tags.merge(corpus.tags, corpus.document_tags, source, target)
        both = [r[0] for r in corpus.tags.where(F.col("name").isin(source, target)).select("tag_id").collect()]
        own = lambda df: df.where(F.col("tag_id").isin(both))
        made = Change.between(corpus.with_tables(document_tags=own(corpus.document_tags)), corpus.with_tables(document_tags=own(held)), "document_tags")
        gone = corpus.tags.join(left.select("tag_id"), "tag_id", "left_anti").select("tag_id")
        said = {"source": source, "target": target, **counts.first().asDict()}
        return Change(made.added, made.removed | {"tags": gone}), lambda _: said

    return committed(store, change)


def assign_tag(store: Store, tag: str, document_ids: list[int], value: str | None = None, chunk_id: int | None = None) -> dict:
    def change(corpus: Corpus):
        row = tags.named(corpus.tags, tag)
        own = corpus.document_tags.where((F.col("tag_id") == row["tag_id"]) & F.col("document_id").isin(document_ids))
        held, lost = tags.assign_by_name(corpus.tags, own, corpus.documents, corpus.chunks, tag, document_ids, value, chunk_id)
        made = Change.between(corpus.with_tables(document_tags=own), corpus.with_tables(document_tags=held), "document_tags")
        stored = held.where("value is not null").first() if value is not None else None
        said = {"tag_id": row["tag_id"], "tag": tag, "value": stored and stored["value"], "chunk_id": f"chunk:{chunk_id}" if chunk_id is not None else None}
        return made, lambda after: said | {"assigned": _named(after, document_ids), "not_found": [f"document:{i}" for i in lost]}

    return committed(store, change)


def unassign_tag(store: Store, tag: str, document_ids: list[int]) -> dict:
    def change(corpus: Corpus):
        row = tags.named(corpus.tags, tag)
        gone = corpus.document_tags.where((F.col("tag_id") == row["tag_id"]) & F.col("document_id").isin(document_ids)).select("document_id", "tag_id")
        known = _named(corpus, document_ids)
        lost = [f"document:{i}" for i in document_ids if f"document:{i}" not in {d["id"] for d in known}]
        return Change(removed={"document_tags": gone}), lambda _: {"tag_id": row["tag_id"], "tag": tag, "unassigned": known, "not_found": lost}

    return committed(store, change)


def _named(corpus: Corpus, ids: list[int]) -> list[dict]:
    """The documents of some numbers, as many as named."""
    return [{"id": f"document:{r[0]}", "file_name": r[1]} for r in corpus.documents.where(F.col("document_id").isin(ids)).select("document_id", "file_name").orderBy("document_id").collect()]


# ---- sessions


def start_session(store: Store, name: str, run_key: str | None = None, memory: bool = True, model: str | None = None, harness: str | None = None) -> dict:
    """The session of a key (without one, of a name), which is made if it is not there."""

    def change(corpus: Corpus):
        number = (corpus.sessions.agg(F.max("session_id")).first()[0] or 0) + 1
        row = corpus.spark.createDataFrame([(number, name, memory, model, harness, run_key)], "session_id long, name string, memory_enabled boolean, model string, harness string, run_key string").withColumn("created_at", F.current_timestamp())
        new = curation.start_session(corpus.sessions.where("false"), row)
        key = F.col("run_key") == run_key if run_key is not None else F.col("name") == name
        there = corpus.sessions.where(key).limit(1).count()
        told = lambda after: {k: v for k, v in after.sessions.where(key).first().asDict().items() if k in ("session_id", "name", "memory_enabled", "model", "harness", "run_key")}
        return Change() if there else Change({"sessions": new}), told

    return committed(store, change)


def end_session(store: Store, session_id: int, at: str) -> dict:
    def change(corpus: Corpus):
        own = corpus.sessions.where(F.col("session_id") == session_id)
        if own.first() is None:
            raise EngineError("USAGE_ERROR", f"no session {session_id}")
        ended = curation.end_session(own, session_id, at)
        return Change({"sessions": ended}, {"sessions": own.select("session_id")}), lambda after: {"session_id": session_id, "ended_at": str(after.sessions.where(F.col("session_id") == session_id).first()["ended_at"])}

    return committed(store, change)


def _swept(rounds: int) -> dict:
    return {"rounds": rounds}


#: Requests by name, as the command line knows them; the first argument is a store.
WRITES = {
    "save_finding": save_finding, "edit_finding": edit_finding, "merge_findings": merge_findings, "delete_finding": delete_finding,
    "save_summary": save_summary, "save_date": save_date, "backfill_dates": backfill_dates,
    "add_tag": add_tag, "rename_tag": rename_tag, "delete_tag": delete_tag, "merge_tags": merge_tags, "assign_tag": assign_tag, "unassign_tag": unassign_tag, "tag": fanout.classify,
    "start_session": start_session, "end_session": end_session, "summarize": lambda store, **how: _swept(fanout.summarise(store, **how)),
    "create": lambda store: {"version": store.create()}, "compact": lambda store: {"version": store.compact()}, "vacuum": lambda store, keep=2: {"deleted": store.vacuum(keep)}, "versions": lambda store: {"versions": store.versions()},
}
