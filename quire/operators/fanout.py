"""Model calls over many rows: few at a time in each task, failures kept with their reason, work that goes on where it stopped.

A sweep goes through its documents in rounds. A round's outcomes are written as a table before anything is
committed, and the commit is the last step; a sweep that is started again leaves out what has been committed, and takes
the outcomes of a round that was called but not committed from their table instead of calling anew.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.functions import text as tx
from quire.operators import curation, models, tags
from quire.sources.corpus import Corpus
from quire.sources.store import Change, Store

IN_FLIGHT, ROUND = 4, 1000
#: A model's odd answer is often mended by asking once more.
CLASSIFY_ATTEMPTS = 2


def call(df: DataFrame, fn: Callable, key: str, returns: str, check: Callable = lambda x: x, in_flight: int = IN_FLIGHT, attempts: int = 1) -> DataFrame:
    """``(key, <returns>, error, calls)``: ``fn`` of each row's ``text``, with at most ``in_flight`` calls at once in a task.

    ``fn`` gives a dict of the columns ``returns`` (DDL); ``check`` gives it back, mended perhaps, or raises. A row whose last attempt
    raised has nulls and the error. Null texts read as ''. Texts come in Arrow batches, so no task holds all of its texts.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [f.name for f in df.sparkSession.createDataFrame([], returns).schema]

    def one(text: str) -> tuple:
        for n in range(1, attempts + 1):
            try:
                value = check(fn(text or ""))
                return *(value[c] for c in names), None, n
            except Exception as wrong:  # one bad text must not end the sweep
                error = f"{type(wrong).__name__}: {wrong}"
        return *(None for _ in names), error, attempts

    def run(batches):
        with ThreadPoolExecutor(max_workers=in_flight) as pool:
            for pdf in batches:
                rows = [(k, *r) for k, r in zip(pdf[key], pool.map(one, pdf["text"]))]
                yield pd.DataFrame(rows, columns=[key, *names, "error", "calls"])

    return df.select(key, "text").mapInPandas(run, f"{key} {kind}, {returns}, error string, calls int")


def rounds(store: Store, kind: str, todo: Callable[[Corpus], DataFrame], ask: Callable[[Corpus, DataFrame], DataFrame], change: Callable[[Corpus, DataFrame], Change], size: int = ROUND) -> int:
    """Run a sweep and commit it round by round; returns the number of rounds.

    ``todo`` gives ``document_id`` of the work that a corpus owes, ``ask`` the outcomes of a round's documents, ``change`` what
    they do to the corpus. A document is asked about once in a sweep, whatever came of it.
    """
    spark, after, done = store.spark, None, 0
    while True:
        mark = store.mark()
        corpus = store.corpus(mark["version"])
        path = f"{store.folder}/work/{kind}-{mark['version']:012d}"
        if "_SUCCESS" not in store.files.names(path):
            work = todo(corpus) if after is None else todo(corpus).where(F.col("document_id") > after)
            some = work.orderBy("document_id").limit(size)
            ids = [r[0] for r in some.select("document_id").collect()]  # a round of ids
            if not ids:
                return done
            ask(corpus, spark.createDataFrame([(i,) for i in ids], "document_id long")).write.mode("overwrite").parquet(path)
        outcomes = spark.read.parquet(path)
        after = outcomes.agg(F.max("document_id")).first()[0]
        store.commit(change(corpus, outcomes))
        store.files.delete(path)
        done += 1


# ---- summaries


def summaries_owed(corpus: Corpus, cap: int = curation.FAILURE_CAP) -> DataFrame:
    """``(document_id)`` of documents without a summary that have text and have not failed ``cap`` times."""
    capped = corpus.failed_ingests.where((F.col("stage") == "summary") & (F.col("attempts") >= cap)).join(corpus.documents, "file_hash").select("document_id")
    return curation.needs_summary(corpus).join(capped, "document_id", "left_anti")


def _summary(value: dict) -> dict:
    """A summary whose parts are texts, and whose text is not blank."""
    if not all(isinstance(value.get(c), str) for c in ("title", "description", "text")) or not value["text"].strip():
        raise ValueError("a summary needs a title, a description and a text")
    return {c: value.get(c) for c in ("title", "description", "text", "authored_date")}


def _failed(corpus: Corpus, failed: DataFrame, stage: str) -> DataFrame:
    """Rows of the failure ledger after ``(document_id, error)`` of one more attempt each."""
    units = failed.join(corpus.documents.select("document_id", "file_hash", "file_name"), "document_id").dropDuplicates(["file_hash"])
    old = corpus.failed_ingests.where(F.col("stage") == stage).select("file_hash", F.col("attempts").alias("before"))
    return units.join(old, "file_hash", "left").select("file_hash", "file_name", F.lit(stage).alias("stage"), "error", (F.coalesce("before", F.lit(0)) + 1).alias("attempts"), F.current_timestamp().alias("last_attempt"))


def summarise(store: Store, name: str = "summarize", model: str = "model", in_flight: int = IN_FLIGHT, size: int = ROUND, embed: str | None = None) -> int:
    """Summaries for all documents that owe one, by a registered callable (text to title, description, text and perhaps authored_date); failures go to the ledger."""
    fn = partial(models.REGISTRY[name]) if name in models.REGISTRY else None
    if fn is None:
        raise EngineError("NO_PROVIDER", f"no model {name!r}", known=sorted(models.REGISTRY))

    def ask(corpus: Corpus, ids: DataFrame) -> DataFrame:
        texts = curation.summary_input(corpus).join(F.broadcast(ids), "document_id", "left_semi")  # a round of ids
        return call(texts, fn, "document_id", "title string, description string, text string, authored_date string", _summary, in_flight)

    def change(corpus: Corpus, outcomes: DataFrame) -> Change:
        fine = outcomes.where("error is null").drop("error", "calls").join(corpus.documents.select("document_id", "file_hash"), "document_id")
        new = curation.numbered(fine, "summary_id", curation._next(corpus.summaries, "summary_id")).drop("file_hash")
        new = new.withColumn("authored_date", tx.authored_date(F.col("authored_date"))).withColumn("model", F.lit(model))
        made = curation.summaries_persisted(corpus, new, embed)
        ledger = _failed(corpus, outcomes.where("error is not null").select("document_id", "error"), "summary")
        keys = made.removed["failed_ingests"].select("file_hash", "stage").unionByName(ledger.select("file_hash", "stage"))
        return Change(made.added | {"failed_ingests": ledger}, made.removed | {"failed_ingests": keys})

    return rounds(store, "summary", summaries_owed, ask, change, size)


# ---- classification


def to_classify(corpus: Corpus, tag_id: int | None = None, force: bool = False) -> DataFrame:
    """``(document_id, file_name, text, reason)`` of all documents: ``reason`` says why one is skipped (no_summary, already_tagged), null where it is to be asked about."""
    held = corpus.document_tags if tag_id is None else corpus.document_tags.where(F.col("tag_id") == tag_id)
    held = held.select("document_id").distinct().withColumn("held", F.lit(True))
    rows = corpus.documents.select("document_id", "file_name").join(corpus.summaries.select("document_id", "text"), "document_id", "left").join(held, "document_id", "left")
    reason = F.when(F.col("text").isNull(), "no_summary").when(F.col("held").isNotNull() & ~F.lit(force), "already_tagged")
    return rows.select("document_id", "file_name", "text", reason.alias("reason"))


def _answer(value, ids: set[int], single: bool) -> dict:
    """The tags that are in the vocabulary, of an answer of the right form."""
    if single:
        if not isinstance(value, bool):
            raise TypeError("a yes or no was asked for")
        return {"tag_ids": [*ids] if value else []}
    if not isinstance(value, list | tuple) or not all(isinstance(x, int) for x in value):
        raise TypeError("a list of tag numbers was asked for")
    return {"tag_ids": [x for x in dict.fromkeys(value) if x in ids]}


def classify(store: Store, name: str = "classify", tag: str | None = None, force: bool = False, in_flight: int = IN_FLIGHT, size: int = ROUND) -> dict:
    """Tags for all documents by their summaries, from a registered callable ``(text, vocabulary)``.

    Without ``tag`` it gives the numbers of those of the vocabulary (tag_id, name, description) that apply, which are added to what a document has; with
    one, of a vocabulary of one, whether it does, and with ``force`` a no takes the tag away. Each document is tried twice. Returns counts of classified, skipped and failed; the failed ones are in ``failed`` with their errors.
    """
    if name not in models.REGISTRY:
        raise EngineError("NO_PROVIDER", f"no model {name!r}", known=sorted(models.REGISTRY))
    start = store.corpus()
    one = tags.named(start.tags, tag) if tag is not None else None
    vocabulary = [tuple(r) for r in (start.tags if one is None else start.tags.where(F.col("tag_id") == one["tag_id"])).select("tag_id", "name", "description").orderBy("name").collect()]
    if not vocabulary:
        raise EngineError("EMPTY_VOCABULARY", "there are no tags yet")
    tag_id, ids = one and one["tag_id"], {v[0] for v in vocabulary}
    asked = models.REGISTRY[name]
    counts = {r["reason"]: r["n"] for r in to_classify(start, tag_id, force).groupBy("reason").agg(F.count("*").alias("n")).collect()}
    failed: list[dict] = []

    def todo(corpus: Corpus) -> DataFrame:
        return to_classify(corpus, tag_id, force).where("reason is null").select("document_id")

    def ask(corpus: Corpus, some: DataFrame) -> DataFrame:
        texts = corpus.summaries.join(F.broadcast(some), "document_id", "left_semi")  # a round of ids
        return call(texts, lambda text: asked(text, vocabulary), "document_id", "tag_ids array<long>", partial(_answer, ids=ids, single=one is not None), in_flight, CLASSIFY_ATTEMPTS)

    def change(corpus: Corpus, outcomes: DataFrame) -> Change:
        failed.extend({"document_id": f"document:{r['document_id']}", "error": r["error"]} for r in outcomes.where("error is not null").orderBy("document_id").collect())  # a round at most
        fine = outcomes.where("error is null")
        rows = fine.select("document_id", F.explode("tag_ids").alias("tag_id")).join(corpus.document_tags, ["document_id", "tag_id"], "left_anti")
        removed = {"document_tags": fine.where(F.size("tag_ids") == 0).select("document_id", F.lit(tag_id).cast("long").alias("tag_id"))} if one is not None and force else {}
        return Change({"document_tags": rows}, removed)

    rounds(store, "classify", todo, ask, change, size)
    return {"mode": "full-vocab" if one is None else "single-tag", "tag": tag, "model": name, "classified": counts.get(None, 0) - len(failed), "skipped": {k: v for k, v in counts.items() if k}, "failed": failed}
