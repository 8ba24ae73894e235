"""Audits: rows that break a rule of the corpus. Sound tables give none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.sources.corpus import KINDS, STAGES, Corpus


def orphan_chunks(corpus: Corpus) -> DataFrame:
    """Chunks whose source does not exist: ``(chunk_id, source_kind, source_id)``."""
    owners = {"document": (corpus.documents, "document_id"), "summary": (corpus.summaries, "summary_id"), "image": (corpus.images, "image_id"), "finding": (corpus.findings, "finding_id")}
    parts = [corpus.chunks.where(F.col("source_kind") == k).join(t.select(F.col(c).alias("source_id")), "source_id", "left_anti") for k, (t, c) in owners.items()]
    return reduce(DataFrame.unionByName, parts).select("chunk_id", "source_kind", "source_id")


def id_sync(corpus: Corpus) -> DataFrame:
    """Vectors without a chunk and chunks of embedded kinds without a vector: ``(side, n)``."""
    chunks, vectors = corpus.chunks.select("chunk_id"), corpus.embeddings.select("chunk_id")
    sides = [("vector_without_chunk", vectors.join(chunks, "chunk_id", "left_anti")), ("chunk_without_vector", chunks.join(vectors, "chunk_id", "left_anti"))]
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "n") for s, d in sides])


def violations(corpus: Corpus) -> DataFrame:
    """``(rule, n)``: keys that repeat, links to nothing, values outside their sets, chunk indexes with gaps below zero or twice."""

    def repeats(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).count().where("count > 1")

    index = corpus.chunks.withColumn("before", F.lag("chunk_index").over(W.partitionBy("source_kind", "source_id").orderBy("chunk_index")))
    rules = {
        "documents.file_hash repeats": repeats(corpus.documents, "file_hash"),
        "documents.parent missing": corpus.documents.where("parent_document_id is not null").join(corpus.documents.select(F.col("document_id").alias("parent_document_id")), "parent_document_id", "left_anti"),
        "summaries.document_id repeats": repeats(corpus.summaries, "document_id"),
        "summaries.document missing": corpus.summaries.join(corpus.documents, "document_id", "left_anti"),
        "chunks.place repeats": index.where("chunk_index = before"),
        "chunks.index below zero": corpus.chunks.where("chunk_index < 0"),
        "chunks.text blank": corpus.chunks.where("trim(coalesce(text, '')) = ''"),
        "chunks.source_kind unknown": corpus.chunks.where(~F.col("source_kind").isin(KINDS)),
        "failed_ingests.stage unknown": corpus.failed_ingests.where(~F.col("stage").isin(STAGES)),
        "sessions.name repeats": repeats(corpus.sessions, "name"),
        "tags.name repeats": repeats(corpus.tags, "name"),
        "document_tags repeats": repeats(corpus.document_tags, "document_id", "tag_id"),
        "finding_citations.chunk missing": corpus.finding_citations.join(corpus.chunks, "chunk_id", "left_anti"),
    }
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("n")).select(F.lit(r).alias("rule"), "n") for r, d in rules.items()])


def contradicted_failures(corpus: Corpus) -> DataFrame:
    """Failures of files that the corpus holds with chunks."""
    whole = corpus.documents.join(corpus.chunks.where("source_kind = 'document'").select(F.col("source_id").alias("document_id")), "document_id", "left_semi")
    return corpus.failed_ingests.where("stage = 'parse'").join(whole.select("file_hash"), "file_hash", "left_semi").select("file_hash", "stage")


def schema_faults(tables: dict[str, DataFrame], schemas: dict[str, str]) -> list[str]:
    """Columns that a table lacks or has with another type."""
    out = []
    for name, df in tables.items():
        have = dict(df.dtypes)
        for c in df.sparkSession.createDataFrame([], schemas[name]).dtypes:
            if have.get(c[0]) not in (c[1], None) or c[0] not in have:
                out.append(f"{name}.{c[0]}: {have.get(c[0], 'missing')}, not {c[1]}")
    return out


#: Rows of an audit that its report shows.
SHOWN = 100


def run_all(corpus: Corpus, shown: int = SHOWN) -> dict[str, object]:
    """Every audit by name: ``{"n": all its rows, "examples": the first of them}``; one that fails gives its error and the others still run."""
    out: dict[str, object] = {}
    for audit in (orphan_chunks, id_sync, violations, contradicted_failures):
        try:
            found = audit(corpus)
            out[audit.__name__] = {"n": found.count(), "examples": found.orderBy(*found.columns).limit(shown).collect()}
        except Exception as wrong:  # the report says which audit could not run
            out[audit.__name__] = wrong
    return out
