"""Publishing a corpus without private work, with the files it was made of, and taking in a published one.

Files are rows (hash, content) of an archive, so they are copied, digested and verified by tasks, from and to whatever file system
Spark knows. A manifest of digests is written when all files are there; what is taken in must be as it says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.sources import corpus as c
from quire.sources import routes
from quire.sources.store import Files

FILE = "file_hash string, content binary, part string"
#: Missing or broken files that a refusal names.
NAMED = 50


def strip_private(corpus: c.Corpus) -> c.Corpus:
    """Without findings, sessions, logs, finding chunks and their vectors; tags anchored at such chunks lose the anchor."""
    chunks = corpus.chunks.where("source_kind <> 'finding'")
    kept = chunks.select("chunk_id", F.lit(True).alias("kept"))
    anchored = corpus.document_tags.join(kept, "chunk_id", "left").withColumn("chunk_id", F.when(F.col("kept"), F.col("chunk_id"))).select(corpus.document_tags.columns)
    return corpus.with_tables(
        findings=corpus.findings.limit(0),
        sessions=corpus.sessions.limit(0),
        audit_logs=corpus.audit_logs.limit(0),
        finding_citations=corpus.finding_citations.limit(0),
        chunks=chunks,
        embeddings=corpus.embeddings.join(chunks, "chunk_id", "left_semi"),
        document_tags=anchored,
    )


def publish(corpus: c.Corpus, folder: str, embedding_model: str) -> None:
    c.save(strip_private(corpus), folder, {"embedding_model": embedding_model})


def take_in(spark: SparkSession, folder: str, archive: str, embedding_model: str | None = None, drop_tags: bool = False) -> c.Corpus:
    """A published corpus with file paths under ``archive``; refused if it was embedded by another model."""
    found = c.open_corpus(spark, folder)
    meta = {r["key"]: r["value"] for r in spark.read.schema(c.SCHEMAS["meta"]).parquet(f"{folder}/meta").collect()}
    if embedding_model and meta.get("embedding_model") != embedding_model:
        raise EngineError("MODEL_MISMATCH", f"corpus is embedded by {meta.get('embedding_model')!r}")
    path = F.concat(F.lit(archive.rstrip("/") + "/"), "file_hash", F.lit("/"), F.regexp_extract("file_path", r"[^/]+$", 0))
    out = found.with_tables(documents=found.documents.withColumn("file_path", path))
    return out.with_tables(tags=out.tags.limit(0), document_tags=out.document_tags.limit(0)) if drop_tags else out


def _sources(corpus: c.Corpus) -> DataFrame:
    """``(file_hash, file_path)`` of documents and images."""
    path = lambda df: F.col("file_path") if "file_path" in df.columns else F.lit(None).cast("string").alias("file_path")
    rows = corpus.documents.select("file_hash", path(corpus.documents)).unionByName(corpus.images.select("file_hash", path(corpus.images)))
    return rows.where("file_hash is not null")


def originals(corpus: c.Corpus) -> DataFrame:
    """``(file_hash, name)`` of the files that documents and images came from, each content once; sections and containers share their original's or have none in the archive."""
    return _sources(corpus).groupBy("file_hash").agg(F.regexp_extract(F.coalesce(F.min("file_path"), F.lit("")), r"[^/]+$", 0).alias("name"))


def _described(contents: DataFrame) -> DataFrame:
    """``(file_hash, length, digest)`` of contents (file_hash, content)."""
    return contents.select("file_hash", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("digest"))


def _manifests(files: Files, folder: str) -> list[int]:
    """Numbers of the manifests that are complete."""
    return [int(n[2:]) for n in files.names(f"{folder}/manifest") if n.startswith("v=") and "_SUCCESS" in files.names(f"{folder}/manifest/{n}")]


def publish_files(corpus: c.Corpus, archive: str, folder: str) -> DataFrame:
    """Copy a corpus's files from an archive to ``folder`` and give the manifest ``(file_hash, name, length, digest)``.

    Files that the folder holds already are not copied again. Hashes that the archive has no file for are left out. The manifest
    comes last, so a publication that failed is none; doing it again copies what is missing.
    """
    spark, files = corpus.spark, Files(corpus.spark, folder)
    kept = spark.read.parquet(archive).select("file_hash", "content")
    held = spark.read.schema(FILE).parquet(f"{folder}/files").select("file_hash") if files.names(f"{folder}/files") else None
    routes.once_by_part(kept, held, _sources(corpus)).write.partitionBy("part").parquet(f"{folder}/files/batch={uuid.uuid4().hex}")
    number = max(_manifests(files, folder), default=0) + 1
    described = _described(kept).join(originals(corpus), "file_hash").select("file_hash", "name", "length", "digest")  # digests are joined, not contents
    described.write.mode("overwrite").parquet(f"{folder}/manifest/v={number}")
    return spark.read.schema(described.schema).parquet(f"{folder}/manifest/v={number}")


def take_in_files(spark: SparkSession, folder: str, archive: str) -> int:
    """Add the files of a publication to an archive, once all of them are there and as the last manifest says; how many it names."""
    files = Files(spark, folder)
    known = _manifests(files, folder)
    if not known:
        raise EngineError("MISSING_ARTIFACT", f"{folder} holds no manifest")
    manifest = spark.read.parquet(f"{folder}/manifest/v={max(known)}")
    there = spark.read.schema(FILE).parquet(f"{folder}/files").select("file_hash", "content")
    seen = _described(there).select("file_hash", F.col("length").alias("n"), F.col("digest").alias("d"))  # each copy, if there are several
    odd = manifest.join(seen, "file_hash", "left").where("d is null or d <> digest or n <> length").groupBy("file_hash").agg(F.max(F.col("d").isNull()).alias("missing")).orderBy("file_hash").limit(NAMED).collect()
    if odd:
        raise EngineError("BROKEN_ARTIFACT", f"{odd[0]['file_hash']} is {'missing' if odd[0]['missing'] else 'broken'}", missing=[r["file_hash"] for r in odd if r["missing"]], broken=[r["file_hash"] for r in odd if not r["missing"]])
    routes.archive(there, archive, manifest)
    return manifest.count()
