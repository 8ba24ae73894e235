"""From files to chunks: the route of each file, converters as plain callables, pages with text recognition, images, the archive."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.sources import files, structure

#: Characters below which a page is sparse, and the least confidence of recognised text there.
SPARSE, CONFIDENCE = 100, 30.0
#: The same for an image to be text rather than a scene.
TEXT_IMAGE, TEXT_CONFIDENCE = 300, 60.0
CHUNK = "path string, chunk_index int, text string, section_heading string, page_number int, content_type string"


def route(kind: Column, head: Column) -> Column:
    """Where a file goes, by its type and its first text: image, pdf, refused (a page of HTML that calls itself a PDF), filing, facts, html, markdown or text."""
    is_html = F.lower(F.ltrim(F.substring(head, 1, 1024))).rlike(r"^(<!doctype html|<html)")
    return (
        F.when(kind == "image", "image")
        .when((kind == "pdf") & is_html, "refused")
        .when(kind == "pdf", "pdf")
        .when(files.is_envelope(head), "filing")
        .when((kind == "html") & files.is_inline_facts(head), "facts")
        .when(kind == "html", "html")
        .when(kind == "markdown", "markdown")
        .otherwise("text")
    )


def with_routes(collected: DataFrame) -> DataFrame:
    """Collected files (path, content, type) with their content's hash and ``route``."""
    return collected.withColumn("file_hash", files.file_hash(F.col("content"))).withColumn("route", route(F.col("type"), files.read_text(F.substring(F.col("content"), 1, 8192))))


def pages(pdfs: DataFrame, extract: Callable, recognise: Callable | None = None, sparse: int = SPARSE, confidence: float = CONFIDENCE) -> DataFrame:
    """``(path, page_number, text, content_type)`` of files (path, content).

    ``extract`` turns bytes into the pages' texts. A page of fewer than ``sparse`` characters is read by
    ``recognise`` (bytes, page number; gives text and confidence): good text is ``ocr``, else the page has an empty
    text and no type, and its picture is to be described. Recognition that fails is no failure of the file.
    """

    def read(content: bytes):
        for number, text in enumerate(extract(content), 1):
            text = (text or "").strip()
            if len(text) >= sparse:
                yield number, text, "text"
                continue
            try:
                found, sure = recognise(content, number) if recognise else ("", 0.0)
            except Exception:  # a reader of pictures may fail in any way
                found, sure = "", 0.0
            yield (number, found, "ocr") if len(found) >= sparse and sure >= confidence else (number, "", None)

    def run(batches):
        for pdf in batches:
            rows = [(p, *r) for p, c in zip(pdf["path"], pdf["content"]) for r in read(c)]
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "content_type"])

    return pdfs.select("path", "content").mapInPandas(run, "path string, page_number int, text string, content_type string")


def converted(texts: DataFrame, convert: Callable) -> DataFrame:
    """Chunks of files (path, text) by a converter: text to (text, heading, page, type) rows. An XBRL converter types its rows sec_text and sec_table."""

    def run(batches):
        for pdf in batches:
            rows = [(p, i, *r) for p, t in zip(pdf["path"], pdf["text"]) for i, r in enumerate(x for x in convert(t or "") if x[0].strip())]
            yield pd.DataFrame(rows, columns=["path", "chunk_index", "text", "section_heading", "page_number", "content_type"])

    return texts.select("path", "text").mapInPandas(run, CHUNK)


def chunks(routed: DataFrame, extract: Callable | None = None, recognise: Callable | None = None, facts: Callable | None = None) -> DataFrame:
    """Chunks of routed files, a branch for each route, in one frame; images have none until they are described.

    Pages are chunked by their structure, with the deepest heading and the kind of the first item; a file of inline facts, without a
    converter of its own, likewise, as ``sec_text`` and ``sec_table``. Filings give the chunks of their inner documents, in their order. Without its
    converter a PDF gives none.
    """
    of = lambda *names: routed.where(F.col("route").isin(*names))
    none = {"section_heading": "string", "page_number": "int", "content_type": "string"}

    def pieces(df: DataFrame, text: Column, **known: Column) -> DataFrame:
        cut = df.select("path", *[known.get(c, F.lit(None)).cast(k).alias(c) for c, k in none.items()], F.inline(tx.chunk_pieces(text)))
        return cut.select("path", F.col("chunk_index").cast("int").alias("chunk_index"), "text", *none)

    body = files.read_text(F.col("content"))
    def paged(df: DataFrame, types: tuple[str, str] | None = None) -> DataFrame:
        cut = structure.chunk_pages(df.select("path", body.alias("html")), "path", types=types)
        return cut.select("path", "chunk_index", "text", "section_heading", F.lit(None).cast("int").alias("page_number"), "content_type")

    out = pieces(of("text"), body).unionByName(paged(of("html")))
    marked = files.chunk_markdown(of("markdown").select("path", body.alias("text")), "path")
    out = out.unionByName(marked.select("path", "chunk_index", "text", "section_heading", F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("content_type")))
    inner = files.split_envelope(of("filing").select("path", body.alias("text")), "path").where("route <> 'skip'")
    marked = F.concat_ws("\n", "position", "path")  # a page of a filing is named by both until its chunks are numbered
    plain = inner.where("route = 'text'").select("path", "position", *[F.lit(None).cast(k).alias(c) for c, k in none.items()], F.inline(tx.chunk_pieces(F.col("body"))))
    cut = structure.chunk_pages(inner.where("route = 'html'").select(marked.alias("name"), "body"), "name", "body")
    paper = cut.select(F.substring_index("name", "\n", 1).cast("int").alias("position"), F.expr("substring(name, instr(name, '\n') + 1)").alias("path"), "chunk_index", "text", "section_heading", F.lit(None).cast("int").alias("page_number"), "content_type")
    out = out.unionByName(_numbered(plain.unionByName(paper), "position"))
    out = out.unionByName(converted(of("facts").select("path", body.alias("text")), facts) if facts else paged(of("facts"), ("sec_text", "sec_table")))
    if extract:
        found = pages(of("pdf"), extract, recognise).where("content_type is not null")
        cut = found.select("path", "page_number", "content_type", F.inline(tx.chunk_pieces(F.col("text"))))
        out = out.unionByName(_numbered(cut.withColumn("section_heading", F.lit(None).cast("string")), "page_number"))
    return out


def _numbered(parts: DataFrame, part: str) -> DataFrame:
    """Chunks of files' parts as chunks of the files: numbered in the order of the parts and of the chunks within."""
    number = F.row_number().over(Window.partitionBy("path").orderBy(part, "chunk_index")) - 1
    return parts.withColumn("chunk_index", number).select("path", "chunk_index", "text", "section_heading", "page_number", "content_type")


def _part(file_hash: Column) -> Column:
    return F.concat(F.lit("h"), F.substring(file_hash, 1, 2))  # the letter keeps Spark from reading parts as numbers


def once_by_part(contents: DataFrame, held: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """``(file_hash, content, part)`` of contents (file_hash, content), each hash once and a part's rows together; without hashes in ``held``, of those in ``only``.

    Hashes are dealt among the contents and grouped with them, so a content is moved once, whatever it is compared with. Contents have few copies
    or none: all of a hash come to one task.
    """
    kind = contents.schema["content"].dataType
    rows = contents.select("file_hash", "content", F.lit("given").alias("of"))
    for name, hashes in (("held", held), ("only", only)):
        if hashes is not None:
            rows = rows.unionByName(hashes.select("file_hash", F.lit(None).cast(kind).alias("content"), F.lit(name).alias("of")))
    is_in = lambda name: F.max(F.col("of") == name)
    found = rows.withColumn("part", _part(F.col("file_hash"))).repartition("part").groupBy("part", "file_hash").agg(F.first("content", ignorenulls=True).alias("content"), *[is_in(n).alias(n) for n in ("given", "held", "only")])
    found = found.where("given and not held" if only is None else "given and not held and only")
    return found.select("file_hash", "content", "part")


def archive(contents: DataFrame, folder: str, only: DataFrame | None = None) -> None:
    """Add contents (file_hash, content) to an archive by content, what it holds already is not written again, copies once. With ``only``, contents of few copies, of these hashes."""
    spark, held = contents.sparkSession, None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        parts = [r[0] for r in contents.select(_part(F.col("file_hash"))).distinct().collect()]  # 256 at most
        held = spark.read.parquet(folder).where(F.col("part").isin(parts)).select("file_hash")
    if only is None:  # a large group of copies comes to no task whole: each task drops its own before they are dealt
        contents = contents.select("file_hash", "content").dropDuplicates(["file_hash"])
    once_by_part(contents, held, only).write.mode("append").partitionBy("part").parquet(folder)


def scaled(width: Column, height: Column, longest: int) -> tuple[Column, Column]:
    """Width and height of an image scaled down so that its long edge is at most ``longest``; one pixel at least."""
    scale = F.least(F.lit(1.0), F.lit(longest) / F.greatest(width, height))
    return tuple(F.greatest(F.lit(1), F.floor(x * scale)).cast("int") for x in (width, height))


def is_too_small(width: Column, height: Column, least: int) -> Column:
    """Whether an edge is below what a model can look at."""
    return F.least(width, height) < least


def is_text_image(chars: Column, confidence: Column) -> Column:
    return (chars >= TEXT_IMAGE) & (confidence >= TEXT_CONFIDENCE)


def image_chunks(analyses: DataFrame) -> DataFrame:
    """``(image_id, text, content_type)`` from analyses (image_id, kind, text, description): the text of a text image, the description of a scene, nothing if that is blank."""
    text = tx.strip(F.when(F.col("kind") == "text", F.col("text")).when(F.col("kind") == "scene", F.col("description")))
    kind = F.when(F.col("kind") == "text", "image_ocr").otherwise("image_description")
    return analyses.select("image_id", text.alias("text"), kind.alias("content_type")).where("text <> ''")
