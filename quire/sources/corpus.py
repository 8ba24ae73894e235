"""The corpus: typed tables of documents, summaries, images, chunks, findings, tags and logs.

A corpus on disk is a folder of Parquet tables; ``chunks`` is partitioned by
``source_kind``. ``from_testdata`` makes one from the driver's tables, every value a pure
function of ids.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.functions import text as tx
from quire.operators import fts

SCHEMA_VERSION = 10
#: Columns of each table.
SCHEMAS = {
    "meta": "key string, value string",
    "ingests": "run_id long, started_at timestamp, finished_at timestamp, config_json string, engine_version string, schema_version int",
    "documents": "document_id long, file_hash string, file_name string, file_path string, page_count int, token_count long, created_at timestamp, ingest_run_id long, parent_document_id long, anchor_id string, section_title string, section_order int",
    "summaries": "summary_id long, document_id long, title string, description string, text string, model string, authored_date string, created_at timestamp, ingest_run_id long",
    "sessions": "session_id long, name string, memory_enabled boolean, model string, harness string, created_at timestamp, ended_at timestamp, run_key string",
    "findings": "finding_id long, session_id long, title string, description string, body string, created_at timestamp",
    "images": "image_id long, file_hash string, file_path string, width int, height int, analysis_json string, analysis_model string, created_at timestamp",
    "document_images": "document_id long, image_id long, page_number int, image_index_on_page int",
    "chunks": "chunk_id long, source_kind string, source_id long, chunk_index int, text string, section_heading string, page_number int, content_type string, created_at timestamp, ingest_run_id long",
    "embeddings": "chunk_id long, embedding array<float>",
    "finding_citations": "finding_id long, chunk_id long",
    "audit_logs": "audit_log_id long, session_id long, tool_name string, args_json string, result_summary string, duration_ms long, created_at timestamp",
    "tags": "tag_id long, name string, description string, value_type string, pattern string, created_at timestamp",
    "document_tags": "document_id long, tag_id long, value string, chunk_id long, created_at timestamp",
    "failed_ingests": "file_hash string, file_name string, stage string, error string, attempts int, last_attempt timestamp",
}
#: The tables of the full-text index.
INDEX = ("postings", "index_stats", "grams")
KINDS = ["document", "summary", "image", "finding"]
STAGES = ["parse", "caption", "summary"]
#: Room for the chunks of one source in chunk numbers.
CHUNK_ROOM = 100_000
#: Numbers of the test corpus's images without a description begin here.
BARE_IMAGES = 1_000_000
#: The tags of the test corpus.
TAGS = [
    (1, "quality", "good prose", None, None),
    (2, "toxic", "hurtful words", None, None),
    (3, "lang_en", "English", None, None),
    (4, "lang_fr", "French", None, None),
    (5, "lang_de", "German", None, None),
    (6, "lang_es", "Spanish", None, None),
    (7, "ipv4", "an address", "string", r"(?P<value>\d+\.\d+\.\d+\.\d+)"),
    (8, "token", "a secret", "string", r'token = "(?P<value>[0-9a-f]{40})"'),
    (9, "digits", "a number", "number", r"(?P<value>\d[\d,]*)"),
    (10, "unused", "nothing has it", None, None),
]


class Later:
    """A table that is made when it is first asked for, and once."""

    def __init__(self, make):
        self._make, self._table, self._lock = make, None, threading.RLock()

    def __call__(self) -> DataFrame:
        with self._lock:
            if self._table is None:
                self._table = self._make()
            return self._table


@dataclass(frozen=True, repr=False)
class Corpus:
    """Each table is a frame, or a ``Later`` that gives one: who reads a table gets the frame, and tables that nobody reads are never made."""

    documents: DataFrame
    summaries: DataFrame
    sessions: DataFrame
    findings: DataFrame
    images: DataFrame
    document_images: DataFrame
    chunks: DataFrame
    embeddings: DataFrame
    finding_citations: DataFrame
    audit_logs: DataFrame
    tags: DataFrame
    document_tags: DataFrame
    failed_ingests: DataFrame
    #: The full-text index of ``chunks`` (see operators.fts) where it has been built.
    postings: DataFrame | None = None
    index_stats: DataFrame | None = None
    #: The trigram index of ``chunks`` (see operators.grams) where it has been built.
    grams: DataFrame | None = None

    def __getattribute__(self, name: str):
        value = object.__getattribute__(self, name)
        return value() if isinstance(value, Later) else value

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession

    def has(self, name: str) -> bool:
        """Whether there is such a table; it is not made for that."""
        return vars(self)[name] is not None

    def with_tables(self, **tables: DataFrame) -> Corpus:
        """The corpus with some tables replaced; other chunks leave it without an index until one is given."""
        if "chunks" in tables:
            tables = dict.fromkeys(INDEX) | tables
        return Corpus(**vars(self) | tables)

    def index(self) -> tuple[DataFrame, DataFrame]:
        """Postings and statistics: the stored ones, else a plan that derives them from the chunks."""
        if self.postings is not None:
            return self.postings, self.index_stats
        table = fts.postings(self.chunks)
        return table, fts.statistics(self.chunks, table)


def chunk_id(kind: str, source_id, index) -> F.Column:
    """A chunk's number: a function of its kind, source and index, so that no global counter is needed. A source with more than CHUNK_ROOM chunks ends the job with an error."""
    number = ((source_id.cast("long") * len(KINDS) + KINDS.index(kind)) * CHUNK_ROOM + index + 1).cast("long")
    return F.when(index >= CHUNK_ROOM, F.raise_error(F.concat(F.lit(f"more than {CHUNK_ROOM} chunks: {kind} "), source_id.cast("string"))).cast("long")).otherwise(number)


def create(spark: SparkSession, folder: str, meta: dict[str, str] | None = None) -> None:
    """Empty tables; ``meta`` last, so that a folder without it is no corpus."""
    for name, schema in SCHEMAS.items():
        if name != "meta":
            spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")
    rows = {"schema_version": str(SCHEMA_VERSION)} | (meta or {})
    spark.createDataFrame(sorted(rows.items()), SCHEMAS["meta"]).coalesce(1).write.parquet(f"{folder}/meta")


def save(corpus: Corpus, folder: str, meta: dict[str, str] | None = None) -> None:
    """All tables and the full-text index, with ``meta`` last: a folder without it is no corpus, so a save that failed is none."""
    for f in fields(Corpus):
        if f.name not in INDEX:
            w = getattr(corpus, f.name).write
            (w.partitionBy("source_kind") if f.name == "chunks" else w).parquet(f"{folder}/{f.name}")
    for name, table in zip(INDEX, indexed(corpus, lambda name, df: df).index()):
        table.write.parquet(f"{folder}/{name}")
    corpus.spark.createDataFrame(sorted(({"schema_version": str(SCHEMA_VERSION)} | (meta or {})).items()), SCHEMAS["meta"]).coalesce(1).write.parquet(f"{folder}/meta")


def open_corpus(spark: SparkSession, folder: str) -> Corpus:
    """The tables of a folder; refused if its schema version is another than this code's."""
    from pyspark.errors import AnalysisException

    try:
        meta = {r["key"]: r["value"] for r in spark.read.schema(SCHEMAS["meta"]).parquet(f"{folder}/meta").collect()}
    except AnalysisException as missing:
        raise EngineError("NO_ACTIVE_PROJECT", f"{folder} holds no corpus") from missing
    if meta.get("schema_version") != str(SCHEMA_VERSION):
        raise EngineError("SCHEMA_MISMATCH", f"corpus has schema {meta.get('schema_version')}, this code {SCHEMA_VERSION}")
    tables = {f.name: spark.read.schema(SCHEMAS[f.name]).parquet(f"{folder}/{f.name}") for f in fields(Corpus) if f.name not in INDEX}
    try:  # a corpus that was only created has none yet
        tables |= {name: spark.read.parquet(f"{folder}/{name}") for name in ("postings", "index_stats")}
    except AnalysisException:
        pass
    return Corpus(**tables)


def indexed(corpus: Corpus, store) -> Corpus:
    """The corpus with a full-text index; ``store(name, frame)`` writes its tables, when they are first read, and gives them back."""
    if corpus.has("postings"):
        return corpus
    table = Later(lambda: store("postings", fts.in_order(fts.postings(fts.dealt(corpus.chunks)), dealt=True)))
    return corpus.with_tables(postings=table, index_stats=Later(lambda: store("index_stats", fts.statistics(corpus.chunks, table()))))


def upgrade(table: DataFrame, name: str) -> DataFrame:
    """An older table with the columns that this version adds, as nulls."""
    want = table.sparkSession.createDataFrame([], SCHEMAS[name])
    return want.unionByName(table, allowMissingColumns=True)


def _day(start: str, days) -> F.Column:
    return F.date_format(F.date_add(F.lit(start).cast("date"), days.cast("int")), "yyyy-MM-dd")


def spread(df: DataFrame) -> DataFrame:
    """A table of few parts dealt to as many tasks as run at once, since chunking costs more than moving so little."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def from_testdata(spark: SparkSession, sf_dir: str, store=lambda name, df: df) -> Corpus:
    """The corpus of the driver's tables; ``store(name, frame)`` may write the derived tables that others are derived from, each when it is first read."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    raw, labels, turns, bench, events = (read(t) for t in ("documents", "labels", "conversations", "benchmark", "events"))
    d = F.col("doc_id")
    dated = F.when(d % 41 == 0, "2024-13-40").when(d % 7 == 0, "nodate").otherwise(_day("2019-01-01", d % 2000))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    documents = raw.select(
        d.alias("document_id"), digest.alias("file_hash"),
        F.concat("source", F.lit("__"), dated, F.lit("__"), "lang", F.lit("_"), F.lpad(d.cast("string"), 6, "0"), F.lit(".txt")).alias("file_name"),
        F.concat(F.lit("/archive/"), digest, F.lit("/"), digest, F.lit(".txt")).alias("file_path"),
        F.ceil(F.col("n_chars") / 3000).cast("int").alias("page_count"), F.expr("n_chars div 4").alias("token_count"),
        F.when((d % 50).isin(1, 2, 3), d - d % 50).alias("parent_document_id"),
    )
    stub = F.col("toxic") == 1
    summaries = labels.join(raw, "doc_id").select(
        (d + 1).alias("summary_id"), d.alias("document_id"),
        *[F.when(stub, "").otherwise(F.substring("text", 1, n)).alias(c) for c, n in (("title", 60), ("description", 200), ("text", 400))],
        F.when(stub, "backfill").otherwise("test").alias("model"), F.when(d % 5 != 0, _day("2015-01-01", d * 13 % 3650)).alias("authored_date"),
    )
    said = turns.where("role = 'assistant'")
    conv, turn = F.col("conv_id"), F.col("turn")
    cited = chunk_id("document", (conv * 31 + turn) % 600, F.lit(0))
    body = F.concat("text", F.lit(" [^chunk:"), cited.cast("string"), F.lit("] [^finding:"), ((conv + 1) * 1000 + turn).cast("string"), F.lit("] [^url:https://example.org/"), conv.cast("string"), F.lit("]"), F.when(conv % 10 == 0, " [3] [^document:9] [^ftp:x]").otherwise(""))
    findings = said.select((conv * 1000 + turn).alias("finding_id"), conv.alias("session_id"), F.substring("text", 1, 40).alias("title"), F.lit(None).cast("string").alias("description"), body.alias("body"), "text")
    sessions = turns.select("conv_id").distinct().select(conv.alias("session_id"), F.concat(F.lit("run-"), conv.cast("string")).alias("name"), (conv % 3 != 0).alias("memory_enabled"), F.when(conv % 4 != 0, F.concat(F.lit("key-"), conv.cast("string"))).alias("run_key"))
    item = F.col("item_id")
    images = bench.select(item.alias("image_id"), digest.alias("file_hash"), F.to_json(F.struct(F.col("text").alias("description"))).alias("analysis_json"))
    bare = bench.where(item % 6 == 5).select((item + BARE_IMAGES).alias("image_id"), F.sha2(item.cast("string").cast("binary"), 256).alias("file_hash"), F.lit(None).cast("string").alias("analysis_json"))
    images = images.unionByName(bare)  # further images that nobody has described yet
    count = bench.agg(F.count("*").alias("n_images"))
    links = raw.where(d % 10 == 3).crossJoin(F.broadcast(count)).select(d.alias("document_id"), (d % F.col("n_images")).alias("image_id"), F.when(d % 4 != 0, d % 9 + 1).cast("int").alias("page_number"), F.lit(1).alias("image_index_on_page"))  # the count is one row
    links = links.unionByName(links.where("image_id % 6 = 5").withColumns({"image_id": F.col("image_id") + BARE_IMAGES, "image_index_on_page": F.lit(2)}))
    none = F.lit(None).cast("string")

    def as_chunks(df: DataFrame, kind: str, source, index, text, heading=none, page=F.lit(None).cast("int"), content=none) -> DataFrame:
        return df.select(chunk_id(kind, source, index).alias("chunk_id"), F.lit(kind).alias("source_kind"), source.cast("long").alias("source_id"), index.cast("int").alias("chunk_index"), text.alias("text"), heading.alias("section_heading"), page.cast("int").alias("page_number"), content.alias("content_type"))

    def all_chunks() -> DataFrame:
        i = F.col("chunk_index")
        pieces = spread(raw.select("doc_id", "lang", "text")).select("doc_id", "lang", F.inline(tx.chunk_pieces(F.col("text"))))
        by_lang = F.when(F.col("lang") == "fr", "ocr").when(F.col("lang") == "de", "text").when(F.col("lang") == "es", "sec_text")
        chunks = as_chunks(pieces, "document", d, i, F.col("text"), F.when(i % 4 == 0, F.concat(F.lit("Appendix "), F.expr("chunk_index div 4").cast("string"))), F.expr("chunk_index div 4 + 1"), by_lang)
        chunks = chunks.unionByName(as_chunks(summaries.where("model <> 'backfill'"), "summary", F.col("summary_id"), F.lit(0), F.col("text")))
        chunks = chunks.unionByName(as_chunks(bench, "image", item, F.lit(0), F.col("text"), content=F.when(item % 2 == 0, "image_ocr").otherwise("image_description")))
        chunks = chunks.unionByName(as_chunks(findings.select("finding_id", F.inline(tx.chunk_pieces(F.col("text")))), "finding", F.col("finding_id"), i, F.col("text")))
        return store("chunks", chunks)

    chunks = Later(all_chunks)
    embeddings = read("embeddings").select(chunk_id("document", F.col("vec_id"), F.lit(0)).alias("chunk_id"), "embedding")
    tags = spark.createDataFrame(TAGS, "tag_id long, name string, description string, value_type string, pattern string")
    flat = F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("chunk_id")
    by_label = labels.select(d.alias("document_id"), F.explode(F.array_compact(F.array(F.when(F.col("quality") == 1, 1), F.when(stub, 2))).cast("array<bigint>")).alias("tag_id"), *flat)
    by_lang_tag = raw.select(d.alias("document_id"), F.when(F.col("lang") == "en", 3).when(F.col("lang") == "fr", 4).when(F.col("lang") == "de", 5).when(F.col("lang") == "es", 6).cast("long").alias("tag_id"), *flat).where("tag_id is not null")
    from quire.operators.citations import edges
    from quire.operators.tags import extract_values

    def all_tags() -> DataFrame:
        doc_chunks = chunks().where("source_kind = 'document'").select(F.col("source_id").alias("document_id"), "chunk_id", "chunk_index", "text")
        valued = [extract_values(doc_chunks, t[4], t[3])["stored"].select("document_id", F.lit(t[0]).cast("long").alias("tag_id"), "value", "chunk_id") for t in TAGS if t[3]]
        document_tags = by_label.unionByName(by_lang_tag)
        for v in valued:
            document_tags = document_tags.unionByName(v)
        return store("document_tags", document_tags)

    logs = events.select(F.col("event_id").alias("audit_log_id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("tool_name"), F.col("props").alias("args_json"), (F.col("value") * 10).cast("long").alias("duration_ms"), F.col("ts").alias("created_at"))
    stage = F.element_at(F.array(*map(F.lit, STAGES)), (F.col("event_id") % 3 + 1).cast("int"))
    failed = events.where("event_type = 'error'").groupBy(F.col("user_id").cast("string").alias("file_hash"), stage.alias("stage")).agg(F.count("*").cast("int").alias("attempts"), F.max("props").alias("error"), F.max("ts").alias("last_attempt"))
    citations = Later(lambda: edges(findings).join(chunks().select("chunk_id"), "chunk_id", "left_semi").select("finding_id", "chunk_id"))
    return Corpus(documents, summaries, sessions, findings.drop("text"), images, links, chunks, embeddings, citations, logs, tags, Later(all_tags), failed)
