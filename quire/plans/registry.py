"""Named queries with production parameters, and the SQL that states the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import benchmark, citations, curation, integrity, profile, reads, scan, scope, search, tags, views
from quire.plans import changed
from quire.plans.adapter_sql import cid, holds, statement
from quire.sources import corpus as c
from quire.sources import artifacts, files, filings, share, structure, tables
from quire.streaming import ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


_open: dict[tuple[str, str], c.Corpus] = {}


def corpus_of(spark: SparkSession, sf_dir: str) -> c.Corpus:
    """The test corpus of a folder, made once a session: chunks, tags and the full-text index are written to the shared folder, and queries read them there."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _open:
        store = tables.store_of(spark, sf_dir)
        _open[key] = c.indexed(c.from_testdata(spark, sf_dir, store), store)
    return _open[key]


def query(name: str, sql: str | None = None, *parts: str):
    """Register a function of a corpus (with ``raw`` in its name's place: of spark and sf_dir)."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(corpus_of(spark, sf_dir))
        if sql:
            ORACLES[name] = statement(sql, *parts)
        return fn

    return add


def raw_query(name: str, sql: str | None = None, *parts: str):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = statement(sql, *parts)
        return fn

    return add


def everything(corpus: c.Corpus) -> scope.Scope:
    return scope.resolve(corpus)


# ---- chunks and scans

query("chunk_text", "SELECT chunk_id, source_id, chunk_index, text FROM c_chunks WHERE source_kind = 'document'", "c_chunks")(
    lambda k: k.chunks.where("source_kind = 'document'").select("chunk_id", "source_id", "chunk_index", "text"))

_SCAN = """SELECT source_id AS document_id, chunk_id, chunk_index, file_name, authored_date, page_number, section_heading,
    {text} AS text, CAST(length(t.text) AS INTEGER) AS text_length
    FROM c_tokens t JOIN c_documents d ON source_id = d.document_id LEFT JOIN c_summaries s ON source_id = s.document_id WHERE source_kind = 'document' AND {where}"""
_SHOWN = "CASE WHEN length(t.text) > 200 THEN substring(t.text, 1, 200) || '…' ELSE t.text END"


def _scan_sql(where: str, tail: str = "") -> str:
    return statement(_SCAN.format(text=_SHOWN, where=where) + tail, "c_tokens", "c_documents", "c_summaries")


def _scan(corpus: c.Corpus, q: str, where: scope.Scope | None = None, **filters) -> DataFrame:
    """All rows of a scan, texts as previews."""
    found = scan.matches(corpus, q, where or everything(corpus), **filters)
    return found.withColumn("text", tx.preview(F.col("text"), tx.PREVIEW_CHARS)).select(*scan.ALL)


query("scan_phrase")(lambda k: scan.ordered(_scan(k, "MIT License")))
query("scan_terms")(lambda k: scan.ordered(_scan(k, "that with", mode="terms")))
query("scan_heading_like")(lambda k: _scan(k, "that", heading_like=["appendix 1%"]))
query("scan_body_matches")(lambda k: _scan(k, "the", body_matches=r"/\d+\.\d+\.\d+\.\d+/"))
query("scan_sort_date")(lambda k: scan.rows(k, "that", everything(k), sort="date", limit=40))
query("scan_page")(lambda k: scan.rows(k, "that", everything(k), limit=20, offset=40))
query("scan_tag_scope")(lambda k: _scan(k, "that", scope.resolve(k, tags=["lang_fr", "toxic"])))
ORACLES |= {
    "scan_phrase": _scan_sql(holds("mit license")),
    "scan_terms": _scan_sql(f"{holds('that')} AND {holds('with')}"),
    "scan_heading_like": _scan_sql(f"{holds('that')} AND section_heading ILIKE 'appendix 1%'"),
    "scan_body_matches": _scan_sql(holds("the") + r" AND regexp_matches(t.text, '\d+\.\d+\.\d+\.\d+')"),
    "scan_sort_date": _scan_sql(holds("that"), " ORDER BY authored_date ASC NULLS LAST, document_id, chunk_index LIMIT 40"),
    "scan_page": _scan_sql(holds("that"), " ORDER BY document_id, chunk_index LIMIT 20 OFFSET 40"),
    "scan_tag_scope": statement(_SCAN.format(text=_SHOWN, where=holds("that") + " AND source_id IN (SELECT document_id FROM c_document_tags WHERE tag_id IN (2, 4))"), "c_tokens", "c_documents", "c_summaries", "c_document_tags"),
}
query("scan_total", f"SELECT count(*) AS total, count(DISTINCT source_id) AS documents FROM c_tokens WHERE source_kind = 'document' AND {holds('that')}", "c_tokens")(
    lambda k: scan.total(k, "that", everything(k)))
query("scan_count_by_document", f"SELECT source_id AS document_id, file_name, count(*) AS n, min(chunk_id) AS chunk_id FROM c_tokens JOIN c_documents ON source_id = document_id WHERE source_kind = 'document' AND {holds('that')} GROUP BY ALL", "c_tokens", "c_documents")(
    lambda k: scan.count_by_document(k, "that", everything(k)))
query("scan_count_by_regex", rf"SELECT value, count(*) AS n, false AS truncated FROM (SELECT unnest(regexp_extract_all(text, '(\d+)\.\d+\.\d+\.\d+', 1)) AS value FROM c_tokens WHERE source_kind = 'document' AND {holds('the')}) GROUP BY value", "c_tokens")(
    lambda k: scan.count_by_regex(k, "the", r"/(\d+)\.\d+\.\d+\.\d+/", everything(k)))
query("scan_count_by_file_name", "SELECT nullif(regexp_extract(file_name, '^(src\\d+)_', 1), '') AS value, count(*) AS n FROM c_documents GROUP BY 1", "c_documents")(
    lambda k: scan.count_by_file_name(k, r"file_name:/^(src\d+)_/"))
query("scan_extract", rf"SELECT source_id AS document_id, chunk_id, chunk_index, file_name, nullif(regexp_extract(text, '(\d+\.\d+)\.(\d+\.\d+)', 1), '') AS net, nullif(regexp_extract(text, '(\d+\.\d+)\.(\d+\.\d+)', 2), '') AS host FROM c_tokens JOIN c_documents ON source_id = document_id WHERE source_kind = 'document' AND {holds('the')}", "c_tokens", "c_documents")(
    lambda k: scan.extract(k, "the", [r"/(?P<net>\d+\.\d+)\.(?P<host>\d+\.\d+)/"], everything(k)))
query("scan_diagnosis", "SELECT count_if(b AND p) AS matched, count_if(b) AS in_scope, count_if(b) AS anywhere, count_if(h) AS in_headings, CASE WHEN count_if(b AND p) > 0 THEN 'found' WHEN count_if(b) > 0 THEN 'filtered_out' WHEN count_if(h) > 0 THEN 'heading_only' ELSE 'absent' END AS verdict FROM (SELECT " + holds("appendix") + " AS b, coalesce(section_heading ILIKE 'part%', false) AS p, " + holds("appendix", "head") + " AS h FROM c_tokens WHERE source_kind = 'document')", "c_tokens")(
    lambda k: scan.diagnosis(k, "appendix", everything(k), heading_like=["part%"]))

# ---- scopes


def _scope_sql(where: str) -> str:
    return statement(f"SELECT d.document_id FROM c_documents d LEFT JOIN c_summaries s ON d.document_id = s.document_id WHERE {where}", "c_documents", "c_summaries", "c_document_tags")


_IN_DATES = "authored_date >= '2016-01-01' AND authored_date <= '2020-12-31'"
_TAGGED = "d.document_id IN (SELECT document_id FROM c_document_tags WHERE tag_id IN (1, 7))"
query("scope_tag")(lambda k: scope.resolve(k, tags=["quality", "ipv4"]).ids)
query("scope_in_documents")(lambda k: scope.resolve(k, in_documents=[*range(1, 51), 10**9]).ids)
query("scope_file_like")(lambda k: scope.resolve(k, file_like=["src1%", "%_DE_%"]).ids)
query("scope_dates")(lambda k: scope.resolve(k, date_from="2016-01-01", date_to="2020-12-31").ids)
query("scope_dates_include_nulls")(lambda k: scope.resolve(k, date_from="2016-01-01", date_to="2020-12-31", include_nulls=True).ids)
query("scope_all")(lambda k: scope.resolve(k, tags=["quality", "ipv4"], file_like=["src1%"], date_from="2016-01-01", date_to="2020-12-31").ids)
query("scope_excluded_null_dated", "SELECT count(*) AS excluded_null_dated FROM c_documents d LEFT JOIN c_summaries s ON d.document_id = s.document_id WHERE authored_date IS NULL AND file_name ILIKE 'src1%'", "c_documents", "c_summaries")(
    lambda k: scope.resolve(k, file_like=["src1%"], date_from="2016-01-01").excluded_null_dated)
ORACLES |= {
    "scope_tag": _scope_sql(_TAGGED),
    "scope_in_documents": _scope_sql("d.document_id BETWEEN 1 AND 50"),
    "scope_file_like": _scope_sql("file_name ILIKE 'src1%' OR file_name ILIKE '%_DE_%'"),
    "scope_dates": _scope_sql(_IN_DATES),
    "scope_dates_include_nulls": _scope_sql(f"authored_date IS NULL OR ({_IN_DATES})"),
    "scope_all": _scope_sql(f"{_TAGGED} AND file_name ILIKE 'src1%' AND {_IN_DATES}"),
}
query("scope_chunks", "SELECT source_kind, count(*) AS n FROM c_chunks WHERE (source_kind = 'document' AND source_id BETWEEN 1 AND 60) OR (source_kind = 'summary' AND source_id BETWEEN 2 AND 61) OR (source_kind = 'image' AND source_id IN (SELECT image_id FROM c_links WHERE document_id BETWEEN 1 AND 60)) GROUP BY 1", "c_chunks", "c_links")(
    lambda k: scope.chunks_in(k, scope.resolve(k, in_documents=list(range(1, 61))), c.KINDS).groupBy("source_kind").agg(F.count("*").alias("n")))
query("memory_wall", "SELECT chunk_id, source_kind FROM c_chunks WHERE source_kind <> 'finding' OR source_id IN (SELECT finding_id FROM c_findings WHERE session_id = 3)", "c_chunks", "c_findings")(
    lambda k: scope.memory_wall(k, k.chunks, 3).select("chunk_id", "source_kind"))

# ---- retrieval


def _bm25_sql(terms: list[str], where: str, k: int) -> str:
    """Scores of chunks that hold all phrases (tokens parted by blanks), against statistics of the whole index."""
    parts = [f"ln_idf{i} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms))]
    idf = ", ".join(f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END AS ln_idf{i}" for i in range(len(terms)))
    n = ", ".join(f"count_if({holds(t)}) AS n{i}" for i, t in enumerate(terms))
    starts = lambda t: " AND ".join(f"tok[p + {j}] = '{x}'" for j, x in enumerate(t.split()))
    f = ", ".join(f"CAST(len(list_filter(range(1, len(tok) + 1), lambda p: {starts(t)})) AS DOUBLE) AS f{i}" for i, t in enumerate(terms))
    held = " AND ".join(holds(t) for t in terms)
    return f"""fts AS (SELECT chunk_id, {" + ".join(parts)} AS score FROM (SELECT chunk_id, len(tok) + len(head) AS dl, {f} FROM c_tokens WHERE {held} AND {where}) hit,
        (SELECT avgdl, {idf} FROM (SELECT count(*) AS n, CAST(sum(len(tok) + len(head)) AS DOUBLE) / count(*) AS avgdl, {n} FROM c_tokens)) st ORDER BY score DESC, chunk_id LIMIT {k})"""


_QVEC = "(SELECT embedding FROM c_embeddings WHERE chunk_id = 1)"
_DIST = f"sqrt(list_sum(list_transform(list_zip(embedding, {_QVEC}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def _knn_sql(where: str, k: int) -> str:
    return f"vec AS (SELECT chunk_id, {_DIST} AS distance FROM c_embeddings WHERE chunk_id IN (SELECT chunk_id FROM c_chunks WHERE {where}) ORDER BY distance, chunk_id LIMIT {k})"


_FUSED = """ranks AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r, 'f' AS leg FROM fts UNION ALL SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id), 'v' FROM vec),
    fused AS (SELECT chunk_id, sum(1.0 / (60 + r)::DOUBLE) AS score, min(CASE WHEN leg = 'f' THEN r END) AS fr, min(CASE WHEN leg = 'v' THEN r END) AS vr FROM ranks GROUP BY chunk_id ORDER BY score DESC, fr NULLS LAST, vr NULLS LAST LIMIT 20),
    hits AS (SELECT *, row_number() OVER (ORDER BY score DESC, fr NULLS LAST, vr NULLS LAST) AS rank FROM fused)"""


def _more(ctes: str, body: str, *parts: str) -> str:
    return statement("", *parts).rstrip() + ",\n" + ctes + "\n" + body


def first_vector(corpus: c.Corpus) -> list[float]:
    """The query vector of the tests: that of the first document's first chunk."""
    return [float(x) for x in corpus.embeddings.where("chunk_id = 1").first()["embedding"]]


_DI = "source_kind IN ('document', 'image')"
query("bm25_topk")(lambda k: search.full_text(k, "that with", everything(k), search.DEFAULT_KINDS, 100).withColumn("score", F.round("score", 6)))
query("bm25_phrase")(lambda k: search.full_text(k, "MIT-License under-the", everything(k), c.KINDS, 100).withColumn("score", F.round("score", 6)))
query("bm25_in_scope")(lambda k: search.full_text(k, "that", scope.resolve(k, file_like=["src1%"]), ["document"], 100).withColumn("score", F.round("score", 6)))
query("knn_topk")(lambda k: search.nearest(k, first_vector(k), everything(k), search.DEFAULT_KINDS, 100).withColumn("distance", F.round("distance", 6)))
query("knn_in_scope")(lambda k: search.nearest(k, first_vector(k), scope.resolve(k, in_documents=list(range(300, 400))), ["document"], 50).withColumn("distance", F.round("distance", 6)))
_LEGS = _bm25_sql(["that"], _DI, 100) + ", " + _knn_sql(_DI, 100) + ", " + _FUSED
query("rrf_fuse")(lambda k: search.fuse(search.full_text(k, "that", everything(k), search.DEFAULT_KINDS, 100), search.nearest(k, first_vector(k), everything(k), search.DEFAULT_KINDS, 100), 20).select("chunk_id", "rank", F.round("score", 6).alias("score")))
query("search_hybrid")(lambda k: search.search(k, "that", everything(k), first_vector(k), limit=20, brief=True).withColumn("score", F.round("score", 6)).withColumn("normalized_score", F.round("normalized_score", 6)))
query("search_context")(lambda k: search.with_context(k, search.fuse(search.full_text(k, "that", everything(k), search.DEFAULT_KINDS, 100), None, 20), 2))
query("search_memory_off")(lambda k: search.search(k, "that", everything(k), first_vector(k), kinds=c.KINDS, limit=20, session_id=3).select("rank", "chunk_id", "source_kind"))
query("search_semantic")(lambda k: search.search(k, "that", everything(k), first_vector(k), limit=20, modes=["semantic"]).select("rank", "chunk_id", F.round("score", 6).alias("score")))
query("full_text_behind_wall")(lambda k: search.full_text(k, "that", everything(k), ["finding"], 100, session_id=3).withColumn("score", F.round("score", 6)))
query("read_chunks_behind_wall")(lambda k: reads.by_ids(k, _FINDING_CHUNKS, session_id=3).select("chunk_id", "position", "found"))
query("cosine_similar")(lambda k: tags.most_similar(k.embeddings, first_vector(k), threshold=0.3).withColumn("similarity", F.round("similarity", 6)))
#: The first chunks of findings of two sessions, and a document's.
_FINDING_CHUNKS = [(3001 * 4 + 3) * c.CHUNK_ROOM + 1, (4001 * 4 + 3) * c.CHUNK_ROOM + 1, 2 * 4 * c.CHUNK_ROOM + 1, 7]
_NAMES = """names AS (SELECT 'document' AS source_kind, document_id AS source_id, file_name AS source_name FROM c_documents
    UNION ALL SELECT 'summary', summary_id, 'summary of ' || file_name FROM c_summaries JOIN c_documents USING (document_id)
    UNION ALL SELECT 'finding', finding_id, title FROM c_findings
    UNION ALL SELECT 'image', image_id, 'image in ' || file_name || CASE WHEN a.p IS NOT NULL THEN ', p.' || a.p ELSE '' END || CASE WHEN others > 0 THEN ' (+' || others || ' other docs)' ELSE '' END
      FROM (SELECT image_id, min(document_id) AS d, arg_min_null(page_number, document_id) AS p, count(DISTINCT document_id) - 1 AS others FROM c_links GROUP BY image_id) a JOIN c_documents ON document_id = a.d)"""
ORACLES |= {
    "bm25_topk": _more(_bm25_sql(["that", "with"], _DI, 100), "SELECT chunk_id, round(score, 6) AS score FROM fts", "c_tokens"),
    "bm25_phrase": _more(_bm25_sql(["mit license", "under the"], "true", 100), "SELECT chunk_id, round(score, 6) AS score FROM fts", "c_tokens"),
    "bm25_in_scope": _more(_bm25_sql(["that"], "source_kind = 'document' AND source_id IN (SELECT document_id FROM c_documents WHERE file_name ILIKE 'src1%')", 100), "SELECT chunk_id, round(score, 6) AS score FROM fts", "c_tokens", "c_documents"),
    "knn_topk": _more(_knn_sql(_DI, 100), "SELECT chunk_id, round(distance, 6) AS distance FROM vec", "c_embeddings", "c_chunks"),
    "knn_in_scope": _more(_knn_sql("source_kind = 'document' AND source_id BETWEEN 300 AND 399", 50), "SELECT chunk_id, round(distance, 6) AS distance FROM vec", "c_embeddings", "c_chunks"),
    "rrf_fuse": _more(_LEGS, "SELECT chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM hits", "c_tokens", "c_embeddings"),
    "search_hybrid": _more(_LEGS + ", " + _NAMES, "SELECT CAST(rank AS INTEGER) AS rank, chunk_id, source_kind, source_id, round(score, 6) AS score, round(score / max(score) OVER (), 6) AS normalized_score, source_name, page_number, CASE WHEN source_kind = 'document' THEN source_id END AS document_id, CASE WHEN length(text) > 240 THEN substring(text, 1, 240) || '…' ELSE text END AS text FROM hits JOIN c_chunks USING (chunk_id) LEFT JOIN names USING (source_kind, source_id)", "c_tokens", "c_embeddings", "c_documents", "c_summaries", "c_findings", "c_links"),
    "search_memory_off": _more(_bm25_sql(["that"], "source_kind IN ('document', 'image', 'summary')", 100) + ", " + _knn_sql("source_kind IN ('document', 'image', 'summary')", 100) + ", " + _FUSED, "SELECT CAST(rank AS INTEGER) AS rank, chunk_id, source_kind FROM hits JOIN c_chunks USING (chunk_id)", "c_tokens", "c_embeddings"),
    "search_semantic": _more(_knn_sql(_DI, 100), "SELECT CAST(r AS INTEGER) AS rank, chunk_id, round(1.0 / (60 + r)::DOUBLE, 6) AS score FROM (SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id) AS r FROM vec) WHERE r <= 20", "c_embeddings", "c_chunks"),
    "full_text_behind_wall": _more(_bm25_sql(["that"], "source_kind = 'finding' AND source_id IN (SELECT finding_id FROM c_findings WHERE session_id = 3)", 100), "SELECT chunk_id, round(score, 6) AS score FROM fts", "c_tokens", "c_findings"),
    "read_chunks_behind_wall": _more("seen AS (SELECT chunk_id FROM c_chunks WHERE source_kind <> 'finding' OR source_id IN (SELECT finding_id FROM c_findings WHERE session_id = 3))", f"SELECT CAST(x AS BIGINT) AS chunk_id, CAST(p AS INTEGER) AS position, chunk_id IS NOT NULL AS found FROM (VALUES {', '.join(f'({x}, {p})' for p, x in enumerate(_FINDING_CHUNKS))}) v(x, p) LEFT JOIN seen ON seen.chunk_id = x", "c_chunks", "c_findings"),
    "search_context": _more(_bm25_sql(["that"], _DI, 20), "SELECT h.chunk_id AS hit_id, n.chunk_id, n.chunk_index, n.chunk_index - h.chunk_index AS distance, n.text FROM fts JOIN c_chunks h USING (chunk_id) JOIN c_chunks n ON n.source_kind = h.source_kind AND n.source_id = h.source_id AND abs(n.chunk_index - h.chunk_index) <= 2", "c_tokens"),
    "cosine_similar": statement(f"SELECT chunk_id, round(s, 6) AS similarity FROM (SELECT chunk_id, list_sum(list_transform(list_zip(embedding, {_QVEC}), lambda p: p[1] * p[2])) AS s FROM c_embeddings) WHERE s >= 0.3", "c_embeddings"),
}

# ---- profile, lists, reads

query("profile_totals", "SELECT (SELECT count(*) FROM c_documents) AS documents, (SELECT CAST(sum(token_count) AS BIGINT) FROM c_documents) AS tokens, (SELECT count(*) FROM c_chunks WHERE source_kind IN ('document', 'image')) AS chunks", "c_documents", "c_chunks")(lambda k: profile.totals(k, everything(k)))
query("date_range", "SELECT min(authored_date) AS first, max(authored_date) AS last, count(authored_date) AS dated FROM c_summaries", "c_summaries")(lambda k: profile.date_range(k, everything(k)))
query("docs_by_year", "SELECT substring(authored_date, 1, 4) AS year, count(*) AS n FROM c_summaries WHERE authored_date IS NOT NULL GROUP BY 1", "c_summaries")(lambda k: profile.documents_by_year(k, everything(k)))
query("content_mix", "SELECT content_type, count(*) AS n FROM c_chunks WHERE source_kind IN ('document', 'image') GROUP BY 1", "c_chunks")(lambda k: profile.content_mix(k, everything(k)))
query("chunk_length", "SELECT quantile_disc(length(text), 0.5) AS median, quantile_disc(length(text), 0.9) AS p90, max(length(text)) AS longest FROM c_chunks WHERE source_kind = 'document'", "c_chunks")(lambda k: profile.chunk_length(k, everything(k)))
query("tag_facet", "SELECT name, count(document_id) AS n FROM c_tags LEFT JOIN c_document_tags USING (tag_id) GROUP BY name", "c_tags", "c_document_tags")(lambda k: profile.tag_facet(k, everything(k)))
query("tag_facet_slice", "SELECT name, count(*) AS n FROM c_tags JOIN c_document_tags USING (tag_id) WHERE document_id BETWEEN 1 AND 50 GROUP BY name", "c_tags", "c_document_tags")(lambda k: profile.tag_facet(k, scope.resolve(k, in_documents=list(range(1, 51)))))
query("summary_coverage", "SELECT count(s.document_id) AS summarized, count_if(s.document_id IS NULL AND d.document_id NOT IN (SELECT parent_document_id FROM c_documents WHERE parent_document_id IS NOT NULL)) AS unsummarized FROM c_documents d LEFT JOIN (SELECT document_id FROM c_summaries WHERE model <> 'backfill') s ON d.document_id = s.document_id", "c_documents", "c_summaries")(lambda k: profile.summary_coverage(k, everything(k)))
query("largest_documents", "SELECT d.document_id, file_name, CASE WHEN model <> 'backfill' THEN title END AS title, token_count FROM c_documents d LEFT JOIN c_summaries s ON d.document_id = s.document_id ORDER BY token_count DESC NULLS LAST, d.document_id LIMIT 10", "c_documents", "c_summaries")(lambda k: profile.largest(k, everything(k)))
query("chunk_counts", "SELECT source_kind, count(*) AS n FROM c_chunks GROUP BY 1", "c_chunks")(profile.chunk_counts)
_LIST = """SELECT d.document_id, file_name, CASE WHEN model <> 'backfill' THEN title END AS title, CASE WHEN model <> 'backfill' THEN description END AS description, authored_date, coalesce(model <> 'backfill', false) AS has_summary,
    page_count, token_count, coalesce(chunk_count, 0) AS chunk_count, coalesce(image_count, 0) AS image_count FROM c_documents d LEFT JOIN c_summaries s ON d.document_id = s.document_id
    LEFT JOIN (SELECT source_id, count(*) AS chunk_count FROM c_chunks WHERE source_kind = 'document' GROUP BY 1) k ON d.document_id = k.source_id LEFT JOIN (SELECT document_id, count(DISTINCT image_id) AS image_count FROM c_links GROUP BY 1) i ON d.document_id = i.document_id ORDER BY """
for _sort, _order in (("id", "d.document_id"), ("title", "lower(CASE WHEN model <> 'backfill' THEN title ELSE file_name END) , d.document_id"), ("date", "authored_date DESC NULLS LAST, d.document_id")):
    if _sort == "title":
        _order = "lower(coalesce(CASE WHEN model <> 'backfill' THEN title END, file_name)), d.document_id"
    query(f"list_documents_{_sort}", _LIST + _order + " LIMIT 50 OFFSET 10", "c_documents", "c_summaries", "c_chunks", "c_links")(lambda k, s=_sort: profile.list_documents(k, everything(k), s, 50, 10).drop("created_at"))
query("value_chips", "SELECT document_id, name, value, chunk_id FROM c_document_tags JOIN c_tags USING (tag_id) WHERE name IN ('ipv4', 'token')", "c_tags", "c_document_tags")(lambda k: profile.value_chips(k, ["ipv4", "token", "quality"]))
query("read_document_text", "SELECT source_id AS document_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS text FROM c_chunks WHERE source_kind = 'document' GROUP BY 1", "c_chunks")(reads.document_texts)
query("read_chunks_by_document", "SELECT chunk_id, chunk_index, text FROM c_chunks WHERE source_kind = 'document' AND source_id = 2 ORDER BY chunk_index LIMIT 50", "c_chunks")(lambda k: reads.by_document(k, 2).select("chunk_id", "chunk_index", "text"))
query("read_chunks_by_id", f"SELECT x AS chunk_id, p AS position, text, text IS NOT NULL AS found FROM (VALUES ({2 * 400000 + 1}, 0), (7, 1), ({5 * 400000 + 1}, 2)) v(x, p) LEFT JOIN c_chunks ON chunk_id = x", "c_chunks")(lambda k: reads.by_ids(k, [2 * 400000 + 1, 7, 5 * 400000 + 1, 7]).select("chunk_id", "position", "text", "found"))
#: A chunk with neighbours on both sides: the fourth of the first document that has seven.
_TARGET = "target AS (SELECT chunk_id, source_id, chunk_index FROM c_chunks WHERE source_kind = 'document' AND chunk_index = 3 AND source_id = (SELECT min(source_id) FROM c_chunks WHERE source_kind = 'document' AND chunk_index = 6))"


def _target(k: c.Corpus) -> int:
    document = k.chunks.where("source_kind = 'document' and chunk_index = 6").agg(F.min("source_id")).first()[0] or 0
    return document * len(c.KINDS) * c.CHUNK_ROOM + 4


ORACLES["around_chunk"] = _more(_TARGET, "SELECT t.chunk_id AS hit_id, n.chunk_id, n.chunk_index, n.chunk_index - t.chunk_index AS distance, n.text FROM c_chunks n JOIN target t ON n.source_kind = 'document' AND n.source_id = t.source_id AND n.chunk_index BETWEEN t.chunk_index - 3 AND t.chunk_index + 3", "c_chunks")
query("around_chunk")(lambda k: reads.around(k, _target(k)))
query("chunk_locations", """SELECT k.chunk_id, o.document_id, file_name, coalesce(k.page_number, o.p) AS page, authored_date FROM c_chunks k LEFT JOIN (
    SELECT 'document' AS kind, document_id AS id, document_id, CAST(NULL AS INTEGER) AS p FROM c_documents UNION ALL SELECT 'summary', summary_id, document_id, NULL FROM c_summaries
    UNION ALL SELECT 'image', image_id, min(document_id), arg_min_null(page_number, document_id) FROM c_links GROUP BY image_id) o ON o.kind = source_kind AND o.id = source_id
    LEFT JOIN c_documents d ON d.document_id = o.document_id LEFT JOIN c_summaries s ON s.document_id = o.document_id""", "c_chunks", "c_documents", "c_summaries", "c_links")(lambda k: reads.chunk_locations(k, k.chunks))
ORACLES["chunk_names"] = _more(_NAMES, "SELECT chunk_id, source_kind, source_name FROM c_chunks LEFT JOIN names USING (source_kind, source_id)", "c_chunks", "c_documents", "c_summaries", "c_findings", "c_links")
query("chunk_names")(lambda k: reads.chunk_names(k, k.chunks).select("chunk_id", "source_kind", "source_name"))
query("list_findings", "SELECT finding_id, s.name AS session_name, title, count(ci.chunk_id) AS citation_count FROM c_findings f LEFT JOIN c_sessions s USING (session_id) LEFT JOIN c_citations ci USING (finding_id) GROUP BY ALL", "c_findings", "c_sessions", "c_citations")(reads.findings_list)
query("tags_per_document", "SELECT document_id, string_agg(name || CASE WHEN value IS NOT NULL THEN '=' || value ELSE '' END, ', ' ORDER BY lower(name)) AS tags FROM c_document_tags JOIN c_tags USING (tag_id) GROUP BY 1", "c_document_tags", "c_tags")(reads.tags_per_document)
query("audit_tail", "SELECT audit_log_id, session_id, tool_name, duration_ms FROM c_logs ORDER BY audit_log_id DESC LIMIT 25", "c_logs")(lambda k: reads.audit_tail(k, 25).select("audit_log_id", "session_id", "tool_name", "duration_ms"))

# ---- citations, tags, dates

query("citation_edges", "SELECT finding_id, CAST(position AS INTEGER) AS position, chunk_id FROM c_edges", "c_edges")(lambda k: citations.edges(k.findings))
query("external_citations", r"SELECT finding_id, 0 AS position, 'url' AS scheme, regexp_extract(body, '\[\^url:([^\]]*)\]', 1) AS ref FROM c_findings", "c_findings")(lambda k: citations.external(k.findings))
query("dangling_citations", "SELECT finding_id, 'chunk' AS kind, chunk_id AS target_id FROM c_edges WHERE chunk_id NOT IN (SELECT chunk_id FROM c_chunks) UNION ALL SELECT finding_id, 'finding', linked_id FROM c_links_out WHERE linked_id NOT IN (SELECT finding_id FROM c_findings)", "c_edges", "c_chunks", "c_links_out")(lambda k: citations.dangling(k.findings, k.chunks))
query("citation_errors", r"SELECT finding_id, 'MALFORMED_CITATION' AS code FROM c_findings WHERE regexp_matches(regexp_replace(body, '\[\^[A-Za-z]+:[^\]]*\]', '', 'g'), '\[\^?\d+\]')", "c_findings")(lambda k: citations.errors(k.findings))
query("footnotes", r"SELECT finding_id, regexp_replace(regexp_replace(regexp_replace(body, '\[\^chunk:\d+\]', '[1]', 'g'), '\[\^finding:\d+\]', '†', 'g'), '\[\^url:[^\]]*\]', '‡', 'g') AS body FROM c_findings", "c_findings")(lambda k: citations.footnotes(k.findings).select("finding_id", "body"))
query("legacy_markers", r"SELECT finding_id, len(regexp_extract_all(b, '\[\^\d+\]')) AS rewritten, regexp_replace(b, '\[\^(\d+)\]', '[^chunk:\1]', 'g') AS body FROM (SELECT finding_id, replace(body, '[^chunk:', '[^') AS b FROM c_findings)", "c_findings")(lambda k: citations.legacy_markers(k.findings.withColumn("body", F.replace("body", F.lit("[^chunk:"), F.lit("[^")))).select("finding_id", "rewritten", "body"))
_NUM = r"regexp_replace(nullif(regexp_extract(text, '(\d[\d,]*)', 1), ''), ',', '', 'g')"
_DOC_CHUNKS = "SELECT source_id AS document_id, chunk_id, chunk_index, " + _NUM + " AS value FROM c_chunks WHERE source_kind = 'document'"


def _own_chunks(k: c.Corpus) -> DataFrame:
    return k.chunks.where("source_kind = 'document'").select(F.col("source_id").alias("document_id"), "chunk_id", "chunk_index", "text")


query("extract_values", f"SELECT document_id, min(value) AS value, arg_min(chunk_id, chunk_index) AS chunk_id FROM ({_DOC_CHUNKS}) WHERE value IS NOT NULL GROUP BY 1 HAVING min(value) = max(value)", "c_chunks")(lambda k: tags.extract_values(_own_chunks(k), r"(?P<value>\d[\d,]*)", "number")["stored"])
query("extract_conflicts", f"SELECT document_id, count(DISTINCT value) AS n_values FROM ({_DOC_CHUNKS}) WHERE value IS NOT NULL GROUP BY 1 HAVING min(value) <> max(value)", "c_chunks")(lambda k: tags.extract_values(_own_chunks(k), r"(?P<value>\d[\d,]*)", "number")["conflicts"])
_MERGE = """SELECT document_id, CASE WHEN s.document_id IS NULL THEN 'keep' WHEN d.document_id IS NULL THEN 'copy' WHEN d.value IS NULL AND s.value IS NOT NULL THEN 'carry' WHEN s.value IS DISTINCT FROM d.value AND s.value IS NOT NULL THEN 'collision' ELSE 'same' END AS outcome,
    coalesce(d.value, s.value) AS value, CASE WHEN d.value IS NULL AND s.document_id IS NOT NULL THEN coalesce(s.chunk_id, d.chunk_id) ELSE d.chunk_id END AS chunk_id
    FROM (SELECT * FROM c_document_tags WHERE tag_id = 9) s FULL JOIN (SELECT * FROM c_document_tags WHERE tag_id = 7) d USING (document_id)"""
query("merge_tags", _MERGE, "c_document_tags")(lambda k: tags.merge_plan(k.document_tags, 9, 7))
query("merge_tags_collisions", f"SELECT outcome, count(*) AS n FROM ({_MERGE}) GROUP BY 1", "c_document_tags")(lambda k: tags.merge_plan(k.document_tags, 9, 7).groupBy("outcome").agg(F.count("*").alias("n")))
query("tag_doc_counts", "SELECT tag_id, name, value_type, count(document_id) AS doc_count FROM c_tags LEFT JOIN c_document_tags USING (tag_id) GROUP BY ALL", "c_tags", "c_document_tags")(lambda k: tags.doc_counts(k.tags, k.document_tags))
query("to_classify", "SELECT document_id FROM c_documents WHERE document_id NOT IN (SELECT document_id FROM c_document_tags WHERE tag_id = 1)", "c_documents", "c_document_tags")(lambda k: tags.to_classify(k.documents, k.document_tags, [1]))
_FILE_DATE = r"__(?P<date>\d{4}-\d{2}-\d{2})__"
_FOUND = r"SELECT document_id, file_name, raw, strftime(try_cast(raw AS DATE), '%Y-%m-%d') AS date FROM (SELECT *, nullif(regexp_extract(file_name, '__(\d{4}-\d{2}-\d{2})__', 1), '') AS raw FROM c_documents)"
query("backfill_dates", f"SELECT f.document_id, raw, date, CASE WHEN raw IS NULL THEN 'unmatched' WHEN date IS NULL THEN 'invalid' WHEN s.document_id IS NULL THEN 'insert' WHEN authored_date IS NULL THEN 'update' ELSE 'keep' END AS outcome FROM ({_FOUND}) f LEFT JOIN c_summaries s ON f.document_id = s.document_id", "c_documents", "c_summaries")(lambda k: curation.backfill_dates(k, _FILE_DATE))
query("probe_dates", f"""SELECT count(*) AS population, count(raw) AS matched, count(date) AS normalized_ok, count(raw) - count(date) AS invalid, round(count(raw) / count(*), 4) AS match_rate, round(count(raw) / count(*), 4) >= 0.9 AS suggest,
    (SELECT string_agg(raw, '|' ORDER BY document_id) FROM (SELECT * FROM f WHERE raw IS NOT NULL ORDER BY document_id LIMIT 5)) AS matched_examples, (SELECT string_agg(file_name, '|' ORDER BY document_id) FROM (SELECT * FROM f WHERE raw IS NULL ORDER BY document_id LIMIT 5)) AS unmatched_examples FROM f""")(lambda k: curation.probe_dates(k, _FILE_DATE))
ORACLES["probe_dates"] = _more(f"f AS ({_FOUND})", ORACLES["probe_dates"], "c_documents")
query("save_summary_carry_date", "SELECT document_id, 'new' AS title, authored_date FROM c_summaries WHERE document_id <= 100 UNION ALL SELECT document_id, title, authored_date FROM c_summaries WHERE document_id > 100", "c_summaries")(
    lambda k: curation.save_summaries(k.summaries, k.summaries.where("document_id <= 100").withColumn("title", F.lit("new")).withColumn("authored_date", F.lit(None).cast("string"))).select("document_id", "title", "authored_date"))

# ---- views

ORACLES["resolved_citations"] = _more(_NAMES, "SELECT finding_id, chunk_id, source_kind, source_id, source_name FROM c_citations JOIN c_chunks USING (chunk_id) LEFT JOIN names USING (source_kind, source_id)", "c_citations", "c_documents", "c_summaries", "c_findings", "c_links")
query("resolved_citations")(views.resolved_citations)
ORACLES["chunk_view"] = _more(_TARGET, "SELECT n.chunk_id, n.chunk_index, n.text, n.chunk_index = t.chunk_index AS is_target FROM c_chunks n JOIN target t ON n.source_kind = 'document' AND n.source_id = t.source_id AND n.chunk_index BETWEEN t.chunk_index - 2 AND t.chunk_index + 2", "c_chunks")
query("chunk_view")(lambda k: views.chunk_view(k, _target(k)))
query("tagged_documents", "SELECT t.document_id, coalesce(CASE WHEN model <> 'backfill' THEN title END, file_name) AS label, value FROM c_document_tags t JOIN c_documents d ON d.document_id = t.document_id LEFT JOIN c_summaries s ON s.document_id = t.document_id WHERE tag_id = 7", "c_document_tags", "c_documents", "c_summaries")(lambda k: views.tagged_documents(k, "ipv4"))
query("used_tags", "SELECT name, count(*) AS doc_count FROM c_document_tags JOIN c_tags USING (tag_id) GROUP BY 1", "c_document_tags", "c_tags")(views.used_tags)
query("image_locators", "SELECT chunk_id, source_id, sha256(b.text) AS image_hash FROM c_chunks JOIN benchmark b ON item_id = source_id WHERE source_kind = 'image'", "c_chunks")(lambda k: views.image_locators(k, k.chunks.where("source_kind = 'image'")).select("chunk_id", "source_id", "image_hash"))
query("corpus_info", "SELECT 'documents' AS name, count(*) AS n FROM c_documents UNION ALL SELECT 'summaries', count(*) FROM c_summaries UNION ALL SELECT 'findings', count(*) FROM c_findings UNION ALL SELECT 'images', count(*) FROM c_images UNION ALL SELECT 'chunks', count(*) FROM c_chunks UNION ALL SELECT 'tags', count(*) FROM c_tags", "c_documents", "c_summaries", "c_findings", "c_images", "c_chunks", "c_tags")(views.corpus_info)
query("finding_files", r"SELECT finding_id, coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'finding') || '-' || finding_id || '.md' AS file_name, regexp_replace(body, '\[\^((?:chunk|finding|url|doc):[^\]]*)\]', '(\1)', 'g') AS body FROM c_findings", "c_findings")(
    lambda k: artifacts.read_finding_files(artifacts.finding_files(k.findings)).select("finding_id", "file_name", "body"))

query("findings_index", "SELECT finding_id, title, CAST(NULL AS VARCHAR) AS description, s.name AS session_name, CAST(NULL AS VARCHAR) AS model, false AS model_set_by_llm, count(ci.chunk_id) AS citation_count FROM c_findings f JOIN c_sessions s USING (session_id) LEFT JOIN c_citations ci USING (finding_id) GROUP BY ALL", "c_findings", "c_sessions", "c_citations")(views.findings_index)
query("document_detail", "SELECT d.document_id, file_name, title, model, coalesce(t.tags, '') AS tags FROM c_documents d LEFT JOIN c_summaries s ON d.document_id = s.document_id LEFT JOIN (SELECT document_id, string_agg(name, '|' ORDER BY lower(name)) AS tags FROM c_document_tags JOIN c_tags USING (tag_id) GROUP BY 1) t ON t.document_id = d.document_id", "c_documents", "c_summaries", "c_document_tags", "c_tags")(
    lambda k: views.document_detail(k).select("document_id", "file_name", "title", "model", F.array_join(F.transform("tags", lambda t: t["name"]), "|").alias("tags")))
_BODY = "(SELECT source_id AS document_id, string_agg(text, ' ' ORDER BY chunk_index) AS body FROM c_chunks WHERE source_kind = 'document' GROUP BY 1)"
query("probe_dates_body", f"SELECT count(*) AS population, count(nullif(regexp_extract(body, '(\\d\\d\\d\\d)', 1), '')) AS matched FROM {_BODY}", "c_chunks")(
    lambda k: curation.probe_dates(k, r"(?P<date>\d\d\d\d)", field="body").select("population", "matched"))
query("apply_backfill", f"SELECT f.document_id, coalesce(s.model, 'backfill') AS model, coalesce(authored_date, date) AS authored_date FROM ({_FOUND}) f LEFT JOIN c_summaries s ON f.document_id = s.document_id WHERE s.document_id IS NOT NULL OR date IS NOT NULL", "c_documents", "c_summaries")(
    lambda k: curation.apply_backfill(k.summaries, curation.backfill_dates(k, _FILE_DATE)).select("document_id", "model", "authored_date"))
query("backfill_counts", f"SELECT count(raw) AS matched, count_if(raw IS NULL) AS unmatched, count_if(raw IS NOT NULL AND date IS NULL) AS invalid, count_if(date IS NOT NULL AND s.document_id IS NULL) AS inserted, count_if(date IS NOT NULL AND s.document_id IS NOT NULL AND authored_date IS NULL) AS updated FROM ({_FOUND}) f LEFT JOIN c_summaries s ON f.document_id = s.document_id", "c_documents", "c_summaries")(
    lambda k: curation.backfill_counts(curation.backfill_dates(k, _FILE_DATE)))
query("merge_counts", f"SELECT count_if(outcome = 'copy') AS inserted, count_if(outcome IN ('carry', 'collision', 'same')) AS already_present, count_if(outcome = 'collision') AS collisions FROM ({_MERGE})", "c_document_tags")(
    lambda k: tags.merge(k.tags.withColumn("value_type", F.lit("string")), k.document_tags, "digits", "ipv4")[2])
query("deleted_findings", "SELECT count(*) AS findings, (SELECT count(*) FROM c_chunks WHERE source_kind = 'finding' AND source_id % 2 = 1) AS chunks, (SELECT count(*) FROM c_citations WHERE finding_id % 2 = 1) AS citations FROM c_findings WHERE finding_id % 2 = 1", "c_findings", "c_chunks", "c_citations")(
    lambda k: curation.delete_counts(k, k.findings.where("finding_id % 2 = 1").select("finding_id")).select("findings", "chunks", "citations"))
query("scan_count_by_date", f"SELECT source_id AS document_id, file_name, authored_date, count(*) AS n, min(chunk_id) AS chunk_id FROM c_tokens t JOIN c_documents d ON source_id = d.document_id LEFT JOIN c_summaries s ON source_id = s.document_id WHERE source_kind = 'document' AND {holds('that')} GROUP BY ALL", "c_tokens", "c_documents", "c_summaries")(
    lambda k: scan.count_by_document(k, "that", everything(k), sort="date"))
query("scan_brief", f"SELECT source_id AS document_id, file_name, chunk_id, page_number, authored_date FROM c_tokens t JOIN c_documents d ON source_id = d.document_id LEFT JOIN c_summaries s ON source_id = s.document_id WHERE source_kind = 'document' AND {holds('that')}", "c_tokens", "c_documents", "c_summaries")(
    lambda k: scan.matches(k, "that", everything(k)).select(*scan.BRIEF))
query("assign_tag", "SELECT document_id, tag_id, value FROM c_document_tags UNION ALL SELECT document_id, 10, NULL FROM c_documents WHERE document_id BETWEEN 5 AND 9", "c_document_tags", "c_documents")(
    lambda k: tags.assign_by_name(k.tags, k.document_tags, k.documents, k.chunks, "unused", [5, 6, 7, 8, 9, 10**9])[0].select("document_id", "tag_id", "value"))
# ---- integrity and operations

query("orphan_chunks", "SELECT chunk_id, source_kind, source_id FROM c_chunks WHERE source_kind = 'document' AND source_id % 97 = 0", "c_chunks")(lambda k: integrity.orphan_chunks(k.with_tables(documents=k.documents.where("document_id % 97 <> 0"))))
query("id_sync", "SELECT 'vector_without_chunk' AS side, count(*) AS n FROM c_embeddings WHERE chunk_id NOT IN (SELECT chunk_id FROM c_chunks) UNION ALL SELECT 'chunk_without_vector', count(*) FROM c_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM c_embeddings)", "c_embeddings", "c_chunks")(integrity.id_sync)
query("constraint_violations", "SELECT rule, CASE rule WHEN 'documents.file_hash repeats' THEN (SELECT count(*) FROM (SELECT file_hash FROM c_documents GROUP BY 1 HAVING count(*) > 1)) ELSE 0 END AS n FROM unnest(['documents.file_hash repeats', 'documents.parent missing', 'summaries.document_id repeats', 'summaries.document missing', 'chunks.place repeats', 'chunks.index below zero', 'chunks.text blank', 'chunks.source_kind unknown', 'failed_ingests.stage unknown', 'sessions.name repeats', 'tags.name repeats', 'document_tags repeats', 'finding_citations.chunk missing']) t(rule)", "c_documents")(integrity.violations)
query("needs_summary", "SELECT document_id FROM c_documents WHERE document_id NOT IN (SELECT document_id FROM c_summaries) AND (document_id IN (SELECT source_id FROM c_chunks WHERE source_kind = 'document') OR document_id IN (SELECT l.document_id FROM c_links l JOIN c_chunks k ON k.source_kind = 'image' AND k.source_id = l.image_id))", "c_documents", "c_summaries", "c_chunks", "c_links")(curation.needs_summary)
query("uncaptioned_images", "SELECT document_id, image_id, min(page_number) AS page_number FROM c_links JOIN c_images USING (image_id) WHERE NOT captioned GROUP BY ALL", "c_links", "c_images")(curation.uncaptioned)
query("summary_input", """SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY page, kind, o, chunk_index, text) AS text FROM (SELECT source_id AS document_id, coalesce(page_number, -1) AS page, 0 AS kind, source_id AS o, chunk_index, text FROM c_chunks WHERE source_kind = 'document'
    UNION ALL SELECT l.document_id, coalesce(l.page_number, -1), 1, l.image_id, chunk_index, CASE WHEN l.page_number >= 0 THEN '[Image on page ' || l.page_number || '] ' ELSE '[Image] ' END || text FROM c_links l JOIN c_chunks k ON k.source_kind = 'image' AND k.source_id = l.image_id) GROUP BY 1""", "c_chunks", "c_links")(curation.summary_input)
query("failed_units", "SELECT file_hash, stage, attempts FROM c_failed WHERE attempts < 3", "c_failed")(lambda k: curation.retryable(k.failed_ingests).select("file_hash", "stage", "attempts"))
query("failed_totals", "SELECT count(*) AS failed, count_if(attempts >= 3) AS capped FROM c_failed", "c_failed")(lambda k: curation.failed_totals(k.failed_ingests))
raw_query("stage_timings", "SELECT event_type AS stage, round(sum(value), 4) AS total, round(sum(value) / (SELECT sum(value) FROM events) * 100, 4) AS pct, round(sum(value) / count(DISTINCT user_id), 4) AS mean FROM events GROUP BY 1")(
    lambda spark, d: curation.stage_timings(spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("stage"), F.col("value").alias("seconds"))).select("stage", *[F.round(x, 4).alias(x) for x in ("total", "pct", "mean")]))
raw_query("config_drift", "SELECT event_id, 'k: ' || (event_id % 3) || ' -> ' || (event_id % 4) AS drift FROM events WHERE event_id % 3 <> event_id % 4")(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", F.explode(curation.config_drift(*[F.create_map(F.lit("k"), (F.col("event_id") % n).cast("string"), F.lit("api_key"), (F.col("event_id") % n).cast("string")) for n in (3, 4)])).alias("drift")))

# ---- leaderboard


def _runs(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.when(F.col("event_type").isin("click", "view", "purchase"), "ollama").otherwise("openai").alias("provider"), F.col("event_type").alias("model"), F.concat(F.lit("d"), (F.col("user_id") % 5).cast("string")).alias("doc"),
        F.when(e % 13 == 0, "docling").otherwise("pdfplumber").alias("extraction"), (~((F.col("event_type") == "error") & (e % 10 == 0))).alias("ok"), (F.col("value") / 100 + 1).alias("wall_seconds"), (e % 3 * 100000000).alias("load_duration_ns"),
        (200 + e % 400).alias("prompt_eval_count"), F.concat(F.lit("s"), (e % 4).cast("string")).alias("summary_sha"), F.when(F.col("user_id") % 20 == 0, "p1").otherwise("p0").alias("prompt_sha"), "ts", "event_id")


def _judgments(runs: DataFrame) -> DataFrame:
    return runs.where("event_id % 3 = 0").select(*benchmark.CELL, F.lit("openai/j1").alias("judge"), "summary_sha", F.least(1 + (F.col("event_id") % 17) / 4.0, F.lit(5.0)).alias("mean"))


def _bench(fn):
    def run(spark, d):
        runs = _runs(spark, d)
        return fn(runs, _judgments(runs))

    return run


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.round(x, 6).alias(x) if x in cols else F.col(x) for x in df.columns])


raw_query("quality_cells", "SELECT provider, model, doc, extraction, round(quality, 6) AS quality, runs, passes FROM b_cells", "b_cells")(_bench(lambda r, j: _rounded(benchmark.quality_cells(r, j), "quality")))
raw_query("quality_by_model", "SELECT provider, model, round(avg(quality), 6) AS quality, count(*) AS cells FROM b_cells GROUP BY ALL", "b_cells")(_bench(lambda r, j: _rounded(benchmark.quality_by_model(benchmark.quality_cells(r, j)), "quality")))
raw_query("input_tps", "SELECT provider, model, round(input_tps, 6) AS input_tps FROM b_tps", "b_tps")(_bench(lambda r, j: _rounded(benchmark.input_tps(r), "input_tps")))
raw_query("schema_gate", "SELECT provider, model, round(schema_pct, 6) AS schema_pct, disqualified FROM b_board", "b_board")(_bench(lambda r, j: _rounded(benchmark.schema_gate(r, 98.0), "schema_pct")))
raw_query("leaderboard", "SELECT provider, model, round(quality, 6) AS quality, round(input_tps, 6) AS input_tps, round(schema_pct, 6) AS schema_pct, disqualified FROM b_board", "b_board")(_bench(lambda r, j: _rounded(benchmark.leaderboard(r, j, 98.0), "quality", "input_tps", "schema_pct")))
raw_query("pareto_frontier", "SELECT provider, model, round(quality, 6) AS quality, round(input_tps, 6) AS input_tps FROM b_board a WHERE provider = 'ollama' AND quality IS NOT NULL AND input_tps IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b_board b WHERE b.provider = 'ollama' AND b.quality >= a.quality AND b.input_tps >= a.input_tps AND (b.quality > a.quality OR b.input_tps > a.input_tps))", "b_board")(_bench(lambda r, j: _rounded(benchmark.pareto_frontier(benchmark.leaderboard(r, j, 98.0)), "quality", "input_tps")))
raw_query("regime_mix", "SELECT provider, model, doc, extraction, 'prompt_sha' AS field, count(DISTINCT prompt_sha) AS n FROM b_runs GROUP BY ALL HAVING count(DISTINCT prompt_sha) > 1", "b_runs")(_bench(lambda r, j: benchmark.regime_mix(r)))
raw_query("judge_topup", "SELECT r.*, greatest(12 - coalesce(have, 0), 0) AS missing FROM (SELECT DISTINCT provider, model, doc, extraction, summary_sha FROM b_runs WHERE ok) r LEFT JOIN (SELECT provider, model, doc, extraction, summary_sha, count(*) AS have FROM b_judgments WHERE judge = 'openai/j1' GROUP BY ALL) USING (provider, model, doc, extraction, summary_sha) WHERE greatest(12 - coalesce(have, 0), 0) > 0", "b_runs", "b_judgments")(_bench(lambda r, j: benchmark.judge_topup(r, j, 12, "openai/j1")))
raw_query("quality_pivot", "PIVOT (SELECT provider, model, extraction, doc, printf('%.2f (%dr/%dp)', quality, runs, passes) AS q FROM b_cells) ON doc IN ('d0', 'd1', 'd2', 'd3', 'd4') USING first(q)", "b_cells")(_bench(lambda r, j: benchmark.quality_pivot(benchmark.quality_cells(r, j), [f"d{i}" for i in range(5)])))
ORACLES["quality_pivot"] = statement("SELECT provider, model, extraction, " + ", ".join(f"max(CASE WHEN doc = 'd{i}' THEN printf('%.2f (%dr/%dp)', quality, runs, passes) END) AS d{i}" for i in range(5)) + " FROM b_cells GROUP BY ALL", "b_cells")
raw_query("run_index", "SELECT provider, model, doc, extraction, event_id, CAST(row_number() OVER (PARTITION BY provider, model, doc, extraction ORDER BY event_id) - 1 + (SELECT count(*) FROM b_runs h WHERE h.provider = r.provider AND h.model = r.model AND h.doc = r.doc AND h.extraction = r.extraction) AS INTEGER) AS run_index FROM b_runs r", "b_runs")(
    _bench(lambda r, j: benchmark.with_run_index(r, r, "event_id").select(*benchmark.CELL, "event_id", "run_index")))
raw_query("rubric_mean", "SELECT event_id, round((event_id % 5 + event_id % 4 + event_id % 3 + event_id % 2) / 4.0, 4) AS mean FROM events")(
    lambda spark, d: benchmark.rubric_mean(spark.read.parquet(f"{d}/events.parquet").select("event_id", *[(F.col("event_id") % n).alias(a) for n, a in zip((5, 4, 3, 2), benchmark.AXES)])).select("event_id", F.round("mean", 4).alias("mean")))
_PAGED = "(SELECT DISTINCT user_id FROM events) u LEFT JOIN documents ON doc_id = user_id"
raw_query("ingest_rates", f"SELECT count(*) AS docs, CAST(coalesce(sum(CAST(ceil(n_chars / 3000.0) AS BIGINT)), 0) AS BIGINT) AS pages, round(count(*) / 40.0, 4) AS docs_per_s, round(coalesce(sum(CAST(ceil(n_chars / 3000.0) AS BIGINT)), 0) / 40.0, 4) AS pages_per_s FROM {_PAGED}")(
    lambda spark, d: curation.ingest_rates(spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("document_id")), spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.ceil(F.col("n_chars") / 3000).cast("int").alias("page_count")), 40.0).select("docs", "pages", *[F.round(x, 4).alias(x) for x in ("docs_per_s", "pages_per_s")]))
raw_query("source_drift", "SELECT DISTINCT provider, model, doc, extraction FROM b_runs WHERE ok AND summary_sha <> 's1'", "b_runs")(
    _bench(lambda r, j: benchmark.source_drift(r.withColumn("source_sha", F.col("summary_sha")), r.select("doc", "extraction").distinct().withColumn("source_sha", F.lit("s1"))).select(*benchmark.CELL).distinct()))
raw_query("window_runs", "SELECT count(*) AS n FROM b_runs WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11' AND model = 'click'", "b_runs")(_bench(lambda r, j: benchmark.window(r, "2024-01-05", "2024-01-10", model="click").agg(F.count("*").alias("n"))))

# ---- ingest, sharing, streams

raw_query("type_route", r"SELECT page_id, CASE WHEN regexp_matches(lower(url), '\.html?($|[?#])') THEN 'html' WHEN starts_with(html, '<!DO') OR starts_with(html, '<htm') THEN 'html' END AS type FROM pages")(lambda spark, d: files.with_types(spark.read.parquet(f"{d}/pages.parquet"), "url", "html").select("page_id", "type"))
query("file_hash_dedup", "SELECT document_id, CASE WHEN row_number() OVER (PARTITION BY file_hash ORDER BY document_id) > 1 THEN 'duplicate' ELSE 'parse' END AS action FROM c_documents", "c_documents")(lambda k: files.classify(k.documents.select("document_id", "file_hash", F.lpad(F.col("document_id").cast("string"), 12, "0").alias("path")), k.documents.limit(0), k.failed_ingests).select("document_id", "action"))
raw_query("page_text", r"SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + '"' + r"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_sha FROM pages")(lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.sha2(files.page_text(F.col("html")).cast("binary"), 256).alias("text_sha")))
query("publish_strip", "SELECT 'chunks' AS name, count(*) AS n FROM c_chunks WHERE source_kind <> 'finding' UNION ALL SELECT 'findings', 0 UNION ALL SELECT 'documents', count(*) FROM c_documents UNION ALL SELECT 'document_tags', count(*) FROM c_document_tags", "c_chunks", "c_documents", "c_document_tags")(
    lambda k: _counts(share.strip_private(k), "chunks", "findings", "documents", "document_tags"))
raw_query("events_hourly", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(lambda spark, d: ingest.hourly_counts(spark.read.parquet(f"{d}/events.parquet")).withColumn("total", F.round("total", 4)))
def _filings(spark: SparkSession, d: str) -> DataFrame:
    """A filing for each document: its text, a page in an XBRL shell, a picture and an empty part."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    parts = [("10-K", F.lit("main.txt"), F.translate("text", "<>", "()")), ("EX-99", F.concat(F.lit("page"), F.col("doc_id").cast("string"), F.lit(".htm")), F.concat(F.lit("<XBRL>\n<p>"), "lang", F.lit("</p>\n</XBRL>"))), ("GRAPHIC", F.lit("a.jpg"), F.lit("begin 644 a.jpg")), ("EX-1", F.lit("b.txt"), F.lit(" "))]
    text = F.concat(F.lit("<SEC-DOCUMENT>\n"), *[F.concat(F.lit(f"<DOCUMENT>\n<TYPE>{t}\n<FILENAME>"), n, F.lit("\n<TEXT>\n"), b, F.lit("\n</TEXT>\n</DOCUMENT>\n")) for t, n, b in parts])
    return docs.select("doc_id", text.alias("text"))


raw_query("edgar_split", """SELECT doc_id, CAST(p AS INTEGER) AS position, ['10-K', 'EX-99', 'GRAPHIC', 'EX-1'][p + 1] AS doc_type, ['main.txt', 'page' || doc_id || '.htm', 'a.jpg', 'b.txt'][p + 1] AS file_name,
    CASE WHEN p = 0 AND regexp_matches(text, '[^\\s]') THEN 'text' WHEN p = 1 THEN 'html' ELSE 'skip' END AS route, length(['x', '<p>' || lang || '</p>', 'begin 644 a.jpg', ''][p + 1]) AS n FROM documents, range(4) r(p)""")(
    lambda spark, d: files.split_envelope(_filings(spark, d), "doc_id").select("doc_id", "position", "doc_type", "file_name", "route", F.when(F.col("position") == 0, 1).otherwise(F.length("body")).cast("long").alias("n")))
#: Parts of filings: type, name, what stands round the document's text, and what is left of it. Variants follow the document's number.
_PARTS = [
    ("10-K", "m.htm", "", "", "html"), ("EX-99", "a.txt", "", "\nbegin 100 days after closing", "text"), ("COVER", "c.txt", "", "", "skip"), ("XML", "x.txt", "", "", "text"),
    ("EX-5", "pic.jpeg", "", "", "skip"), ("EX-6", "", "<div>", "", "html"), ("EX-7", "q.txt", "we quote <html> here ", "", "text"), ("EX-8", "s.txt", "<xbrl>", "</XBRL>", "text"),
    ("EX-101.INS", "i.txt", "", "", "skip"), ("EX-9", "g.dat", "begin 644 a.bin\n", "", "skip"), ("PDF", "p.pdf", "", "", "skip"), (" 10-q ", "n.HTML", "see <XML>", "</XML> and more", "html"),
]


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filing for each document, its whole text in a part and in a second one of the next variant."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    def part(number):
        out = F.lit("")
        for i, (t, n, a, b, _) in enumerate(_PARTS):
            out = F.when(number % len(_PARTS) == i, F.concat(F.lit(f"<DOCUMENT>\n<TYPE>{t}\n" + (f"<FILENAME>{n}\n" if n else "") + f"<TEXT>\n{a}"), F.col("t"), F.lit(f"{b}\n</TEXT>\n</DOCUMENT>\n"))).otherwise(out)
        return out

    return docs.select("doc_id", F.concat(F.lit("<SEC-HEADER>x\n"), part(F.col("doc_id")), part(F.col("doc_id") + 5)).alias("text"))


_STRIPPED = lambda x: f"trim({x}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_VARIANTS = ", ".join(f"({i}, '{t.strip()}', {repr(n) if n else 'NULL'}, {repr(a) if 'XML' not in b.upper() and 'XBRL' not in b.upper() else repr('')}, {repr(b) if not b.startswith('</') else repr('')}, '{r}')".replace("\\n", "' || chr(10) || '") for i, (t, n, a, b, r) in enumerate(_PARTS))
raw_query("edgar_bodies", f"""WITH v(i, doc_type, file_name, a, b, route) AS (VALUES {_VARIANTS}),
    p AS (SELECT doc_id, CAST(k AS INTEGER) AS position, doc_type, file_name, route, {_STRIPPED("a || coalesce(text, '') || b")} AS body FROM documents, (VALUES (0), (1)) n(k) JOIN v ON i = (doc_id + 5 * k) % 12)
    SELECT doc_id, position, doc_type, file_name, CASE WHEN body = '' OR regexp_matches(substring(body, 1, 200), '(?m)^begin [0-9]{{3}} ') THEN 'skip' ELSE route END AS route, CAST(length(body) AS BIGINT) AS n_chars, md5(body) AS body_md5 FROM p""")(
    lambda spark, d: files.split_envelope(_bodies(spark, d), "doc_id").select("doc_id", "position", "doc_type", "file_name", "route", F.length("body").cast("long").alias("n_chars"), F.md5(F.col("body").cast("binary")).alias("body_md5")))
def _filing_files(spark: SparkSession, d: str) -> DataFrame:
    """Inner documents of the filings, written as text files of many filings each and read by ranges of 1 MB."""
    folder = f"{tables.folder_of(spark, d)}/filings"
    _bodies(spark, d).select("text").write.mode("overwrite").text(folder)
    return filings.inner_documents(filings.listed(spark, [folder]), 1 << 20).select("doc_type", "file_name", "route", F.length("body").cast("long").alias("n_chars"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


raw_query("filing_ranges", f"SELECT doc_type, file_name, route, n_chars, body_md5 FROM ({ORACLES['edgar_bodies']})")(_filing_files)
raw_query("html_sections", """SELECT doc_id, CAST(o AS INTEGER) AS section_order, [NULL, 's1', 's2'][o + 1] AS anchor_id, ['__preamble__', 'Part one', 'Part two'][o + 1] AS section_title, o > 0 AS has_anchor,
    [NULL, source, lang || ' ' || doc_id][o + 1] AS body FROM documents, range(3) r(o)""")(
    lambda spark, d: files.html_sections(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit('<p>Index</p><ul><li><a href="#s1">Part one</a></li><li><a href="#s2">Part two</a></li></ul><h2 id="s1"></h2><p>'), "source", F.lit('</p><h2 id="s2"></h2><p>'), "lang", F.lit(" "), F.col("doc_id").cast("string"), F.lit("</p>")).alias("html")), "doc_id")
    .select("doc_id", "section_order", "anchor_id", "section_title", (F.col("section_order") > 0).alias("has_anchor"), F.when(F.col("section_order") > 0, F.col("text")).alias("body")))
raw_query("chunk_markdown")(lambda spark, d: files.chunk_markdown(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "doc_id"))


# Chunks by structure, stated once more: page tags cut a page into items, units of long ones and then pieces are packed one after the other.
_REFERENCES = [("&copy;?", "©"), ("&middot;?", "·"), ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "''"), ("&nbsp;?", " "), ("&amp;?", "&")]  # these count without their semicolon, too
_DECODED = reduce(lambda x, r: f"regexp_replace({x}, '{r[0]}', '{r[1]}', 'g')", _REFERENCES, r"regexp_replace(x, '<[^>]*>', '', 'g')")
raw_query("page_chunks", rf"""WITH RECURSIVE bare AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>|<!--.*?-->', '', 'g') AS x FROM pages),
    marked AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<br[^>]*>', ' ', 'g'), '<h1\b[^>]*>', chr(1) || 'H', 'g'), '<li\b[^>]*>', chr(1) || 'L', 'g'), '</?(?:body|nav|ul|li|div|article|h1|p|footer|header|main|section|aside)\b[^>]*>', chr(1) || 'T', 'g') AS x FROM bare),
    raw AS (SELECT page_id, unnest(string_split('T' || x, chr(1))) AS x, generate_subscripts(string_split('T' || x, chr(1)), 1) AS pos FROM marked),
    texts AS (SELECT page_id, pos, x[1] AS k, trim(regexp_replace({_DECODED.replace("(x,", "(x[2:],")}, '[\x09-\x0D\x20\x{{A0}}]+', ' ', 'g')) AS text FROM raw),
    kinds AS (SELECT *, k = 'H' AND length(text) <= 200 AS h FROM texts WHERE text <> ''),
    follows AS (SELECT *, h AND NOT coalesce(lead(h) OVER (PARTITION BY page_id ORDER BY pos), true) AS opens FROM kinds),
    headed AS (SELECT page_id, pos, k, text, opens, CASE WHEN NOT h THEN max(CASE WHEN h THEN pos END) OVER (PARTITION BY page_id ORDER BY pos) END AS h_at FROM follows),
    items AS (SELECT i.page_id, i.pos, CASE i.k WHEN 'H' THEN 'section_header' WHEN 'L' THEN 'list_item' ELSE 'text' END AS kind, i.text, o.text AS heading, 400 - coalesce(CAST(ceil(length(o.text) / 4) AS BIGINT), 0) AS room
        FROM headed i LEFT JOIN headed o ON o.page_id = i.page_id AND o.pos = i.h_at WHERE NOT i.opens),
    cut AS (SELECT * EXCLUDE text, CASE WHEN ceil(length(text) / 4) <= room THEN [text] ELSE regexp_extract_all(text, '[^ ].{{0,62}}(?: |$)|[^ ]{{1,64}}') END AS u FROM items),
    units AS (SELECT page_id, pos, kind, heading, room, unnest(u) AS text, generate_subscripts(u, 1) AS n FROM cut),
    sized AS (SELECT *, CAST(ceil(length(text) / 4) AS BIGINT) AS size FROM units),
    packed AS (SELECT page_id, pos, n, 0 AS piece, size AS used FROM sized WHERE n = 1
        UNION ALL SELECT s.page_id, s.pos, s.n, CASE WHEN used + size <= room THEN piece ELSE piece + 1 END, CASE WHEN used + size <= room THEN used + size ELSE size END FROM packed p JOIN sized s ON s.page_id = p.page_id AND s.pos = p.pos AND s.n = p.n + 1),
    pieces AS (SELECT page_id, pos, piece, any_value(kind) AS kind, any_value(heading) AS heading, any_value(room) AS room, rtrim(string_agg(text, '' ORDER BY n)) AS text, sum(size) AS size, row_number() OVER (PARTITION BY page_id ORDER BY pos, piece) AS i FROM sized JOIN packed USING (page_id, pos, n) GROUP BY page_id, pos, piece),
    merged AS (SELECT page_id, i, 0 AS chunk_index, size AS used, heading FROM pieces WHERE i = 1
        UNION ALL SELECT s.page_id, s.i, CASE WHEN used + size <= room AND m.heading IS NOT DISTINCT FROM s.heading THEN chunk_index ELSE chunk_index + 1 END, CASE WHEN used + size <= room AND m.heading IS NOT DISTINCT FROM s.heading THEN used + size ELSE size END, s.heading FROM merged m JOIN pieces s ON s.page_id = m.page_id AND s.i = m.i + 1)
    SELECT page_id, CAST(chunk_index AS INTEGER) AS chunk_index, any_value(p.heading) AS section_heading, arg_min(kind, i) AS content_type, sha256(coalesce(any_value(p.heading) || chr(10), '') || string_agg(text, chr(10) ORDER BY i)) AS text_sha
    FROM merged m JOIN pieces p USING (page_id, i) GROUP BY page_id, chunk_index""")(
    lambda spark, d: structure.chunk_pages(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html"), "page_id").select("page_id", "chunk_index", "section_heading", "content_type", F.sha2("text", 256).alias("text_sha")))


def _order_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each order with the table of its lines, under a head of two rows with spans."""
    line = F.concat(F.lit("<tr><td>"), F.col("l_linenumber").cast("string"), F.lit("</td><td>"), F.col("l_quantity").cast("int").cast("string"), F.lit("</td><td>"), "l_returnflag", F.lit(" by "), "l_linestatus", F.lit("</td></tr>"))
    lines = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", line.alias("row")))), lambda r: r["row"]), "").alias("rows"))  # an order has a handful
    head = "</h1><p>Lines</p><table><thead><tr><td rowspan=2>Line</td><td colspan=2>What</td></tr><tr><td>Number</td><td>Sent</td></tr></thead>"
    return lines.select("l_orderkey", F.concat(F.lit("<h1>Order "), F.col("l_orderkey").cast("string"), F.lit(head), "rows", F.lit("</table>")).alias("html"))


raw_query("table_chunks", """WITH RECURSIVE rows AS (SELECT l_orderkey, 'Order ' || l_orderkey AS h, l_linenumber || ' | ' || CAST(l_quantity AS INTEGER) || ' | ' || l_returnflag || ' by ' || l_linestatus AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag, l_linestatus) AS n FROM lineitem),
    sized AS (SELECT *, CAST(ceil(length(text) / 4) AS BIGINT) AS size, 40 - CAST(ceil(length(h) / 4) AS BIGINT) - CAST(ceil(length('Line | What | What' || chr(10) || 'Line | Number | Sent') / 4) AS BIGINT) AS room FROM rows),
    packed AS (SELECT l_orderkey, n, 1 AS chunk_index, size AS used FROM sized WHERE n = 1
        UNION ALL SELECT s.l_orderkey, s.n, CASE WHEN used + size <= room THEN chunk_index ELSE chunk_index + 1 END, CASE WHEN used + size <= room THEN used + size ELSE size END FROM packed p JOIN sized s ON s.l_orderkey = p.l_orderkey AND s.n = p.n + 1)
    SELECT l_orderkey, CAST(chunk_index AS INTEGER) AS chunk_index, any_value(h) AS section_heading, 'sec_table' AS content_type, any_value(h) || chr(10) || 'Line | What | What' || chr(10) || 'Line | Number | Sent' || chr(10) || string_agg(text, chr(10) ORDER BY n) AS text FROM sized JOIN packed USING (l_orderkey, n) GROUP BY l_orderkey, chunk_index
    UNION ALL SELECT DISTINCT l_orderkey, 0, h, 'sec_text', h || chr(10) || 'Lines' FROM rows""")(
    lambda spark, d: structure.chunk_pages(_order_pages(spark, d), "l_orderkey", tokens=40, types=("sec_text", "sec_table")))


def _counts(k: c.Corpus, *names: str) -> DataFrame:
    out = None
    for n in names:
        one = getattr(k, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


assert cid(0, "1", "0")

# ---- changed corpora and indexes that prune

changed.register(QUERIES, ORACLES, everything, _bm25_sql, _knn_sql, _more, first_vector)
