"""Tags, dates, staged commits, requests and routes, on small corpora."""

import json

import pytest
from pyspark.sql import functions as F

from quire import __main__ as cli
from quire import api
from quire.errors import EngineError
from quire.functions import counting
from quire.operators import benchmark, curation, scan, scope, tags
from quire.sources import corpus as c
from quire.sources import files, routes


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    from quire.plans.registry import corpus_of

    return corpus_of(spark, sf_dir)


@pytest.fixture()
def empty(spark):
    return c.Corpus(**{n: spark.createDataFrame([], s) for n, s in c.SCHEMAS.items() if n not in ("meta", "ingests")})


def refused(code, call, *args, **kwargs):
    with pytest.raises(EngineError) as e:
        call(*args, **kwargs)
    assert e.value.code == code
    return e.value


def test_tags_are_added_or_in_conflict(corpus):
    own = corpus.tags
    for code, args in (("EMPTY_DESCRIPTION", ("x", " ")), ("EMPTY_NORMALIZED_NAME", ("--", "d")), ("INCOMPLETE_VALUE_TAG", ("x", "d", "number")), ("INVALID_PATTERN", ("x", "d", "number", r"(\d+)")), ("INVALID_PATTERN", ("x", "d", "number", "("))):
        refused(code, tags.add, own, *args)
    kind, row = tags.add(own, "Lang EN", "again")
    assert kind == "conflict" and row.first()["name"] == "lang_en" and row.first()["similarity"] == 1.0
    kind, more = tags.add(own, "amount", "money", "number", r"(?P<value>\d+)")
    assert kind == "created" and more.count() == own.count() + 1 and more.where("name = 'amount'").first()["tag_id"] == 11
    kind, row = tags.add(own, "tongue", "English", embed=lambda t: [1.0, 0.0] if "English" in t else [0.0, 1.0])
    assert kind == "conflict" and row.first()["name"] == "lang_en"


def test_tags_are_assigned_by_name(corpus):
    call = lambda *a, **k: tags.assign_by_name(corpus.tags, corpus.document_tags, corpus.documents, corpus.chunks, *a, **k)
    some = corpus.chunks.where("source_kind = 'document'").first()["chunk_id"]
    refused("TAG_NOT_FOUND", call, "nope", [1])
    refused("CHUNK_WITHOUT_VALUE", call, "quality", [1], chunk_id=some)
    refused("NOT_A_VALUE_TAG", call, "quality", [1], value="3")
    refused("INVALID_VALUE", call, "digits", [1], value="many")
    refused("UNKNOWN_CHUNK", call, "digits", [1], value="3", chunk_id=5)
    out, lost = call("digits", [1, 2, 10**9], value=" $1,234 ", chunk_id=some)
    assert lost == [10**9] and {(r.document_id, r.value, r.chunk_id) for r in out.where("tag_id = 9 and document_id in (1, 2)").collect()} == {(1, "1234", some), (2, "1234", some)}
    again, _ = tags.assign_by_name(corpus.tags, out, corpus.documents, corpus.chunks, "digits", [1])
    assert again.where("tag_id = 9 and document_id = 1").first()["value"] == "1234" and again.count() == out.count()


def test_tags_are_merged_within_their_kind(spark, corpus):
    refused("MIXED_TYPE_MERGE", tags.merge, corpus.tags, corpus.document_tags, "quality", "digits")
    refused("SELF_MERGE", tags.merge, corpus.tags, corpus.document_tags, "quality", "quality")
    rows = spark.createDataFrame([(1, 9, "5", 50), (2, 9, "6", 60), (3, 9, None, None), (4, 9, "7", 70), (1, 7, "5", 51), (2, 7, "x", 61), (4, 7, None, None), (5, 7, "z", 80)], "document_id long, tag_id long, value string, chunk_id long")
    left, after, counts = tags.merge(corpus.tags, rows, "digits", "ipv4")
    assert left.where("name = 'digits'").count() == 0
    assert {tuple(r) for r in after.collect()} == {(1, 7, "5", 51), (2, 7, "x", 61), (3, 7, None, None), (4, 7, "7", 70), (5, 7, "z", 80)}
    assert counts.first()[:] == (1, 3, 1)


def test_backfill_is_planned_counted_and_applied(corpus):
    pattern = r"__(?P<date>\d{4}-\d{2}-\d{2})__"
    plan = curation.backfill_dates(corpus, pattern)
    n = curation.backfill_counts(plan).first()
    assert n.matched + n.unmatched == corpus.documents.count() and n.inserted > 0 and n.updated > 0
    after = curation.apply_backfill(corpus.summaries, plan)
    assert after.count() == corpus.summaries.count() + n.inserted == after.select("summary_id").distinct().count()
    assert curation.backfill_counts(curation.backfill_dates(corpus.with_tables(summaries=after), pattern)).first()[:] == (n.matched, n.unmatched, n.invalid, 0, 0)
    body = curation.probe_dates(corpus, r"(?P<date>\d{4}-\d{2}-\d{2})", field="body", sample=50).first()
    assert body.population == 50 and not body.suggest
    refused("USAGE_ERROR", curation.probe_dates, corpus, pattern, field="title")


def test_findings_with_unknown_targets_are_refused(spark, corpus):
    chunk = corpus.chunks.first()["chunk_id"]
    finding = lambda body: spark.createDataFrame([(99, 1, "t", None, body)], "finding_id long, session_id long, title string, description string, body string")
    e = refused("UNKNOWN_FINDING_LINKS", curation.save_finding, corpus, finding(f"a [^chunk:{chunk}] [^finding:77777777] [^finding:88888888]"))
    assert e.extra == {"unknown_finding_ids": [77777777, 88888888]}
    assert refused("UNKNOWN_CITATIONS", curation.save_finding, corpus, finding("a [^chunk:9999999999]")).extra == {"unknown_chunk_ids": [9999999999]}
    after = curation.save_finding(corpus, finding(f"a [^chunk:{chunk}] [^finding:99]"))
    assert after.findings.where("finding_id = 99").count() == 1
    assert curation.delete_counts(after, spark.createDataFrame([(99,)], "finding_id long")).first()[:] == (1, 1, 1, 0)


def test_sessions_and_audit(spark, empty):
    one = curation.start_session(empty.sessions, spark.createDataFrame([(1, "s", True, "m", None)], "session_id long, name string, memory_enabled boolean, model string, run_key string"))
    said = curation.set_provenance(one, 1, harness="h").first()
    assert (said.model, said.harness) == ("m", "h")
    log = curation.log_call(curation.log_call(empty.audit_logs, 1, "scan", {"q": "x", "limit": None}, 12), 1, "search", {}, 5, "EMPTY_QUERY")
    assert [(r.audit_log_id, r.tool_name, r.args_json, r.result_summary) for r in log.orderBy("audit_log_id").collect()] == [(1, "scan", '{"q": "x"}', None), (2, "search", "{}", "error: EMPTY_QUERY")]


def test_staged_commits(spark, empty):
    parsed = spark.createDataFrame([("aa1", "a.txt", 3, None, None), ("bb2", "b.htm", None, None, None), ("bb3", "b.htm", None, "bb2", "s1"), ("bb2", "b.htm", None, None, None)], "file_hash string, file_name string, page_count int, parent_hash string, anchor_id string")
    chunks = spark.createDataFrame([("aa1", 0, "one"), ("aa1", 1, "two"), ("bb3", 0, "three")], "file_hash string, chunk_index int, text string")
    images = spark.createDataFrame([("aa1", "ff1", "/i/ff1", 2, 1), ("bb2", "ff1", "/i/ff1", None, 1)], "file_hash string, image_hash string, file_path string, page_number int, image_index_on_page int")
    failed = spark.createDataFrame([("aa1", "parse", 1), ("zz9", "parse", 2), ("ff1", "caption", 1), ("aa1", "summary", 1)], "file_hash string, stage string, attempts int")
    start = empty.with_tables(failed_ingests=curation._appended(empty.failed_ingests, failed))
    one = curation.persist_parse(start, parsed, chunks, images)
    rows = {r.file_hash: r for r in one.documents.collect()}
    assert sorted(r.document_id for r in rows.values()) == [1, 2, 3] and rows["bb3"].parent_document_id == rows["bb2"].document_id
    assert one.chunks.count() == 3 and one.chunks.select("chunk_id").distinct().count() == 3
    assert one.images.count() == 1 and one.document_images.count() == 2
    assert {(r.file_hash, r.stage) for r in one.failed_ingests.collect()} == {("zz9", "parse"), ("ff1", "caption"), ("aa1", "summary")}
    twice = curation.persist_parse(one, parsed, chunks, images)
    assert (twice.documents.count(), twice.chunks.count(), twice.document_images.count()) == (3, 3, 2)
    captions = spark.createDataFrame([(1, '{"d": 1}', "m", "a scene", "image_description")], "image_id long, analysis_json string, analysis_model string, text string, content_type string")
    two = curation.persist_captions(one, captions)
    assert two.images.first().analysis_json == '{"d": 1}' and two.chunks.where("source_kind = 'image'").first().text == "a scene" and two.failed_ingests.where("stage = 'caption'").count() == 0
    assert curation.persist_captions(two, captions).chunks.count() == two.chunks.count() == 4
    summary = lambda i, text: spark.createDataFrame([(i, rows["aa1"].document_id, "t", "d", text, "m", None)], "summary_id long, document_id long, title string, description string, text string, model string, authored_date string")
    three = curation.persist_summaries(curation.persist_summaries(two, summary(1, "first text")), summary(2, "second"))
    assert three.summaries.first().text == "second" and [r.text for r in three.chunks.where("source_kind = 'summary'").collect()] == ["second"]
    assert {r.stage for r in three.failed_ingests.collect()} == {"parse"}


def test_dense_numbers(spark):
    df = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("file_hash")).repartition(7)
    rows = curation.numbered(df, "n", F.lit(10)).orderBy("file_hash").collect()
    assert [r.n for r in rows] == list(range(10, 3010))


def test_rates_and_benchmark(spark):
    timings = spark.createDataFrame([(1, "parse", 2.0), (1, "embed", 1.0), (2, "parse", 1.0)], "document_id long, stage string, seconds double")
    documents = spark.createDataFrame([(1, 7), (2, None)], "document_id long, page_count int")
    assert curation.ingest_rates(timings, documents, 4.0).first()[:] == (2, 7, 0.5, 1.75)
    scores = spark.createDataFrame([(1, 2, 3, 5), (1, 1, 1, None)], "faithfulness int, coverage int, conciseness int, constraint_compliance int")
    assert [r["mean"] for r in benchmark.rubric_mean(scores).collect()] == [2.75, None]
    plan = spark.createDataFrame([("p", "m", d, "x", n) for n, d in enumerate("aabba")], "provider string, model string, doc string, extraction string, call int")
    runs = spark.createDataFrame([("p", "m", "a", "x", True, "s1", "h")] * 2, "provider string, model string, doc string, extraction string, ok boolean, source_sha string, summary_sha string")
    assert [r.run_index for r in benchmark.with_run_index(plan, runs).orderBy("call").collect()] == [2, 3, 0, 1, 4]
    none = spark.createDataFrame([], benchmark.JUDGMENT_SCHEMA)
    source = lambda sha: spark.createDataFrame([("a", "x", sha)], "doc string, extraction string, source_sha string")
    refused("SOURCE_DRIFT", benchmark.judge_topup, runs, none, 3, "j", source("s2"))
    assert benchmark.judge_topup(runs, none, 3, "j", source("s1")).first().missing == 3


def test_stores_get_a_time(spark, tmp_path):
    folder = str(tmp_path / "s")
    benchmark.append_store(spark.createDataFrame([("p", True)], "provider string, ok boolean"), folder)
    assert benchmark.read_store(spark, folder, benchmark.RUN_SCHEMA).first().ts is not None


def test_requests(corpus):
    listed = api.list_documents_request(corpus, "verbose", limit=3, tags=["ipv4", "quality"])
    assert len(listed["documents"]) == 3 and set(listed["documents"][0]) == {"id", *api.TIERS["verbose"], "tag_values"} - {"document_id"}
    assert set(listed["documents"][0]["tag_values"]) == {"ipv4"} and listed["hint"].startswith("Showing 1-3")
    assert set(api.list_documents_request(corpus, "brief", limit=1)["documents"][0]) == {"id", "file_name", "title"}
    assert set(api.describe_request(corpus, in_documents=[1, 2, 3])) >= {"totals", "dates", "tags", "largest"}
    read = api.read_document_request(corpus, 2)
    assert read["document"]["id"] == "document:2" and read["full_text"]
    assert api.read_document_request(corpus, 2, summary=True)["full_text"] is None
    assert api.answer(api.read_document_request, corpus, 2, most_tokens=1)["code"] == "DOCUMENT_TOO_LARGE"
    assert api.read_document_request(corpus, 2, force=True, most_tokens=1)["full_text"]
    chunk = corpus.chunks.where("source_kind = 'document' and source_id = 2").first().chunk_id
    assert api.answer(api.read_chunks_request, corpus, document_id=chunk) | {"error": ""} == {"error": "", "code": "DOCUMENT_NOT_FOUND", "hint": f"chunk:{chunk} is a chunk"}
    got = api.read_chunks_request(corpus, chunks=["chunk:150", f"chunk:{chunk}"])
    assert got["missing"] == ["chunk:150"] and got["chunks"][0]["chunk_id"] == f"chunk:{chunk}" and "document:150" in got["hint"]
    assert len(api.read_chunks_request(corpus, document_id=2, limit=1, preview=5)["chunks"][0]["text"]) == 6
    assert any(r["chunk_id"] == f"chunk:{chunk}" for r in api.read_chunks_request(corpus, around=chunk)["chunks"])
    assert api.answer(api.read_chunks_request, corpus, around=5)["code"] == "CHUNK_NOT_FOUND" and api.answer(api.read_chunks_request, corpus)["code"] == "USAGE_ERROR"
    finding = corpus.findings.first()
    closed = corpus.sessions.where(~F.col("memory_enabled") & (F.col("session_id") != finding.session_id)).first().session_id
    told = api.read_finding_request(corpus, finding.finding_id)
    assert told["body"] == finding.body and told["external_citations"][0]["scheme"] == "url"
    refused_ = api.answer(api.read_finding_request, corpus, finding.finding_id, closed)
    assert refused_["code"] == "MEMORY_OFF" and refused_["foreign_finding_ids"] == [f"finding:{finding.finding_id}"]
    assert api.answer(api.read_finding_request, corpus, 10**12)["code"] == "FINDING_NOT_FOUND"
    assert api.list_findings_request(corpus, limit=2)["total"] == corpus.findings.count()
    assert len(api.tags_request(corpus)["tags"]) == 10
    out = api.extract_request(corpus, "digits", [f"chunk:{chunk}", "chunk:150"])
    assert out["missing"] == ["chunk:150"] and set(out) == {"stored", "conflicts", "cast_errors", "no_match", "missing"}
    assert set(api.scan_request(corpus, "that", limit=1, brief=True)["results"][0]) <= set(scan.BRIEF)
    assert api.answer(api.scan_request, corpus, "that", brief=True, returning=["text"])["code"] == "RETURNING_NOT_APPLICABLE"
    assert api.capture_request(corpus, "that", r"/(th)/", deadline=300)["counts"][0]["value"] == "th"


def test_patterns_have_a_deadline(spark):
    slow = spark.range(0, 4 * 10**7, 1, 8).where(F.sha2(F.sha2(F.col("id").cast("string"), 512), 512) == "x")
    refused("CAPTURE_TIMEOUT", scan.within_seconds, spark, 0.5, slow.count)
    assert scan.within_seconds(spark, 60, spark.range(5).count) == 5
    with pytest.raises(ZeroDivisionError):
        scan.within_seconds(spark, 60, lambda: 1 / 0)


def test_command_line(spark, corpus, tmp_path):
    folder = str(tmp_path / "k")
    small = corpus.with_tables(chunks=corpus.chunks.where("source_id < 20"), audit_logs=corpus.audit_logs.limit(3))
    c.save(small, folder)
    assert cli.respond(spark, [folder, "scan", 'query=that', "limit=2"])["total"] > 0
    assert json.dumps(cli.respond(spark, [folder, "info"])) and "violations" in cli.respond(spark, [folder, "verify"])
    assert cli.respond(spark, [folder, "nope"])["code"] == cli.respond(spark, [folder, "scan", "quark=1"])["code"] == "USAGE_ERROR"
    assert cli.respond(spark, [str(tmp_path / "none"), "info"])["code"] == "NO_ACTIVE_PROJECT"


def test_routes_and_chunks(spark):
    filing = "<SEC-DOCUMENT>\n<DOCUMENT>\n<TYPE>10-K\n<FILENAME>a.txt\n<TEXT>\nfirst part\n</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>EX-1\n<FILENAME>b.htm\n<TEXT>\n<p>second</p>\n</TEXT>\n</DOCUMENT>"
    rows = [("a.txt", "plain words", "text"), ("b.html", "<p>page</p>", "html"), ("c.md", "# H\nbody", "markdown"), ("d.txt", filing, "text"), ("e.pdf", "<!DOCTYPE html>x", "pdf"), ("f.pdf", "%PDF p1|p2", "pdf"), ("g.htm", f"<html {files.INLINE_FACTS}>facts", "html"), ("h.png", "\x89", "image")]
    routed = routes.with_routes(spark.createDataFrame([(p, bytearray(t.encode()), k) for p, t, k in rows], "path string, content binary, type string"))
    assert {r.path: r.route for r in routed.collect()} == {"a.txt": "text", "b.html": "html", "c.md": "markdown", "d.txt": "filing", "e.pdf": "refused", "f.pdf": "pdf", "g.htm": "facts", "h.png": "image"}
    extract = lambda raw: ["x" * 150, "short", ""]

    def recognise(raw, number):
        if number == 3:
            raise RuntimeError("no reader")
        return "y" * 120, 80.0

    out = routes.chunks(routed, extract, recognise, lambda text: [("cell", None, None, "sec_table"), (" ", None, None, "sec_text")])
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.path, r.chunk_index)):
        got.setdefault(r.path, []).append((r.chunk_index, r.text[:11], r.section_heading, r.page_number, r.content_type))
    assert got == {
        "a.txt": [(0, "plain words", None, None, None)], "b.html": [(0, "page", None, None, "text")], "c.md": [(0, "body", "H", None, None)],
        "d.txt": [(0, "first part", None, None, None), (1, "second", None, None, "text")], "f.pdf": [(0, "x" * 11, None, 1, "text"), (1, "y" * 11, None, 2, "ocr")], "g.htm": [(0, "cell", None, None, "sec_table")],
    }
    assert {r.page_number: r.content_type for r in routes.pages(routed.where("path = 'f.pdf'"), extract, recognise).collect()} == {1: "text", 2: "ocr", 3: None}


def test_archive_by_content(spark, tmp_path):
    folder = str(tmp_path / "a")
    df = spark.createDataFrame([("aa", bytearray(b"1")), ("aa", bytearray(b"1")), ("bb", bytearray(b"2"))], "file_hash string, content binary")
    routes.archive(df.where("file_hash = 'aa'"), folder)
    routes.archive(df, folder)
    assert sorted(r.file_hash for r in spark.read.parquet(folder).collect()) == ["aa", "bb"]


def test_images(spark):
    row = spark.range(1).select(*routes.scaled(F.lit(4000), F.lit(3), 1000), routes.is_too_small(F.lit(28), F.lit(500), 32), routes.is_text_image(F.lit(300), F.lit(60.0)), routes.is_text_image(F.lit(299), F.lit(99.0))).first()
    assert row[:] == (1000, 1, True, True, False)
    told = spark.createDataFrame([(1, "text", " words ", ""), (2, "scene", "", "a view"), (3, "scene", "t", " "), (4, "none", "t", "d")], "image_id long, kind string, text string, description string")
    assert [tuple(r) for r in routes.image_chunks(told).orderBy("image_id").collect()] == [(1, "words", "image_ocr"), (2, "a view", "image_description")]


def test_figures_cover_what_they_cover(spark):
    page = 600.0 * 800
    boxes = [(1, 0, 0, 100, 8), (1, 0, 0, 8, 100), (1, 50, 50, 60, 60), (2, 0, 0, 60, 60), (2, 62.9, 0, 70, 60), (3, 0, 0, 60, 60), (4, 0, 0, 600, 790)]
    df = spark.createDataFrame([tuple(map(float, b)) + (page,) for b in boxes], "page_id double, x0 double, y0 double, x1 double, y1 double, page_area double").withColumn("page_id", F.col("page_id").cast("long"))
    tables = spark.createDataFrame([(3, 10.0, 10.0, 50.0, 50.0)], "page_id long, x0 double, y0 double, x1 double, y1 double")
    # an L covers 1,536 (and a rim), though its frame has 10,000; a table's page has no figure; a page's frame is none
    assert [tuple(r) for r in files.vector_figures(df, tables).collect()] == [(2, 1000, -1.5, -1.5, 71.5, 61.5)]


def test_sections_need_a_table_of_contents():
    body = '<h2 id="a"></h2><p>one</p><h2 id="b"></h2><p>two</p><h2 id="c"></h2><p>three</p>'
    toc = '<p>Title</p><table><tr><td><a href="#b">B</a></td><td><a href="#b">7</a></td></tr><tr><td><a href="#a">A</a></td></tr></table>'
    assert files.sections(toc + body) == [(0, None, "__preamble__", "Title"), (1, "a", "A", "one"), (2, "b", "B", "two\n\nthree")]
    assert files.sections('<p>See <a href="#a">A</a> and <a href="#b">B</a>.</p>' + body) == []
    cut = '<ul><li><a href="#a">A</a></li><li><a href="#gone">G</a></li><li><a href="#b">B</a></li><li><a href="#c">C</a></li></ul>'
    assert [s[1] for s in files.sections(cut + body)] == [None, "b", "c"]  # a link without a target parts the run


def test_tokens_are_counted_by_what_is_handed_in(spark):
    class Letters:
        encode = staticmethod(list)
        decode = staticmethod("".join)

    df = spark.createDataFrame([("abcdefgh",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(counting.count_tokens(F.col("t"))).collect()] == [2, 0, 0]
    assert [r[0] for r in df.select(counting.count_tokens(F.col("t"), lambda: Letters)).collect()] == [8, 0, 0]
    assert [r[0] for r in df.select(counting.truncate_tokens(F.col("t"), 3, lambda: Letters)).collect()] == ["abc", None, ""]


def test_scope_of_counts_by_date(corpus):
    rows = scan.count_by_document(corpus, "that", scope.resolve(corpus), sort="date").collect()
    dates = [r.authored_date for r in rows]
    assert dates == sorted(d for d in dates if d) + [None] * dates.count(None)
