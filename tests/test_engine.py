"""Exact small cases of the engine's operators."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire import api
from quire.errors import EngineError
from quire.functions import regexes
from quire.functions import text as tx
from quire.functions import vectors
from quire.operators import benchmark, citations, curation, fts, integrity, models, profile, reads, scan, scope, search, tags
from quire.sources import corpus as c
from quire.sources import files, share
from quire.streaming import ingest


def value(spark, column, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(column).first()[0] if cols else spark.range(1).select(column).first()[0]


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    from quire.plans.registry import corpus_of

    return corpus_of(spark, sf_dir)


def test_chunks(spark):
    def pieces(text, *args):
        return [(r.chunk_index, r.text) for r in value(spark, tx.chunk_pieces(F.lit(text), *args))]

    assert pieces("short") == [(0, "short")] and pieces("  ") == [] and pieces(None) == []
    long = "".join(chr(97 + i % 26) for i in range(2000))
    got = pieces(long)
    assert [x for _, x in got] == [long[:800], long[700:1500], long[1400:]]
    assert pieces("ab" + " " * 20 + "cd", 8, 2) == [(0, "ab"), (1, "cd")]
    with pytest.raises(ValueError):
        tx.chunk_pieces(F.lit("x"), 5, 5)


def test_tokens_and_phrases(spark):
    assert value(spark, tx.tokens(F.lit("H.R. 815 foo_bar Éclair ß 5,376"))) == ["h", "r", "815", "foo", "bar", "eclair", "ß", "5", "376"]
    assert tx.py_tokens("H.R. 815 foo_bar Éclair ß") == ["h", "r", "815", "foo", "bar", "eclair", "ß"]
    chunks = spark.createDataFrame([(1, "document", 5, "A b, a b a", "b Head"), (2, "image", 6, "b", None), (3, "finding", 7, None, "a")], "chunk_id long, source_kind string, source_id long, text string, section_heading string")
    table = fts.postings(chunks)
    assert fts.statistics(chunks, table).first()[:] == (3, 9)
    found = lambda *phrases, **kw: sorted(r.chunk_id for r in fts.holding(table, list(phrases), **kw).collect())
    assert found(["b", "a"], ["a"]) == [1] and found(["b"]) == [1, 2] and found(["a", "a"]) == found() == [] and found(["a"], in_heading=True) == [3]
    assert [[r.f for r in fts.hits(table, p).collect()] for p in (["a"], ["a", "b", "a"], ["a"] * 7)] == [[3.0], [2.0], []]
    assert {r.doc_len for r in fts.hits(table, ["a"]).collect()} == {7}
    assert fts.scan_phrases('say "x y"  z') == [["say", "x", "y", "z"]] and fts.search_phrases('"x.y" - z') == [["x", "y"], ["z"]]


@pytest.mark.parametrize("text,want", [("$1,234,567", "1234567"), ("(5,000)", "-5000"), ("12%", "12"), ("1d", None), ("1_000", None), ("", None), (".5", ".5")])
def test_numbers(spark, text, want):
    assert value(spark, tx.normalize_number(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [("2024-02-29", "2024-02-29"), (" 2024-01-01 ", "2024-01-01"), ("2024-13-40", None), ("2024-2-3", None), ("0000-01-01", None)])
def test_dates(spark, text, want):
    assert value(spark, tx.authored_date(F.lit(text))) == want


def test_small_functions(spark):
    assert value(spark, tx.preview(F.lit("abcdef"), 3)) == "abc…" and value(spark, tx.preview(F.lit("abc"), 3)) == "abc"
    assert value(spark, tx.slug(F.lit("  A b--C! "))) == "a-b-c" and value(spark, tx.slug(F.lit("!!"))) == "finding"
    assert value(spark, tx.normalize_name(F.lit("A-b 1"))) == "ab1"
    assert value(spark, tx.clamp_snippet(F.lit("one two, three"), 9)) == "one two…"
    assert value(spark, tx.strip_ext(F.lit("a.b.txt"))) == "a.b" and value(spark, tx.duration(F.lit(1500))) == "1.50s"
    assert value(spark, tx.like_any(F.lit("a\\xb"), ["A\\_b"])) and not value(spark, tx.like_any(F.lit("a_b"), ["a\\_b"]))
    assert tx.parse_ids(["chunk:3", "chunk:1", "chunk:3"], "chunk") == [3, 1]
    with pytest.raises(EngineError):
        tx.parse_ids(["3"], "chunk")
    with pytest.raises(EngineError):
        tx.parse_ids(["chunk:0"], "chunk")


def test_shown_texts(spark):
    assert value(spark, tx.date_range(F.lit("2020"), F.lit("2021"))) == "2020 – 2021" and value(spark, tx.date_range(F.lit("2020"), F.lit("2020"))) == "2020" and value(spark, tx.date_range(F.lit(None), F.lit("x"))) is None
    assert value(spark, tx.pluralize(F.lit(1234), "match", "matches")) == "1,234 matches" and value(spark, tx.pluralize(F.lit(1), "chunk")) == "1 chunk"
    assert [(r.text, r.highlight) for r in value(spark, tx.highlighted(F.lit("C++ category, a Cat"), "cat c++"))] == [("C++", True), (" ", False), ("cat", True), ("egory, a ", False), ("Cat", True)]
    assert [(r.text, r.highlight) for r in value(spark, tx.highlighted(F.lit("abc"), " "))] == [("abc", False)]
    assert value(spark, tx.truncated(F.lit("x" * 90))) == "x" * 79 + "…" and value(spark, tx.truncated(F.lit(None).cast("string"))) == ""
    assert value(spark, tx.sorted_json(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")))) == '{"a":"2","b":"1"}'


def test_regexes():
    assert regexes.java(r"(?P<a_b>x)(?P=a_b)") == r"(?<aUb>x)\k<aUb>"
    assert regexes.columns([r"(?P<n>a)(b)", r"(c)"], set()) == [("n", r"(?P<n>a)(b)", 1), ("g1", r"(?P<n>a)(b)", 2), ("g2", r"(c)", 1)]
    for bad, code in (("x", "INVALID_CAPTURE_REGEX"), ("/(/", "INVALID_CAPTURE_REGEX")):
        with pytest.raises(EngineError) as e:
            regexes.unslash(bad)
        assert e.value.code == code
    with pytest.raises(EngineError) as e:
        regexes.group_names("abc")
    assert e.value.code == "CAPTURE_NO_GROUP"
    with pytest.raises(EngineError) as e:
        regexes.columns(["(?P<n>a)", "(?P<n>b)"], set())
    assert e.value.code == "EXTRACT_COLUMN_COLLISION"


def test_rrf(spark):
    one = spark.createDataFrame([(i, -float(p)) for p, i in enumerate([10, 20, 30, 40])], "chunk_id long, score double")
    two = spark.createDataFrame([(i, float(p)) for p, i in enumerate([30, 10, 50])], "chunk_id long, distance double")
    rows = search.fuse(one, two, 10).collect()
    assert [r.chunk_id for r in rows] == [10, 30, 20, 50, 40]
    assert abs(rows[0].score - (1 / 61 + 1 / 62)) < 1e-12 and abs(rows[1].score - (1 / 63 + 1 / 61)) < 1e-12


def test_nearest_looks_within_scope(corpus):
    v = [float(x) for x in corpus.embeddings.first()["embedding"]]
    far = scope.resolve(corpus, in_documents=[60, 61, 62])
    got = search.nearest(corpus, v, far, ["document"], 2).join(corpus.chunks, "chunk_id").select("source_id").collect()
    assert {r.source_id for r in got} <= {60, 61, 62} and len(got) == 2
    assert value(corpus.spark, vectors.cosine(F.array(F.lit(3.0), F.lit(4.0)), vectors.literal([6, 8]))) == 1.0


def test_search_is_part_of_scan_and_pages_join(corpus):
    everything = scope.resolve(corpus)
    whole = [r.chunk_id for r in scan.rows(corpus, "that", everything, limit=10_000).collect()]
    parts = [r.chunk_id for o in range(0, len(whole), 37) for r in scan.rows(corpus, "that", everything, limit=37, offset=o).collect()]
    assert parts == whole and len(set(whole)) == len(whole)
    assert {r.chunk_id for r in search.full_text(corpus, "that", everything, ["document"], 10**6).collect()} == set(whole)


def test_search_modes_and_memory(corpus):
    everything = scope.resolve(corpus)
    by_model = search.search(corpus, "that", everything, embed=lambda q: [0.1] * 64, modes=["semantic"], limit=5)
    assert by_model.count() == 5
    for args in ({"modes": ["semantic"]}, {"embed": lambda q: 1 / 0}, {"embed": lambda q: []}, {"embed": lambda q: [float("nan")]}):
        with pytest.raises(EngineError) as e:
            search.search(corpus, "that", everything, **args)
        assert e.value.code == "EMBED_FAILED"
    with pytest.raises(EngineError):
        search.search(corpus, "that", everything, modes=["nope"])
    closed = corpus.sessions.where("not memory_enabled").first().session_id
    open_ = corpus.sessions.where("memory_enabled").first().session_id
    kinds = lambda session: {r.source_kind for r in search.search(corpus, "that", everything, kinds=c.KINDS, limit=500, session_id=session).collect()}
    assert "finding" in kinds(open_) and "finding" in kinds(None) and "finding" not in kinds(closed)
    foreign = corpus.chunks.where("source_kind = 'finding'").join(corpus.findings.where(F.col("session_id") != closed).select(F.col("finding_id").alias("source_id")), "source_id", "left_semi").first().chunk_id
    assert [[r.found for r in reads.by_ids(corpus, [foreign], s).collect()] for s in (closed, open_)] == [[False], [True]]


def test_index_follows_the_chunks(corpus, tmp_path):
    some = corpus.chunks.where("source_kind = 'document' and source_id < 20")
    cut = corpus.with_tables(chunks=some)
    assert corpus.postings is not None and cut.postings is None
    want = {r.chunk_id for r in scan.matches(cut, "that", scope.resolve(cut)).collect()}
    c.save(cut.with_tables(**{t: getattr(cut, t).limit(50) for t in ("audit_logs", "document_tags")}), str(tmp_path / "k"))
    again = c.open_corpus(corpus.spark, str(tmp_path / "k"))
    assert again.postings is not None and {r.chunk_id for r in scan.matches(again, "that", scope.resolve(again)).collect()} == want and want


def test_empty_captures_count(spark):
    df = spark.createDataFrame([("a1 b c22",)], "text string")
    got = lambda p, g=1: df.select(regexes.matches(F.col("text"), p, g)).first()[0]
    assert got(r"[a-c](\d*)") == ["1", "", "22"] and got(r"[a-c](\d+)?") == ["1", "22"] and got(r"a(\d)|b") == ["1"]


def test_scopes_and_refusals(corpus):
    for code, args in (("TAG_NOT_FOUND", {"tags": ["nope"]}), ("INVALID_DATE", {"date_from": "2024-02-30"})):
        with pytest.raises(EngineError) as e:
            scope.resolve(corpus, **args)
        assert e.value.code == code
    assert scope.resolve(corpus).ids is None and scope.resolve(corpus, include_nulls=True).ids is None
    assert scope.resolve(corpus, in_documents=[]).ids.count() == 0
    with pytest.raises(EngineError) as e:
        scan.matches(corpus, " ", scope.resolve(corpus))
    assert e.value.code == "EMPTY_QUERY"
    with pytest.raises(EngineError) as e:
        scan.rows(corpus, "x", scope.resolve(corpus), returning=["nope"])
    assert e.value.code == "UNKNOWN_RETURNING_FIELD"


def test_diagnosis(corpus):
    def verdict(q, **args):
        where = scope.resolve(corpus, **args.pop("scope", {}))
        return scan.diagnosis(corpus, q, where, **args).first()["verdict"]

    assert verdict("zzzzqqqq") == "absent" and verdict("appendix") == "heading_only" and verdict("that") == "found"
    assert verdict("that", heading_like=["nothing%"]) == "filtered_out" and verdict("that", scope={"in_documents": []}) == "out_of_scope"


def test_regex_cap(corpus):
    rows = scan.count_by_regex(corpus, "that", r"/(th)/", scope.resolve(corpus), cap=None).collect()
    assert sum(r.n for r in rows) > 5 and not any(r.truncated for r in rows)
    rows = scan.count_by_regex(corpus, "that", r"/(th)/", scope.resolve(corpus), cap=5).collect()
    assert [(r.value, r.n, r.truncated) for r in rows] == [("th", 5, True)]


def test_api(corpus):
    out = api.scan_request(corpus, "that", limit=2, in_documents=list(range(60)))
    assert out["total"] > 2 and len(out["results"]) == 2 and out["results"][0]["chunk_id"].startswith("chunk:") and "hint" in out
    assert api.scan_request(corpus, "zzzzqqqq")["diagnosis"]["verdict"] == "absent"
    assert api.answer(api.scan_request, corpus, "")["code"] == "EMPTY_QUERY"
    assert json.dumps(api.search_request(corpus, "that", limit=3, brief=True)["results"])


def test_values(spark):
    rows = [(1, 10, 0, "Total revenue was $1,234,567 for the year."), (2, 20, 0, "Revenue: 42 units reported."), (3, 30, 0, "revenue 1"), (3, 31, 1, "revenue 2"), (4, 40, 1, "revenue 7"), (4, 41, 0, "revenue 7"), (5, 50, 0, "none"), (6, 60, 0, "revenue: ,")]
    got = tags.extract_values(spark.createDataFrame(rows, "document_id long, chunk_id long, chunk_index int, text string"), r"(?i)revenue:?\s*(?:was\s+)?\$?(?P<value>[\d,]+)", "number")
    assert {tuple(r) for r in got["stored"].collect()} == {(1, "1234567", 10), (2, "42", 20), (4, "7", 41)}
    assert [tuple(r) for r in got["conflicts"].collect()] == [(3, 2)] and [r.chunk_id for r in got["cast_errors"].collect()] == [60] and [r.chunk_id for r in got["no_match"].collect()] == [50]
    with pytest.raises(EngineError):
        tags.extract_values(spark.createDataFrame(rows, "document_id long, chunk_id long, chunk_index int, text string"), r"(\d)", "number")


def test_merging_tags(spark):
    dt = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", 6), (2, 1, "x", 7), (2, 2, None, None), (3, 1, "c", 8), (4, 2, "d", 9), (5, 3, None, None)], "document_id long, tag_id long, value string, chunk_id long")
    assert {r.document_id: (r.outcome, r.value) for r in tags.merge_plan(dt, 1, 2).collect()} == {1: ("collision", "b"), 2: ("carry", "x"), 3: ("copy", "c"), 4: ("keep", "d")}
    assert {(r.document_id, r.tag_id) for r in tags.merged(dt, 1, 2).collect()} == {(1, 2), (2, 2), (3, 2), (4, 2), (5, 3)}
    with pytest.raises(EngineError):
        tags.merge_plan(dt, 1, 1)
    names = spark.createDataFrame([(1, "Big-Deal"), (2, "other")], "tag_id long, name string")
    with pytest.raises(EngineError):
        tags.rename(names, 2, "bigdeal")
    assert tags.rename(names, 1, "big deal").where("tag_id = 1").first()["name"] == "big deal"


def test_citations(spark):
    bodies = ["ok [^chunk:4] [^chunk:2] [^chunk:4] [^finding:9] [^URL: http://x ] [^doc:d]", "see [3] [^chunk:1]", "see [^3]", "x [^chunk:42abc]", "x [^chunk:1] [^document:3]", "x [^chunk:1] [^ftp:x]", "x [^chunk:1] [^url: ]", "none", " "]
    f = spark.createDataFrame(list(enumerate(bodies)), "finding_id long, body string")
    assert [(r.position, r.chunk_id) for r in citations.edges(f).where("finding_id = 0").collect()] == [(0, 4), (1, 2)]
    assert [(r.scheme, r.ref) for r in citations.external(f).where("finding_id = 0").collect()] == [("url", "http://x"), ("doc", "d")]
    assert {r.finding_id: r.code for r in citations.errors(f).collect()} == {1: "MALFORMED_CITATION", 2: "MALFORMED_CITATION", 3: "MALFORMED_CITATION", 4: "WRONG_CITATION_TYPE", 5: "MALFORMED_EXTERNAL_CITATION", 6: "MALFORMED_EXTERNAL_CITATION", 7: "NO_INLINE_CITATIONS", 8: "EMPTY_BODY"}
    assert citations.footnotes(f).where("finding_id = 0").first()["body"] == "ok [1] [2] [1] † ‡ §"
    assert citations.inert(f).where("finding_id = 1").first()["body"] == "see [3] (chunk:1)"
    twice = citations.legacy_markers(citations.legacy_markers(f).drop("rewritten")).where("finding_id = 2").first()
    assert twice.body == "see [^chunk:3]" and twice.rewritten == 0


def test_findings_change(corpus, spark):
    new = spark.createDataFrame([(10**9, 1, "t", "d", "see [^chunk:400001]")], "finding_id long, session_id long, title string, description string, body string")
    after = curation.save_finding(corpus, new)
    assert after.finding_citations.where("finding_id = 1000000000").count() == 1 and after.chunks.where("source_kind = 'finding' and source_id = 1000000000").count() == 1
    own = after.chunks.where("source_id = 1000000000").first()["chunk_id"]
    with pytest.raises(EngineError) as e:
        curation.edit_finding(after, new.withColumn("body", F.lit(f"me [^chunk:{own}]")))
    assert e.value.code == "CITES_OWN_CHUNKS"
    gone = curation.delete_findings(after, new.select("finding_id"))
    assert gone.findings.count() == corpus.findings.count() and gone.chunks.where("source_id = 1000000000").count() == 0
    with pytest.raises(EngineError) as e:
        curation.save_finding(corpus, new.withColumn("body", F.lit("x [^chunk:7]")))
    assert e.value.code == "UNKNOWN_CITATIONS"
    with pytest.raises(EngineError) as e:
        curation.merge_findings(after, new, [10**9])
    assert e.value.code == "TARGET_IN_SOURCES"


def test_tables_change(spark):
    old = spark.createDataFrame([("h", "parse", "e1", 2, "2024-01-01")], "file_hash string, stage string, error string, attempts int, last_attempt string")
    new = spark.createDataFrame([("h", "parse", "e2", "2024-01-02"), ("i", "parse", "e3", "2024-01-03")], "file_hash string, stage string, error string, last_attempt string")
    after = curation.record_failures(old, new)
    assert {r.file_hash: (r.attempts, r.error) for r in after.collect()} == {"h": (3, "e2"), "i": (1, "e3")}
    assert [r.file_hash for r in curation.retryable(after).collect()] == ["i"] and tuple(curation.failed_totals(after).first()) == (2, 1)
    s = spark.createDataFrame([(1, "a", "k")], "session_id long, name string, run_key string")
    more = spark.createDataFrame([(2, "b", "k"), (3, "a", None), (4, "c", None), (5, "d", "q")], "session_id long, name string, run_key string")
    assert {r.session_id for r in curation.start_session(s, more).collect()} == {1, 4, 5}
    dates = spark.createDataFrame([(1, "2020-01-01")], "document_id long, authored_date string")
    assert curation.save_date(dates, 1, None).first()["authored_date"] is None
    for code, args in (("INVALID_DATE", (1, "2020-1-1")), ("NO_SUMMARY", (2, "2020-01-01"))):
        with pytest.raises(EngineError) as e:
            curation.save_date(dates, *args)
        assert e.value.code == code


def test_reads(corpus):
    ids = [r.chunk_id for r in corpus.chunks.where("source_id = 2 and source_kind = 'document'").collect()]
    assert [(r.chunk_id, r.found) for r in reads.by_ids(corpus, [7, ids[0], 7]).collect()] == [(7, False), (ids[0], True)]
    with pytest.raises(EngineError) as e:
        reads.read_document(corpus, 10**9)
    assert e.value.code == "DOCUMENT_NOT_FOUND"
    with pytest.raises(EngineError) as e:
        reads.read_document(corpus, 2, full=True, max_tokens=0)
    assert e.value.code == "DOCUMENT_TOO_LARGE"
    assert reads.read_document(corpus, 2, full=True).first()["text"]
    with pytest.raises(EngineError):
        profile.list_documents(corpus, scope.resolve(corpus), "nope")


def test_leaderboard(spark):
    runs, judged = [], []
    for model, ok, tokens in (("alpha", [1, 1, 1], 400), ("beta", [1, 1, 1], 200), ("gamma", [1, 1, 0], 800)):
        for i, good in enumerate(ok):
            runs.append(("ollama", model, f"d{i}", "x", bool(good), 5.0, 10**9, tokens, "s"))
            judged.append(("ollama", model, f"d{i}", "x", "j", "s", {"alpha": 4.0, "beta": 3.75, "gamma": 5.0}[model]))
    r = spark.createDataFrame(runs, "provider string, model string, doc string, extraction string, ok boolean, wall_seconds double, load_duration_ns long, prompt_eval_count long, summary_sha string")
    j = spark.createDataFrame(judged, "provider string, model string, doc string, extraction string, judge string, summary_sha string, mean double")
    board = benchmark.leaderboard(r, j)
    assert [(x.model, x.quality, x.input_tps, x.disqualified) for x in board.collect()] == [("alpha", 4.0, 100.0, False), ("beta", 3.75, 50.0, False), ("gamma", None, None, True)]
    assert [x.model for x in benchmark.pareto_frontier(board).collect()] == ["alpha"]
    assert benchmark.judge_topup(r, j, 2, "j").agg(F.sum("missing")).first()[0] == 8


def test_stores(spark, tmp_path):
    d = tmp_path / "store"
    d.mkdir()
    (d / "a.jsonl").write_text('{"provider": "p", "ok": true}\nnot json\n{"provider": "q"}\n')
    assert {r.provider for r in benchmark.read_store(spark, str(d), benchmark.RUN_SCHEMA).collect()} == {"p", "q"}


def test_envelope(spark):
    text = "<SEC-DOCUMENT>x\n<DOCUMENT>\n<TYPE>10-K\n<FILENAME>a.htm\n<TEXT>\n<XBRL>\n<html><p>TYPE</html>\n</XBRL>\n</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>GRAPHIC\n<FILENAME>b.jpg\n<TEXT>\nbegin 644 b.jpg\n</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>EX-99\n<FILENAME>c.txt\n<TEXT>\nplain\n</TEXT>\n</DOCUMENT>"
    df = spark.createDataFrame([("f", text)], "path string, text string")
    assert df.select(files.is_envelope(F.col("text"))).first()[0]
    assert [(r.doc_type, r.file_name, r.route) for r in files.split_envelope(df).orderBy("position").collect()] == [("10-K", "a.htm", "html"), ("GRAPHIC", "b.jpg", "skip"), ("EX-99", "c.txt", "text")]


def test_sections(spark):
    page = "<p>Cover</p><p><a href='#one'>Item 1</a> <a href='#one'>3</a> <a href='#two'>Item 2</a></p><h2 id='one'>Item 1</h2><p>First body.</p><h2><a name='two'></a>Item 2</h2><p>Second body, see <a href='#one'>above</a>.</p>"
    got = files.html_sections(spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "page_id long, html string"), "page_id").collect()
    assert [(r.page_id, r.anchor_id, r.section_title) for r in got] == [(1, None, "__preamble__"), (1, "one", "Item 1"), (1, "two", "Item 2")]
    assert "First body." in got[1].text and "Second" not in got[1].text


def plain_markdown(text, limit):
    """What chunks of markdown are, line by line and letter by letter."""
    out, heading, body = [], None, []

    def close():
        whole = "\n".join(body).strip()
        parts = []
        if len(whole) <= limit:
            parts.append(whole)
        else:
            for para in re.split(r"\n\s*\n", whole):
                if len(para) > limit:
                    parts += [(x, True) for x in ["".join(para[i : i + limit]) for i in range(0, len(para), limit)]]
                elif para.strip():
                    parts.append((para, False))
            packed = []
            for x, alone in parts:
                if packed and not alone and not packed[-1][1] and len(packed[-1][0]) + 2 + len(x) <= limit:
                    packed[-1] = (packed[-1][0] + "\n\n" + x, False)
                else:
                    packed.append((x, alone))
            parts = [x for x, _ in packed]
        out.extend((heading, x.strip()) for x in parts if x.strip())
        body.clear()

    for line in text.splitlines():
        marks = len(line) - len(line.lstrip("#"))
        if 1 <= marks <= 6 and line[marks : marks + 1].isspace() and line[marks:].strip():
            close()
            heading = line[marks:].strip()
        else:
            body.append(line)
    close()
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a# \n\n\nb", max_size=120), st.integers(1, 30))
def test_markdown_equals_the_plain_statement(text, limit):
    assert files.markdown_chunks(text, limit) == plain_markdown(text, limit)


def test_markdown():
    assert [len(t) for _, t in files.markdown_chunks("x" * 1700 + "\n\ny")] == [1600, 100, 1]
    assert files.markdown_chunks("#\n\nplain text") == [(None, "#\n\nplain text")]
    assert files.markdown_chunks("a \n\n\n b") == [(None, "a \n\n\n b")]
    assert files.markdown_chunks("") == [] and files.markdown_chunks("plain") == [(None, "plain")]
    assert files.markdown_chunks("a\n# H one\nb\n\nc\n## Two\nd") == [(None, "a"), ("H one", "b\n\nc"), ("Two", "d")]
    long = files.markdown_chunks("x" * 4000)
    assert [len(t) for _, t in long] == [1600, 1600, 800]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.TXT").write_text("hello")
    (tmp_path / "y").write_bytes(b"%PDF-1.7")
    (tmp_path / "z.bin").write_bytes(b"\x00")
    got = {r.path.rsplit("/", 1)[1]: r.type for r in files.collect(spark, [str(tmp_path)]).collect()}
    assert got == {"x.TXT": "text", "y": "pdf", "z.bin": None}
    assert files.format_filter(["htm", "pdf"]) == ["html", "pdf"]
    with pytest.raises(EngineError):
        files.format_filter(["exe"])
    fs = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3")], "path string, file_hash string")
    known = spark.createDataFrame([("2",)], "file_hash string")
    failed = spark.createDataFrame([("3", "parse", 3)], "file_hash string, stage string, attempts int")
    assert {r.path: r.action for r in files.classify(fs, known, failed).collect()} == {"a": "parse", "b": "duplicate", "c": "skip", "d": "give_up"}


def test_figures(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 50.0, 1e6), (1, 52.0, 0.0, 100.0, 50.0, 1e6), (1, 300.0, 300.0, 310.0, 310.0, 1e6)], "page_id long, x0 double, y0 double, x1 double, y1 double, page_area double")
    assert [tuple(r) for r in files.vector_figures(boxes).collect()] == [(1, 1000, -1.5, -1.5, 101.5, 51.5)]


def test_corpus_on_disk(corpus, spark, tmp_path):
    few = corpus.with_tables(chunks=corpus.chunks.where("source_id < 5"), audit_logs=corpus.audit_logs.limit(3))
    folder = str(tmp_path / "c")
    share.publish(few, folder, "m1")
    back = share.take_in(spark, folder, "/new/", "m1")
    assert back.chunks.where("source_kind = 'finding'").count() == 0 and back.findings.count() == 0
    assert back.documents.first()["file_path"].startswith("/new/") and back.chunks.count() == few.chunks.where("source_kind <> 'finding'").count()
    with pytest.raises(EngineError) as e:
        share.take_in(spark, folder, "/new", "m2")
    assert e.value.code == "MODEL_MISMATCH"
    empty = str(tmp_path / "e")
    c.create(spark, empty)
    opened = c.open_corpus(spark, empty)
    assert opened.documents.count() == 0 and integrity.schema_faults({"documents": opened.documents}, c.SCHEMAS) == []
    assert c.upgrade(spark.createDataFrame([(1,)], "tag_id long"), "tags").columns == [f.split()[0] for f in c.SCHEMAS["tags"].split(", ")]
    with pytest.raises(EngineError):
        c.open_corpus(spark, str(tmp_path / "none"))


def test_audits(corpus):
    report = integrity.run_all(corpus)
    assert set(report) == {"orphan_chunks", "id_sync", "violations", "contradicted_failures"} and report["orphan_chunks"] == {"n": 0, "examples": []}
    many = integrity.run_all(corpus.with_tables(documents=corpus.documents.where("false")), shown=3)["orphan_chunks"]
    assert many["n"] == corpus.chunks.where("source_kind = 'document'").count() and len(many["examples"]) == 3
    assert isinstance(integrity.run_all(corpus.with_tables(embeddings=None))["id_sync"], Exception)


def test_models(spark):
    df = spark.createDataFrame([(1, "One sentence. Two."), (2, None)], "document_id long, text string")
    assert {r.document_id: r.title for r in models.summarize(df).collect()} == {1: "One sentence.", 2: ""}
    v = models.embed(df, key="document_id").where("document_id = 1").first()["embedding"]
    assert abs(sum(x * x for x in v) - 1) < 1e-5
    assert models.keyword_classifier("A red car", {"colour": ["red"], "animal": ["dog"]}) == ["colour"]


def test_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string").coalesce(1).write.parquet(src)
    ingest.new_documents(spark, src, "doc_id long, text string", out, ck).awaitTermination(60)
    spark.createDataFrame([(4, "b"), (5, "c")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    ingest.new_documents(spark, src, "doc_id long, text string", out, ck).awaitTermination(60)
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [1, 2, 5]


def test_event_sessions(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert ingest.sessions(events).agg(F.sum("n")).first()[0] == events.count()
    assert events.schema["ts"].dataType.typeName().startswith("timestamp")


def test_finding_files_and_models(spark):
    from quire.sources import artifacts

    f = spark.createDataFrame([(1, 'A "b"\\c', None, "x [^chunk:3]\n---\ny"), (2, "", "d: e", "")], "finding_id long, title string, description string, body string")
    rows = artifacts.finding_files(f)
    assert {r.file_name for r in rows.collect()} == {"a-b-c-1.md", "finding-2.md"}
    assert {r.finding_id: (r.title, r.description, r.body) for r in artifacts.read_finding_files(rows).collect()} == {1: ('A "b"\\c', "", "x (chunk:3)\n---\ny"), 2: ("", "d: e", "")}
    assert artifacts.parse_model("a/b/c:d") == ("a", "b/c:d")
    with pytest.raises(EngineError):
        artifacts.parse_model("x")
    refs = spark.createDataFrame([("a/b:c",), ("a/b-c",), ("q/z",)], "ref string")
    assert [tuple(r) for r in artifacts.slug_clashes(refs).collect()] == [("a-b-c", 2)]
    blind = artifacts.blind(refs, "ref", 7)
    assert {r.label for r in blind.collect()} == {"model-1", "model-2", "model-3"} and blind.columns == ["label"]


def test_views_clamp(corpus):
    from quire.operators import views

    assert views.clamp(0, 9) == (20, 5) and views.clamp(9999, -1) == (500, 0)
    assert views.enriched(corpus, corpus.documents.select("document_id").limit(3)).columns == ["document_id", "title", "description", "href"]


def test_filing_parts(spark):
    part = lambda head, body: f"<DOCUMENT>\n{head}<TEXT>\n{body}\n</TEXT>\n</DOCUMENT>\n"
    long = "word " * 60
    cases = [
        ("<TYPE>EX-99\n<FILENAME>a.txt\n", long + "\nbegin 100 days after closing", "text", long + "\nbegin 100 days after closing"),
        ("<TYPE>EX-99\n<FILENAME>a.txt\n", "begin 644 x.jpg\nM1234", "skip", None),
        ("<TYPE>COVER\n<FILENAME>a.txt\n", long, "skip", None), ("<TYPE>cover\n", long, "skip", None),
        ("<TYPE>XML\n<FILENAME>a.txt\n", long, "text", None), ("<TYPE>PDF\n<FILENAME>a.txt\n", long, "text", None), ("<TYPE>JSON\n<FILENAME>a.txt\n", long, "text", None),
        *[("<TYPE>EX-1\n<FILENAME>a" + e + "\n", long, "skip", None) for e in (".jpeg", ".BMP", ".tif", ".tiff", ".pdf", ".json")],
        ("<TYPE>EX-1\n", " \n<DIV>" + long, "html", None), ("<TYPE>EX-1\n", "it says <html> here", "text", None), ("<TYPE>EX-1\n", "<?xml version='1.0'?><a>b</a>", "html", None),
        ("<TYPE>EX-1\n", "<xbrl>inner</XBRL>", "text", "inner"), ("<TYPE>EX-1\n", "before <XML> inner <b>x</b></xml> after", "text", "inner <b>x</b>"), ("<TYPE>EX-1\n", "<XML>never closed", "text", "<XML>never closed"),
        ("<TYPE>EX-1\n<FILENAME>m.HTM\n", "x", "html", "x"), ("<TYPE>EX-101.INS\n", long, "skip", None), ("<TYPE>EX-1\n", " \n ", "skip", ""),
        ("note <TYPE>GRAPHIC\n<TYPE> EX-2 \n<FILENAME>old.jpg\n<FILENAME>new.txt\n", long, "text", None),
    ]
    whole = "<SEC-HEADER>\n" + "".join(part(h, b) for h, b, _, _ in cases) + "<DOCUMENT>\n<TYPE>EX-3\n<TEXT>open to the end\n</DOCUMENT>\n"
    df = spark.createDataFrame([("p", whole), ("q", None), ("r", "")], "path string, text string")
    assert [bool(r[0]) for r in df.select(files.is_envelope(F.col("text"))).collect()] == [True, False, False]
    rows = files.split_envelope(df).orderBy("position").collect()
    assert [r.route for r in rows] == [c[2] for c in cases] + ["skip"]
    for r, (_, body, _, want) in zip(rows, cases):
        assert r.body == (body.strip() if want is None else want.strip())
    assert (rows[-2].doc_type, rows[-2].file_name) == ("EX-2", "new.txt") and rows[-1].body == "" and rows[-1].doc_type == "EX-3"


def test_chunk_numbers_have_room(spark):
    number = lambda i: spark.range(1).select(c.chunk_id("document", F.lit(3), F.lit(i))).first()[0]
    assert number(c.CHUNK_ROOM - 1) == 13 * c.CHUNK_ROOM == spark.range(1).select(c.chunk_id("summary", F.lit(3), F.lit(0))).first()[0] - 1
    with pytest.raises(Exception, match="more than 100000 chunks: document 3"):
        number(c.CHUNK_ROOM)
