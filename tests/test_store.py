"""Commits on a stored corpus: what they write, what they leave when they fail, and that search over them equals a rebuilt index."""

import os

import pytest
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.operators import curation, fts, grams, integrity, search, scope
from quire.sources import corpus as c
from quire.sources import store as st
from quire.sources.store import Change, Store

FINDING = "finding_id long, session_id long, title string, description string, body string"


CITED = " [^chunk:400001]"  # the first chunk of document 1


def finding(spark, *rows):
    return spark.createDataFrame([(i, 1, f"t{i}", None, b + CITED) for i, b in rows], FINDING)


def parsed(spark, n, start=0):
    words = "stone river cloud amber field quiet winter lamp".split()
    docs = spark.createDataFrame([(f"{i * 37 % 256:02x}{i}", f"f{i}.txt", 1) for i in range(start, start + n)], "file_hash string, file_name string, page_count int")
    chunks = spark.createDataFrame([(f"{i * 37 % 256:02x}{i}", j, " ".join(words[(i + j + k) % (3 + i % 5)] for k in range(6 + i % 4)), f"Part {j}") for i in range(start, start + n) for j in range(2)], "file_hash string, chunk_index int, text string, section_heading string")
    return docs, chunks


@pytest.fixture()
def empty(spark):
    return c.Corpus(**{n: spark.createDataFrame([], s) for n, s in c.SCHEMAS.items() if n not in ("meta", "ingests")})


@pytest.fixture()
def kept(spark, empty, tmp_path):
    """A store of 12 documents, with the number of tokenised chunks as a list that grows."""
    store = Store(spark, f"{tmp_path}/corpus")
    store.create()
    store.commit(curation.parse_persisted(store.corpus(), *parsed(spark, 12)))
    return store


def rebuilt(corpus):
    """The same chunks without what commits wrote for the index."""
    return corpus.with_tables(chunks=corpus.spark.createDataFrame(corpus.chunks.collect(), corpus.chunks.schema))


def same_search(corpus, queries=("river cloud", "words", "quiet-winter")):
    plain = rebuilt(corpus)
    assert corpus.postings is not None and plain.postings is None
    assert corpus.index_stats.first()[:] == fts.statistics(plain.chunks, fts.postings(plain.chunks)).first()[:]
    for q in queries:
        got, want = (sorted((r.chunk_id, round(r.score, 9)) for r in search.full_text(k, q, scope.resolve(k), ["document", "finding", "summary", "image"], 1000).collect()) for k in (corpus, plain))
        assert got == want
    rows = lambda df: sorted(map(tuple, df.select("gram", "chunk_id", "source_kind", "source_id").collect()))
    assert rows(corpus.grams) == rows(grams.postings(corpus.chunks))


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))


def test_search_follows_every_change(spark, kept, monkeypatch):
    seen = []
    real = fts.postings
    monkeypatch.setattr(fts, "postings", lambda chunks: (seen.append(sorted(r[0] for r in chunks.select("chunk_id").collect())), real(chunks))[1])
    kept.commit(curation.finding_saved(kept.corpus(), finding(spark, (1, "new words on stone"), (2, "gone soon")), "embed"))
    kept.commit(curation.finding_edited(kept.corpus(), finding(spark, (2, "amber words that stay"))))
    kept.commit(curation.findings_merged(kept.corpus(), finding(spark, (1, "merged stone river")), [2]))
    kept.commit(curation.finding_saved(kept.corpus(), finding(spark, (3, "x quiet winter"), (4, "y"))))
    kept.commit(curation.findings_deleted(kept.corpus(), spark.createDataFrame([(4,)], "finding_id long")))
    docs = kept.corpus().documents
    new = docs.where("document_id % 3 = 0").select((F.col("document_id") + 100).alias("summary_id"), "document_id", F.lit("t").alias("title"), F.lit("d").alias("description"), F.lit("a summary of stone").alias("text"), F.lit("m").alias("model"), F.lit(None).cast("string").alias("authored_date"))
    kept.commit(curation.summaries_persisted(kept.corpus(), new))
    kept.commit(curation.summaries_persisted(kept.corpus(), new.where("document_id = 3").withColumn("text", F.lit("a better summary")).withColumn("authored_date", F.lit("2020-01-01"))))
    assert sum(map(len, seen)) == 2 + 1 + 1 + 2 + 4 + 1  # only what came was tokenised
    monkeypatch.undo()
    now = kept.corpus()
    same_search(now)
    assert {r.finding_id: r.body for r in now.findings.collect()} == {1: "merged stone river" + CITED, 3: "x quiet winter" + CITED}
    assert now.embeddings.count() == 0 and now.summaries.count() == 4  # the vectors of finding 1's first body went with it
    assert now.summaries.where("document_id = 3").first()["authored_date"] == "2020-01-01"
    assert integrity.orphan_chunks(now).count() == 0
    assert sum(r.n for r in integrity.violations(now).collect()) == 0
    old = kept.corpus(3)  # earlier versions can still be read
    assert {r.finding_id: r.body for r in old.findings.collect()}[2] == "gone soon" + CITED and old.embeddings.count() == 2
    same_search(old)


def test_what_a_commit_writes_grows_with_the_change(spark, kept):
    kept.commit(curation.parse_persisted(kept.corpus(), *parsed(spark, 300, 100)))
    before = size(kept.folder)
    version = kept.commit(curation.finding_saved(kept.corpus(), finding(spark, (9, "a short finding"))))
    mark = kept.mark()
    new = {n: [p["rows"] for p in parts if f"/{version:012d}-" in p["path"]] for n, parts in mark["tables"].items()}
    assert new["findings"] == [1] and new["chunks"] == [1] and new["postings"] == [5] and new["documents"] == []
    assert size(kept.folder) - before < 0.5 * before


@pytest.mark.parametrize("step", ["_write", "_lost", "_publish"])
def test_a_commit_that_fails_leaves_the_version_before(spark, kept, monkeypatch, step):
    kept.commit(curation.finding_saved(kept.corpus(), finding(spark, (1, "gone soon"))))
    before, version = sorted(map(tuple, kept.corpus().chunks.collect()), key=repr), kept.mark()["version"]
    change = curation.finding_edited(kept.corpus(), finding(spark, (1, "amber instead")))
    calls, real = [], getattr(Store, step)

    def broken(self, *args):
        calls.append(args)
        if len(calls) > (1 if step == "_write" else 0):
            raise OSError("the machine is gone")
        return real(self, *args)

    monkeypatch.setattr(Store, step, broken)
    with pytest.raises(OSError):
        kept.commit(change)
    monkeypatch.undo()
    again = Store(spark, kept.folder)
    assert again.mark()["version"] == version and sorted(map(tuple, again.corpus().chunks.collect()), key=repr) == before
    again.commit(change)  # and can be done again
    assert again.corpus().findings.first()["body"] == "amber instead" + CITED
    again.vacuum(keep=2)
    same_search(again.corpus())


def test_one_of_two_writers_is_refused(spark, kept):
    one, two = Store(spark, kept.folder), Store(spark, kept.folder)
    change = lambda s, i: curation.finding_saved(s.corpus(), finding(spark, (i, "stone")))
    stale = two.mark()
    one.commit(change(one, 1))
    with pytest.raises(EngineError) as e:
        two._commit(stale, change(two, 2), (None, None))
    assert e.value.code == "COMMIT_CONFLICT" and not [n for n in two.files.names(f"{kept.folder}/commits") if n.endswith(".draft")]
    assert [r[0] for r in two.corpus().findings.select("finding_id").collect()] == [1]
    two.commit(change(two, 2))
    assert two.corpus().findings.count() == 2


def test_compaction_keeps_rows_and_drops_tombstones(spark, kept, monkeypatch):
    for i in range(4):
        kept.commit(curation.finding_saved(kept.corpus(), finding(spark, (i, f"stone {i}"))))
    kept.commit(curation.finding_edited(kept.corpus(), finding(spark, (2, "amber"))))
    kept.commit(curation.findings_deleted(kept.corpus(), spark.createDataFrame([(0,), (77,)], "finding_id long")))
    want = {n: sorted(map(tuple, getattr(kept.corpus(), n).collect()), key=repr) for n in ("findings", "finding_citations", "documents", "chunks", "postings")}
    monkeypatch.setattr(fts, "postings", None)  # nothing is tokenised
    kept.compact()
    mark = kept.mark()
    assert len(mark["tables"]["findings"]) == 1 and len(mark["tables"]["documents"]) == 1
    assert len(mark["tables"]["chunks"]) == 2  # the large, old segment is left alone
    assert {n: sorted(map(tuple, getattr(kept.corpus(), n).collect()), key=repr) for n in want} == want
    assert "findings" not in mark["gone"]
    kept.compact(ratio=1e9)
    mark = kept.mark()
    assert all(len(p) <= 1 for p in mark["tables"].values()) and mark["gone"] == {}
    assert {n: sorted(map(tuple, getattr(kept.corpus(), n).collect()), key=repr) for n in want} == want
    monkeypatch.undo()
    same_search(kept.corpus())
    before = size(kept.folder)
    assert kept.vacuum(keep=1) and size(kept.folder) < before and kept.versions() == [mark["version"]]
    same_search(kept.corpus())
    kept.commit(curation.finding_edited(kept.corpus(), finding(spark, (2, "quiet winter"))))  # and changes go on
    same_search(kept.corpus())


def test_changes_of_small_tables(spark, kept):
    now = kept.corpus()
    after = now.with_tables(sessions=curation.start_session(now.sessions, spark.createDataFrame([(1, "s", True, "k")], "session_id long, name string, memory_enabled boolean, run_key string")))
    kept.commit(Change.between(now, after, "sessions"))
    now = kept.corpus()
    kept.commit(Change.between(now, now.with_tables(sessions=curation.set_provenance(now.sessions, 1, harness="h")), "sessions"))
    assert [(r.session_id, r.name, r.harness) for r in kept.corpus().sessions.collect()] == [(1, "s", "h")]
    version = kept.mark()["version"]
    kept.commit(Change.between(kept.corpus(), kept.corpus(), "sessions", "tags"))  # nothing differs, nothing is written
    assert [len(p) for p in kept.mark()["tables"].values()] == [len(p) for p in kept.mark(version)["tables"].values()]


def test_refusals(spark, kept, tmp_path):
    for code, call in (("PROJECT_EXISTS", kept.create), ("NO_ACTIVE_PROJECT", Store(spark, f"{tmp_path}/none").mark), ("NO_ACTIVE_PROJECT", lambda: kept.mark(99))):
        with pytest.raises(EngineError) as e:
            call()
        assert e.value.code == code
