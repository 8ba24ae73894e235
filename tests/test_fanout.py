"""Model calls over many rows: bounds, failures, retries and restarts."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.operators import curation, fanout, models
from quire.sources import corpus as c
from quire.sources.store import Change, Store


@pytest.fixture()
def kept(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/corpus")
    store.create()
    docs = spark.createDataFrame([(f"{i:02x}a", f"f{i}.txt", 1) for i in range(1, 8)], "file_hash string, file_name string, page_count int")
    chunks = spark.createDataFrame([(f"{i:02x}a", 0, f"text number {i} of all.") for i in range(1, 7)], "file_hash string, chunk_index int, text string")  # the seventh has none
    store.commit(curation.parse_persisted(store.corpus(), docs, chunks))
    now = store.corpus()
    tags = spark.createDataFrame([(1, "even", "even numbers"), (2, "odd", "odd numbers")], "tag_id long, name string, description string")
    store.commit(Change({"tags": tags}))
    assert now.documents.count() == 7
    return store


def logbook(folder):
    """Notes of what was called, as files that outlive worker processes, and their reading; functions of their own, which workers can be sent."""
    os.mkdir(folder)

    def note(text):
        open(f"{folder}/{text.split()[2]}-{time.time_ns()}-{threading.get_ident()}", "w").close()

    def read():
        return sorted(n.split("-")[0] for n in os.listdir(folder))

    return note, read


def test_calls_in_flight_are_bounded_and_failures_kept(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 9 else str(i)) for i in range(40)], "k long, text string").coalesce(1)

    class Counted:
        now = most = 0

    def fn(text):
        Counted.now += 1
        Counted.most = max(Counted.most, Counted.now)
        time.sleep(0.01)
        Counted.now -= 1
        if text == "7":
            raise RuntimeError("no")
        return {"n": len(text), "most": Counted.most}

    rows = {r.k: r for r in fanout.call(df, fn, "k", "n long, most long", in_flight=3, attempts=2).collect()}
    assert len(rows) == 40 and rows[7].n is None and rows[7].error == "RuntimeError: no" and rows[7].calls == 2
    assert rows[8].calls == 1 and rows[9].n == 0 and 1 < max(r.most for r in rows.values() if r.most) <= 3
    assert fanout.call(df.limit(0), fn, "k", "n long, most long").count() == 0


def test_summaries_go_on_where_they_stopped(spark, kept, tmp_path, monkeypatch):
    note, log = logbook(str(tmp_path / "log"))

    def fn(text):
        note(text)
        if " 3 " in text:
            raise ValueError("too hard")
        return {"title": "t", "description": "d", "text": "" if " 5 " in text else f"summary of {text}", "authored_date": "2020-02-30" if " 1 " in text else "2020-02-03"}

    models.register("noted", fn)
    real, calls = Store.commit, []

    def broken(self, change):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("gone")
        return real(self, change)

    monkeypatch.setattr(Store, "commit", broken)
    with pytest.raises(OSError):
        fanout.summarise(kept, "noted", size=2, in_flight=2)
    monkeypatch.undo()
    assert len(log()) == 4 and kept.corpus().summaries.count() == 2  # two rounds called, one committed
    assert fanout.summarise(Store(spark, kept.folder), "noted", size=2) == 2
    assert log() == ["1", "2", "3", "4", "5", "6"]  # nothing was called twice
    now = kept.corpus()
    assert {r.document_id for r in now.summaries.collect()} == {1, 2, 4, 6} and now.summaries.select("summary_id").distinct().count() == 4
    assert {r.document_id: r.authored_date for r in now.summaries.collect()}[1] is None and now.chunks.where("source_kind = 'summary'").count() == 4
    assert {(r.file_hash, r.attempts, r.error.split(":")[0]) for r in now.failed_ingests.collect()} == {("03a", 1, "ValueError"), ("05a", 1, "ValueError")}
    for _ in range(3):
        fanout.summarise(kept, "noted")
    assert log().count("3") == curation.FAILURE_CAP == kept.corpus().failed_ingests.where("file_hash = '03a'").first().attempts
    models.register("noted", lambda text: {"title": "t", "description": "d", "text": "fine"})
    assert fanout.summarise(kept, "noted") == 0  # capped
    assert kept.files.names(f"{kept.folder}/work") == []


def test_classification(spark, kept, tmp_path):
    with pytest.raises(EngineError) as e:
        fanout.classify(kept, "nobody")
    assert e.value.code == "NO_PROVIDER"
    fanout.summarise(kept)
    note, log = logbook(str(tmp_path / "log"))

    def fn(text, vocabulary):
        note(text)
        n = int(text.split()[2])
        if n == 4 or n == 5 and log().count("5") == 1:
            raise ConnectionError("empty answer")
        return [1 + n % 2, 99] if n != 6 else [2, "x"]

    models.register("classify_test", fn)
    said = fanout.classify(kept, "classify_test", size=4)
    assert (said["mode"], said["classified"], said["skipped"]) == ("full-vocab", 4, {"no_summary": 1})
    assert [(f["document_id"], f["error"].split(":")[0]) for f in said["failed"]] == [("document:4", "ConnectionError"), ("document:6", "TypeError")]
    assert log() == ["1", "2", "3", "4", "4", "5", "5", "6", "6"]
    held = lambda: {(r.document_id, r.tag_id) for r in kept.corpus().document_tags.collect()}
    assert held() == {(1, 2), (2, 1), (3, 2), (5, 2)}
    assert fanout.classify(kept, "classify_test")["skipped"] == {"no_summary": 1, "already_tagged": 4}
    models.register("classify_test", lambda text, vocabulary: vocabulary == [(2, "odd", "odd numbers")] and int(text.split()[2]) > 3)
    one = fanout.classify(kept, "classify_test", tag="odd")
    assert one["mode"] == "single-tag" and one["skipped"] == {"no_summary": 1, "already_tagged": 3} and held() == {(1, 2), (2, 1), (3, 2), (4, 2), (5, 2), (6, 2)}
    assert fanout.classify(kept, "classify_test", tag="odd", force=True)["classified"] == 6 and held() == {(2, 1), (4, 2), (5, 2), (6, 2)}
    for code, args in (("TAG_NOT_FOUND", {"tag": "nope"}),):
        with pytest.raises(EngineError) as e:
            fanout.classify(kept, "classify_test", **args)
        assert e.value.code == code
    now = kept.corpus()
    kept.commit(Change(removed={"tags": now.tags.select("tag_id")}))
    with pytest.raises(EngineError) as e:
        fanout.classify(kept, "classify_test")
    assert e.value.code == "EMPTY_VOCABULARY" and now.tags.agg(F.count("*")).first()[0] == 2 and c.KINDS
