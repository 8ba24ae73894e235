"""Requests that change a stored corpus, from the command line on."""

import pytest

from quire import __main__ as cli
from quire.errors import EngineError
from quire.operators import curation
from quire.sources.store import Change, Store

BODY = "a body [^chunk:400001]"


@pytest.fixture()
def run(spark, tmp_path):
    folder = f"{tmp_path}/corpus"
    call = lambda *argv: cli.respond(spark, [folder, *argv])
    assert call("create") == {"version": 1} and call("create")["code"] == "PROJECT_EXISTS"
    store = Store(spark, folder)
    docs = spark.createDataFrame([(f"{i:02x}a", f"2020-01-0{i} f{i}.txt", 1) for i in range(1, 5)], "file_hash string, file_name string, page_count int")
    chunks = spark.createDataFrame([(f"{i:02x}a", 0, f"stone number {i}") for i in range(1, 5)], "file_hash string, chunk_index int, text string")
    store.commit(curation.parse_persisted(store.corpus(), docs, chunks))
    call.store = store
    return call


def test_findings(run, tmp_path):
    path = tmp_path / "body.md"
    path.write_text(BODY)
    assert run("start_session", "name=s", "memory=false", "model=m")["session_id"] == 1
    assert run("start_session", "name=s")["memory_enabled"] is False  # the same one
    one = run("save_finding", "title=T", "description=D", f"body_file={path}", "session_id=1")
    assert one["finding_id"] == "finding:1" and one["body"] == BODY and one["model"] == "m" and one["chunk_ids"] == ["chunk:700001"]
    assert [c["chunk_id"] for c in one["citations"]] == ["chunk:400001"]
    assert run("save_finding", "title=T", "description=D", "body_file=/nowhere")["code"] == "BODY_FILE_NOT_FOUND"
    for code, args in (("EMPTY_TITLE", ["title= ", "description=D", "body=x"]), ("EMPTY_DESCRIPTION", ["title=T", "description=", "body=x"]), ("EMPTY_BODY", ["title=T", "description=D", "body= "]), ("UNKNOWN_CITATIONS", ["title=T", "description=D", "body=x [^chunk:9]"])):
        assert run("save_finding", *args)["code"] == code
    two = run("save_finding", "title=U", "description=D", "body=other [^chunk:800001] [^url:http://x]", "embed=embed")
    assert two["finding_id"] == "finding:2" and two["external_citations"] == [{"scheme": "url", "ref": "http://x"}] and run.store.corpus().embeddings.count() == 1
    assert run("search", "query=other", 'kinds=["finding"]')["results"][0]["chunk_id"] == two["chunk_ids"][0]
    assert run("edit_finding", "finding_id=2")["code"] == "NOTHING_TO_UPDATE" and run("edit_finding", "finding_id=9", "title=x")["code"] == "FINDING_NOT_FOUND"
    assert run("edit_finding", "finding_id=2", "title=V", "session_id=1")["code"] == "MEMORY_OFF"
    named = run("edit_finding", "finding_id=2", "title=V")
    assert named["title"] == "V" and named["body"] == two["body"] and named["chunk_ids"] == two["chunk_ids"] and run.store.corpus().embeddings.count() == 1
    assert run("edit_finding", "finding_id=2", f"body=x [^{two['chunk_ids'][0]}]")["code"] == "CITES_OWN_CHUNKS"
    assert run("edit_finding", "finding_id=2", "body=changed [^chunk:400001]")["body"].startswith("changed")
    assert run("merge_findings", "into=1", "from_ids=[1]", f"body={BODY}")["code"] == "TARGET_IN_SOURCES"
    assert run("merge_findings", "into=1", "from_ids=[7]", f"body={BODY}")["missing_finding_ids"] == [7]
    assert run("merge_findings", "into=1", "from_ids=[2]", "body=x [^chunk:1100001]")["code"] == "CITES_MERGED_CHUNKS"
    both = run("merge_findings", "into=1", "from_ids=[2]", "body=both [^chunk:400001]", "title=W")
    assert both["merged_from"] == ["finding:2"] and both["title"] == "W" and run("list_findings")["total"] == 1
    assert run("search", "query=changed", 'kinds=["finding"]')["results"] == []
    gone = run("delete_finding", "finding_id=1")
    assert (gone["status"], gone["title"], gone["removed_chunks"], gone["removed_citations"]) == ("deleted", "W", 1, 1)
    assert run("list_findings")["total"] == 0 and run("verify")["violations"]["finding_citations.chunk missing"] == 0
    assert run("end_session", "session_id=1", "at=2024-01-01 00:00:00")["ended_at"].startswith("2024-01-01")


def test_summaries_dates_and_tags(run):
    assert run("save_date", "document_id=1", "date=2020-01-01")["code"] == "NO_SUMMARY" and run("save_date", "document_id=77", "date=2020-01-01")["code"] == "DOCUMENT_NOT_FOUND"
    assert run("save_summary", "document_id=1", "title=t", "description=d", "text= ")["code"] == "EMPTY_TEXT"
    assert run("save_summary", "document_id=1", "title=t", "description=d", "text=a river", "authored_date=2019-05-05")["summary_id"] == "summary:1"
    assert run("save_date", "document_id=1", "date=2020-13-01")["code"] == "INVALID_DATE" and run("save_date", "document_id=1")["code"] == "USAGE_ERROR"
    assert run("save_date", "document_id=1", "date=2021-06-07") == {"document_id": "document:1", "old_authored_date": "2019-05-05", "new_authored_date": "2021-06-07"}
    again = run("save_summary", "document_id=1", "title=t", "description=d", "text=a lake")
    assert again["summary_id"] == "summary:2" and [r[:] for r in run.store.corpus().summaries.select("summary_id", "authored_date").collect()] == [(2, "2021-06-07")]
    assert run("search", "query=river", 'kinds=["summary"]')["results"] == [] and len(run("search", "query=lake", 'kinds=["summary"]')["results"]) == 1
    assert run("backfill_dates", r"pattern=(?P<date>\d{4}-\d{2}-\d{2})") == {"matched": 4, "unmatched": 0, "invalid": 0, "inserted": 3, "updated": 0}
    assert run("add_tag", "name=Stone", "description=stones")["tag_id"] == 1 and run("add_tag", "name=stone!", "description=x")["status"] == "conflict"
    assert run("add_tag", "name=number", "description=n", "value_type=number", r"pattern=(?P<value>\d+)")["tag_id"] == 2
    got = run("assign_tag", "tag=number", "document_ids=[1, 2, 99]", "value=$1,5", "chunk_id=400001")
    assert got["value"] == "15" and [d["id"] for d in got["assigned"]] == ["document:1", "document:2"] and got["not_found"] == ["document:99"]
    assert run("assign_tag", "tag=Stone", "document_ids=[1, 3]")["value"] is None
    assert run("assign_tag", "tag=nope", "document_ids=[1]")["code"] == "TAG_NOT_FOUND"
    assert run("unassign_tag", "tag=Stone", "document_ids=[3, 98]")["not_found"] == ["document:98"]
    assert run("rename_tag", "old=Stone", "new=number")["code"] == "TAG_EXISTS" and run("rename_tag", "old=Stone", "new=Rock")["new_name"] == "Rock"
    run("add_tag", "name=pebble", "description=small ones")
    run("assign_tag", "tag=pebble", "document_ids=[1, 4]")
    assert run("merge_tags", "source=pebble", "target=number")["code"] == "MIXED_TYPE_MERGE"
    assert run("merge_tags", "source=pebble", "target=Rock") == {"source": "pebble", "target": "Rock", "inserted": 1, "already_present": 1, "collisions": 0}
    held = sorted((r.document_id, r.tag_id, r.value) for r in run.store.corpus().document_tags.collect())
    assert held == [(1, 1, None), (1, 2, "15"), (2, 2, "15"), (4, 1, None)]
    assert run("delete_tag", "tag=number")["removed_assignments"] == 2 and len(run("tags")["tags"]) == 1
    run("add_tag", "name=size", "description=n", "value_type=number", r"pattern=(?P<value>\d+)")
    run("assign_tag", "tag=size", "document_ids=[4]", "value=7")
    listed = run("list_documents", 'returning=["file_name", "tag_values", "created_at"]', 'tags=["size", "Rock"]')["documents"]
    assert [(d["file_name"][-6:], d["tag_values"]["size"]["value"]) for d in listed] == [("f1.txt", None), ("f4.txt", "7")] and all("created_at" in d for d in listed)
    assert run("list_documents", 'returning=["tag_values"]')["documents"][0] == {"tag_values": None} and "created_at" in run("list_documents")["documents"][0]
    version = run("versions")["versions"][-1]
    assert run("compact")["version"] == version + 1 and run("vacuum")["deleted"] and len(run("versions")["versions"]) == 2
    assert run("scan", "query=stone")["total"] == 4


def test_a_change_is_made_anew_after_a_conflict(run, monkeypatch):
    real, other = Store.commit, []

    def late(self, change):
        if not other:
            other.append(1)
            real(self, Change({"tags": self.spark.createDataFrame([(5, "first", "d")], "tag_id long, name string, description string")}))
            raise EngineError("COMMIT_CONFLICT", "late")
        return real(self, change)

    monkeypatch.setattr(Store, "commit", late)
    assert run("add_tag", "name=second", "description=d")["tag_id"] == 6
    monkeypatch.setattr(Store, "commit", lambda self, change: 1 / 0)
    assert run("add_tag", "name=third", "description=d")["code"] == "INTERNAL_ERROR"
