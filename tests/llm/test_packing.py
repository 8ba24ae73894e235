import zlib

import numpy as np
import public_tokenizers
from brute import TEXTS
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_best_fit_never_overflows_and_leaves_no_two_half_empty_bins(sizes):
    bins = packing.best_fit(np.array(sizes, dtype=np.int64), 64)
    used = np.bincount(bins, weights=sizes) if sizes else np.zeros(0)
    assert (used <= 64).all()
    assert (used * 2 <= 64).sum() <= 1


def test_pieces():
    assert packing._pieces(5, 10) == [(0, 5)]
    assert packing._pieces(10, 10) == [(0, 10)]
    assert packing._pieces(25, 10) == [(0, 5), (5, 10), (15, 10)]


def check(rows, texts, capacity):
    library = Tokenizer.from_file(PATH)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts}
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r.ids_crc32
    for d, rs in by_doc.items():
        rs.sort(key=lambda r: r.piece)
        assert [r.piece for r in rs] == list(range(len(rs)))
        assert [r.start for r in rs] == [0, *np.cumsum([r.length for r in rs])[:-1]]
        assert sum(r.length for r in rs) == len(ids[d])
        assert all(r.length == capacity for r in rs[1:])
    for rs in by_bin.values():
        rs.sort(key=lambda r: r.offset)
        at = 0
        for r in rs:
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert by_doc.keys() == ids.keys()
    return len(by_bin), sum(map(len, ids.values()))


def test_odd_texts(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, piece int").repartition(3)
    check(packing.pack(df, PATH).collect(), list(enumerate(TEXTS)), 1024)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_tree_joins_what_partitions_leave_over(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(20)
    rows = packing.pack(df, PATH).collect()
    n, total = check(rows, [(r.doc_id, r.text) for r in df.collect()], 1024)
    assert n <= -(-total // 1024) * 1.03 + 1
    monkeypatch.setattr(packing, "LOCAL_ITEMS", 5)
    again = packing.pack(df.coalesce(1), PATH).collect()
    check(again, [(r.doc_id, r.text) for r in df.collect()], 1024)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_a_plan_of_counts_makes_the_bins_of_best_fit(sizes):
    counts = np.bincount(sizes, minlength=65) if sizes else np.zeros(65, dtype=np.int64)
    n, runs = packing.plan(counts, 64)
    assert n == len(set(packing.best_fit(np.array(sizes, dtype=np.int64), 64).tolist()))
    used = np.zeros(n, dtype=np.int64)
    for size in range(64, 0, -1):
        own = runs[runs[:, 0] == size]
        ends = [*own[1:, 1].tolist(), int(counts[size])]
        assert not len(own) or own[0, 1] == 0
        for (_, first, each, bins, at), end in zip(own.tolist(), ends):
            for k in range(end - first):
                assert used[bins + k // each] == at + k % each * size
                used[bins + k // each] += size
    assert used.sum() == sum(sizes) and (used <= 64).all()


def test_lengths_that_are_clustered_by_partition_are_packed_as_well_as_mixed_ones(spark):
    text = "repeat(' a', case when doc_id < 3000 then 599 else 399 end)"
    df = spark.range(0, 6000, 1, 2).selectExpr("id as doc_id", f"{text} as text")
    texts = [(r.doc_id, r.text) for r in df.collect()]
    n, total = check(packing.pack(df, PATH, 1000).collect(), texts, 1000)
    assert (n, total) == (3000, 3_000_000)


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    df = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, None)], "doc_id long, text string")
    rows = packing.pack(df, PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (0, 4), (7, 4), (7, 4)]
    assert len({r.sequence_id for r in rows}) == 1 and sorted(r.offset for r in rows)[0] == 0 and sum(r.length for r in rows) == 13
