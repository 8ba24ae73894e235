import math
import random

import numpy as np
import pytest
from brute import TEXTS, terms

from quire.llm import ranked


def brute(docs, items, k=50):
    """docs: (doc_id, text); items: (item_id, text); rows (item_id, rank, doc_id, score)."""
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    nd, nl = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, t in held:
            m, s = 50 + 50 * len(t) * nd // nl, 0
            for x in set(terms(text)) & set(t):
                tf = t.count(x)
                s += math.floor(1000 * math.log((2 * nd + 2) / (2 * df[x] + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_terms_in_pieces(monkeypatch):
    for piece in (1, 7, 1 << 20):
        monkeypatch.setattr(ranked, "PIECE", piece)
        for t in TEXTS:
            assert [x.decode() for part in ranked.terms((t or "").encode()) for x in part] == terms(t)


def made(rng, n):
    voc = [f"w{i}" for i in range(60)]
    return [" ".join(rng.choices(voc, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("k,postings", [(1, 1), (3, 50), (10, 700), (50, 1 << 20)])
def test_wand_over_shards_equals_brute_force(k, postings, monkeypatch):
    monkeypatch.setattr(ranked, "WINDOW", 8)
    rng = random.Random(k)
    texts = made(rng, 400)
    docs = list(zip(rng.sample(range(1000), 400), texts))
    items = [(i, t) for i, t in enumerate(made(rng, 25))]
    vocabulary = {f"w{i}".encode(): i for i in range(60)}
    held = [(i, terms(t)) for i, t in docs if terms(t)]
    nd, nl = len(held), sum(len(t) for _, t in held)
    weights = np.array([ranked.weight(nd, sum(f"w{i}" in t for _, t in held)) for i in range(60)])
    heaps = [ranked.Heap(k) for _ in items]
    scored = 0
    while held:
        part, held = held[: max(1, postings // 20)], held[max(1, postings // 20) :]
        pairs = [[(vocabulary[x.encode()], t.count(x)) for x in sorted(set(t))] for _, t in part]
        flat = [p for x in pairs for p in x]
        shard = ranked.Shard(np.array([i for i, _ in part]), np.array([len(t) for _, t in part]), np.concatenate([[0], np.cumsum([len(x) for x in pairs])]), np.array([a for a, _ in flat]), np.array([b for _, b in flat], dtype=np.int32), weights, nd, nl)
        for (_, text), heap in zip(items, heaps):
            scored += ranked.wand(shard, np.array([vocabulary[x.encode()] for x in sorted(set(terms(text)))], dtype=np.int64), heap)
    got = [(q, r, int(i), int(s)) for q, h in enumerate(heaps) for r, (i, s) in enumerate(zip(h.ids, h.scores), 1)]
    assert got == brute(docs, items, k)
    if k == 1 and postings == 1 or k == 3:  # most documents are passed over
        assert scored < 0.8 * nd * len(items)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i + 1, t) for i, t in enumerate(TEXTS)] + [(100 + i, t) for i, t in enumerate(made(rng, 150))]
    docs += [(7000 + i, "Tie TIE tie9 é") for i in range(70)] + [(7000, "Tie TIE tie9 é"), (None, "Tie TIE tie9 é"), (None, None)]
    items = [(1, "w1 W3 w59 w1"), (2, "tie é"), (2, "tie"), (None, "日本語 one two"), (3, None), (4, ""), (5, "absent"), (6, " ".join(t or "" for t in TEXTS)), (7, "w0 w2 w4 w6 w8")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, item_id string").repartition(5)
    queries = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id int, text string, rank int")
    got = sorted(map(tuple, ranked.search(df, queries).collect()), key=repr)
    assert got == sorted(brute(docs, items), key=repr)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 5)  # several passes, a longer query by itself
    assert sorted(map(tuple, ranked.search(df, queries, k=3).collect()), key=repr) == sorted(brute(docs, items, 3), key=repr)
    assert ranked.search(df.limit(0), queries).count() == 0 and ranked.search(df, queries.limit(0)).count() == 0


def test_shards_of_any_size(spark, monkeypatch):
    rng = random.Random(9)
    docs = [(i, t) for i, t in enumerate(made(rng, 120))]
    items = [(i, t) for i, t in enumerate(made(rng, 6))]
    vocabulary = {f"w{i}".encode(): i for i in range(60)}
    index = ranked.forward(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), vocabulary, "doc_id", "text").cache()
    held = [terms(t) for _, t in docs if terms(t)]
    weights = np.array([ranked.weight(len(held), sum(f"w{i}" in t for t in held)) for i in range(60)])
    queries = [np.array(sorted(vocabulary[x.encode()] for x in set(terms(t))), dtype=np.int64) for _, t in items]
    want = {(i, d, s) for i, _, d, s in brute(docs, items, 1000)}
    for postings in (1, 37, 1000):
        rows = ranked.heaps(index, queries, weights, len(held), sum(map(len, held)), 1000, postings).collect()
        assert {(r["query"], r.doc_id, r.score) for r in rows} == want and len(rows) == len(want)


def test_long_documents_do_not_overflow():
    n = np.array([10**7, 3])
    shard = ranked.Shard(np.array([1, 2]), n, np.array([0, 1, 2]), np.array([0, 0]), np.array([10**6, 1], dtype=np.int32), np.array([5]), 10**12, 10**13)
    m = [50 + 50 * int(x) * 10**12 // 10**13 for x in n]
    assert shard.impacts.tolist() == [5 * (10**9 * t // (1000 * t + 20 * x)) for t, x in zip((10**6, 1), m)]
