"""Indexes that let queries pass over what cannot matter: the rows must be those of the full computation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import clusters, fts, grams, scan, scope, search, topk
from quire.sources import corpus as c


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    from quire.plans.registry import corpus_of

    return corpus_of(spark, sf_dir)


@pytest.fixture(scope="module")
def indexed(corpus, tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("grams"))
    grams.in_order(grams.postings(corpus.chunks)).write.mode("overwrite").parquet(path)
    return corpus.with_tables(grams=spark.read.parquet(path))


TEXTS = ["", "ab", "abc", "ABCD xyz", "the colour of it", "the color of it", "gray or grey", "192.168.10.1 and 10.0.0.255", "token = \"deadbeef\"", "foofoofoo bar", "Straße ÉCOLE école", "a\nb\nabc", "tel 555-1234", "aXbXc", "日本語テキスト", "ſub Kelvin K", "x(y)z", "aaaaaaaaab", "abab abab", "begin end", "cat dog", "catalog", None]
PATTERNS = [
    "abc", "colou?r", "gr[ae]y", r"\d+\.\d+\.\d+\.\d+", "(foo){2,3} bar", "(?i)abcd", "(?i)école", "xyz|dog|bar", "(cat|dog)alog", "a.c", "a*b", "(ab)+ ab", "[^x]yz", "tok(en)? = \"(?P<v>[0-9a-f]+)\"",
    "^begin", "end$", r"\bcat\b", "(?=cat)catalog", "(?!dog)cat", "日本語", "[a-z]{3}alog", "a{9}b", "a{2,}b", "x\\(y\\)z", "(a|b|c)(d|e|f)(g|h|i) q", "of (it|them)", "(?:gr)(?:a|e)y", "(x|)yz", "foo(foo)*", "(fo+)+", "Stra(ss|ß)e", "(?s)a.b.abc", "(?x) a b c", "[a-c&&b]bc", "(?i:COLOR) of", "", "e", r"(\w)\1", "[a[b]]c", "(?u)école",
]


def test_plans_hold_for_every_match(spark):
    """No text that matches lacks what its pattern's plan asks for."""

    def held(text, plan):
        low = (text or "").translate(grams._FOLD)
        have = {low[i : i + 3] for i in range(len(low) - 2)}

        def ok(p):
            return p is None or (p in have if isinstance(p, str) else (all if p[0] == "and" else any)(map(ok, p[1])))

        return ok(plan)

    for p in PATTERNS:
        plan = grams.plan_of(p)
        for t in TEXTS:
            if t is not None and re.search(p, t):
                assert held(t, plan), (p, t, plan)
    assert set(grams.grams_of(grams.plan_of("colou?r"))) == {"col", "olo", "lou", "our", "lor"}
    assert grams.plan_of("abc") == "abc" and grams.plan_of("a.c") is None and grams.plan_of("xyz|dog") == ("or", ("dog", "xyz"))
    assert grams.plan_of("ABCD") == ("and", ("abc", "bcd"))


def test_random_patterns_lose_no_match():
    rng = random.Random(4)

    def made(depth):
        kind = rng.randrange(8 if depth else 3)
        if kind < 3:
            return "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
        if kind == 3:
            return rng.choice(["[ab]", "[^a]", ".", r"\w"])
        if kind == 4:
            return f"(?:{made(depth - 1)}|{made(depth - 1)})"
        if kind == 5:
            return f"(?:{made(depth - 1)}){rng.choice(['?', '*', '+', '{2}', '{1,3}', '{5}', '{0}'])}"
        return made(depth - 1) + made(depth - 1)

    for _ in range(3000):
        p = made(3)
        plan = grams.plan_of(p)
        for _ in range(4):
            t = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))
            if re.search(p, t):
                have = {t[i : i + 3] for i in range(len(t) - 2)}
                ok = lambda q: q is None or (q in have if isinstance(q, str) else (all if q[0] == "and" else any)(map(ok, q[1])))
                assert ok(plan), (p, t, plan)


def test_candidates_of_an_index(spark):
    chunks = spark.createDataFrame([(i, "document", i, t) for i, t in enumerate(TEXTS)], "chunk_id long, source_kind string, source_id long, text string")
    index = grams.postings(chunks).cache()
    for p in ("abc", "colou?r", "(?i)abcd", "xyz|dog|bar", "Stra(ss|ß)e", "a{9}b", "日本語", "|".join(f"{x}{y}q" for x in "abcdefgh" for y in "abcdefghi") + "|cat"):
        plan = grams.plan_of(p)
        got = {r[0] for r in grams.candidates(index, plan).collect()}
        want = {i for i, t in enumerate(TEXTS) if t is not None and re.search(p, t)}
        assert plan is not None and want <= got and len(got) <= len(want) + 2


@pytest.mark.parametrize("pattern", [r"/\d+\.\d+\.\d+\.\d+/", r'/token = "(?P<v>[0-9a-f]{40})"/', "/(?i)licen[cs]e/", "/MIT|Apache/", "/zzzqqq/"])
def test_scans_with_the_index_equal_those_without(corpus, indexed, pattern):
    where = scope.resolve(corpus, file_like=["src1%"])
    rows = lambda k: sorted(map(tuple, scan.body_scan(k, pattern, where).collect()))
    assert rows(indexed) == rows(corpus)
    both = [sorted(r[0] for r in scan.matches(k, "the", scope.resolve(k), body_matches=pattern).select("chunk_id").collect()) for k in (corpus, indexed)]
    assert both[0] == both[1]
    n = scan.body_report(indexed, pattern, where).first()
    assert n.matched == len(rows(corpus)) <= n.candidates <= n.chunks
    if grams.plan_of(pattern[1:-1]) is not None:
        assert n.candidates < 0.5 * n.chunks


@pytest.mark.parametrize("ids", [1 << 19, 1 << 40])
def test_best_by_blocks_equals_bm25(corpus, monkeypatch, ids):
    monkeypatch.setattr(topk, "BLOCK_IDS", ids)
    monkeypatch.setattr(topk, "ROUND", 2)
    postings, stats = corpus.index()
    table = topk.blocks(postings).cache()
    for terms, k, where in ((["that", "with"], 7, scope.resolve(corpus)), (["the"], 25, scope.resolve(corpus, file_like=["src1%"])), (["license", "mit"], 500, scope.resolve(corpus)), (["that", "that"], 5, scope.resolve(corpus)), (["absentword", "that"], 5, scope.resolve(corpus)), ([], 5, scope.resolve(corpus))):
        seen = lambda rows: scope.within(corpus, rows, where, ["document"])
        want = fts.bm25(postings, stats, [[t] for t in terms], seen).orderBy(F.desc("score"), "chunk_id").limit(k).collect()
        got = topk.best(postings, stats, table, terms, seen, k)
        rows = got.rows.orderBy(F.desc("score"), "chunk_id").collect()
        assert [r.chunk_id for r in rows] == [r.chunk_id for r in want] and got.read <= got.blocks
        assert all(abs(a.score - b.score) < 1e-9 for a, b in zip(rows, want))
        if terms == ["that", "with"] and ids == 1 << 19:
            assert got.read < got.blocks


def test_nearest_in_clusters_equals_all(corpus, spark):
    built = clusters.build(corpus.embeddings)
    members, centroids = built.members.cache(), built.centroids.cache()
    built = clusters.Clusters(members, centroids)
    assert members.count() == corpus.embeddings.count() == centroids.agg(F.sum("n")).first()[0]
    some = [r.embedding for r in corpus.embeddings.orderBy("chunk_id").limit(3).collect()]
    read = []
    for vector in [*some, [0.0] * len(some[0]), [5.0] * len(some[0])]:
        for k, where in ((5, scope.resolve(corpus)), (40, scope.resolve(corpus, in_documents=list(range(0, 100)))), (10**4, scope.resolve(corpus, in_documents=[1, 2, 3]))):
            want = [tuple(r) for r in search.nearest(corpus, vector, where, ["document"], k).collect()]
            own = None if where.ids is None else scope.chunks_in(corpus, where, ["document"])
            got = clusters.nearest(built, own if own is not None else corpus.chunks.where("source_kind = 'document'"), vector, k)
            assert sorted(map(tuple, got.rows.collect()), key=lambda r: (r[1], r[0])) == want
            read.append(got.read / got.vectors)
    assert min(read) < 0.7


def test_odd_vectors_are_near_to_nothing(spark):
    rows = [(1, [0.0, 1.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 1.0, 1.0]), (6, [0.0, 1.0]), (7, [float("inf"), 0.0]), (8, [3.0, 4.0])]
    built = clusters.build(spark.createDataFrame(rows, "chunk_id long, embedding array<float>"))
    got = clusters.nearest(built, None, [0.0, 0.0], 10)
    assert [tuple(r) for r in got.rows.collect()] == [(1, 1.0), (6, 1.0), (8, 5.0)]
    none = clusters.build(spark.createDataFrame([], "chunk_id long, embedding array<float>"))
    assert clusters.nearest(none, None, [0.0, 0.0], 3).rows.count() == 0
