import random

import numpy as np
from brute import TEXTS, WORD

from quire.llm import lines as op


def tokens(line):
    w = WORD.findall(line)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute(docs, t=0.8):
    """docs: (doc_id, text) with ids; texts without the lines that an earlier one matches."""
    rows = [((i, k), line, tokens(line)) for i, text in docs for k, line in enumerate((text or "").split("\n"))]
    rows.sort(key=lambda r: r[0])
    gone = set()
    for j, (at, _, s) in enumerate(rows):
        if s is not None and any(p < at and x is not None and len(x & s) >= t * len(x | s) for p, _, x in rows[:j]):
            gone.add(at)
    return {i: None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone) for i, text in docs}


def corpus():
    random.seed(11)
    some = [f"w{i}" for i in range(3000)]
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    base = [random.choice(some) for _ in range(60)]
    for i in range(90):
        out = []
        for _ in range(random.randint(1, 5)):
            kind = random.random()
            if kind < 0.2:
                out.append("the very common line of this site is here")
            elif kind < 0.5:  # near copies of one passage, some similar enough and some not
                line = list(base)
                for _ in range(random.randint(0, 3)):
                    line[random.randrange(len(line))] = random.choice(some)
                out.append(" ".join(line[: random.choice((60, 60, 50, 45))]))
            elif kind < 0.6:
                out.append(random.choice(["", "  ", "a", "a b", "a  b"]))
            else:
                out.append(" ".join(random.choices(some, k=random.randint(1, 40))))
        docs.append((100 + i, "\n".join(out)))
    return docs


def test_equals_brute_force(spark, monkeypatch):
    docs = corpus()
    want = brute(docs)
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in docs] + [(None, docs[-1][1], "x", 3), (None, None, "x", 3)], "doc_id long, text string, line string, n int").repartition(3)
    for cell in (1024, 7):
        monkeypatch.setattr(op, "CELL", cell)
        out = op.dedup(df, removed="n_removed")
        assert out.columns == ["doc_id", "text", "line", "n", "n_removed"]
        rows = out.collect()
        assert len(rows) == len(docs) + 2
        for r in rows:
            if r.doc_id is None:
                assert r.text in (docs[-1][1], None) and r.n_removed == 0
            else:
                assert r.text == want[r.doc_id], r.doc_id
    assert op.dedup(df.limit(0)).count() == 0


def test_copies_under_one_id_are_one_document(spark):
    df = spark.createDataFrame([(1, "same line here\nother"), (1, "same line here\nother"), (2, "same line here\nthird")], "doc_id long, text string")
    assert sorted(tuple(r) for r in op.dedup(df).collect()) == [(1, "same line here\nother"), (1, "same line here\nother"), (2, "third")]


def test_shuffled_removals_equal_broadcast_ones(spark, monkeypatch, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {tuple(r) for r in op.dedup(df).select("doc_id", "text").collect()}
    monkeypatch.setattr(op, "BROADCAST_LINES", -1)
    assert {tuple(r) for r in op.dedup(df).select("doc_id", "text").collect()} == want
    assert {r[0]: r[1] for r in want} == brute([(r.doc_id, r.text) for r in df.collect()])


def test_sets_of_a_text_with_more_lines_than_a_sort_key_numbers(monkeypatch):
    counts = np.zeros(1 << op.COUNTER_BITS, dtype=np.int64)
    some = [f"a{i % 1000} b{i} c" for i in range((1 << 20) + 5)]
    text = "\n".join(some)
    found = op.Sets([text, "one more text"], counts)
    assert len(found.h1) == len(some) + 1 and (np.diff(found.owner) >= 0).all()
    apart = op.Sets([*some[:3], *some[-7:], "one more text"], counts)
    at = [0, 1, 2, *range(len(some) - 7, len(some) + 1)]
    assert found.h1[at].tolist() == apart.h1.tolist() and found.h2[at].tolist() == apart.h2.tolist()
    monkeypatch.setattr(op, "LINE_BITS", 4)  # tokens of a line come in the same order by either sort
    odd = [t or "" for t in TEXTS] + ["x y z w v u t s r " * 5, *some[:30]]
    two = op.Sets(odd, counts)
    monkeypatch.undo()
    one = op.Sets(odd, counts)
    assert all((getattr(one, k) == getattr(two, k)).all() for k in ("tokens", "owner", "first", "size", "h1", "h2"))


def test_lines_of_a_very_long_text_are_removed(spark):
    some = [f"w{i}" for i in range((1 << 20) + 5)]
    docs = [(1, "w5 is here\nonly here"), (2, "\n".join(["only here", *some, "w5 is here", "w7"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    left = {r.doc_id: (r.text, r.n) for r in op.dedup(df, removed="n").collect()}
    assert left == {1: (docs[0][1], 0), 2: ("\n".join(some), 3)}


def test_a_column_of_the_count_gives_way(spark):
    line = "a line of words that is long enough to have several runs in it"
    df = spark.createDataFrame([(1, f"{line}\nx", 7), (2, line, 8)], "doc_id long, text string, gone int")
    out = op.dedup(df, removed="gone")
    assert out.columns == ["doc_id", "text", "gone"] and {(r.doc_id, r.gone) for r in out.collect()} == {(1, 0), (2, 1)}
