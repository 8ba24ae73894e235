import numpy as np

from quire.llm import embeddings as op


def brute(rows, threshold=0.98):
    """rows: (vec_id, vector or None, label); links, components."""
    ok = {}
    for i, (_, v, lab) in enumerate(rows):
        if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v, dtype=float) / max(map(abs, v))
            ok[i] = v / np.linalg.norm(v)
    links = {i: {j for j in ok if i != j and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= threshold} if i in ok else set() for i in range(len(rows))}
    comp = {}
    for i in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        if i in comp:
            continue
        todo, comp[i] = [i], rows[i][0]
        while todo:
            for j in links[todo.pop()]:
                if j not in comp:
                    comp[j] = rows[i][0]
                    todo.append(j)
    return {rows[i][0]: (len(links[i]), comp[i], comp[i] == rows[i][0]) for i in range(len(rows))}


def planted(seed=4):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(16).tolist(), i % 3) for i in range(120)]
    base = rng.standard_normal(16)
    base /= np.linalg.norm(base)
    for i in range(60):  # a chain of near copies and copies
        base = base + 0.03 * rng.standard_normal(16)
        rows.append((1000 + i, (base * (1 + i)).tolist(), 1 if i % 2 else 2))
    rows += [(2000 + i, rows[-1][1], 1) for i in range(25)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [float("nan")] * 16, 1), (3004, [None] + [1.0] * 15, 1), (3005, rows[-1][1], None), (3006, rows[5][1], 2), (3007, [float("inf")] + [1.0] * 15, 1), (3008, [1e200] * 16, 0), (3009, [2e-200] * 16, 0), (3010, [1.0] * 8, 0)]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rows = planted()
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, label int, node int")
    want = brute(rows)
    for cell, few in ((2048, 8), (10, 8), (10, 2), (2048, 64)):
        monkeypatch.setattr(op, "CELL", cell)
        monkeypatch.setattr(op, "SMALL_CELL", few)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op.near_duplicates(df).collect()}
        assert got == want
    assert op.near_duplicates(df.limit(0)).count() == 0


def test_tables_keep_the_chance_to_miss():
    for n in (10, 10_000, 10**9):
        k, tables = op.plan_tables(n, 0.98)
        assert (1 - op._meet(0.2) ** k) ** tables <= op.MISS
        assert n * op._meet(2**0.5) ** k <= 1.01 or k == 8


def test_meeting_chance_is_as_measured():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((4000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    turn = rng.standard_normal((4000, 32))
    turn -= (turn * a).sum(axis=1, keepdims=True) * a
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * turn
    lab = np.zeros(4000, dtype=np.int64)
    met = (op.bucket_keys(a, lab, 1, 20) == op.bucket_keys(b, lab, 1, 20)).mean()
    assert abs(met - op._meet(0.2)) < 0.02


def test_rows_with_equal_or_null_ids(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(1, v, 1), (1, v, 1), (None, v, 1), (None, [3.0, -2.0, 1.0], 1), (4, v, 2)], "vec_id long, embedding array<double>, label int")
    key = lambda r: (r.vec_id is None, r.vec_id or 0, r.n_links)
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in sorted(op.near_duplicates(df).collect(), key=key)] == [(1, 2, 1, True), (1, 2, 1, True), (4, 0, 4, True), (None, 0, None, False), (None, 2, 1, False)]
