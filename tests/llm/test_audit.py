import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from brute import TEXTS, words

from quire.llm import audit
from quire.llm.common import Words


def fails(text):
    w, t = words(text), text or ""
    return (len(w) < 50) | (100 * len(set(w)) < 65 * len(w)) << 1 | (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) << 2 | bool(re.search("[#$%&*|]", t)) << 3


def brute(docs, labels):
    """docs: (doc_id, text, part); labels: (doc_id, quality, toxic)."""
    seen = {}
    for i, t, _ in docs:
        if i is not None:
            seen[t or ""] = min(i, seen.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows = [(i, p or "", {"ABCDE"[k] for k in range(4) if fails(t) >> k & 1} | ({"E"} if i is not None and t is not None and seen[t] < i or i is not None and not t and seen[""] < i else set())) for i, t, p in docs]
    out = {}
    for part in {p for _, p, _ in rows}:
        own = [(i, f) for i, p, f in rows if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                shapley[x] += len(gone)
                failing = sum(x in f for _, f in own)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def masks(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    return [m for _, data, offsets in audit.buffer_passes(batch, "text") for m in audit.masks_of(data, offsets).tolist()]


def test_masks_equal_the_plain_statement(spark, sf_dir, monkeypatch):
    rng = random.Random(3)
    texts = TEXTS + ["", "", None, "end", "#", " a", "b ", "Ab" * 40, " ".join(rng.choice("abcdefgh") for _ in range(60)), " ".join(f"w{i % 33}" for i in range(50)), "日本 " * 60, "x" * 9000 + " " + "x" * 9000]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).collect()]
    want = [fails(t) for t in texts]
    assert masks(texts) == want
    for limit in (1, 50, 4000):  # however documents and pairs of words fall into passes
        monkeypatch.setattr(audit.buffer_passes, "__defaults__", (limit,))
        monkeypatch.setattr(audit, "PASS_CHARS", limit)
        assert masks(texts) == want
    assert masks([]) == [] and masks([None]) == [1]
    column = pa.RecordBatch.from_arrays([pa.array(["x", *texts], pa.string())], ["text"]).slice(1)  # a column that does not begin at its buffer's start
    assert [m for _, d, o in audit.buffer_passes(column, "text") for m in audit.masks_of(d, o).tolist()] == want


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    text = b"aa bb aa cc bb dd " * 3 + b"q" * 5000 + b" " + b"q" * 5000 + b" " + b"r" * 5000
    data, offsets = np.frombuffer(text + b"aa", dtype=np.uint8), np.array([0, len(text), len(text) + 2])
    assert audit.distinct_words(audit.words_of(data, offsets), 2).tolist() == [6, 1]
    monkeypatch.setattr(Words, "hashes", lambda self: np.zeros(len(self.start), dtype=np.uint64))
    assert audit.distinct_words(audit.words_of(data, offsets), 2).tolist() == [6, 1]


def test_audit_equals_all_orders_one_by_one(spark):
    long = " ".join(f"w{i}" for i in range(80))
    docs = [(i + 1, t, "ab"[i % 2]) for i, t in enumerate(TEXTS)]
    docs += [(50 + i, t, p) for i, (t, p) in enumerate([(long, "a"), (long, None), (long, ""), (long + " #", "b"), (long + " #", "b"), (long.upper(), "a"), ("A# A# " * 30, "c"), ("A# A# " * 30, "c")])]
    docs += [(50, long, "a"), (None, long, "a"), (None, "x", "d"), (200, "x", "d")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(1, 60)] + [(1, 0, 1), (51, None, 1), (51, 1, None), (None, 1, 1), (999, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    df = spark.createDataFrame([(i, t, p, 7, "x") for i, t, p in docs], "doc_id long, text string, source string, mask int, part string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = audit.audit(df, said).collect()
    got = {tuple(r)[:3]: tuple(r)[3:] for r in rows}
    assert len(rows) == len(got) == 5 * 600 and got == brute(docs, labels)
    assert audit.audit(df.limit(0), said).count() == 0
    bare = {tuple(r)[:3]: tuple(r)[3:] for r in audit.audit(df, said.limit(0)).collect()}
    assert bare == brute(docs, [])
