import random

import numpy as np
from brute import TEXTS, components, simhash

from quire.llm import simhash as op
from quire.llm.common import components as spark_components


def test_fingerprints_equal_the_plain_statement(spark, sf_dir):
    texts = [t or "" for t in TEXTS] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    assert op.fingerprints_of(texts).tolist() == [simhash(t) for t in texts]
    assert op.fingerprints_of(["", " "]).tolist() == [0, 0]


def test_bucket_links_span_the_same_groups_as_all_pairs():
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for n in (2, 60):  # chains and a dense group larger than a small bucket
        x = rng.getrandbits(64)
        for _ in range(n):
            fps.append(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
    x = rng.getrandbits(64)
    fps += [x ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)]
    fps = sorted(set(fps))
    arr = np.array(fps, dtype=np.uint64)
    keys = op.variants(arr)
    order = np.argsort(keys.ravel(), kind="stable")
    a, b = op.bucket_links(keys.ravel()[order], np.repeat(arr, keys.shape[1])[order])
    assert (np.bitwise_count(a ^ b) <= 4).all()
    edges = {}
    for x, y in zip(a.tolist(), b.tolist()):
        edges.setdefault(x, set()).add(y)
        edges.setdefault(y, set()).add(x)
    assert components(fps, lambda x, y: y in edges.get(x, ())) == components(fps, lambda x, y: (x ^ y).bit_count() <= 4)


def test_near_duplicates(spark):
    random.seed(2)
    text = [f"w{random.randint(0, 999)}" for _ in range(400)]
    docs = [(i + 1, t) for i, t in enumerate(TEXTS)]
    for i in range(40):
        t = list(text)
        t[random.randrange(400)] = "other"
        docs.append((100 + i, " ".join(t)))
    docs += [(200, " ".join(text)), (50, " ".join(text)), (50, " ".join(text)), (None, " ".join(text))]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, fp int, component_id int")
    rows = op.near_duplicates(df).collect()
    assert len(rows) == len(docs)
    fp = {i: simhash(t) for i, t in docs if i is not None}
    want = components(fp, lambda x, y: (fp[x] ^ fp[y]).bit_count() <= 4)
    for r in rows:
        if r.doc_id is not None:
            assert r.fingerprint == f"{fp[r.doc_id]:016x}" and r.component_id == want[r.doc_id]
        else:
            assert r.component_id == want[50]
    left = op.keep_one(df)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {i for i in want if want[i] == i} | {None}
    assert op.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_hubs_and_odd_edges(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, 2000 + i) for i in range(300)] + [(5, 5), (7000, None), (9001, 9000)]
    rows = spark_components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r.node: r.component for r in rows}
    assert len(rows) == len(got)
    assert all(got[i] == 1 for i in range(1, 61)) and got[2150] == 1000 and got[9001] == 9000 and 7000 not in got
    assert spark_components(spark.createDataFrame([], "a long, b long")).count() == 0
