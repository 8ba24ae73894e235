import math
import subprocess
import sys

import numpy as np
from brute import TEXTS, base
from pyspark.sql import functions as F

from quire.llm import quality


def test_base_columns_equal_the_plain_statement(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts = docs + [(10_000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (10_000, None)]
    df = spark.createDataFrame([(i, t, "x", True) for i, t in texts], "doc_id long, text string, n_words string, kept boolean")
    rows = quality.judge(df).collect()
    assert len(rows) == len(texts)
    want = dict(texts)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(want[r.doc_id]), r.doc_id
            assert not (r.base_failed and r.kept)
    assert quality.judge(df.limit(0)).count() == 0


def test_verdicts_agree_with_labels(spark, sf_dir):
    rows = quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("n_words >= 10").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def plain_em(votes):
    """Probability of the good class for each row of votes, by the textbook: loops over documents, no patterns."""
    k, n = len(quality.RULES), len(votes)
    prior = [[0.005] * k] + [[0.9 if i == j else 0.1 for i in range(k)] for j in range(k)]
    firm = [max(1000, n / 50)] + [2] * k
    share0 = [0.85] + [0.15 / k] * k
    rate, share = [list(r) for r in prior], list(share0)
    for _ in range(400):
        weight, bad, said = [0.0] * (k + 1), [[0.0] * k for _ in range(k + 1)], [[0.0] * k for _ in range(k + 1)]
        post = []
        for v in votes:
            p = [s * math.prod(r[j] if x < 0 else 1 - r[j] for j, x in enumerate(v) if x) for s, r in zip(share, rate)]
            p = [x / sum(p) for x in p]
            post.append(p[0])
            for c, x in enumerate(p):
                weight[c] += x
                for j, y in enumerate(v):
                    bad[c][j] += x * (y < 0)
                    said[c][j] += x * (y != 0)
        rate = [[(bad[c][j] + firm[c] * prior[c][j]) / (said[c][j] + firm[c]) for j in range(k)] for c in range(k + 1)]
        share = [(weight[c] + 10 * share0[c]) / (n + 10) for c in range(k + 1)]
    return post


def test_verdicts_equal_a_plain_em(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    votes = [tuple(r[0]) for r in quality.with_features(docs, keep=["doc_id"]).orderBy("doc_id").select(F.array(*quality.votes())).collect()]
    rows = quality.judge(docs).orderBy("doc_id").collect()
    for r, p in zip(rows, plain_em(votes), strict=True):
        assert abs(r.quality_prob - p) < 1e-3 and r.kept == (p >= 0.5 and not r.base_failed), r.doc_id


def test_a_very_long_text_takes_little_memory():
    text = "some words of a text that is long and repeats itself in lines\n" * 400_000
    code = "import resource, sys; from quire.llm import quality, simhash; t = sys.stdin.read(); m = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; a = m(); f = quality.features_of([t]); b = m(); simhash.fingerprints_of([t]); print(a, b, m(), f['n_words'][0], f['n_repeat_words'][0], f['n_dup_lines'][0])"
    a, b, c, *found = map(int, subprocess.run([sys.executable, "-c", code], input=text, capture_output=True, text=True, check=True).stdout.split())
    assert found == [5_200_000, 5_200_000, 399_999]
    assert b - a < 40 * len(text) // 1024 and c - a < 40 * len(text) // 1024


def test_keep_good_returns_rows_as_they_were(spark):
    clean = "The plain words of this text stand in lines that say a thing once and then end."
    df = spark.createDataFrame([(1, clean, 5), (2, "!! ".join(["NOISE"] * 40), 6), (3, None, 7), (4, "a*** b### c$$$ d&&& e%%% f*** g### h$$$ i&&& j%%% k***", 8)], "doc_id long, text string, n_words int")
    assert [(r.doc_id, r.text, r.n_words) for r in quality.keep_good(df).collect()] == [(1, clean, 5)]


def test_fit_finds_planted_accuracies():
    rng = np.random.default_rng(3)
    k, n = len(quality.RULES), 40_000
    cls = np.where(rng.random(n) < 0.8, 0, rng.integers(1, 4, n))
    rate = np.vstack([np.full(k, 0.01), np.full((3, k), 0.05) + 0.9 * np.eye(3, k)])
    vote = np.where(rng.random((n, k)) < rate[cls], -1, 1)
    codes, counts = np.unique(((vote + 1) * 3 ** np.arange(k)[::-1]).sum(axis=1), return_counts=True)
    patterns = dict(zip(codes.tolist(), counts.tolist()))
    model = quality.fit(patterns)
    assert abs(model[0][0] - 0.8) < 0.03
    assert np.abs(model[1][0] - 0.01).max() <= 0.0101 and np.abs(np.diag(model[1][1:4]) - 0.95).max() < 0.05
    right = [np.mean((vote[:, j] == 1) == (cls == 0)) for j in range(k)]
    assert np.abs(np.array(list(quality.accuracies(patterns, model).values())) - right).max() < 0.04
