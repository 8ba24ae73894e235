"""Quality rules under weak supervision.

Each rule votes good or bad or abstains. Counts of all vote patterns over all documents
go to the driver (their number is bounded by 3 to the power of the number of rules), where
expectation-maximisation estimates how often each rule is right on good documents and on
each kind of bad ones. A document's posterior probability of being good then decides, in place of
demanding that it pass every rule.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import Words, mapped, mixed, stored, text_passes

WINDOW = 5
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_capital_words", "n_marks", "n_letters", "n_stutters"]

#: Rule: numerator, denominator; good below, bad from (or good from, bad below, where good is the larger).
RULES = {
    "symbols": ("n_symbols", "n_words", 0.02, 0.10),
    "repeats": ("n_repeat_words", "n_words", 0.10, 0.20),
    "capitals": ("n_capital_words", "n_words", 0.10, 0.30),
    "marks": ("n_marks", "n_words", 0.08, 0.20),
    "dup_lines": ("n_dup_lines", "n_lines", 0.10, 0.50),
    "distinct": ("n_distinct_words", "n_words", 0.40, 0.20),
    "stutters": ("n_stutters", "n_words", 0.10, 0.30),
    "letters": ("n_letters", "word_chars", 0.75, 0.60),
    "long_words": ("word_chars", "n_words", 9.0, 12.0),
    "short_words": ("word_chars", "n_words", 3.5, 2.5),
}

_ASCII_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _repeat_words(text: bytes) -> int:
    """Words that lie in a window of WINDOW words found twice or more, exactly: words get numbers, and windows grow by one of them at a time."""
    numbers: dict[bytes, int] = {}
    words = np.fromiter((numbers.setdefault(m[0], len(numbers)) for m in _WORD.finditer(text)), dtype=np.int64)
    if len(words) < WINDOW:
        return 0
    windows = words
    for k in range(1, WINDOW):
        pair = windows[: len(words) - k] * np.int64(len(numbers)) + words[k:]
        windows = np.unique(pair, return_inverse=True)[1]
    again = np.bincount(windows)[windows] > 1
    hit = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + WINDOW, -1)
    return int((np.cumsum(hit[:-1]) > 0).sum())


def features_of(texts: list[str]) -> dict[str, np.ndarray]:
    """The features of whole texts, as integer arrays."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    w = Words(raw)
    n = len(raw)
    n_words = np.diff(w.first)
    out = {"n_words": n_words}
    space = {ord(c): None for c in " \t\n\r\x0b\x0c"}
    out["word_chars"] = np.array([len(t) - sum(map(t.count, map(chr, space))) for t in texts], dtype=np.int64)
    out["n_symbols"] = np.array([len(b) - len(b.translate(None, b"#*$%&|<>")) for b in raw], dtype=np.int64)
    out["n_marks"] = np.array([b.count(b"!") + b.count(b"?") for b in raw], dtype=np.int64)
    # letters: ASCII letters and all code points from U+0080 on
    out["n_letters"] = np.array([len(t) - len(b.translate(None, bytes(range(128, 256)))) + len(b) - len(b.translate(None, _ASCII_LETTERS)) for t, b in zip(texts, raw)], dtype=np.int64)
    h = w.hashes()
    of = w.of.astype(np.uint64)
    key = mixed(h + of * np.uint64(0xC2B2AE3D27D4EB4F))
    out["n_distinct_words"] = np.bincount(w.of[np.unique(key, return_index=True)[1]], minlength=n)
    del key, of
    # a word with two ASCII capitals or more and no small ASCII letter
    if len(w.start):  # from a word's start to the next one's: what parts them is no letter
        large = np.add.reduceat((w.bytes >= 65) & (w.bytes <= 90), w.start, dtype=np.int32)
        loud = (large >= 2) & ~np.logical_or.reduceat((w.bytes >= 97) & (w.bytes <= 122), w.start)
    else:
        loud = np.zeros(0, dtype=bool)
    out["n_capital_words"] = np.bincount(w.of[loud], minlength=n)
    again = np.flatnonzero((h[1:] == h[:-1]) & (w.of[1:] == w.of[:-1]))  # a word right after itself
    out["n_stutters"] = np.bincount(w.of[again], minlength=n)
    # windows: equal hashes are only a hint, texts that have any are counted exactly
    repeat = np.zeros(n, dtype=np.int64)
    if len(h) >= WINDOW:
        win = h[: len(h) - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            win = win * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - WINDOW + 1 + k]
        whole = w.of[: len(win)] == w.of[WINDOW - 1 :]
        of = w.of[: len(win)][whole]
        win = mixed(win[whole] + of.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(win)
        twice = np.flatnonzero(np.diff(win[order]) == 0)
        for i in np.unique(of[order[twice]]).tolist():
            repeat[i] = _repeat_words(raw[i])
    out["n_repeat_words"] = repeat
    lines, dups = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i, b in enumerate(raw):
        full = [x for x in b.split(b"\n") if x and not x.isspace()]
        lines[i], dups[i] = len(full), len(full) - len(set(full))
    out["n_lines"], out["n_dup_lines"] = lines, dups
    return out


def with_features(df: DataFrame, text: str = "text", names: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) of ``df`` and its texts' features, one pass, no shuffle. A null text has no words."""
    names = names or FEATURES
    keep = [c for c in (keep if keep is not None else df.columns) if c not in names]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, T.LongType(), False) for n in names)])

    def run(batches):
        for b in batches:
            for a, texts in text_passes(b, text):
                yield _featured(b.slice(a, len(texts)), texts, keep, names)

    return mapped(df.select(*dict.fromkeys([*keep, text])), run, schema)


def _featured(part: pa.RecordBatch, texts: list[str], keep: list[str], names: list[str]) -> pa.RecordBatch:
    got = features_of(texts)
    return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(got[x].astype(np.int64)) for x in names)], [*keep, *names])


def votes() -> list[Column]:
    """1 good, -1 bad, 0 abstains, for each rule; a rule without a denominator abstains."""
    out = []
    for top, below, good, bad in RULES.values():
        x = F.col(top) / F.when(F.col(below) > 0, F.col(below))
        low = good < bad
        out.append(F.coalesce(F.when(x < good if low else x >= good, 1).when(x >= bad if low else x < bad, -1), F.lit(0)))
    return out


def _split(codes: np.ndarray) -> np.ndarray:
    """Votes of patterns, a row each."""
    k = len(RULES)
    return np.stack([codes // 3 ** (k - 1 - j) % 3 - 1 for j in range(k)], axis=1) if len(codes) else np.zeros((0, k), dtype=np.int64)


#: What is believed of rules before any document is seen: how often one errs on good documents, and
#: how firmly: as if a share of all documents, and so many at least, had shown it. The rates are the
#: mode of what the votes and this belief say together; nothing bounds them. (On the given documents
#: verdicts are the same for shares from 0.02 to 1.)
ERRS, FIRMNESS, LEAST_FIRM = 0.005, 0.02, 1000.0
#: The same for bad classes' rates, and for the shares of the classes.
FIRM_BAD, FIRM_SHARES = 2.0, 10.0


def fit(patterns: dict[int, int], rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the classes and the rates of bad votes, ``rate[class, rule]``, by expectation-maximisation.

    Class 0 is good; class j + 1 is bad in the way that rule j is for, since documents that
    fail differently do not make all rules vote alike. ``patterns`` maps a vote pattern
    (base 3, digit vote + 1, first rule highest) to its count. Abstentions carry nothing.
    Votes alone do not tell a rule that errs on good documents from a kind of bad ones that
    only this rule sees; that rules seldom err is the belief that decides it.
    """
    k = len(RULES)
    codes = np.array(sorted(patterns), dtype=np.int64)
    counts = np.array([patterns[c] for c in codes.tolist()], dtype=float)
    v = _split(codes)
    said_bad, said = (v == -1).astype(float), (v != 0).astype(float)
    start = np.vstack([np.full((1, k), ERRS), np.full((k, k), 0.1) + 0.8 * np.eye(k)])
    weight = np.append(max(LEAST_FIRM, FIRMNESS * counts.sum()), np.full(k, FIRM_BAD))[:, None]
    share0 = np.append(0.85, np.full(k, 0.15 / k))
    rate, share = start.copy(), share0.copy()
    for _ in range(rounds):
        p = counts[:, None] * _posterior(v, share, rate)
        before = rate, share
        rate = np.clip((p.T @ said_bad + weight * start) / (p.T @ said + weight), 1e-6, 1 - 1e-6)
        share = (p.sum(axis=0) + FIRM_SHARES * share0) / (counts.sum() + FIRM_SHARES)
        if max(np.abs(rate - before[0]).max(), np.abs(share - before[1]).max()) < 1e-9:
            break
    return share, rate


def _posterior(v: np.ndarray, share: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Probability of each class for each row of votes."""
    log = np.log(share) + (v == -1).astype(float) @ np.log(rate).T + (v == 1).astype(float) @ np.log1p(-rate).T
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def accuracies(patterns: dict[int, int], model: tuple[np.ndarray, np.ndarray]) -> dict[str, float]:
    """Estimated share of each rule's votes that are right."""
    codes = np.array(sorted(patterns), dtype=np.int64)
    v = _split(codes)
    counts = np.array([patterns[c] for c in codes.tolist()], dtype=float)
    good = _posterior(v, *model)[:, 0]
    right = np.where(v == 1, good[:, None], np.where(v == -1, 1 - good[:, None], 0.0))
    return dict(zip(RULES, ((counts @ right + 1e-9) / (counts @ (v != 0) + 1e-9)).tolist()))


def pattern_code() -> Column:
    code = F.lit(0)
    for v in votes():
        code = code * 3 + v + 1
    return code.cast("long")


def count_patterns(features: DataFrame) -> dict[int, int]:
    """Counts of the vote patterns of all rows; at most 3**len(RULES) reach the driver."""
    return {r["code"]: r["n"] for r in features.groupBy(pattern_code().alias("code")).agg(F.count("*").alias("n")).collect()}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdicts(features: DataFrame, patterns: dict[int, int], threshold: float = 0.5) -> DataFrame:
    """``features`` with ``quality_prob`` (probability of the good class), ``base_failed`` and ``kept``.

    The probabilities of the patterns found, at most 3**len(RULES) rows, are broadcast.
    """
    codes = np.array(sorted(patterns), dtype=np.int64)
    good = _posterior(_split(codes), *fit(patterns))[:, 0]
    table = features.sparkSession.createDataFrame(list(zip(codes.tolist(), good.tolist())), "vote_code long, quality_prob double")
    judged = features.withColumn("vote_code", pattern_code()).join(F.broadcast(table), "vote_code").drop("vote_code")
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality_prob") >= threshold))


def judge(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id``, the features, ``base_failed``, ``quality_prob``, ``kept``.

    Texts are read once: their features are stored, the vote patterns counted over
    all of them, then every row is judged. Null text: no words, so ``base_failed``. Repeated
    or null ids are judged row by row. An empty table gives no rows. Other columns are not read.
    """
    features = stored(with_features(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"]))
    return verdicts(features, count_patterns(features))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that are judged good, with its columns.

    Two passes over the texts and no shuffle of them: one counts the vote patterns of all
    rows, one judges. Names of columns may clash with features; they come back untouched. A null or
    empty text has no words, so its row goes; repeated rows are judged alike; an empty table stays empty.
    """
    patterns = count_patterns(with_features(df.select(F.col(text).alias("text")), keep=[]))
    place = df.columns.index(text)
    nested = df.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns))).alias("row"))
    schema = T.StructType([nested.schema["row"], *(T.StructField(n, T.LongType(), False) for n in FEATURES)])

    def run(batches):
        for b in batches:
            for a, texts in text_passes(pa.RecordBatch.from_arrays([b.column("row").field(place)], ["text"]), "text"):
                yield _featured(b.slice(a, len(texts)), texts, ["row"], FEATURES)

    kept = verdicts(mapped(nested, run, schema), patterns).where("kept")
    return kept.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)))
