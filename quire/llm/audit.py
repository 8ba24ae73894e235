"""Audit of how filters interact.

Five filters look at each whole text. Words, capitals and symbols are counted by byte classes and
prefix sums straight over Arrow's buffers; distinct words by sorting each document's word
hashes and comparing neighbours byte by byte. What a document fails is a mask of five
bits, so all orders of the filters, and what each of them removes in each order, follow from
the number of documents for each of 32 masks.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import PASS_CHARS, SPACES, Words, mapped, small, stored
from quire.llm.exact import grouped

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
#: Rows and bytes of a pair of words beyond which it is compared by itself.
PASS_ROWS, LONG_WORD = 1 << 14, 1 << 12

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def buffer_passes(batch: pa.RecordBatch, column: str, limit: int = PASS_CHARS):
    """Yield ``(first_row, bytes, offsets)`` of runs of about ``limit`` bytes of a text column, as views of its buffers; null is empty."""
    col = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    n = len(col)
    if not n:
        return
    _, places, held = col.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, dtype=np.uint8)
    runs = (offsets[:-1] - offsets[0]) // limit + np.arange(n) // PASS_ROWS
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(runs)) + 1, [n]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are marked, by one prefix sum."""
    run = np.zeros(len(marks) + 1, dtype=np.int64 if len(marks) >> 31 else np.int32)
    np.cumsum(marks, out=run[1:], dtype=run.dtype)
    return np.diff(run[offsets]).astype(np.int64)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of texts that lie one after another in ``data`` with nothing between them."""
    space = SPACES[data]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before, after = np.ones(len(data), dtype=bool), np.ones(len(data), dtype=bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[inner], after[inner - 1] = True, True
    start = np.flatnonzero(~space & before)
    return Words.at(data, start, np.flatnonzero(~space & after) + 1, np.searchsorted(offsets, start, side="right") - 1, np.searchsorted(start, offsets))


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the words of ``size`` bytes at ``a`` and ``b`` are equal, byte by byte, in blocks of bounded memory."""
    out = np.empty(len(a), dtype=bool)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    rest = np.flatnonzero(size <= LONG_WORD)
    ends = np.cumsum(size[rest])
    low = 0
    while low < len(rest):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PASS_CHARS, side="right")))
        part = rest[low:high]
        n = size[part]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        unlike = data[np.repeat(a[part], n) + step] != data[np.repeat(b[part], n) + step]
        out[part] = ~np.logical_or.reduceat(unlike, np.cumsum(n) - n)
        low = high
    return out


def distinct_words(w: Words, n_texts: int) -> np.ndarray:
    """Distinct words of each text: its hashes in order, each word held against the one before it where hashes agree."""
    n = np.diff(w.first)
    if not len(w.start):
        return n
    top = max(1, (n_texts - 1).bit_length())
    key = w.of.astype(np.uint64) << np.uint64(64 - top) | w.hashes() >> np.uint64(top)
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(np.diff(key[order]) == 0)
    a, b = order[again], order[again + 1]
    size = w.end - w.start
    equal = size[a] == size[b]
    equal[equal] = _same(w.bytes, w.start[a[equal]], w.start[b[equal]], size[a[equal]])
    out = n - np.bincount(w.of[a[equal]], minlength=n_texts)
    for t in np.unique(w.of[a[~equal]]).tolist():  # different words with one hash: that text's words are told apart as they are
        own = slice(w.first[t], w.first[t + 1])
        out[t] = len({w.bytes[i:j].tobytes() for i, j in zip(w.start[own].tolist(), w.end[own].tolist())})
    return out


def masks_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits 1, 2, 4 and 8 for the texts that fail A, B, C and D."""
    w = words_of(data, offsets)
    n_words = np.diff(w.first)
    fails = [
        n_words < LEAST_WORDS,
        100 * distinct_words(w, len(n_words)) < DISTINCT_PERCENT * n_words,
        100 * _per_text((data >= 65) & (data <= 90), offsets) > CAPITAL_PERCENT * _per_text((data & 0xC0) != 0x80, offsets),
        _per_text(_IS_SYMBOL[data], offsets) > 0,
    ]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def scanned(df: DataFrame, part: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, part, mask, digest)``: what each whole text fails of A to D, and its SHA-256."""
    own = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            for a, data, offsets in buffer_passes(b, "text"):
                n = len(offsets) - 1
                digests = [hashlib.sha256(data[i:j]).digest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(a, n), b.column("part").slice(a, n), pa.array(masks_of(data, offsets), pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    return mapped(own, run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, part string, mask int, digest binary")


def failures(df: DataFrame, part: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, part, mask)``: all five filters' bits for each row of ``df``; E holds where a smaller doc_id has the same text."""
    rows = grouped(stored(scanned(df, part, doc_id, text)), "digest", "doc_id")
    copy = F.coalesce(F.col("doc_id") > F.col("keep_id"), F.lit(False))
    return rows.select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def _weights() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) of each row of a part, and for each measure how often a document with a mask counts in it: 32 x rows."""
    mask = np.arange(1 << len(FILTERS))
    fails = [mask >> i & 1 for i in range(len(FILTERS))]
    orders = 120
    #: of the orders, so many have a filter before all others that the mask fails
    shares = np.array([0, *(orders // k for k in range(1, len(FILTERS) + 1))])[sum(fails)]
    labels, out = [], {m: [] for m in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    for order in permutations(range(len(FILTERS))):
        gone = np.zeros(len(mask), dtype=np.int64)
        for step, i in enumerate(order, 1):
            labels.append(("".join(FILTERS[j] for j in order), step))
            out["removed"].append(fails[i] & ~gone & 1)
            out["redundant"].append(fails[i] & gone)
            out["unique_fails"].append((mask == 1 << i).astype(np.int64))
            out["shapley"].append(fails[i] * shares)
            gone = gone | fails[i]
            out["kept"].append(1 - gone)
    return labels, {m: np.stack(v, axis=1).astype(np.int64) for m, v in out.items()}


#: Results and the counts they are made of: all documents, those labelled good, those labelled toxic.
MEASURES = {"kept": ("n", "kept"), "removed": ("n", "removed"), "redundant": ("n", "redundant"), "unique_fails": ("n", "unique_fails"), "good_lost": ("n_good", "removed"), "toxic_lost": ("n_toxic", "removed"), "shapley": ("n", "shapley")}
#: Parts that are expanded to rows at once.
PART_BLOCK = 64


def _expand(batches):
    labels, weights = _weights()
    for batch in batches:
        for low in range(0, batch.num_rows, PART_BLOCK):
            some = batch.slice(low, PART_BLOCK)
            parts, rows = some.column("part"), some.column("masks").to_pylist()
            counts = {c: np.zeros((len(rows), 1 << len(FILTERS)), dtype=np.int64) for c in ("n", "n_good", "n_toxic")}
            for i, held in enumerate(rows):
                for x in held:
                    for c in counts:
                        counts[c][i, x["mask"]] += x[c]
            columns = [parts.take(pa.array(np.repeat(np.arange(len(rows)), len(labels)))), pa.array([o for o, _ in labels] * len(rows)), pa.array([s for _, s in labels] * len(rows), pa.int32())]
            columns += [pa.array((counts[c] @ weights[m]).ravel()) for c, m in MEASURES.values()]
            yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *MEASURES])


def audit(df: DataFrame, labels: DataFrame, part: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each part (value of column ``part``; null: the empty string), order of the five filters and step in it.

    ``labels`` has ``doc_id``, ``quality`` and ``toxic``; a document that several rows label is good, or toxic, if any says so, and
    labels without a document count nowhere. Repeated rows of ``df`` count as often as they are there; those that share doc_id and text are not
    copies of each other under E, and a null doc_id is smaller than none and fails no E. Null and empty texts fail A (and E, if
    repeated). Texts of any length are scanned whole, in memory of some 30 bytes a byte; an empty table has no parts and gives no rows;
    columns beyond those named are ignored. What meets in one task are the 32 counts of each part, added up where documents are read.
    """
    said = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).cast("long").alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("long").alias("toxic"))
    said = small(stored(said.where("good + toxic > 0")))
    of = failures(df, part, doc_id, text).join(said, "doc_id", "left")
    counts = of.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("n_good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("n_toxic"))
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("masks"))  # 32 at most
    return mapped(by_part, _expand, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))
