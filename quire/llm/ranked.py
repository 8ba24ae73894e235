"""Ranked lexical search: WAND over shards of documents.

A first pass turns each document into the numbers and frequencies of those of its terms that some
query has, a stored table from which document frequencies and lengths are counted. A second
one gathers its partitions into shards of bounded size, each a small inverted index with the greatest
impact of every term in it. A query goes through a shard window by window: lists that even together cannot
lift a document over the heap's threshold bring up no document; those that the others bring up
are dropped as soon as bounds say so; the pivots that are left are scored and
pushed on the heap. A task carries its heaps from shard to shard, and the heaps of all tasks are merged in two levels.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import mapped, stored

TOP = 50
#: The scoring's constants, in percent and thousandths.
LENGTH_PERCENT, SCALE, TF_SCALE, LENGTH_SCALE = 50, 1_000_000_000, 1000, 20
#: Queries that are ranked in one pass over the documents hold so many terms in all (a longer query has a pass of its own).
BLOCK_TERMS = 1 << 18
#: Postings of a shard, some 60 bytes each while it is built; one document of more makes a shard by itself.
SHARD_POSTINGS = 1 << 20
#: Documents of a query's first window in a shard, and of the largest: each has twice the last one's, as the threshold settles.
WINDOW, MOST_WINDOW = 128, 1 << 14
#: Bytes of a folded text that are split into terms at once.
PIECE = 1 << 20
#: Heaps of tasks meet in so many groups before those of a query meet in one.
MERGES = 64

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, piece by piece: runs of ASCII letters (A-Z lower-cased), digits and all code points from U+0080 on."""
    folded = raw.translate(_FOLD)
    at = 0
    while at < len(folded):
        stop = folded.find(b" ", at + PIECE)
        stop = len(folded) if stop < 0 else stop
        yield folded[at:stop].split()
        at = stop


def weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def blocks_of(queries: DataFrame, item_id: str, text: str) -> Iterator[tuple[list[tuple], list[list[bytes]]]]:
    """Runs of queries of at most BLOCK_TERMS terms: their ids, and their distinct terms."""
    ids: list[tuple] = []
    held: list[list[bytes]] = []
    size = 0
    for r in queries.select(item_id, text).toLocalIterator():  # the stated query set, one block in memory
        own = sorted({t for part in terms((r[1] or "").encode("utf-8", "replace")) for t in part})
        if ids and size + len(own) > BLOCK_TERMS:
            yield ids, held
            ids, held, size = [], [], 0
        ids.append((len(ids), r[0]))
        held.append(own)
        size += len(own)
    if ids:
        yield ids, held


def forward(df: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of documents that have terms: how many, and number and frequency of those in the vocabulary."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # at most BLOCK_TERMS terms

    def run(batches):
        number = shared.value
        known = number.__contains__
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.binary())
            places, sizes, found, tfs, cuts = [], [], [], [], [0]
            for i in range(b.num_rows):
                raw = texts[i].as_py()
                n, counts = 0, Counter()
                for part in terms(raw) if raw else ():
                    n += len(part)
                    counts.update(filter(known, part))
                if n:
                    places.append(i)
                    sizes.append(n)
                    found.extend(map(number.__getitem__, counts))
                    tfs.extend(counts.values())
                    cuts.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (found, tfs)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(places, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return mapped(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Shard:
    """The inverted index of some documents: postings by term, documents ascending by id in each, with their impacts."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, first: np.ndarray, found: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_documents: int, n_terms: int):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        if n_documents * int(sizes.max(initial=0)) * LENGTH_PERCENT >> 63:
            share = np.array([LENGTH_PERCENT * int(s) * n_documents // n_terms for s in sizes], dtype=np.int64)
        else:
            share = LENGTH_PERCENT * sizes * np.int64(n_documents) // np.int64(max(1, n_terms))
        norm = 100 - LENGTH_PERCENT + share
        place = np.empty(len(ids), dtype=np.int32)
        place[order] = np.arange(len(ids), dtype=np.int32)
        lengths = np.diff(first)
        tf = tfs.astype(np.int64)
        impact = weights[found] * ((SCALE * tf) // (TF_SCALE * tf + LENGTH_SCALE * np.repeat(norm, lengths)))
        doc = np.repeat(place, lengths)
        some = np.flatnonzero(impact > 0)
        by = some[np.lexsort((doc[some], found[some]))]
        self.docs, self.impacts = doc[by], impact[by]
        heads = np.searchsorted(found[by], np.arange(len(weights) + 1))
        self.first = heads
        self.bounds = np.zeros(len(weights), dtype=np.int64)
        full = np.flatnonzero(np.diff(heads))
        if len(full):
            self.bounds[full] = np.maximum.reduceat(self.impacts, heads[full])


class Heap:
    """The best ``k`` documents so far: score, then smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    @property
    def threshold(self) -> int:
        """The least score that may still enter (an equal one does with a smaller id)."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def push(self, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.append(self.scores, scores), np.append(self.ids, ids)
        best = np.lexsort((i, -s))[: self.k]
        self.scores, self.ids = s[best], i[best]


def wand(shard: Shard, query: np.ndarray, heap: Heap) -> int:
    """Push a shard's documents that may enter the heap of a query; returns how many were scored."""
    lists = query[shard.bounds[query] > 0]
    lists = lists[np.argsort(shard.bounds[lists], kind="stable")]
    bounds = shard.bounds[lists]
    sums = np.concatenate([[0], np.cumsum(bounds)])  # what the first lists bring together at most
    ends, at = shard.first[lists + 1], shard.first[lists].copy()
    low, size, scored = 0, WINDOW, 0
    while low < len(shard.ids):
        need = heap.threshold
        if sums[-1] < need:
            break
        high = min(low + size, len(shard.ids))
        nexts = np.array([a + np.searchsorted(shard.docs[a:e], high) for a, e in zip(at.tolist(), ends.tolist())], dtype=np.int64)
        pivot = int(np.searchsorted(sums[1:], need))  # the lists before it cannot lift a document over the threshold
        bound = np.zeros(high - low, dtype=np.int64)
        for j in range(pivot, len(lists)):
            bound[shard.docs[at[j] : nexts[j]] - low] += bounds[j]
        left = np.flatnonzero(bound)
        reach = bound[left]
        for j in range(pivot - 1, -1, -1):
            may = reach + sums[j + 1] >= need
            left, reach = left[may], reach[may]
            if not len(left):
                break
            reach = reach + bounds[j] * _held(shard.docs[at[j] : nexts[j]], left + low)[0]
        left = left[reach >= need]
        if len(left):
            scores = np.zeros(len(left), dtype=np.int64)
            for j in range(len(lists)):
                hit, where = _held(shard.docs[at[j] : nexts[j]], left + low)
                scores[hit] += shard.impacts[at[j] + where[hit]]
            enter = scores >= need
            heap.push(scores[enter], shard.ids[left[enter] + low])
            scored += len(left)
        at, low, size = nexts, high, min(2 * size, MOST_WINDOW)
    return scored


def _held(docs: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the wanted documents are in a sorted list, and where they are or would be."""
    where = np.searchsorted(docs, wanted)
    if not len(docs):
        return np.zeros(len(wanted), dtype=bool), where
    return docs[np.minimum(where, len(docs) - 1)] == wanted, where


#: A document without an id has this one inside a shard, after all others.
NO_ID = np.iinfo(np.int64).max


def _shards(batches, postings: int):
    """Documents of a partition, ``(ids, sizes, first, terms, tfs)``, in runs of about so many postings."""
    held, size = [], 0
    for b in batches:
        found = b.column("terms")
        first = found.offsets.to_numpy().astype(np.int64)
        low = 0
        while low < b.num_rows:
            high = max(low + 1, int(np.searchsorted(first, first[low] + postings - size, side="right")) - 1)
            cut = slice(int(first[low]), int(first[high]))
            ids = b.column("doc_id").slice(low, high - low).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            held.append((ids, b.column("n").slice(low, high - low).to_numpy(), np.diff(first[low : high + 1]), *(b.column(c).values.to_numpy()[cut] for c in ("terms", "tfs"))))
            size += cut.stop - cut.start
            low = high
            if size >= postings or low < b.num_rows:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple:
    ids, sizes, counts, found, tfs = (np.concatenate(x) for x in zip(*held))
    return ids, sizes, np.concatenate([[0], np.cumsum(counts)]), found, tfs


def heaps(index: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n_documents: int, n_terms: int, k: int, postings: int = SHARD_POSTINGS) -> DataFrame:
    """``(query, merge, doc_id, score)``: the k best of each query in each task, over the task's shards."""
    shared = index.sparkSession.sparkContext.broadcast((queries, weights))  # at most BLOCK_TERMS terms

    def run(batches):
        own, w = shared.value
        best = [Heap(k) for _ in own]
        for docs in _shards(batches, postings):
            shard = Shard(*docs, w, n_documents, n_terms)
            for q, heap in zip(own, best):
                wand(shard, q, heap)
        merge = TaskContext.get().partitionId() % MERGES
        for i in range(0, len(best), 256):
            some = best[i : i + 256]
            ids, scores = np.concatenate([h.ids for h in some]), np.concatenate([h.scores for h in some])
            numbers = np.repeat(np.arange(i, i + len(some)), [len(h.ids) for h in some])
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(np.full(len(ids), merge), pa.int32()), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], ["query", "merge", "doc_id", "score"])

    return mapped(index.select("doc_id", "n", "terms", "tfs"), run, "query int, merge int, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each query: ``item_id``, ``rank`` from 1, ``doc_id``, ``score`` (over 0), equal scores by ascending doc_id.

    Every row of ``queries`` is a query, repeated rows and ids too (ranks are then given anew for each); a null or empty text ranks
    nothing. Every row of ``docs`` is a document, repeated ones too; null and empty texts have no terms and count nowhere; a null doc_id
    counts and ranks after all others of its score; ids are integers. An empty table ranks nothing. Texts of any length are read
    whole, in pieces; other columns are ignored. Queries go in blocks of BLOCK_TERMS terms, each one pass over the documents.
    """
    spark = docs.sparkSession
    kind = queries.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for ids, held in blocks_of(queries, item_id, query_text):
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for q in held for t in q))}
        index = stored(forward(docs, vocabulary, doc_id, text))
        size: Row = index.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
        if not size.documents:
            continue
        counted = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # one for each term of the block
        weights = np.zeros(len(vocabulary), dtype=np.int64)
        for r in counted:
            weights[r.term] = weight(size.documents, r.df)
        found = heaps(index, [np.array([vocabulary[t] for t in q], dtype=np.int64) for q in held], weights, size.documents, size.terms, k)
        best = found
        for group in (["query", "merge"], ["query"]):
            order = W.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = F.broadcast(spark.createDataFrame(ids, f"query int, item_id {kind}"))  # a block of queries
        out = out.unionByName(best.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    return out
