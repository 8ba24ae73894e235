"""SimHash near-duplicate detection with deletion-variant signatures.

Fingerprints that differ at 4 bits or fewer, cut into 3 segments, have a segment that
differs at one bit at most. Each segment is therefore indexed once for each of its bits
with that bit as a wildcard: segments that differ at one bit agree in the variant without
it, equal ones in all. An equality shuffle on (segment, wildcard, other bits) brings
candidates together, where whole fingerprints are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Words, components, mapped, spread_join, stored, text_passes, without_ids

WORDS, SEED, BITS = 4, 42, 4
#: Places of the segments' bits: 4 bits or fewer cannot differ twice in each of three.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Buckets up to this size are compared pair by pair in array steps; larger ones by a search that drops what is linked.
SMALL_BUCKET = 24
#: Shingles that are hashed at once.
BLOCK = 1 << 16


def fingerprints_of(texts: list[str]) -> np.ndarray:
    """The SimHash of each whole text as uint64."""
    w = Words([t.encode("utf-8", "replace").lower() for t in texts])
    out = np.zeros(len(texts), dtype=np.uint64)
    n = np.diff(w.first)
    if not len(w.start):
        return out
    # words joined by one blank: place of each word in the joined bytes
    size = w.end - w.start
    gap = np.zeros(len(w.bytes) + 1, dtype=np.int8)
    gap[w.start] += 1
    gap[w.end] -= 1
    inside = np.cumsum(gap[:-1], dtype=np.int8).astype(bool)
    inside[w.end] = True
    joined = np.where(inside, w.bytes, 0)[inside]
    ends = np.cumsum(size + 1)
    begins = ends - size - 1
    joined[ends - 1] = 32
    data = joined.tobytes()
    # one shingle begins at each word that has enough words after it in its text, and at a short text's first word
    last = w.first[1:][w.of] - 1
    k = np.arange(len(size))
    short = n[w.of] < WORDS
    begin = np.flatnonzero((k + WORDS - 1 <= last) | (short & (k == w.first[:-1][w.of])))
    stop = ends[np.minimum(begin + WORDS - 1, last[begin])] - 1
    digest = xxhash.xxh64_intdigest
    of = w.of[begin]
    heads = np.flatnonzero(np.append(True, np.diff(of) != 0))
    total = np.diff(np.append(heads, len(of)))
    votes = np.zeros((len(heads), 64), dtype=np.int64)
    row = np.repeat(np.arange(len(heads)), total)
    for low in range(0, len(begin), BLOCK):  # blocks of shingles bound memory for texts of any length
        part = slice(low, low + BLOCK)
        h = np.array([digest(data[a:b], SEED) for a, b in zip(begins[begin[part]].tolist(), stop[part].tolist())], dtype=np.uint64)
        first = np.flatnonzero(np.append(True, np.diff(row[part]) != 0))
        own = row[part][first]
        for at in range(0, 64, 8):  # a byte of each hash at a time keeps the unpacked bits small
            byte = ((h >> np.uint64(at)) & np.uint64(255)).astype(np.uint8)
            votes[own, at : at + 8] += np.add.reduceat(np.unpackbits(byte[:, None], axis=1, bitorder="little").astype(np.int32), first, axis=0)
    bits = 2 * votes > total[:, None]
    out[of[heads]] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)``: the fingerprint of each whole text as a signed long; null text: zero."""

    def run(batches):
        for b in batches:
            for a, texts in text_passes(b, text):
                yield pa.RecordBatch.from_arrays([b.column(doc_id).slice(a, len(texts)), pa.array(fingerprints_of(texts).view(np.int64))], ["doc_id", "fp"])

    return mapped(df.select(doc_id, text), run, f"doc_id {df.schema[doc_id].dataType.simpleString()}, fp long")


def variants(fps: np.ndarray) -> np.ndarray:
    """Keys of the one-wildcard variants of each fingerprint, one row each: wildcard's number, then the segment without that bit."""
    out, number = [], 0
    for at, size in SEGMENTS:
        seg = (fps >> np.uint64(at)) & np.uint64((1 << size) - 1)
        for bit in range(size):
            out.append((np.uint64(number << 22) | (seg & ~np.uint64(1 << bit))).astype(np.int64))
            number += 1
    return np.stack(out, axis=1)


def _first_key(x: np.ndarray) -> np.ndarray:
    """Number of the first wildcard under which fingerprints with this difference meet."""
    out = np.full(len(x), -1, dtype=np.int64)
    number = 0
    for at, size in SEGMENTS:
        d = (x >> np.uint64(at)) & np.uint64((1 << size) - 1)
        ones = np.bitwise_count(d)
        place = np.where(ones == 1, np.bitwise_count(d - np.uint64(1)), 0).astype(np.int64)
        out = np.where((out < 0) & (ones <= 1), number + place, out)
        number += size
    return out


def bucket_links(keys: np.ndarray, fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join up what is within ``bits`` in each bucket; ``keys`` are sorted.

    In small buckets every pair is compared, and given out in the first of its buckets
    only. In a large one a search goes from fingerprint to fingerprint and leaves out those already
    reached, so a dense group costs little more than its size; its links span each group.
    """
    a, b = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.uint64)]
    if len(keys) < 2:
        return a[0], b[0]
    heads = np.flatnonzero(np.append(True, np.diff(keys) != 0))
    size = np.diff(np.append(heads, len(keys)))
    of_size = np.repeat(size, size)
    few = np.flatnonzero((of_size > 1) & (of_size <= SMALL_BUCKET))
    k, f = keys[few], fps[few]
    for d in range(1, min(SMALL_BUCKET, len(k))):
        same = np.flatnonzero(k[d:] == k[:-d])
        if not len(same):
            break
        x = f[same] ^ f[same + d]
        near = np.bitwise_count(x) <= bits
        same, x = same[near], x[near]
        own = _first_key(x) == k[same] >> 22
        a.append(f[same[own]])
        b.append(f[same[own] + d])
    for i in np.flatnonzero(size > SMALL_BUCKET).tolist():
        rest = fps[heads[i] : heads[i] + size[i]]
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                pivot = front.pop()
                near = np.bitwise_count(rest ^ pivot) <= bits
                if near.any():
                    found = rest[near]
                    a.append(np.full(len(found), pivot, dtype=np.uint64))
                    b.append(found)
                    front.extend(found)
                    rest = rest[~near]
    return np.concatenate(a), np.concatenate(b)


def _index(batches):
    for b in batches:
        fps = b.column("fp").to_numpy().view(np.uint64)
        for i in range(0, len(fps), 20_000):
            part = fps[i : i + 20_000]
            keys = variants(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part, keys.shape[1]).view(np.int64))], ["key", "fp"])


def _links(batches):
    """Runs through a partition sorted by key; the last, perhaps unfinished bucket waits for the next batch."""
    keys, fps = [], []

    def out():
        a, b = bucket_links(np.concatenate(keys), np.concatenate(fps))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        k, f = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        if not len(k):
            continue
        cut = np.searchsorted(k, k[-1])
        if keys and (cut or keys[-1][0] != k[-1]):
            keys.append(k[:cut])
            fps.append(f[:cut])
            yield out()
            keys, fps = [k[cut:]], [f[cut:]]
        elif keys:
            keys.append(k)
            fps.append(f)
        else:
            if cut:
                keys, fps = [k[:cut]], [f[:cut]]
                yield out()
            keys, fps = [k[cut:]], [f[cut:]]
    if keys:
        yield out()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Fingerprints at 4 or fewer differing bits link; ``component_id`` is the smallest doc_id reachable.
    Equal fingerprints are one node, so copies are never paired; a null text has fingerprint zero and links
    like any other; a null doc_id is never a component's id unless it has no other (then null). Repeated rows repeat, an empty table
    gives none; shingles of a long text are hashed in blocks; other columns, whatever their names, are not read. A bucket of
    fingerprints that share a variant is held by one task.
    """
    prints = stored(fingerprints(df, doc_id, text))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    index = mapped(nodes.select("fp"), _index, "key long, fp long")
    links = mapped(index.repartition("key").sortWithinPartitions("key"), _links, "a long, b long")
    groups = stored(components(links))
    lowest = groups.join(nodes, groups.node == nodes.fp).groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    labels = spread_join(groups, lowest, ["component"], "members", groups.count()).select(F.col("node").alias("fp"), "component_id")
    named = nodes.join(labels, "fp", "left").select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id"))
    return spread_join(prints, named, ["fp"], "n", prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df`` without those of documents that are not the first of their group.

    Rows that share a doc_id are one document and stay or go together; null ids stay.
    """
    groups = stored(near_duplicates(df, doc_id, text))
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    return without_ids(df, gone, doc_id)
