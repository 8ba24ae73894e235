"""Best-fit packing of token sequences by hierarchical residual packing.

Documents are encoded and cut into pieces; whole-length pieces are sequences already.
Each partition packs its other pieces best-fit and closes bins that are nearly full. All
others go up as items, but only as counts by size: the counts of all partitions meet at the
root, which packs them best-fit, however many they are, and each item finds its place by
its rank among those of its size. The root also tries the pieces of those bins one by one and
takes what makes fewer bins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import Spec, codec_of
from quire.llm.common import mapped, small, stored, text_passes

#: Bins of at most this many free tokens are closed where they are packed.
SLACK = 4
#: Pieces that a partition packs at once; memory is bounded by it, whatever the partition's size.
LOCAL_ITEMS = 100_000

#: A bin's place (node: its partition; at: the piece's offset in it), whether it goes up, and the ranks, within the partition, of the bin by ``used`` and of the piece by ``length`` if so.
_PLACE = ["node", "bin", "used", "open", "at", "bin_rank", "piece_rank"]
_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item by best-fit decreasing: largest first, into the fullest bin that has room.

    Free space per bin is tracked by bins waiting at each free size and a bit mask of the
    sizes that have any, so an item costs a few integer operations. Ties go by position.
    """
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    out = np.empty(len(sizes), dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        room = mask >> size
        if room:
            free = size + ((room & -room).bit_length() - 1)
            at = waiting[free].pop()
            if not waiting[free]:
                mask &= ~(1 << free)
        else:
            free, at, bins = capacity, bins, bins + 1
        out[i] = at
        if free > size:
            waiting[free - size].append(at)
            mask |= 1 << (free - size)
    return out


def _pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole-length pieces at its end, the rest first."""
    head = n % capacity or capacity
    return [(0, head), *((a, capacity) for a in range(head, n, capacity))]


def plan(counts: np.ndarray, capacity: int) -> tuple[int, np.ndarray]:
    """Best-fit decreasing of ``counts[s]`` items of each size s: the number of bins, and runs of items that lie alike.

    Bins of equal contents are one group, and a size adds three groups at most, so cost and
    result are bounded by ``capacity``, whatever the number of items. A run is (size, rank of
    its first item among those of that size, items in each bin, number of its first bin, offset in a bin).
    """
    waiting: list[list[tuple]] = [[] for _ in range(capacity + 1)]
    mask = 0

    def put(free: int, n: int, runs: list[tuple]):
        nonlocal mask
        if n:
            waiting[free].append((n, runs))
            mask |= 1 << free

    for size in np.flatnonzero(counts)[::-1].tolist():
        left, rank = int(counts[size]), 0
        while left:
            room = mask >> size
            if room:
                free = size + ((room & -room).bit_length() - 1)
                n, runs = waiting[free].pop()
                if not waiting[free]:
                    mask &= ~(1 << free)
            else:
                free, n, runs = capacity, -(-left // (capacity // size)), []
            each = free // size
            full = min(n, left // each)
            last = left - full * each if full < n else 0  # what the bin after the full ones takes
            at = 0
            for bins, of in ((full, each), (1 if last else 0, last), (n - full - (last > 0), 0)):
                own = [(s, first + at * m, m) for s, first, m in runs] + ([(size, rank, of)] if of else [])
                put(free - of * size, bins, own)
                at, rank, left = at + bins, rank + bins * of, left - bins * of
    out, bins = [], 0
    for groups in waiting:
        for n, runs in groups:
            at = 0
            for size, first, m in runs:
                out.append((size, first, m, bins, at))
                at += size * m
            bins += n
    return bins, np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def _ranks(sizes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rank of each item among those of its size, after the ``seen`` ones, which are counted on."""
    order = np.argsort(sizes, kind="stable")
    n = np.bincount(sizes, minlength=len(seen))
    out = np.empty(len(sizes), dtype=np.int64)
    out[order] = np.arange(len(sizes)) - (np.cumsum(n) - n - seen)[sizes[order]]
    seen += n
    return out


def pack(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents of ``df`` into as few sequences of at most ``capacity`` tokens as it can.

    A document is its ids (null text: empty) and then ``end_id``; longer ones are cut into
    pieces of ``capacity``, the first may be shorter. Returns one row per piece: ``doc_id,
    piece, start, length, ids_crc32, sequence_id, offset``. Rows with equal or null ids are
    documents of their own; an empty table gives no rows; other columns are not read. A long text is encoded whole, its
    ids in one array of its task.

    One pass over the texts packs every partition by itself. Every bin with more than SLACK
    free tokens is packed again at the root, of which the driver sees a count for each size;
    pieces stay where they are, so no task's input grows with the corpus.
    """
    sc = df.sparkSession.sparkContext
    spec = sc.broadcast(Spec.load(tokenizer))
    kind = df.schema[doc_id].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(kind), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [*_PLACE, *_PIECE]
    schema = f"node long, bin long, used long, open boolean, at long, bin_rank long, piece_rank long, doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    source = df.select(doc_id, text)

    def local(batches):
        codec, part = codec_of(spec.value), TaskContext.get().partitionId()
        tail = np.array([] if end_id is None else [end_id], dtype=np.int32)
        items: list[tuple] = []
        serial = 0
        seen = np.zeros((2, capacity + 1), dtype=np.int64)

        def emit(pieces: list[tuple], bins: np.ndarray) -> pa.RecordBatch:
            """The pieces with the places of their bins; ids of bins and ranks go on between the rounds of one partition."""
            nonlocal serial
            order = np.argsort(bins, kind="stable")
            cols = [pa.array([pieces[i][k] for i in order.tolist()], t) for k, t in enumerate(types)]
            length, bins = cols[3].to_numpy(), bins[order]
            heads = np.flatnonzero(np.append(True, np.diff(bins) != 0))
            used = np.add.reduceat(length, heads)
            up = used < capacity - SLACK
            bin_rank, piece_rank = np.zeros(len(heads), dtype=np.int64), np.zeros(len(bins), dtype=np.int64)
            bin_rank[up] = _ranks(used[up], seen[0])
            piece_rank[up[bins]] = _ranks(length[up[bins]], seen[1])
            before = np.cumsum(length) - length
            place = [np.full(len(bins), part, dtype=np.int64), bins + serial, used[bins], up[bins], before - before[heads][bins], bin_rank[bins], piece_rank]
            serial += len(heads)
            return pa.RecordBatch.from_arrays([*map(pa.array, place), *cols], names)

        def packed():
            return emit(items, best_fit(np.array([x[3] for x in items], dtype=np.int64), capacity))

        for b in batches:
            for a, texts in text_passes(b, text):
                ids = b.column(doc_id).slice(a, len(texts)).to_pylist()
                flat, counts = codec.encode_batch(texts)
                at, whole = 0, []
                for doc, n in zip(ids, counts.tolist()):
                    tokens = np.concatenate([flat[at : at + n], tail]).astype("<u4")
                    at += n
                    raw = memoryview(tokens.tobytes())
                    for k, (s, size) in enumerate(_pieces(len(tokens), capacity) if len(tokens) else []):
                        piece = (doc, k, s, size, zlib.crc32(raw[4 * s : 4 * (s + size)]))
                        (whole if size == capacity else items).append(piece)
                if whole:
                    yield emit(whole, np.arange(len(whole)))
                if len(items) >= LOCAL_ITEMS:
                    yield packed()
                    items = []
        if items:
            yield packed()

    now = stored(mapped(source, local, schema))
    waiting = now.where("open")
    options = []
    for size, rank, inner, one in (("used", "bin_rank", "at", "at = 0"), ("length", "piece_rank", "0L", "true")):
        by_node = waiting.where(one).groupBy("node", F.col(size).alias("size")).agg(F.count("*").alias("n"))
        counts = np.zeros(capacity + 1, dtype=np.int64)
        for r in by_node.groupBy("size").agg(F.sum("n").alias("n")).collect():
            counts[r["size"]] = r["n"]
        options.append((*plan(counts, capacity), by_node, size, rank, inner))
    _, runs, by_node, size, rank, inner = min(options, key=lambda x: x[0])
    runs = sc.broadcast(runs)
    # ranks within a partition become ranks among all by the number of such items in partitions before it
    base = by_node.select("node", "size", F.expr("sum(n) over (partition by size order by node) - n as base"))
    ranked = waiting.withColumn("size", F.col(size)).join(small(base), ["node", "size"])
    ranked = ranked.select(*_PIECE, "size", F.expr(f"base + {rank}").alias("rank"), F.expr(inner).alias("at"))
    done = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def placed(batches):
        sizes, first, each, bins, at = runs.value.T
        keys = sizes << 40 | first
        for b in batches:
            own, nth, within = (b.column(n).to_numpy() for n in ("size", "rank", "at"))
            i = np.searchsorted(keys, own << 40 | nth, side="right") - 1
            k = nth - first[i]
            place = [bins[i] + k // each[i] + (1 << 59), at[i] + k % each[i] * own + within]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in _PIECE), *map(pa.array, place)], [*_PIECE, "sequence_id", "offset"])

    # 24 bits of node and 35 of bin make a number of its own for each closed bin; the root's have the bit above
    rows = now.where("not open").select(*_PIECE, F.expr("shiftleft(node, 35) + bin").alias("sequence_id"), F.col("at").alias("offset"))
    rows = rows.unionByName(mapped(ranked, placed, done))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
