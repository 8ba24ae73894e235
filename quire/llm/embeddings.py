"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks.

Vectors are scaled to length one, projected on Gaussian directions and quantised with a
common width; ``k`` quantised projections make a bucket of a table. Equal vectors are one
node beforehand. Buckets shared by nodes of one label bring their vectors together in
cells of bounded size, where cosines are taken in double precision.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import components, mapped, mixed, spread_join, stored

#: Quantisation width, and chance to miss a pair that is just similar enough.
WIDTH, MISS = 2.0, 0.002
#: Nodes in a cell; larger buckets are split, each pair of parts being a cell.
CELL = 2048
#: Cells up to this size are compared pair by pair, many cells at once; of larger ones only spanning links leave.
SMALL_CELL = 8


def _meet(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection is equal for vectors at a distance."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, threshold: float) -> tuple[int, int]:
    """(k, tables): k so that ``n`` unrelated vectors give about one chance mate in a bucket, tables so that MISS holds."""
    near, far = _meet(math.sqrt(2 - 2 * threshold)), _meet(math.sqrt(2))
    k = max(8, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log(1 - near**k))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; large components are scaled down first so that squares stay finite."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


@functools.lru_cache(maxsize=8)
def _directions(size: int, n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions and shifts for vectors of a size; the same in every worker."""
    rng = np.random.default_rng([seed, size])
    return rng.standard_normal((size, n)), rng.uniform(0, WIDTH, n)


def bucket_keys(units: np.ndarray, labels: np.ndarray, k: int, tables: int) -> np.ndarray:
    """A 64-bit bucket key for each row and table, of its label, dimension, table and k quantised projections."""
    directions, shift = _directions(units.shape[1], k * tables)
    out = np.empty((len(units), tables), dtype=np.int64)
    for i in range(0, len(units), 4096):
        cells = np.floor((units[i : i + 4096] @ directions + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(-1, tables, k)
        h = labels[i : i + 4096].view(np.uint64)[:, None] * np.uint64(tables) + np.arange(tables, dtype=np.uint64)
        h = mixed(h + np.uint64(units.shape[1] << 32))
        for j in range(k):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j])
        out[i : i + 4096] = h.view(np.int64)
    return out


def _met(x: np.ndarray, y: np.ndarray, tab: np.ndarray) -> np.ndarray:
    """Whether rows of keys share a bucket of a table before ``tab``, where their pair was counted."""
    return ((x == y) & (np.arange(x.shape[1]) < np.reshape(tab, (-1, 1)))).any(axis=1)


def small_links(u: np.ndarray, cell: np.ndarray, weights: np.ndarray, keys: np.ndarray, tab: np.ndarray, threshold: float, most: int):
    """(counts, a, b) of many small cells at once: rows with equal ``cell``, ``most`` or fewer, are neighbours and are compared pair by pair."""
    counts = np.zeros(len(u), dtype=np.int64)
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for d in range(1, most):
        i = np.flatnonzero(cell[d:] == cell[:-d])
        if not len(i):
            break
        i = i[np.einsum("ij,ij->i", u[i], u[i + d]) >= threshold]
        i = i[~_met(keys[i], keys[i + d], tab[i])]
        np.add.at(counts, i, weights[i + d])
        np.add.at(counts, i + d, weights[i])
        a.append(i)
        b.append(i + d)
    return counts, np.concatenate(a), np.concatenate(b)


def cell_links(u: np.ndarray, weights: np.ndarray, keys: np.ndarray, tab: int, part: np.ndarray, threshold: float):
    """(counts, a, b) of one cell of unit vectors: weight of others linked to each row in this table first, and spanning links.

    ``part`` numbers the bucket's parts that meet here; where there are two, only pairs
    across them count. A pair that shares a bucket of an earlier table was counted there.
    """
    n = len(u)
    counts = np.zeros(n, dtype=np.int64)
    across = part.min() != part.max()
    root = np.arange(n)
    a, b = [], []
    for i in range(0, n, 256):
        near = u[i : i + 256] @ u.T >= threshold
        if across:
            near &= part[i : i + 256, None] != part
        near[np.arange(len(near)), i + np.arange(len(near))] = False
        for t in range(tab):
            near &= keys[i : i + 256, t, None] != keys[:, t]
        counts[i : i + 256] = near @ weights
        x, y = np.nonzero(near)
        x += i
        upper = x < y
        x, y = x[upper], y[upper]
        while len(x):  # union-find over the linked pairs of these rows
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            apart = low != high
            x, y, low, high = x[apart], y[apart], low[apart], high[apart]
            if not len(x):
                break
            best = np.full(n, n)
            np.minimum.at(best, high, low)
            moved = np.flatnonzero(best < n)
            a.append(moved)
            b.append(best[moved])
            root[moved] = best[moved]
            while (root[root] != root).any():
                root = root[root]
    none = [np.zeros(0, dtype=np.int64)]
    return counts, np.concatenate(none + a), np.concatenate(none + b)


def near_duplicates(df: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of ``df``: ``vec_id, n_links, component_id, kept``.

    Rows link if their labels are equal and not null and their cosine is ``threshold`` or more.
    Vectors that are null, empty or zero, or hold null or non-finite components link with nothing; so do those
    of other dimensions. ``n_links`` counts other rows, copies included; ``component_id`` is the smallest
    vec_id reachable, ``kept`` says that it is the row's own. Links are found with a
    chance of 1 - MISS at the threshold and more above it; none is made up. A null vec_id is
    nobody's component unless the group has no other (then null, and kept is false). An empty table gives no rows; other
    columns are not read.

    Buckets of any size are worked off in cells of CELL nodes; per cell only counts and spanning links leave.
    """

    def read(batches):
        for batch in batches:
            lists, label = batch.column("embedding"), batch.column("label")
            flat = np.asarray(pc.fill_null(lists.flatten(), np.nan), dtype=np.float64)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
            off = np.concatenate([[0], np.cumsum(sizes)])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            bad = np.bincount(owner[~np.isfinite(flat)], minlength=len(sizes)) > 0
            some = np.bincount(owner[flat != 0], minlength=len(sizes)) > 0
            ok = some & ~bad & ~np.asarray(label.is_null())
            low, high = np.zeros(len(ok), dtype=np.uint64), np.zeros(len(ok), dtype=np.uint64)
            flat = flat + 0.0  # a negative zero is a zero
            raw, labels = memoryview(flat).cast("B"), np.asarray(pc.fill_null(label, 0)).view(np.uint64)
            for i in np.flatnonzero(ok).tolist():
                d = xxhash.xxh3_128_intdigest(raw[8 * off[i] : 8 * off[i + 1]], seed=int(labels[i]))
                low[i], high[i] = d & 0xFFFFFFFFFFFFFFFF, d >> 64
            mask = pa.array(ok).buffers()[1]
            vectors = pa.Array.from_buffers(pa.binary(), len(ok), [mask, pa.py_buffer((8 * off).astype(np.int32)), pa.py_buffer(flat)])
            cols = [batch.column("vec_id"), label, vectors, pa.array(low.view(np.int64), mask=~ok), pa.array(high.view(np.int64), mask=~ok)]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "vector", "k1", "k2"])

    id_type = df.schema[vec_id].dataType.simpleString()
    source = df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).cast("long").alias("label"))
    rows = stored(mapped(source, read, f"vec_id {id_type}, label long, vector binary, k1 long, k2 long"))
    grouped = rows.where("vector is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    nodes = stored(grouped.withColumn("node", F.monotonically_increasing_id()))
    n_nodes = nodes.count()
    k, tables = plan_tables(n_nodes, threshold)

    def matrices(raw: pa.Array):
        """Unit vectors by dimension: (row numbers, matrix)."""
        sizes = np.asarray(pc.binary_length(raw), dtype=np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            yield at, unit(np.frombuffer(b"".join(raw.take(pa.array(at)).to_pylist()), dtype=np.float64).reshape(len(at), -1))

    def keyed(batches):
        for b in batches:
            keys = np.zeros((b.num_rows, tables), dtype=np.int64)
            labels = b.column("label").to_numpy()
            for at, u in matrices(b.column("vector")):
                keys[at] = bucket_keys(u, labels[at], k, tables)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * tables, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "n", "vector")), lists], ["node", "n", "vector", "keys"])

    def cells(batches):
        """Buckets of two nodes or more, from a partition sorted by bucket, as rows (cell, bucket, table, part, node)."""
        names = ["cell", "bucket", "tab", "part", "node"]

        def out(bucket, tab, node):
            heads = np.flatnonzero(np.append(True, np.diff(bucket) != 0))
            size = np.diff(np.append(heads, len(bucket)))
            few = np.repeat((size > 1) & (size <= CELL), size)
            cols = [mixed(bucket[few].view(np.uint64)).view(np.int64), bucket[few], tab[few].astype(np.int64), np.zeros(few.sum(), dtype=np.int64), node[few]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names)
            for i in np.flatnonzero(size > CELL).tolist():
                h, s = int(heads[i]), int(size[i])
                parts = -(-s // CELL)
                own = np.arange(s) % parts
                for j in range(parts):  # one part and all others, a row a node each, is held at a time
                    one, two = np.minimum(own, j), np.maximum(own, j)
                    cell = mixed((one * parts + two + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + bucket[h].view(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (cell, np.full(s, bucket[h]), np.full(s, tab[h], dtype=np.int64), own, node[h : h + s]))], names)

        for run in sorted_runs(batches):
            yield from out(*(run.column(i).to_numpy() for i in range(3)))

    def verify(batches):
        """Cells from a partition sorted by (cell, bucket); gives (a, b, links): counts have b null, spanning links have links 0."""
        for run in sorted_runs(batches):
            cell, bucket, tab, part, node, weights = (run.column(c).to_numpy() for c in ("cell", "bucket", "tab", "part", "node", "n"))
            keys = run.column("keys").flatten().to_numpy().reshape(-1, tables)
            out = [[], [], []]

            def told(counts, a, b, node):
                some = np.flatnonzero(counts)
                out[0].append(pa.array(np.concatenate([node[some], node[a]])))
                out[1].append(pa.array(np.concatenate([node[some], node[b]]), mask=np.arange(len(some) + len(a)) < len(some)))
                out[2].append(pa.array(np.concatenate([counts[some], np.zeros(len(a), dtype=np.int64)])))

            for at, u in matrices(run.column("vector")):
                # cells whose numbers are equal by chance are told apart by their buckets
                heads = np.flatnonzero(np.append(True, (np.diff(cell[at]) != 0) | (np.diff(bucket[at]) != 0)))
                size = np.diff(np.append(heads, len(at)))
                name = np.repeat(np.arange(len(heads)), size)
                own = part[at] != part[at[heads]][name]
                split = np.bincount(name[own], minlength=len(heads)) > 0
                few = np.flatnonzero(((size <= SMALL_CELL) & ~split)[name])
                told(*small_links(u[few], name[few], weights[at[few]], keys[at[few]], tab[at[few]], threshold, SMALL_CELL), node[at[few]])
                for i in np.flatnonzero((size > SMALL_CELL) | split).tolist():
                    o = at[heads[i] : heads[i] + size[i]]
                    told(*cell_links(u[heads[i] : heads[i] + size[i]], weights[o], keys[o], int(tab[o[0]]), part[o], threshold), node[o])
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([*x, pa.array([], pa.int64())]) for x in out], ["a", "b", "links"])

    vectors = stored(mapped(nodes.select("node", "label", "n", "vector"), keyed, "node long, n long, vector binary, keys array<long>"))
    buckets = vectors.select(F.posexplode("keys").alias("tab", "bucket"), "node").select("bucket", "tab", "node").repartition("bucket").sortWithinPartitions("bucket")
    meeting = mapped(buckets, cells, "cell long, bucket long, tab long, part long, node long")
    full = meeting.join(vectors, "node").select("cell", "bucket", "tab", "part", "node", "n", "vector", "keys").repartition("cell").sortWithinPartitions("cell", "bucket")
    found = stored(mapped(full, verify, "a long, b long, links long"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    groups = components(found.where("b is not null"))
    named = stored(nodes.select("node", "k1", "k2", "n", "first_id").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    facts = spread_join(named, lowest, ["component"], "members", n_nodes).join(links, "node", "left").select("k1", "k2", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = spread_join(rows.where("vector is not null").select("vec_id", "k1", "k2"), facts, ["k1", "k2"], "n", rows.count())
    out = joined.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def sorted_runs(batches) -> Iterator[pa.RecordBatch]:
    """Batches of a partition sorted by its first column, cut so that equal values stay together; each is copied once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        first = b.column(0).to_numpy()
        cut = int(np.searchsorted(first, first[-1]))
        if held and held[-1].column(0)[0].as_py() == first[-1]:
            held.append(b)
            continue
        if held or cut:
            yield _joined([*held, b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield _joined(held)


def _joined(batches: list) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
