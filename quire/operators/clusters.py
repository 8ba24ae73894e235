"""Exact nearest neighbours that pass over most vectors.

Vectors are dealt to their nearest centroid, with their distance from it; a cluster's radius is the largest of them. By the
triangle inequality a vector is no nearer to a query than the two distances from the centroid differ, and
a cluster no nearer than its centroid's distance less its radius. The clusters around the query are read first;
the k-th distance found there rules out whole clusters, and vectors of the others before their distance is computed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import vectors

#: Vectors that centroids are fitted on, the first by a hash of their number, and centroids at most: the bound of what the driver and each task hold.
SAMPLE, MOST_CENTROIDS, STEPS = 20_000, 1024, 8
#: Distances that are equal but for rounding.
SLACK = 1e-9


@dataclass(frozen=True)
class Clusters:
    """``members`` (chunk_id, embedding, cluster, from_centroid), sorted by the last two; ``centroids`` (cluster, centroid, radius, n)."""

    members: DataFrame
    centroids: DataFrame


@dataclass(frozen=True)
class Found:
    """``rows`` (chunk_id, distance), and of how many vectors how many had their distance computed."""

    rows: DataFrame
    vectors: int
    read: int


def _nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A nearest centroid of each point (by products, so nearly equal ones may be mistaken for each other) and how far that one is, by differences."""
    norms = (centroids**2).sum(axis=1)
    near = np.concatenate([np.zeros(0, dtype=np.int64), *((norms - 2 * points[i : i + 4096] @ centroids.T).argmin(axis=1) for i in range(0, len(points), 4096))])
    return near, np.sqrt(((points - centroids[near]) ** 2).sum(axis=1))


def fitted(sample: np.ndarray, n: int, steps: int = STEPS) -> np.ndarray:
    """``n`` centroids of a sample: rows far apart to begin with, then means of what is nearest."""
    if not len(sample):
        return sample
    rng = np.random.default_rng(0)
    centroids = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(steps):
        near, _ = _nearest(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        count = np.bincount(near, minlength=len(centroids))
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return np.unique(centroids, axis=0)


def build(embeddings: DataFrame, store=lambda name, df: df, n_centroids: int | None = None) -> Clusters:
    """Clusters of ``(chunk_id, embedding)``; ``store(name, frame)`` writes the tables and gives them back.

    The square root of the number of vectors is the number of centroids, MOST_CENTROIDS at most. All vectors have the length of
    most of the sample's; null ones, ones with nulls or values that are not finite, and those of another length are near to nothing and left out.
    """
    spark = embeddings.sparkSession
    some = embeddings.where("embedding is not null").select("embedding", F.xxhash64("chunk_id").alias("h"), "chunk_id").orderBy("h", "chunk_id").limit(SAMPLE)
    held = [np.array(r[0], dtype=np.float64) for r in some.select("embedding").collect() if None not in r[0]]
    sizes = [len(v) for v in held]
    dim = max(set(sizes), key=lambda d: (sizes.count(d), d)) if sizes else 0
    fine = [v for v in held if len(v) == dim and np.isfinite(v).all()]
    sample = np.array(fine).reshape(len(fine), dim)
    n = n_centroids or min(MOST_CENTROIDS, max(1, int(embeddings.count() ** 0.5)))
    shared = spark.sparkContext.broadcast(fitted(sample, n))

    def run(batches):
        centroids = shared.value
        for b in batches:
            rows = b.column("embedding").to_pylist()
            points = [(i, r) for i, r in enumerate(rows) if r is not None and len(r) == dim and None not in r] if len(centroids) else []
            flat = np.array([r for _, r in points], dtype=np.float64).reshape(len(points), dim)
            fine = np.isfinite(flat).all(axis=1) if len(flat) else np.zeros(0, dtype=bool)
            near, far = _nearest(flat[fine], centroids) if fine.any() else (np.zeros(0, dtype=np.int64), np.zeros(0))
            at = pa.array(np.array([i for i, _ in points], dtype=np.int64)[fine])
            yield pa.RecordBatch.from_arrays([b.column("chunk_id").take(at), b.column("embedding").take(at), pa.array(near.astype(np.int32)), pa.array(far)], ["chunk_id", "embedding", "cluster", "from_centroid"])

    dealt = embeddings.select("chunk_id", "embedding").mapInArrow(run, "chunk_id long, embedding array<float>, cluster int, from_centroid double")
    members = store("members", dealt.repartitionByRange("cluster", "from_centroid").sortWithinPartitions("cluster", "from_centroid"))
    known = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(shared.value)], "cluster int, centroid array<double>")
    sizes_of = members.groupBy("cluster").agg(F.max("from_centroid").alias("radius"), F.count("*").alias("n"))
    return Clusters(members, store("centroids", known.join(sizes_of, "cluster")))


def nearest(clusters: Clusters, own: DataFrame | None, vector: list[float], k: int) -> Found:
    """The ``k`` nearest of the chunks in ``own`` (``chunk_id``; all where it is None), equal distances by chunk; at most k rows of a round reach the driver."""
    spark = clusters.members.sparkSession
    centres = clusters.centroids.collect()  # MOST_CENTROIDS at most
    query = np.array(vector, dtype=np.float64)
    gap = {r["cluster"]: float(np.sqrt(((np.array(r["centroid"]) - query) ** 2).sum())) for r in centres if len(r["centroid"]) == len(query)}
    least = {r["cluster"]: max(0.0, gap[r["cluster"]] - r["radius"]) for r in centres if r["cluster"] in gap}
    size = {r["cluster"]: r["n"] for r in centres}
    have: list = []
    read = 0

    def scored(rows: DataFrame) -> tuple[list, int]:
        if own is not None:
            rows = rows.join(own.select("chunk_id"), "chunk_id", "left_semi")
        far = rows.select("chunk_id", vectors.l2(F.col("embedding"), vectors.literal(vector)).alias("distance")).cache()
        try:
            return [tuple(r) for r in far.orderBy("distance", "chunk_id").limit(k).collect()], far.count()
        finally:
            far.unpersist()

    left, want = sorted(gap, key=lambda c: (gap[c], c)), 4 * k
    while left:
        if len(have) == k:
            worst = have[-1][1] * (1 + SLACK) + SLACK
            rest = [c for c in left if least[c] <= worst]
            if rest:
                far = F.create_map(*[F.lit(x) for c in rest for x in (c, gap[c])])[F.col("cluster")]
                rows, n = scored(clusters.members.where(F.col("cluster").isin(rest) & (F.abs(far - F.col("from_centroid")) <= worst)))
                have, read = sorted(have + rows, key=lambda r: (r[1], r[0]))[:k], read + n
            break
        now, held = [], 0
        while left and held < want:
            held += size[left[0]]
            now.append(left.pop(0))
        rows, n = scored(clusters.members.where(F.col("cluster").isin(now)))
        have, read, want = sorted(have + rows, key=lambda r: (r[1], r[0]))[:k], read + n, want * 8
    return Found(spark.createDataFrame(have, "chunk_id long, distance double"), sum(size.values()), read)
