"""Shared helpers: tables in the shared folder, Arrow text access, hashed words, joins with hot keys and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import shared_folder

#: Rows of Arrow batches are regrouped so that one numpy pass sees about so many characters.
PASS_CHARS = 1 << 19


#: Paths of the tables written since the innermost ``scratch`` began.
_written: list[list[str]] = [[]]


def new_path(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder, which the ``scratch`` around it deletes."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _written[-1].append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, whatever executors are lost."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, keep: int = 0):
    """Tables stored inside are deleted at the end, but for the last ``keep``, which the surroundings own.

    Only for steps whose result has been stored or fetched by then: lazy results read their tables later.
    """
    _written.append([])
    try:
        yield
    finally:
        own = _written.pop()
        cut = len(own) - keep
        _written[-1].extend(own[cut:])
        forget(spark, own[:cut])


#: Bytes of an Arrow batch that goes to a worker, in place of Spark's default of 64 MB; a session that sets another limit keeps it.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with small batches, whose memory is given back when a partition is done.

    By default a batch holds up to 10,000 texts, in the executor and again in the worker. The limit is a setting of the session.
    """
    spark = df.sparkSession
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))

    def released(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(released, schema)


def _release() -> None:
    """Give memory that this worker holds but does not use back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_passes(batch: pa.RecordBatch, column: str, limit: int = PASS_CHARS):
    """Yield ``(first_row, texts)`` runs of a batch of about ``limit`` bytes each; null texts read as ''."""
    col = batch.column(column)
    if len(col) == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    cuts = np.cumsum(sizes) // limit
    starts = np.concatenate([[0], np.flatnonzero(np.diff(cuts)) + 1, [len(col)]])
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        yield a, ["" if x is None else x for x in col.slice(a, b - a).to_pylist()]


#: A key with more than this share of the rows of a join is hot; there are fewer than 1 / HOT_SHARE such keys.
HOT_SHARE = 0.001
#: Rows of a key below which it is not hot in any table.
HOT_ROWS = 1000


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``many`` with ``one`` (a row for each key; ``n``: that key's rows in ``many``, of ``total`` in all).

    Rows of hot keys stay where they are: as each has more than HOT_SHARE of the rows, fewer than
    1 / HOT_SHARE rows of ``one`` are broadcast. All other keys meet by a shuffle.
    """
    limit = max(HOT_ROWS, int(total * HOT_SHARE))
    hot = F.broadcast(one.where(F.col(n) > limit).drop(n))
    rest = one.where(F.col(n) <= limit).drop(n)
    return many.join(hot, keys).unionByName(many.join(hot.select(*keys), keys, "left_anti").join(rest, keys))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list by alternating large-star and small-star rounds.

    Returns ``(node, component)`` for each node on an edge; ``component`` is the
    smallest node reachable. Null ends and self-loops are dropped. Each round is two
    groupBy-min aggregations and joins (no neighbour list is ever collected; hubs are joined
    where they are), and its edges are stored, so an executor lost mid-way costs one round at most.
    The driver sees only two sums per round.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return df.where(F.col("u") > F.col("v")).distinct()

    def star(df: DataFrame, large: bool, rows: int) -> DataFrame:
        both = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else df
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        if large:
            least = least.withColumn("m", F.least("u", "m"))
        linked = spread_join(both, least, ["u"], "n", 2 * rows if large else rows)
        if large:
            out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return tidy(out)

    def mark_of(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    ends = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
    now = stored(tidy(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("x is not null and y is not null")))
    mark = mark_of(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        now = stored(star(star(now, True, mark[0]), False, mark[0]))
        before, mark = mark, mark_of(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


#: Rows of an id table up to which it is broadcast (8 MB of longs); larger ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def small(df: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted here, are few; else as it is."""
    return F.broadcast(df) if df.count() <= limit else df


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``ids`` (one column of that name); null keys stay."""
    return df.join(small(ids), key, "left_anti")


#: Bytes that part words.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_WORD_MULT = 0x9E3779B97F4A7C15


#: Bytes that are hashed at once; longer words are hashed in such blocks.
HASH_BLOCK = 1 << 19
_word_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """The first n (at most HASH_BLOCK) powers of an odd multiplier and of its inverse modulo 2**64."""
    if not _word_powers:
        for base in (_WORD_MULT, pow(_WORD_MULT, -1, 1 << 64)):
            table = np.full(HASH_BLOCK, base, dtype=np.uint64)
            table[0] = 1
            _word_powers.append(np.multiply.accumulate(table))
    return [p[:n] for p in _word_powers]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of many byte strings, as flat arrays.

    ``data`` holds all strings with a line feed after each; ``start``/``end`` are the
    words' places in it and ``of`` the string each belongs to. ``first[i]`` is the index
    of string i's first word (``first[-1]`` the number of words).
    """

    def __init__(self, strings: list[bytes]):
        self.data = b"\n".join(strings) + b"\n"
        self.bytes = np.frombuffer(self.data, dtype=np.uint8)
        sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings)) + 1
        space = SPACES[self.bytes]
        before = np.empty(len(space), dtype=bool)
        before[0], before[1:] = True, space[:-1]
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(space & ~before)
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.start, self.offset)
        self.of = np.repeat(np.arange(len(strings)), np.diff(self.first))

    @classmethod
    def at(cls, data: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray, first: np.ndarray) -> Words:
        """Words whose places in ``data`` are known."""
        self = cls.__new__(cls)
        self.bytes, self.start, self.end, self.of, self.first = data, start, end, of, first
        return self

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, equal for equal words in any batch; temporary arrays span HASH_BLOCK bytes."""
        out = np.empty(len(self.start), dtype=np.uint64)
        size = self.end - self.start
        i = 0
        while i < len(out):
            low = int(self.start[i])
            j = int(np.searchsorted(self.end, low + HASH_BLOCK, side="right"))
            if j > i:
                high = int(self.end[j - 1])
                out[i:j] = self._sums(low, high, self.start[i:j] - low, self.end[i:j] - low)
            else:  # a word longer than a block: its blocks' sums, each moved to its place
                j, high, moved, total = i + 1, int(self.end[i]), 1, 0
                for at in range(low, high, HASH_BLOCK):
                    stop = min(at + HASH_BLOCK, high)
                    total += int(self._sums(at, stop, np.array([0]), np.array([stop - at]))[0]) * moved
                    moved = moved * pow(_WORD_MULT, HASH_BLOCK, 1 << 64) % (1 << 64)
                out[i] = total % (1 << 64)
            i = j
        return mixed(out ^ size.astype(np.uint64) << np.uint64(56))

    def _sums(self, low: int, high: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Polynomials of the words ``start:end`` of the bytes from ``low`` to ``high``, from one running sum."""
        up, down = powers(high - low)
        run = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum((self.bytes[low:high].astype(np.uint64) + np.uint64(1)) * up, out=run[1:])
        return (run[end] - run[start]) * down[start]
