"""Filings read by byte ranges: a submission of any size is searched and read by many tasks, and never held whole.

A first pass finds the marks of inner documents in ranges of the files and keeps, of neighbouring marks of one kind, the
first; what the ranges mean for each other follows from one row for each range. A second pass reads each inner document by its own bytes.
"""

from __future__ import annotations

import math
import re
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.sources import files

#: Bytes of a range, and bytes that are searched at once.
RANGE, BLOCK = 128 << 20, 8 << 20
MARK = re.compile(rb"<(/?)DOCUMENT>")
_LONGEST = len(b"</DOCUMENT>")
_MARKS = pa.list_(pa.struct([("at", pa.int64()), ("opens", pa.bool_())]))


def opened(path: str):
    """A file of any store that Arrow knows, by the path that Spark gives it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    store, inner = fs.FileSystem.from_uri(quote(re.sub(r"^s3[an]:", "s3:", path), safe=":/@"))
    return store.open_input_file(inner)


def marks_within(file, start: int, end: int) -> list[tuple[int, bool]]:
    """Places of marks that begin in the range, and whether they open; of neighbours of one kind the first."""
    out: list[tuple[int, bool]] = []
    held, at = b"", start
    file.seek(start)
    left = end + _LONGEST - 1 - start  # a mark that begins in the range may end behind it
    while left > 0 and (block := file.read(min(BLOCK, left))):
        left -= len(block)
        data = held + block
        for m in MARK.finditer(data):
            place, opens = at + m.start(), not m[1]
            if place < end and (not out or (out[-1][1] != opens)):
                out.append((place, opens))
        tail = min(len(data), _LONGEST - 1)
        held, at = data[len(data) - tail :], at + len(data) - tail
    return out


def _spread(df: DataFrame, total: int, size: int) -> DataFrame:
    """Rows that stand for ``total`` bytes, dealt to a task for each ``size`` of them: the rows themselves say nothing of their cost."""
    return df.repartition(max(1, math.ceil(total / size)))


def document_ranges(listed: DataFrame, size: int = RANGE) -> DataFrame:
    """``(path, position, start, end)`` of what stands in each inner document of files ``(path, length)``.

    A document goes from a mark that opens, outside of any other document, to the next one that closes; without that it is none.
    Places are the same for any ``size`` of the ranges. The files are read once, in blocks; a range gives one row.
    """
    total = listed.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    ranges = listed.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("start"))

    def find(batches):
        for b in batches:
            for path, length, start in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), b.column("start").to_pylist()):
                with opened(path) as file:
                    found = marks_within(file, start, min(start + size, length))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start]), pa.array([found], type=_MARKS)], ["path", "start", "marks"])

    found = _spread(ranges, total, size).mapInArrow(find, "path string, start long, marks array<struct<at:long,opens:boolean>>").where(F.size("marks") > 0)
    w = Window.partitionBy("path").orderBy("start")
    # a first mark of the kind that the range before ended with changes nothing; at a file's start nothing is open
    before = F.coalesce(F.lag(F.element_at("marks", -1)["opens"]).over(w), F.lit(False))
    kept = found.withColumn("before", before).withColumn("marks", F.when(F.col("marks")[0]["opens"] == F.col("before"), F.slice("marks", 2, F.size("marks"))).otherwise(F.col("marks"))).where(F.size("marks") > 0)
    after = F.lead(F.col("marks")[0]["at"]).over(w)
    earlier = F.coalesce(F.sum(F.size(F.filter("marks", lambda m: m["opens"]))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = F.filter(F.transform("marks", lambda m, i: F.struct(m["at"].alias("at"), m["opens"].alias("opens"), F.coalesce(F.get("marks", i + 1)["at"], F.col("after")).alias("closes"))), lambda m: m["opens"] & m["closes"].isNotNull())
    out = kept.withColumn("after", after).withColumn("earlier", earlier).select("path", "earlier", F.posexplode(pairs).alias("i", "m"))
    return out.select("path", (F.col("earlier") + F.col("i")).cast("int").alias("position"), (F.col("m.at") + len("<DOCUMENT>")).alias("start"), F.col("m.closes").alias("end"))


def inner_documents(listed: DataFrame, size: int = RANGE) -> DataFrame:
    """``(path, position, doc_type, file_name, route, body)`` of filings ``(path, length)``, as ``files.split_envelope`` gives for their whole texts.

    No task holds more than one inner document at once (one of over 2 GB is beyond a row). Files listed twice are read once; an empty file or table gives
    no rows; other columns are not read.
    """
    places = document_ranges(listed.select("path", "length").dropDuplicates(["path"]), size)
    total = listed.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]

    def read(batches):
        for b in batches:
            for path, position, start, end in zip(*(b.column(c).to_pylist() for c in ("path", "position", "start", "end"))):
                with opened(path) as file:
                    file.seek(start)
                    block = file.read(end - start)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([position], type=pa.int32()), pa.array([block])], ["path", "position", "block"])

    blocks = _spread(places, total, size).mapInArrow(read, "path string, position int, block binary")
    return files.part_bodies(blocks.select("path", "position", files.read_text(F.col("block")).alias("block")), "path")


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, length)`` of all files below the paths; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length")


def listed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream of what is new in a folder, for ``foreachBatch`` of ``inner_documents``."""
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "length")
