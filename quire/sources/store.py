"""A corpus on disk that changes by commits.

A commit writes only what it changes: rows that come (a segment of each table), keys of rows that go
(tombstones), and postings of the new chunks. Then its mark, a small file that names the
segments and tombstones of every table, is renamed into place; without its mark a commit
does not exist, so one that fails at any step leaves the version before it as it was. A row is alive
unless a later commit's tombstone has its key. Statistics of the index are sums in the mark, to which a commit adds
what comes and from which it takes what goes. ``compact`` rewrites young, small segments as one, and drops the
rows that are dead; ``vacuum`` deletes what no kept version names.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.functions import text as tx
from quire.operators import fts, grams
from quire.sources.corpus import SCHEMA_VERSION, SCHEMAS, Corpus

#: What tells a table's rows apart.
KEYS = {
    "documents": ["document_id"], "summaries": ["summary_id"], "sessions": ["session_id"], "findings": ["finding_id"], "images": ["image_id"],
    "document_images": ["document_id", "image_id"], "chunks": ["chunk_id"], "embeddings": ["chunk_id"], "finding_citations": ["finding_id", "chunk_id"],
    "audit_logs": ["audit_log_id"], "tags": ["tag_id"], "document_tags": ["document_id", "tag_id"], "failed_ingests": ["file_hash", "stage"],
}
#: Tables derived from chunks, whose rows go with their chunk.
DERIVED: tuple[str, ...] = ("postings", "grams")
#: How the rows of a segment are sorted, so that readers can pass over row groups.
ORDER = {"chunks": ["chunk_id"], "embeddings": ["chunk_id"], "document_tags": ["tag_id", "document_id"]}
#: Tombstones of a table up to which they are broadcast; more of them are joined by a shuffle.
BROADCAST_GONE = 1_000_000
#: Keys up to which they are looked up by a filter that reaches the scan.
FILTERED_KEYS = 1000
#: A segment is merged with the younger ones if it has at most so many times their rows.
RATIO = 2.0
#: Chunks of a commit up to which each of its indexes is one file.
FEW_CHUNKS = 2000
#: Tables that a commit writes at a time.
WRITERS = 8
_AT = "__commit"


@dataclass(frozen=True)
class Change:
    """What a commit does: ``removed`` holds keys (KEYS of that table), ``added`` rows. Keys go before rows come, so a row is replaced by naming it in both."""

    added: dict[str, DataFrame] = field(default_factory=dict)
    removed: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def between(cls, before: Corpus, after: Corpus, *names: str) -> Change:
        """What makes the named tables of one corpus those of another. Both are read; what is written are the rows that differ."""
        added, removed = {}, {}
        for name in names:
            old, new = getattr(before, name), getattr(after, name)
            kinds = old.sparkSession.createDataFrame([], SCHEMAS[name]).dtypes
            old, new = (df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds]) for df in (old, new))
            added[name], removed[name] = new.exceptAll(old), old.exceptAll(new).select(KEYS[name])
        return cls(added, removed)

    def applied(self, corpus: Corpus) -> Corpus:
        """The corpus that follows, as a plan only."""
        tables = {}
        for name in {*self.added, *self.removed}:
            table = getattr(corpus, name)
            if name in self.removed:
                table = table.join(self.removed[name].select(KEYS[name]), KEYS[name], "left_anti").select(table.columns)
            if name in self.added:
                rows = self.added[name]
                table = table.unionByName(rows.select(*[c for c in rows.columns if c in table.columns]), allowMissingColumns=True)
            tables[name] = table
        return corpus.with_tables(**tables)


def bearing(gone: list[dict], parts: list[dict]) -> list[dict]:
    """The tombstones that may still take rows out of some segments."""
    return [g for g in gone if any(g["commit"] > max(p["oldest"], p["applied"]) for p in parts)]


class Files:
    """The few file operations that a mark needs, on whatever store the folder is in."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(folder).getFileSystem(self._conf)

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Write a file whole or not at all; False if there is one of that name."""
        draft = self._path(f"{path}.{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(kind.NONE.getClass(), 1)
        options[0] = kind.NONE  # refuses a name that is taken
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._path(path)), options)
        except Exception as wrong:
            if self._fs.exists(self._path(path)):
                self._fs.delete(draft, False)
                return False
            raise wrong
        return True

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


class Store:
    """The versions of a stored corpus in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark, folder)

    # ---- marks

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.folder}/commits") if n.endswith(".json")]

    def mark(self, version: int | None = None) -> dict:
        """The mark of a version, the last one by default."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise EngineError("NO_ACTIVE_PROJECT", f"{self.folder} holds no corpus" if not known else f"no version {version}")
        found = json.loads(self.files.read(f"{self.folder}/commits/{version or known[-1]:012d}.json"))
        if found["schema_version"] != SCHEMA_VERSION:
            raise EngineError("SCHEMA_MISMATCH", f"corpus has schema {found['schema_version']}, this code {SCHEMA_VERSION}")
        return found

    def _publish(self, mark: dict) -> int:
        if not self.files.publish(f"{self.folder}/commits/{mark['version']:012d}.json", json.dumps(mark, sort_keys=True)):
            raise EngineError("COMMIT_CONFLICT", f"version {mark['version']} has been committed by another")
        return mark["version"]

    # ---- reading

    def _schema(self, name: str) -> str:
        return {"postings": fts.POSTING_SCHEMA, "grams": grams.SCHEMA}.get(name) or SCHEMAS[name]

    def _read(self, name: str, parts: list[dict], schema: str) -> DataFrame:
        schema = f"{schema}, {_AT} long"
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p['path']}" for p in parts]) if parts else self.spark.createDataFrame([], schema)

    def _alive(self, mark: dict, name: str, parts: list[dict] | None = None) -> DataFrame:
        """Rows of a table (or of some of its segments) that no later tombstone names, with the commit they came by."""
        of = "chunks" if name in DERIVED else name
        keys = KEYS[of]
        parts = mark["tables"][name] if parts is None else parts
        rows = self._read(name, parts, self._schema(name))
        gone = bearing(mark["gone"].get(of, []), parts)
        if not gone:
            return rows
        kinds = dict(self.spark.createDataFrame([], self._schema(of)).dtypes)
        dead = self._read(of, gone, ", ".join(f"{k} {kinds[k]}" for k in keys)).groupBy(*keys).agg(F.max(_AT).alias("__until"))
        if sum(g["rows"] for g in gone) <= BROADCAST_GONE:
            dead = F.broadcast(dead)
        on = [rows[k] == dead[k] for k in keys]
        return rows.join(dead, [*on, rows[_AT] < dead["__until"]], "left_anti")

    def corpus(self, version: int | None = None) -> Corpus:
        """The corpus of a version, with the index that its commits have written."""
        mark = self.mark(version)
        tables = {n: self._alive(mark, n).drop(_AT) for n in KEYS}
        stats = self.spark.createDataFrame([(mark["stats"]["n_all"], mark["stats"]["len_all"])], "n_all long, len_all long")
        return Corpus(**tables, index_stats=stats, **{n: self._alive(mark, n).drop(_AT) for n in DERIVED if n in mark["tables"]})

    # ---- writing

    def create(self, corpus: Corpus | None = None, derived: tuple[str, ...] = DERIVED) -> int:
        """Version 1: the tables of a corpus, or empty ones; ``derived`` are the indexes that this and later commits keep."""
        if self.versions():
            raise EngineError("PROJECT_EXISTS", f"{self.folder} holds a corpus")
        added = {n: getattr(corpus, n) for n in KEYS} if corpus is not None else {}
        blank = {"version": 0, "schema_version": SCHEMA_VERSION, "tables": {n: [] for n in (*KEYS, *derived)}, "gone": {}, "stats": {"n_all": 0, "len_all": 0}}
        return self._commit(blank, Change(added), tuple(getattr(corpus, n) if corpus is not None and n in derived else None for n in DERIVED))

    def commit(self, change: Change) -> int:
        """The next version; refused if another writer has committed it meanwhile."""
        return self._commit(self.mark(), change, (None, None))

    def _commit(self, mark: dict, change: Change, made: tuple[DataFrame | None, DataFrame | None]) -> int:
        number = mark["version"] + 1
        tables, gone, stats = dict(mark["tables"]), dict(mark["gone"]), dict(mark["stats"])
        with ThreadPoolExecutor(WRITERS) as pool:  # tables do not wait for each other
            going = {n: pool.submit(self._write_gone, n, keys.select(KEYS[n]).distinct(), number) for n, keys in change.removed.items()}
            coming = {n: pool.submit(self._write, n, self._whole(n, rows).withColumn(_AT, F.lit(number).cast("long")), number, number) for n, rows in change.added.items()}
        for name, part in ((n, f.result()) for n, f in going.items()):
            if not part["rows"]:
                continue
            if name == "chunks":
                n, size = self._lost(mark, part)
                stats = {"n_all": stats["n_all"] - n, "len_all": stats["len_all"] - size}
            gone[name] = [*gone.get(name, []), part]
        for name, part in ((n, f.result()) for n, f in coming.items()):
            if not part["rows"]:
                continue
            tables[name] = [*tables[name], part]
            if name == "chunks":
                chunks = self._read(name, [part], self._schema(name))  # as written: what comes is tokenised once, from here
                few = part["rows"] <= FEW_CHUNKS
                indexes = [(i, derive(chunks if few else fts.dealt(chunks, most)) if table is None else table, table is None) for i, table, derive, most in zip(DERIVED, made, (fts.postings, grams.postings), (fts.PART_CHUNKS, grams.PART_CHUNKS)) if i in tables]
                with ThreadPoolExecutor(WRITERS) as pool:
                    write = lambda index: self._write(index[0], index[1].withColumn(_AT, F.lit(number).cast("long")), number, number, 0, few, index[2])  # noqa: E731, B023
                    for (index, *_), held in zip(indexes, pool.map(write, indexes)):
                        tables[index] = [*tables[index], held] if held["rows"] else tables[index]
                        if index == "postings":
                            stats = {"n_all": stats["n_all"] + part["rows"], "len_all": stats["len_all"] + held["rows"]}
        return self._publish(mark | {"version": number, "tables": tables, "gone": gone, "stats": stats})

    def _whole(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows with exactly the table's columns; those that they lack are null."""
        kinds = self.spark.createDataFrame([], self._schema(name)).dtypes
        return rows.select(*[F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in kinds])

    def _write(self, name: str, rows: DataFrame, number: int, oldest: int, applied: int = 0, few: bool = False, dealt: bool = False) -> dict:
        path = f"data/{name}/{number:012d}-{uuid.uuid4().hex}"
        if name in DERIVED:
            rows = {"postings": fts.in_order, "grams": grams.in_order}[name](rows, few, dealt)
        elif name in ORDER:
            rows = rows.sortWithinPartitions(*ORDER[name])
        rows.write.parquet(f"{self.folder}/{path}")
        return {"path": path, "oldest": oldest, "applied": applied, "rows": self._read(name, [{"path": path}], self._schema(name)).count()}

    def _write_gone(self, name: str, keys: DataFrame, number: int) -> dict:
        path = f"data/{name}/gone-{number:012d}-{uuid.uuid4().hex}"
        keys.withColumn(_AT, F.lit(number).cast("long")).write.parquet(f"{self.folder}/{path}")
        return {"path": path, "commit": number, "rows": self.spark.read.parquet(f"{self.folder}/{path}").count()}

    def _lost(self, mark: dict, part: dict) -> tuple[int, int]:
        """Number and tokens of the chunks that tombstones take away: only those chunks are read as texts."""
        keys = self._read("chunks", [part], "chunk_id long").select("chunk_id")
        rows = self._alive(mark, "chunks")
        if part["rows"] <= FILTERED_KEYS:
            rows = rows.where(F.col("chunk_id").isin([r[0] for r in keys.collect()]))
        else:
            rows = rows.join(keys, "chunk_id", "left_semi")
        size = F.size(tx.tokens(F.col("text"))) + F.size(tx.tokens(F.col("section_heading")))
        lost = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
        return lost["n"], lost["size"]

    # ---- upkeep

    def compact(self, ratio: float = RATIO) -> int:
        """The next version, with the same rows: in each table the young segments that are small beside the still younger ones become one.

        Merged segments lose their dead rows, and rows keep the commit they came by. Tombstones that no segment needs any more go too.
        Nothing is tokenised.
        """
        mark = self.mark()
        number = mark["version"] + 1
        tables, gone = dict(mark["tables"]), dict(mark["gone"])
        for name, parts in mark["tables"].items():
            cut, younger = len(parts) - 1, parts[-1]["rows"] if parts else 0
            while cut > 0 and parts[cut - 1]["rows"] <= ratio * younger:
                cut -= 1
                younger += parts[cut]["rows"]
            dead = bearing(gone.get("chunks" if name in DERIVED else name, []), parts[cut:])
            if len(parts) - cut > 1 or dead and not cut:
                whole = self._write(name, self._alive(mark, name, parts[cut:]), number, min(p["oldest"] for p in parts[cut:]), mark["version"])
                tables[name] = [*parts[:cut], *([whole] if whole["rows"] else [])]
        for of in list(gone):
            held = [p for n in (of, *(DERIVED if of == "chunks" else ())) for p in tables.get(n, [])]
            if not (left := bearing(gone.pop(of), held)):
                continue
            gone[of] = left
        return self._publish(mark | {"version": number, "tables": tables, "gone": gone})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete older marks than the last ``keep`` ones, and data that none of those names; the deleted paths.

        Data of a commit under way is named by no mark yet, so this is not for a folder that is being written to.
        """
        kept = self.versions()[-keep:]
        named = {p["path"] for v in kept for m in [self.mark(v)] for kind in ("tables", "gone") for parts in m[kind].values() for p in parts}
        out = [f"commits/{n}" for n in self.files.names(f"{self.folder}/commits") if not n.endswith(".json") or int(n[:-5]) not in kept]
        for name in self.files.names(f"{self.folder}/data"):
            out += [p for d in self.files.names(f"{self.folder}/data/{name}") if (p := f"data/{name}/{d}") not in named]
        for p in out:
            self.files.delete(f"{self.folder}/{p}")
        return out
