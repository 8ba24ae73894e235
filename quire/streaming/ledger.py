"""The failure ledger as the state of a stream.

Events say that a unit (a file's stage) failed or was done. A unit's entry is made of the failures since it was last
done, by the events' own times and each event once, so neither replayed nor reordered events change it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.curation import FAILURE_CAP

EVENTS = "event_id long, file_hash string, stage string, outcome string, error string, at timestamp"
ENTRY = "file_hash string, stage string, attempts int, error string, last_attempt timestamp, capped boolean"
_STATE = "done timestamp, ids array<long>, times array<timestamp>, errors array<string>"


def entries(events: DataFrame, cap: int = FAILURE_CAP) -> DataFrame:
    """The ledger of a table of events: units with failures after their last success. Events are told apart by ``event_id``; of equal times the larger id is the later."""
    own = events.dropDuplicates(["event_id"]).where("file_hash is not null and stage is not null and at is not null")
    done = own.where("outcome = 'done'").groupBy("file_hash", "stage").agg(F.max("at").alias("done"))
    open_ = own.where("outcome = 'failed'").join(done, ["file_hash", "stage"], "left").where("done is null or at > done")
    counted = open_.groupBy("file_hash", "stage").agg(F.count("*").cast("int").alias("attempts"), F.max_by("error", F.struct("at", "event_id")).alias("error"), F.max("at").alias("last_attempt"))
    return counted.withColumn("capped", F.col("attempts") >= cap)


def _unit(cap: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, failures = None, {}
        if state.exists:
            done, ids, times, errors = state.get
            failures = {i: (t, e) for i, t, e in zip(ids, times, errors)}
            done = None if done is None or pd.isna(done) else done
        for pdf in batches:
            for i, outcome, error, at in zip(pdf["event_id"], pdf["outcome"], pdf["error"], pdf["at"]):
                if pd.isna(at):
                    continue
                if outcome == "done":
                    done = at if done is None or at > done else done
                elif outcome == "failed":
                    failures[int(i)] = (at, None if pd.isna(error) else error)
        failures = {i: f for i, f in failures.items() if done is None or f[0] > done}  # what was before the last success counts no more
        state.update((done, [*failures], [f[0].to_pydatetime() if hasattr(f[0], "to_pydatetime") else f[0] for f in failures.values()], [f[1] for f in failures.values()]))
        last = max(failures.items(), key=lambda f: (f[1][0], f[0]), default=None)
        yield pd.DataFrame({"file_hash": [key[0]], "stage": [key[1]], "attempts": [len(failures)], "error": [last and last[1][1]], "last_attempt": [last and last[1][0]], "capped": [len(failures) >= cap]})

    return run


def changes(events: DataFrame, cap: int = FAILURE_CAP) -> DataFrame:
    """A stream of entries as they change, ENTRY's columns; one of no attempts says that the unit is done.

    The state of a unit are its failures since it was last done, as many as attempts.
    """
    own = events.where("file_hash is not null and stage is not null")
    return own.groupBy("file_hash", "stage").applyInPandasWithState(_unit(cap), ENTRY, _STATE, "update", GroupStateTimeout.NoTimeout)


def kept(events: DataFrame, target: str, checkpoint: str, cap: int = FAILURE_CAP):
    """Take in what is new in a stream of events and stop. Each batch's entries go to a folder of their own, replaced if the batch is replayed; ``current`` reads what holds."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return changes(events, cap).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(batches: DataFrame) -> DataFrame:
    """The ledger that the batches of ``kept`` add up to: each unit's last entry, if it has attempts."""
    last = batches.groupBy("file_hash", "stage").agg(F.max_by(F.struct("attempts", "error", "last_attempt", "capped"), "batch").alias("e"))
    return last.select("file_hash", "stage", "e.*").where("attempts > 0")
