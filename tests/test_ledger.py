"""The failure ledger of a stream against that of a table, with replayed and reordered events."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quire.streaming import ledger


def brute(events, cap=3):
    units = {}
    for e in {e[0]: e for e in events}.values():
        units.setdefault(e[1:3], []).append(e)
    out = set()
    for unit, own in units.items():
        done = max((e[5] for e in own if e[3] == "done"), default=None)
        left = [e for e in own if e[3] == "failed" and (done is None or e[5] > done)]
        if left:
            last = max(left, key=lambda e: (e[5], e[0]))
            out.add((*unit, len(left), last[4], last[5], len(left) >= cap))
    return out


def test_a_stream_equals_the_table(spark, tmp_path):
    rng = random.Random(6)
    start = datetime(2024, 1, 1)
    events = [(i, f"f{rng.randrange(8)}", rng.choice(["parse", "summary"]), "done" if rng.random() < 0.25 else "failed", rng.choice([None, "boom", "slow"]), start + timedelta(minutes=rng.randrange(300))) for i in range(120)]
    shuffled = [*events, *rng.sample(events, 40)]
    rng.shuffle(shuffled)
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(ledger.EVENTS).parquet(folder)
    for a in range(0, len(shuffled), 55):
        spark.createDataFrame(shuffled[a : a + 55], ledger.EVENTS).coalesce(1).write.mode("append").parquet(folder)
        ledger.kept(stream(), target, str(tmp_path / "check")).awaitTermination()
        ledger.kept(stream(), target, str(tmp_path / "check")).awaitTermination()  # nothing new, nothing done
        now = {tuple(r) for r in ledger.current(spark.read.parquet(target)).collect()}
        assert now == brute(shuffled[: a + 55])
    table = ledger.entries(spark.createDataFrame(shuffled, ledger.EVENTS))
    assert {tuple(r) for r in table.collect()} == brute(events) == now
    assert ledger.entries(table.sparkSession.createDataFrame([], ledger.EVENTS)).agg(F.count("*")).first()[0] == 0
