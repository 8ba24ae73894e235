"""Leaderboard analytics over append-only run and judgment stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.functions import text as tx

RUN_SCHEMA = "provider string, model string, doc string, extraction string, ok boolean, wall_seconds double, load_duration_ns long, prompt_eval_count long, summary_sha string, source_sha string, prompt_sha string, temperature double, max_tokens int, ts timestamp"
JUDGMENT_SCHEMA = "provider string, model string, doc string, extraction string, judge string, summary_sha string, mean double, ok boolean, ts timestamp"
CELL = ["provider", "model", "doc", "extraction"]
LOCAL = ["ollama"]


def read_store(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All JSON lines of a store; lines that are no JSON are left out."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(folder)
    return df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def append_store(df: DataFrame, folder: str) -> None:
    """Rows as JSON lines of a store, with the time of writing where a row has none."""
    stamp = F.coalesce("ts", F.current_timestamp()) if "ts" in df.columns else F.current_timestamp()
    df.withColumn("ts", stamp).write.mode("append").json(folder)


#: The axes of the rubric.
AXES = ["faithfulness", "coverage", "conciseness", "constraint_compliance"]


def rubric_mean(scores: DataFrame, axes: list[str] | None = None) -> DataFrame:
    """``scores`` with ``mean`` over the axes; null if one is missing."""
    axes = axes or AXES
    return scores.withColumn("mean", sum((F.col(a) for a in axes[1:]), F.col(axes[0])).cast("double") / len(axes))


def with_run_index(plan: DataFrame, runs: DataFrame, order: str = "call") -> DataFrame:
    """Planned calls with ``run_index``, which goes on in each cell from the runs it already has."""
    have = runs.groupBy(*CELL).agg(F.count("*").alias("have"))
    nth = F.row_number().over(W.partitionBy(*CELL).orderBy(order)) - 1
    return plan.withColumn("nth", nth).join(have, CELL, "left").withColumn("run_index", (F.col("nth") + F.coalesce("have", F.lit(0))).cast("int")).drop("nth", "have")


def source_drift(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Cells whose valid runs read another text than the one at hand (``sources``: doc, extraction, source_sha), or one that is gone."""
    now = sources.select("doc", "extraction", F.col("source_sha").alias("now_sha"))
    return runs.where("ok").join(now, ["doc", "extraction"], "left").where(~F.col("source_sha").eqNullSafe(F.col("now_sha"))).select(*CELL, "source_sha", "now_sha").distinct()


def window(df: DataFrame, since: str | None = None, until: str | None = None, **equal) -> DataFrame:
    """Rows with since <= ts < until (a bare date as ``until`` means its end) and equal fields."""
    if since:
        df = df.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until:
        end = F.date_add(F.lit(until).cast("date"), 1).cast("timestamp") if tx.is_date(until) else F.lit(until).cast("timestamp")
        df = df.where(F.col("ts") < end)
    for k, v in equal.items():
        df = df.where(F.col(k) == v)
    return df


def quality_cells(runs: DataFrame, judgments: DataFrame) -> DataFrame:
    """Quality of each cell: passes average per summary first, then summaries weigh by their runs."""
    key = [*CELL, "summary_sha"]
    n_runs = runs.where("ok").groupBy(*key).agg(F.count("*").alias("runs"))
    per = judgments.groupBy(*key).agg(F.avg("mean").alias("mean"), F.count("*").alias("passes"))
    return n_runs.join(per, key).groupBy(*CELL).agg((F.sum(F.col("mean") * F.col("runs")) / F.sum("runs")).alias("quality"), F.sum("runs").alias("runs"), F.sum("passes").alias("passes"))


def quality_by_model(cells: DataFrame) -> DataFrame:
    return cells.groupBy("provider", "model").agg(F.avg("quality").alias("quality"), F.count("*").alias("cells"))


def input_tps(runs: DataFrame) -> DataFrame:
    """Input tokens a second: the median of each document's runs, then the mean over documents."""
    secs = F.col("wall_seconds") - F.coalesce("load_duration_ns", F.lit(0)) / 1e9
    per = runs.where("ok").withColumn("secs", secs).where("secs > 0").groupBy("provider", "model", "doc").agg(F.median(F.col("prompt_eval_count") / F.col("secs")).alias("tps"))
    return per.groupBy("provider", "model").agg(F.avg("tps").alias("input_tps"))


def schema_gate(runs: DataFrame, least: float = 100.0) -> DataFrame:
    """Share of runs with valid output, and whether a model is out: below ``least`` per cent, or nothing valid at all."""
    out = runs.groupBy("provider", "model").agg((F.avg(F.col("ok").cast("int")) * 100).alias("schema_pct"), F.count_if("ok").alias("n_ok"))
    return out.withColumn("disqualified", (F.col("schema_pct") < least) | (F.col("n_ok") == 0)).drop("n_ok")


def leaderboard(runs: DataFrame, judgments: DataFrame, least: float = 100.0) -> DataFrame:
    """Models with quality, speed and gate; best quality first, then faster."""
    gate = schema_gate(runs, least)
    quality = quality_by_model(quality_cells(runs, judgments))
    out = gate.join(quality, ["provider", "model"], "left").join(input_tps(runs), ["provider", "model"], "left")
    shown = lambda c: F.when(~F.col("disqualified"), F.col(c)).alias(c)
    return out.select("provider", "model", shown("quality"), shown("input_tps"), "schema_pct", "disqualified").orderBy(F.desc_nulls_last("quality"), F.desc_nulls_last("input_tps"), "model")


def pareto_frontier(board: DataFrame) -> DataFrame:
    """Local models that no other local one beats at one axis while matching it at the other; equal ones both stay.

    A model stays if it is the fastest of its quality and faster than all of better quality: one aggregation and a running
    maximum over the distinct qualities, of which there are fewer than models.
    """
    local = board.where(F.col("provider").isin(LOCAL) & F.col("quality").isNotNull() & F.col("input_tps").isNotNull()).select("provider", "model", "quality", "input_tps")
    best = local.groupBy("quality").agg(F.max("input_tps").alias("top"))
    best = best.withColumn("above", F.max("top").over(W.orderBy(F.desc("quality")).rowsBetween(W.unboundedPreceding, -1)))
    stays = (F.col("input_tps") == F.col("top")) & (F.col("above").isNull() | (F.col("above") < F.col("input_tps")))
    return local.join(best, "quality").where(stays).select("provider", "model", "quality", "input_tps")


def regime_mix(runs: DataFrame, fields: tuple[str, ...] = ("source_sha", "prompt_sha", "temperature", "max_tokens")) -> DataFrame:
    """Cells whose runs differ in a condition: ``(cell, field, n)``."""
    have = [f for f in fields if f in runs.columns]
    per = runs.groupBy(*CELL).agg(*[F.countDistinct(f).alias(f) for f in have])
    return per.unpivot(CELL, have, "field", "n").where("n > 1")


def quality_pivot(cells: DataFrame, docs: list[str]) -> DataFrame:
    """Model by document, each with its runs and passes."""
    text = F.format_string("%.2f (%dr/%dp)", "quality", "runs", "passes")
    return cells.groupBy("provider", "model", "extraction").pivot("doc", docs).agg(F.first(text))


def judge_topup(runs: DataFrame, judgments: DataFrame, passes: int, judge: str, sources: DataFrame | None = None) -> DataFrame:
    """Summaries that lack valid passes of a judge, and how many; refused if ``sources`` are not the texts that were summarised."""
    if sources is not None and (moved := source_drift(runs, sources).first()):
        raise EngineError("SOURCE_DRIFT", f"document {moved['doc']} is not the text that was summarised", doc=moved["doc"], extraction=moved["extraction"])
    key = [*CELL, "summary_sha"]
    valid = judgments.where(F.coalesce("ok", F.lit(True))) if "ok" in judgments.columns else judgments
    have = valid.where(F.col("judge") == judge).groupBy(*key).agg(F.count("*").alias("have"))
    need = F.greatest(F.lit(passes) - F.coalesce("have", F.lit(0)), F.lit(0))
    return runs.where("ok").select(*key).distinct().join(have, key, "left").select(*key, need.alias("missing")).where("missing > 0")


def write_csv(board: DataFrame, folder: str) -> None:
    board.coalesce(1).write.option("header", True).csv(folder)
