"""Incremental ingest with Structured Streaming: new files since the last run, each content once, batches that can be replayed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions import text as tx


def new_documents(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, text: str = "text", key: str = "doc_id") -> StreamingQuery:
    """Take in what is new in a folder of Parquet files and stop: documents whose content is not in ``target`` yet.

    A batch writes to its own folder ``batch=N``, replaced if the batch is replayed, so a lost
    driver or executor never doubles a document. Hashes of what has been taken in lie beside the target, by
    their first byte; a batch reads only those parts that its own hashes fall into, never the documents.
    """
    hashes = f"{target.rstrip('/')}-hashes"
    part = F.concat(F.lit("h"), F.substring("file_hash", 1, 2))  # the letter keeps Spark from reading parts as numbers

    def write(batch: DataFrame, number: int) -> None:
        own = batch.withColumn("file_hash", F.sha2(F.col(text).cast("binary"), 256))
        first = own.groupBy("file_hash").agg(F.min_by(F.struct(*batch.columns), key).alias("d")).select("file_hash", "d.*")
        parts = [r[0] for r in own.select(part.alias("part")).distinct().collect()]  # 256 at most
        try:
            old = spark.read.parquet(hashes).where((F.col("batch") < number) & F.col("part").isin(parts)).select("file_hash")
            first = first.join(old, "file_hash", "left_anti")
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        first.write.mode("overwrite").parquet(f"{target}/batch={number}")
        taken = spark.read.schema(first.schema).parquet(f"{target}/batch={number}").select("file_hash", part.alias("part"))
        taken.write.mode("overwrite").partitionBy("part").parquet(f"{hashes}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunked(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Chunks of documents, as stream or table."""
    return documents.select(key, F.inline(tx.chunk_pieces(F.col(text))))


def hourly_counts(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Log rows by hour and tool; as a stream, hours close once the watermark has passed. An extension of the audit log."""
    timed = events.withWatermark("ts", lateness) if events.isStreaming else events
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Runs of a user's events without a pause of ``gap``."""
    timed = events.withWatermark("ts", lateness) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n")
