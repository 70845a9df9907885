"""Streaming forms: windowed spike counts, pulse sessions, and idempotent ingest of session files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, keys, window: str, late: str | None = None, ts="ts") -> DataFrame:
    """Tumbling counts per key. On a stream, late is the watermark; the same plan runs on a batch."""
    events = events.withWatermark(ts, late) if events.isStreaming and late else events
    out = events.groupBy(*keys, F.window(ts, window).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), "n")


def pulse_sessions(on: DataFrame, keys, gap: str, late: str | None = None, ts="ts") -> DataFrame:
    """Start, end and size of bursts of events no further apart than gap."""
    on = on.withWatermark(ts, late) if on.isStreaming and late else on
    out = on.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
    return out.drop("w")


def complete_sessions(spark: SparkSession, root: str, marker: str = "copied.txt") -> DataFrame:
    """(session_id): the folders under root that hold the marker which is copied last."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/{marker}")  # Spark's readers skip empty files, which markers are
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return spark.createDataFrame([(f.getPath().getParent().getName(),) for f in found], "session_id string")


def ingest(stream: DataFrame, path: str, quarantine: str, good, checkpoint: str):
    """Writes a file stream to Parquet by session_id and source_file, bad rows to quarantine by source_file.

    A batch replaces only the files it holds, so that a batch run again gives the same rows and a session whose files
    come in several batches keeps all of them.
    """
    named = stream.withColumn("source_file", F.col("_metadata.file_name"))

    def batch(df: DataFrame, _: int) -> None:
        put = lambda part, to, *by: part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(to)
        put(df.where(good), path, "session_id", "source_file")
        put(df.where(~F.coalesce(good, F.lit(False))), quarantine, "source_file")

    return named.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
