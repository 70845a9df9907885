"""Readers of recording folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import tag_values


def seconds_of_day(ts: str) -> Column:
    clock = F.split(F.regexp_extract(ts, r"T([0-9:.]+)", 1), ":")
    return clock[0].cast("double") * 3600 + clock[1].cast("double") * 60 + clock[2].cast("double")


def read_tracking(spark: SparkSession, path: str) -> DataFrame:
    """Tracking CSV of six fields without header (a seventh, empty one is left out); t: seconds since a file's first row, no matter which is the earliest."""
    schema = "ts string, x_left double, y_left double, x_right double, y_right double, sync_led double, extra string"
    df = spark.read.schema(schema).option("sep", " ").csv(path).drop("extra")
    df = df.withColumns({"file": F.col("_metadata.file_path"), "row_no": F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()), "t": seconds_of_day("ts")})
    w = Window.partitionBy("file").orderBy("row_no")
    return df.withColumns({"t": F.col("t") - F.first("t").over(w), "row_no": F.row_number().over(w) - 1})


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session type, location and tags from parameter files."""
    df = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    line = F.split("value", r"\r?\n")
    df = df.select("file", F.trim(F.get(line, F.lit(0))).alias("session_type"), F.get(line, F.lit(1)).alias("location"), F.get(line, F.lit(2)).alias("tags"))
    return df.withColumns(tag_values("tags"))


def read_cluster_quality(spark: SparkSession, path: str) -> DataFrame:
    """One row per cluster of quality JSON files: file, cluster_id and the metrics."""
    df = spark.read.option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    return df.select("file", F.explode("clusters").alias("c")).select("file", F.col("c.label").alias("cluster_id"), "c.metrics.*")


def with_quality(clusters: DataFrame, quality: DataFrame, keys) -> DataFrame:
    """Clusters with their quality metrics by keys and cluster_id; null where there are none."""
    return clusters.join(quality.dropDuplicates([*keys, "cluster_id"]), [*keys, "cluster_id"], "left")


def write_sessions(df: DataFrame, path: str) -> None:
    """Parquet by session; only the sessions in df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def write_results(path: str, **tables: DataFrame) -> None:
    """A session's result tables (spatial_firing, position, noisy_clusters, lfp_data, processed_position and others), each in a folder of its name."""
    for name, df in tables.items():
        write_sessions(df, f"{path}/{name}")
