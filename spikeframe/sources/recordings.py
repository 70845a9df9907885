"""Recordings as tables: channel signals, sorted spikes, events, tracking of other sources, curation results, and exports for modelling.

Binary files are read by ranges of records (sources/records.py), a row per record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .records import RECORD_SAMPLES, RecordSource

def _first_line(lines: DataFrame) -> DataFrame:
    """(file, first line) of text lines with their file."""
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"), "value")
    return lines.groupBy("file").agg(F.min_by("value", "at").alias("first"))


def tracking_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file) of the CSV files under folder whose first field is a time stamp: ten characters, then a T."""
    lines = spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).text(folder)
    stamp = F.split("first", " ")[0]
    return _first_line(lines).where(F.instr(stamp, "T") == 11).select("file")


def _records(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    spark.dataSource.register(RecordSource)
    return spark.read.format(RecordSource.name()).options(kind=kind, path=path, **options).load()


def read_continuous(spark: SparkSession, path: str, channels: list[int] | None = None, **options) -> DataFrame:
    """(file, channel, block_no, timestamp, recording, data array of microvolts) of channel files; channel: the number after CH in the name, or null.

    With channels, only their files are read. A file that isn't a header and whole records of 1024 samples raises an error.
    """
    if channels is not None:
        if not channels:
            return _records(spark, path, "continuous", **options).where("false")
        options["channels"] = ",".join(map(str, channels))
    return _records(spark, path, "continuous", **options)


def samples(blocks: DataFrame) -> DataFrame:
    """(file, channel, t, value): one row per sample of read_continuous, t from the file's first sample."""
    return blocks.select("file", "channel", "block_no", F.posexplode("data").alias("pos", "value")).select("file", "channel", (F.col("block_no") * RECORD_SAMPLES + F.col("pos")).alias("t"), "value")


def read_matrices(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, col, values array): the columns of matrix files (a code, the size of an entry, the dimensions, entries column by column)."""
    return _records(spark, path, "matrices", **options)


def sorted_spikes(matrices: DataFrame) -> DataFrame:
    """(file, spike_idx, primary_channel, t_sample, cluster_id) of three-row matrices of a spike sorter."""
    v = F.col("values")
    return matrices.select("file", F.col("col").alias("spike_idx"), v[0].cast("int").alias("primary_channel"), v[1].cast("long").alias("t_sample"), v[2].cast("int").alias("cluster_id"))


def cluster_frame(spikes: DataFrame, keys) -> DataFrame:
    """One row per cluster: its rising firing times and the primary channel of its first spike."""
    return spikes.groupBy(*keys, "cluster_id").agg(F.sort_array(F.collect_list("t_sample")).alias("firing_times"), F.min_by("primary_channel", "spike_idx").alias("primary_channel"))


def read_events(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, event_no, timestamp, sample, kind, node, event, channel, recording) of event files; every whole record, the last one too."""
    return _records(spark, path, "events", **options)


def live_channels(spark: SparkSession, path: str, channels: int = 16, per_tetrode: int = 4) -> DataFrame:
    """(file, channel, tetrode) of all channels but those in the file's list of dead ones (a number a line)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").try_cast("int").alias("channel"))
    every = lines.select("file").distinct().withColumn("channel", F.explode(F.sequence(F.lit(1), F.lit(channels))))
    alive = every.join(lines.where("channel is not null"), ["file", "channel"], "left_anti")
    return alive.withColumn("tetrode", F.floor((F.col("channel") - 1) / per_tetrode + 1).cast("int"))


def load_sessions(spark: SparkSession, root: str, needed: list[str], columns: list[str]) -> DataFrame:
    """columns of the cells of all sessions under root (Parquet by session_id) in which every needed column has a value; columns that no session has are null."""
    df = spark.read.option("mergeSchema", True).parquet(root)
    have = {c.lower() for c in df.columns}
    if any(c.lower() not in have for c in needed):
        df = df.where("false")
    else:
        full = df.groupBy("session_id").agg(*(F.count(c).alias(c) for c in needed))
        for c in needed:
            full = full.where(F.col(c) > 0)
        df = df.join(full.select("session_id"), "session_id", "left_semi")
    return df.select("session_id", *(F.col(c) if c.lower() in have else F.lit(None).alias(c) for c in columns if c != "session_id"))


def foreign_position(df: DataFrame, keys, time: str = "post", left=("posx", "posy"), right=("posx2", "posy2")) -> DataFrame:
    """Position of another laboratory's tracking in canonical columns, with its sampling rate; sessions in which a column has no value go.

    Coordinates are the middle of both diodes, and hd the angle between them.
    """
    needed = [time, *left, *right]
    full = df.groupBy(*keys).agg(*(F.count(c).alias(c) for c in needed))
    for c in needed:
        full = full.where(F.col(c) > 0)
    df = df.join(full.select(*keys), list(keys), "left_semi")
    w = Window.partitionBy(*keys)
    rate = df.groupBy(*keys).agg(F.min(time).alias("t0")).join(df.select(*keys, time), list(keys)).where(F.col(time) > F.col("t0")).groupBy(*keys).agg((1 / (F.min(time) - F.first("t0"))).alias("sampling_rate"))
    (a, b), (c, d) = left, right
    out = df.join(rate, list(keys), "left")
    return out.select(*keys, (F.row_number().over(w.orderBy(time)) - 1).alias("pos_idx"), F.col(time).alias("synced_time"), ((F.col(a) + F.col(c)) / 2).alias("x"), ((F.col(b) + F.col(d)) / 2).alias("y"), F.degrees(F.atan2(F.col(d) - F.col(b), F.col(c) - F.col(a))).alias("hd"), "sampling_rate")


def foreign_spikes(df: DataFrame, keys, time: str, rate: float) -> DataFrame:
    """Spike times in seconds as samples of rate."""
    return df.select(*keys, F.floor(F.col(time) * rate).cast("long").alias("t_sample"))


def simulated_position(df: DataFrame) -> DataFrame:
    """Head directions of simulated sessions from 0 to 360 as -180 to 180."""
    return df.withColumn("hd", F.col("hd") - 180)


def pulse_samples(events: DataFrame, keys, time: str, rate: float) -> DataFrame:
    """(keys, idx): the samples that are on, from event times in seconds; all others are off and have no row."""
    return events.where(F.col(time).isNotNull()).select(*keys, F.floor(F.col(time) * rate).cast("long").alias("idx")).distinct()


def curated_clusters(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(clusters with their group and primary channel, clusters that only one of both files has) from cluster_group.tsv and cluster_info.tsv of curation folders."""
    read = lambda name: spark.read.option("sep", "\t").option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).csv(folder).withColumn("session", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1))
    groups = read("cluster_group.tsv").select("session", F.col("cluster_id").cast("int").alias("cluster_id"), F.col("group").alias("cluster_group"))
    info = read("cluster_info.tsv").select("session", F.col("cluster_id").cast("int").alias("cluster_id"), (F.col("ch").cast("int") + 1).alias("primary_channel"))
    keys = ["session", "cluster_id"]
    lost = groups.select(*keys).join(info, keys, "left_anti").union(info.select(*keys).join(groups, keys, "left_anti"))
    return groups.join(info, keys).withColumn("unsorted", F.col("cluster_group") == "unsorted"), lost


def with_curated(cells: DataFrame, curated: DataFrame, session_keys) -> DataFrame:
    """Cells of the sorted sessions, and the cells curated by hand of sessions that have no sorting."""
    missing = curated.join(cells.select(*session_keys).distinct(), list(session_keys), "left_anti")
    return cells.unionByName(missing.select(*cells.columns))


def pulse_series(parameters: DataFrame, pulses: DataFrame, keys, order: str) -> DataFrame:
    """Pulses (keys, pulse_id from 1) with the parameters of the series they lie in; parameters: keys, order, pulses (how many) and what is to be copied. Later pulses go."""
    w = Window.partitionBy(*keys).orderBy(order)
    last = F.sum("pulses").over(w.rowsBetween(Window.unboundedPreceding, 0))
    series = parameters.withColumn("__to", last).withColumn("pulse_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pulses").cast("long")))).withColumn("pulse_id", F.col("__to") - F.col("pulses") + F.col("pulse_id"))
    return pulses.join(series.drop("__to", "pulses"), [*keys, "pulse_id"])


def labelled_samples(samples_: DataFrame, field_bins: DataFrame, keys, bin_px: float, x: str = "x_px", y: str = "y_px") -> DataFrame:
    """Samples with field_id, the last of the fields that hold them, 0 outside all; fields are numbered from 1 in the result."""
    at = samples_.withColumns({"bin_x": F.floor(F.col(x) / bin_px), "bin_y": F.floor(F.col(y) / bin_px)})
    last = field_bins.groupBy(*keys, "bin_x", "bin_y").agg((F.max("field_id") + 1).alias("field_id"))
    return at.join(last, [*keys, "bin_x", "bin_y"], "left").withColumn("field_id", F.coalesce("field_id", F.lit(0).cast("long"))).drop("bin_x", "bin_y")


def export(df: DataFrame, path: str, by: list[str], kind: str = "csv") -> None:
    """Files for other tools, in a folder for each value of by."""
    df.write.mode("overwrite").option("header", True).partitionBy(*by).format(kind).save(path)

