"""Where intermediate tables go: the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows in an Arrow batch to a Python worker: texts are long, and the JVM and the worker each hold several batches.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on Arrow batches (64 MB by default) to ARROW_BYTES; a lower one stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = "".join(c for c in spark.conf.get(name) if c.isdigit() or c == "-")
    if not 0 < int(now) <= ARROW_BYTES:
        spark.conf.set(name, ARROW_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder; a temporary one is set only where none is, on a local master."""
    small_batches(spark)
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="spark-checkpoints-")
        sc.setCheckpointDir(named)
        found = sc.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the rows are written once, later plans start from the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(columns: list[str], wanted: str) -> str:
    """wanted, with underscores after it until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


#: Rows that may be broadcast; above it a join shuffles.
BROADCAST_ROWS = 1_000_000


def bounded(small: DataFrame) -> DataFrame:
    """Marked for a broadcast where its rows (some short columns) are at most BROADCAST_ROWS; else the join shuffles."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


class Scratch:
    """Parquet tables that an operator writes and reads again before it returns."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
