"""Session helpers: settings for scale, and the one place that knows the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this engine relies on. Sizes of partitions are left to AQE.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the session comes from spark-submit."""
    b = SparkSession.builder.master(master).appName("lexloom").config(map=SETTINGS)
    b = b.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false")
    for k, v in extra.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one;
    a cluster gets an error, as its executors could not read each other's files."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to a new table in the shared folder and reads it again.

    It cuts the lineage, keeps the result through the loss of executors (unlike a local checkpoint), and is
    columnar, so that later reads are pruned. `release` removes the tables when their readers are done.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes the tables that `materialize` has written in this process, and says how many; frames made from them can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    n = 0
    while _written:
        p = path(_written.pop())
        n += p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return n


def small_batches(batches, rows: int = 256):
    """Arrow batches cut into pieces of at most so many rows, so that what Python makes of a batch of long texts stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows) or [0]:
            yield b.slice(at, rows)


def spread(df: DataFrame) -> DataFrame:
    """A scan of few files dealt out to all cores before costly work on its rows; a scan with a task for each core stays as it is.

    On a cluster that reads many files this changes nothing and shuffles nothing.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
