"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHECKPOINT_KEY = "spark.checkpoint.dir"
# With it Spark drops a query's shuffle files as soon as its result is written.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "commentlab", cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("COMMENTLAB_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder of its own.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="commentlab-")
    spark.conf.set(CHECKPOINT_KEY, path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, so that no run overwrites another."""
    return f"{shared_dir(spark).rstrip('/')}/commentlab/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a frame that is read more than once to the shared folder and read it back.

    Unlike a cache it survives the loss of executors and cuts the lineage; the shuffle files it was made
    through are dropped.
    """
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP_KEY, "false")
    conf.set(CLEANUP_KEY, "true")
    try:
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(path)
    finally:
        conf.set(CLEANUP_KEY, before)
    fields = sorted(df.schema.fields, key=lambda f: f.name == partition_by)
    return df.sparkSession.read.schema(StructType(fields)).parquet(path)


def checkpointed(spark: SparkSession, rdd: RDD) -> RDD:
    """``rdd`` kept until its next action has written it to the shared folder; see ``reread``."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark).rstrip('/')}/checkpoints")
    rdd.persist(StorageLevel.MEMORY_AND_DISK)
    rdd.checkpoint()
    return rdd


def reread(spark: SparkSession, rdd: RDD) -> tuple[RDD, str]:
    """What ``checkpointed`` has written, with no tie to what it was made of, and its path."""
    path = rdd.getCheckpointFile()
    rdd.unpersist()
    return spark.sparkContext._checkpointFile(path, rdd._jrdd_deserializer), path


def stored(spark: SparkSession, rdd: RDD) -> tuple[RDD, str]:
    """``rdd`` written to the shared folder and read from there, and its path."""
    kept = checkpointed(spark, rdd)
    kept.count()
    return reread(spark, kept)


def discard(spark: SparkSession, what: DataFrame | str) -> None:
    """Deletes what this module has written: a path, or a table of ``materialize`` without partition columns."""
    paths = [what] if isinstance(what, str) else {os.path.dirname(f) for f in what.inputFiles()}
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free(spark: SparkSession) -> None:
    """Lets Spark's cleaner find the shuffle files that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()
