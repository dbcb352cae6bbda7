"""Session helpers shared by the library, the tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Removes the shuffle files of a query when it ends.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str = "local[8]", app: str = "catalink", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark share."""
    cores = master.removeprefix("local[").removesuffix("]")
    settings = {
        "spark.ui.enabled": "false",
        "spark.driver.memory": "16g",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": cores if cores.isdigit() else "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only on a local master (tests)."""
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="catalink-")
        spark.conf.set(CHECKPOINT_CONF, named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def landed(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back.

    A written table outlives the executors that produced it, so later jobs never
    recompute it when one of them is lost; nothing needs the shuffles of the write any longer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that begin inside leave no shuffle files when they end."""
    before = spark.conf.get(CLEANUP_CONF)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_CONF, before)


def dropped(table: DataFrame) -> None:
    """Delete a landed table that nothing reads any more, such as that of an earlier iteration."""
    spark = table.sparkSession
    jvm = spark._jvm
    for folder in {os.path.dirname(file) for file in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, label: str, by: str, buckets: int) -> DataFrame:
    """The same, written in buckets by a column: tables in as many buckets join on it unshuffled."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = os.path.basename(path).replace("-", "_")
    with _shuffles_dropped(spark):
        df.write.option("path", path).bucketBy(buckets, by).saveAsTable(name)
    return spark.table(name)


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a plain scan only when it yields fewer partitions than there are cores.

    Large inputs already split into more partitions than cores and pass through
    untouched, so this adds a shuffle for small inputs only. Give it a scan (with filters
    and columns), never a join: counting the partitions of a join would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
