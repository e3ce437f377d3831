"""The folder that driver and executors share, for what cuts a plan's lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or what the context was given as such. Only where none is configured and Spark runs
    in one process (tests) is a temporary one made; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not re.fullmatch(r"local(\[.*])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="ledgerlight-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        context.setCheckpointDir(found)
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df computed and stored in the shared folder as a Parquet table, so that readers take the columns they need; gone when
    the application ends."""
    path = dropped_at_end(df.sparkSession, f"{shared_dir(df.sparkSession).rstrip('/')}/ledgerlight/settled-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def laid_out(df: DataFrame, key: str) -> DataFrame:
    """df stored in the shared folder by buckets of a column: joins and groups by it need no shuffle, however many there are."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"laid_out_{uuid.uuid4().hex}"
    path = dropped_at_end(spark, f"{shared_dir(spark).rstrip('/')}/ledgerlight/{name}")
    df.repartition(n, key).write.bucketBy(n, key).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def dropped_at_end(spark: SparkSession, path: str) -> str:
    """path, which Spark deletes when the application ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
