"""What the text operators share: reading tables, the shared work folder, written intermediate tables, components."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(columns: list[str]) -> list[Column]:
    """Columns by their exact names, whatever characters these have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def row_and(packed: DataFrame, more: str) -> StructType:
    """The schema of packed's struct column `row`, followed by further fields in DDL."""
    return StructType([packed.schema["row"], *StructType.fromDDL(more).fields])


def with_row(df: DataFrame, text: str, without: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """df as a struct column `row` of all columns but those named, and `text` as a string; and the names in row. A text that
    is in row as a string is not sent a second time: texts_of() finds it."""
    kept = [c for c in df.columns if c not in without]
    row = F.struct(*named(kept)).alias("row") if kept else F.struct(F.lit(0).alias("_")).alias("row")
    if text in kept and df.schema[text].dataType.simpleString() == "string":
        return df.select(row), kept
    return df.select(row, named([text])[0].cast("string").alias("text")), kept


def texts_of(batch, text: str) -> list:
    return (batch.column(1) if batch.num_columns > 1 else batch.column(0).field(text)).to_pylist()


def kept_by_worker(name: str, build: Callable[[], object]):
    """What build() gives, kept by the Python worker for its later tasks. A worker keeps one such thing at a time; with an
    empty name it only lets go of what it has, and gives freed memory back to the system."""
    import ctypes
    import sys
    import types

    kept = sys.modules.setdefault("_ledgerlight_kept", types.ModuleType("_ledgerlight_kept"))
    if getattr(kept, "of", "") != name or not name:
        kept.of, kept.value = name, None
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass
        kept.value = build() if name else None
    return kept.value


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what a Python worker holds of long texts: fewer rows to an Arrow batch than Spark's default, unless set lower."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or what the context was given as such. Only where there is none
    and Spark runs in one process (tests) is a temporary folder made; on a cluster that is an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="ledgerlight-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
        found = context.getCheckpointDir()
    return found


def _folder(spark: SparkSession, path: str):
    """A path and its file system, as the JVM's objects."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives lost executors. It is deleted when the
    application ends, or earlier by drop_written()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/ledgerlight/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at, files = _folder(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Delete tables made by written() that no later plan reads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            at, files = _folder(df.sparkSession, file)
            files.delete(at.getParent(), True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans now, not when the driver next happens to collect garbage.

    One collection only queues some of the plans that hold them; the next, a moment later, lets go of their files.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable over the undirected edges (u, v); only nodes with an edge.

    Alternating large-star and small-star rounds: each node is hooked to the least node it sees. A round is two
    aggregations and joins whose hot sides are split by the adaptive skew join; no neighbourhood is collected.
    Rounds end when the edge set no longer changes.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = _signature(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = reduce(DataFrame.unionByName, [small.select(F.col("v").alias("u"), F.col("m").alias("v")), small.select("u", F.col("m").alias("v"))])
        after = written(small.where("u <> v").distinct(), "edges")
        drop_written(now)
        now, before, sign = after, sign, _signature(after)
        if sign == before:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first())
