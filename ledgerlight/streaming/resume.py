"""Fetching that is stopped and goes on: a stream over roster files, an outcome for each key once, and a record of each run."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOME = "key string, payload binary, sha256 string, error string"


class ResumableFetch:
    """Fetches what roster files (Parquet with a column `key`) name, into `path`.

    fetch is a function from a key to bytes, that raises if there is none; it runs on the executors. A batch's outcomes and
    its record are folders named by the batch, which a batch that is run again overwrites. So whenever a run is stopped,
    the next goes on with the batch that was not finished, and no key is stored twice. A key that has been fetched is passed
    over wherever it turns up again; one that failed is tried again then.
    """

    def __init__(self, spark: SparkSession, roster: str, path: str, fetch: Callable[[str], bytes], files_per_batch: int = 1, tasks: int = 8):
        self.spark, self.roster, self.path, self.fetch = spark, roster, path.rstrip("/"), fetch
        self.files_per_batch, self.tasks = files_per_batch, tasks

    def run(self) -> None:
        """Take all roster files there are and no run has finished yet."""
        stream = self.spark.readStream.schema("key string").option("maxFilesPerTrigger", self.files_per_batch).parquet(self.roster)
        started = stream.writeStream.foreachBatch(self.store).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        started.awaitTermination()

    def _read(self, what: str, schema: str) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{what}") if there else self.spark.createDataFrame([], f"{schema}, batch long")

    def outcomes(self) -> DataFrame:
        """OUTCOME and batch of all that was tried."""
        return self._read("outcomes", OUTCOME)

    def records(self) -> DataFrame:
        """batch, named, passed_over, fetched, failed of each batch that is done."""
        return self._read("records", "named long, passed_over long, fetched long, failed long")

    def store(self, batch: DataFrame, batch_id: int) -> None:
        fetch = self.fetch

        def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys in batches:
                for key in keys.column(0).to_pylist():  # a payload at a time
                    try:
                        payload, error = fetch(key), None
                    except Exception as e:  # an outcome like any other
                        payload, error = None, f"{type(e).__name__}: {e}"
                    digest = None if payload is None else hashlib.sha256(payload).hexdigest()
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([payload], pa.binary()), pa.array([digest], pa.string()), pa.array([error], pa.string())], ["key", "payload", "sha256", "error"])

        named = batch.select("key").dropna().distinct()
        known = self.outcomes().where((F.col("batch") != batch_id) & F.col("error").isNull()).select("key").distinct()
        pending = named.join(known, "key", "left_anti").repartition(self.tasks)
        pending.mapInArrow(fetched, OUTCOME).write.mode("overwrite").parquet(f"{self.path}/outcomes/batch={batch_id}")
        mine = self.outcomes().where(F.col("batch") == batch_id).agg(F.count_if(F.col("error").isNull()).alias("fetched"), F.count_if(F.col("error").isNotNull()).alias("failed"))
        record = named.agg(F.count("*").alias("named")).crossJoin(mine)  # one row each
        record.select("named", (F.col("named") - F.col("fetched") - F.col("failed")).alias("passed_over"), "fetched", "failed").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/records/batch={batch_id}")
