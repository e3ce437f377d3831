"""A stored table that takes batches: rows are replaced by their natural key, the last write wins.

The table is bucketed by its key, so a batch is shuffled to the buckets it belongs to and the stored rows stay where they
are: each task reads one bucket, merges what came for it, and writes one bucket of the next version. A version is published
in one step, knows which batches it holds, and takes none of them twice; so a batch that is sent again, as after a failure
of a stream's sink, changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.operators.sequence import last_write
from ledgerlight.sources.store import Versions


class MergedTable:
    """keys and sequence name columns of the rows; of two rows with one key that of the greater sequence stays, the newer batch's
    if these are equal. Keys and sequence are never null: a batch with such a row is refused. Batches have the columns of
    the first. Choose `buckets` once, for the size the table will have: about one for each half gigabyte."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sequence: str, buckets: int = 64):
        self.spark, self.keys, self.sequence, self.buckets = spark, list(keys), sequence, buckets
        self.versions = Versions(spark, path)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest if none is named; laid out by bucket, so that joins and groups by the key need
        no shuffle. There is none before the first batch."""
        content = self.versions.read(version)
        if not content:
            raise ValueError("no batch has been merged yet")
        # the session's catalogue is told what the files are; they are found again by any session
        name, quoted = f"merged_{content['folder'].rsplit('/', 1)[1]}", ", ".join(f"`{k}`" for k in content["keys"])
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({content['schema']}) USING parquet CLUSTERED BY ({quoted}) SORTED BY ({quoted}) INTO {content['buckets']} BUCKETS LOCATION '{self.versions.folder(content['folder'])}'")
        return self.spark.table(name)

    def planned(self, batch: DataFrame, stored: DataFrame | None) -> DataFrame:
        """The next version's rows: a full join by the key, whose stored side is read as it lies."""
        whole = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null"))).otherwise(F.col(c)).alias(c) if c in (*self.keys, self.sequence) else F.col(c) for c in batch.columns]
        newest = last_write(batch.select(*whole), self.keys, self.sequence)
        if stored is None:
            return newest.repartition(self.buckets, *self.keys)
        rest = [c for c in stored.columns if c not in self.keys]
        old = stored.select(*self.keys, F.struct(*rest).alias("_old"))
        new = newest.select(*self.keys, F.struct(*rest).alias("_new"))
        later = F.col("_new").isNotNull() & (F.col("_old").isNull() | (F.col(f"_new.{self.sequence}") >= F.col(f"_old.{self.sequence}")))
        row = F.when(later, F.col("_new")).otherwise(F.col("_old"))
        return old.join(new.hint("merge"), self.keys, "full").select(*self.keys, row.alias("_row")).select(*self.keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*stored.columns)

    def merge(self, batch: DataFrame, batch_id: int | str) -> int:
        """Merge a batch and return the version that holds it: a new one, or the latest if that has it already."""
        version = self.versions.latest()
        content = self.versions.read(version)
        if str(batch_id) in content.get("batches", []):
            return version
        rows = self.planned(batch, self.read(version) if content else None)
        folder = f"data/{uuid.uuid4().hex}"
        name = f"staged_{folder.rsplit('/', 1)[1]}"
        try:
            rows.write.format("parquet").option("path", self.versions.folder(folder)).option("compression", "zstd").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(name)
            schema = self.spark.table(name).schema
            ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            after = {"folder": folder, "schema": ddl, "keys": self.keys, "buckets": self.buckets, "batches": [*content.get("batches", []), str(batch_id)]}
            return self.versions.publish(after, version)
        except Exception:
            self.versions.drop(folder)
            raise
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # of the catalogue alone: the files are ours

    def vacuum(self, keep: int = 2) -> None:
        """Drop all but the last versions."""
        self.versions.vacuum(lambda content: [content["folder"]], keep)
