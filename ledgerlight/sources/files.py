"""Documents as files: a scan that gives one outcome a file, whatever the file is."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.operators.documents import html_text, text_quality


class Recogniser(Protocol):
    """What reads text from images of pages. It is sent to the executors."""

    name: str

    def is_available(self) -> bool: ...

    def unavailable_reason(self) -> str | None: ...

    def extract(self, data: bytes) -> tuple[str, int]:
        """The text and the number of pages; raises if it can't."""
        ...


class NoRecogniser:
    """Stands for a recogniser where none is installed."""

    name = "none"

    def is_available(self) -> bool:
        return False

    def unavailable_reason(self) -> str | None:
        return "no recogniser is installed"

    def extract(self, data: bytes) -> tuple[str, int]:
        raise RuntimeError(self.unavailable_reason())


#: Partitions of Spark's file scan that one task reads, one after the other.
TOGETHER = 32
KINDS = {".pdf": "pdf", ".html": "html", ".htm": "html"}


def _first(read_layer: Callable[[bytes], list[str]] | None):
    """What a file's own text is, in Arrow batches of (path, kind, content)."""

    def one(kind: str | None, data: bytes) -> tuple:
        if kind is None:
            return None, None, "FAILED", "unsupported kind of file"
        if kind == "html":
            return html_text(data.decode("utf-8", errors="replace")), None, "TEXT_LAYER", None
        if read_layer is None:
            return None, None, "BACKEND_UNAVAILABLE", "no reader of text layers is installed"
        try:
            pages = read_layer(data)
            return "\n".join(pages), len(pages), None, None  # the quality gate decides
        except Exception as e:  # an outcome like any other
            return None, None, "FAILED", f"could not be parsed: {e}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(kind, data or b"") for kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            text, pages, status, error = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string()), pa.array(pages, pa.int32()), pa.array(status, pa.string()), pa.array(error, pa.string())], ["path", "kind", "content", "text", "pages", "status", "error"])

    return read


def _recognised(recogniser: Recogniser):
    """The text of files that still have content, by the recogniser."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, pages, errors = [], [], []
            for data in batch.column(batch.num_columns - 1).to_pylist():
                text, n, error = None, None, None
                if data is not None:
                    try:
                        text, n = recogniser.extract(data)
                    except Exception as e:
                        error = f"{recogniser.name} raised: {e}"
                texts.append(text), pages.append(n), errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(pages, pa.int32()), pa.array(errors, pa.string())], [*batch.schema.names[:-1], "read_text", "read_pages", "read_error"])

    return read


def document_scan(spark: SparkSession, path: str, read_layer: Callable[[bytes], list[str]] | None = None, recogniser: Recogniser | None = None, named: DataFrame | None = None) -> DataFrame:
    """path, kind, status, text, pages, chars, method, error: a row for each file under `path`, at any depth.

    Files are told by their suffix; of other kinds they fail. The text of HTML is taken as it is. A PDF's is that of its
    layer (read_layer gives the text of each page), if it passes the quality gate; else what the recogniser reads, if that
    passes. status: TEXT_LAYER, OCR, EXTRACTION_UNRELIABLE (neither passes), BACKEND_UNAVAILABLE (no reader, or no
    recogniser where one is needed), FAILED. Failures are rows with an error; none ends a task, and none looks like an
    empty text. Only files that need it reach the recogniser. Spark's scan passes over files without a byte: `named` (path, as
    Spark writes it) says which files there should be, and those that aren't seen fail as missing or empty. A task reads up
    to TOGETHER partitions of spark.sql.files.maxPartitionBytes, one after the other; what Python gets at once is bounded by
    spark.sql.execution.arrow.maxBytesPerBatch and the largest file.
    """
    recogniser = recogniser or NoRecogniser()
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", kinds[suffix].alias("kind"), "content")
    # small files are few to a partition, as each counts as openCostInBytes; a task takes several, so that starting tasks and
    # their Python workers, twice each, does not cost more than the files do
    parts = files.select("path").rdd.getNumPartitions()
    files = files.coalesce(min(max(parts, 1), max(8 * spark.sparkContext.defaultParallelism, -(-parts // TOGETHER))))
    first = files.mapInArrow(_first(read_layer), "path string, kind string, content binary, text string, pages int, status string, error string")
    good = lambda text, pages: F.coalesce(text_quality(F.coalesce(F.col(text), F.lit("")), F.col(pages))[3], F.lit(False))
    status = F.coalesce("status", F.when(good("text", "pages"), "TEXT_LAYER"), F.when(F.lit(not recogniser.is_available()), "BACKEND_UNAVAILABLE"))
    gated = first.withColumn("status", status).withColumn("error", F.when(F.col("status") == "BACKEND_UNAVAILABLE", F.coalesce("error", F.lit(recogniser.unavailable_reason()))).otherwise(F.col("error")))
    asked = gated.select("path", "kind", "text", "pages", "status", "error", F.when(F.col("status").isNull(), F.col("content")).alias("content"))
    read = asked.mapInArrow(_recognised(recogniser), "path string, kind string, text string, pages int, status string, error string, read_text string, read_pages int, read_error string") if recogniser.is_available() else asked.selectExpr("* EXCEPT (content)", "CAST(NULL AS STRING) AS read_text", "CAST(NULL AS INT) AS read_pages", "CAST(NULL AS STRING) AS read_error")
    asked_for = F.col("status").isNull()
    pages = F.when(asked_for, F.coalesce("read_pages", "pages")).otherwise(F.col("pages"))
    done = read.withColumn("all_pages", pages)
    outcome = F.when(~asked_for, F.col("status")).when(F.col("read_error").isNotNull(), "FAILED").when(good("read_text", "all_pages"), "OCR").otherwise("EXTRACTION_UNRELIABLE")
    text = F.when(outcome == "TEXT_LAYER", F.col("text")).when(outcome.isin("OCR", "EXTRACTION_UNRELIABLE"), F.col("read_text")).otherwise("")
    error = F.when(~asked_for, F.col("error")).otherwise(F.coalesce("read_error", F.when(outcome == "EXTRACTION_UNRELIABLE", "neither the text layer nor what was recognised passes the quality gate")))
    method = F.when(asked_for, F.lit(recogniser.name)).when((F.col("kind") == "pdf") & (outcome == "TEXT_LAYER"), "text layer")
    found = done.select("path", F.coalesce("kind", F.lit("unknown")).alias("kind"), outcome.alias("status"), text.alias("text"), F.col("all_pages").alias("pages"), F.char_length(text).alias("chars"), method.alias("method"), error.alias("error"))
    if named is None:
        return found
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")  # no content is read
    absent = named.select("path").distinct().join(seen, "path", "left_anti")
    kind = F.coalesce(kinds[suffix], F.lit("unknown"))
    return found.unionByName(absent.select("path", kind.alias("kind"), F.lit("FAILED").alias("status"), F.lit("").alias("text"), F.lit(None).cast("int").alias("pages"), F.lit(0).alias("chars"), F.lit(None).cast("string").alias("method"), F.lit("missing or empty").alias("error")))
