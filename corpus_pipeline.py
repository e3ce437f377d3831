"""The corpus pipeline: language ID, near-dedup, substring dedup, benchmark decontamination, packing.

Each stage works on the Parquet table that the one before it wrote; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import kept_by_worker, named, row_and, table, written
from ledgerlight.llm.decontam import contamination
from ledgerlight.llm.langid import fit, held_out, identify
from ledgerlight.llm.packing import pack_documents
from ledgerlight.llm.simhash import near_dedup
from ledgerlight.llm.suffix import suffix_dedup

#: Documents whose language is less sure than this are rejected.
SURE = 0.5
#: Bytes of a repeated string that is cut. A passage of fifty words has so many if its words have four letters on the average;
#: one of shorter words has fewer and isn't seen.
PASSAGE = 240


def set_apart(docs: DataFrame, taken: tuple[str, ...]) -> DataFrame:
    """docs with further columns that have a name which an operator gives its results renamed; toDF(*docs.columns) undoes it."""
    return docs.toDF(*(f"own-{c}" if c in taken else c for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty ones too) and those of no sure language. Repeated rows are judged each;
    ids are not used, so they may be null; further columns stay as they are, whatever their names; no rows give none."""
    model = fit(docs.where(~held_out()))
    own = set_apart(docs, ("lang_pred", "score"))
    return identify(own, model).where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*named(own.columns)).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles with a similarity of 0.8 or more: SimHash fingerprints of
    the shingles give candidates, an exact filter on the shingles the links that are too wide for fingerprints."""
    return near_dedup(docs, 5, 0.8)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every string of PASSAGE bytes that also starts elsewhere; a character that is cut through goes as a whole.
    Every document stays, with what is left of its text; n_chars is counted anew. Null texts become empty; copies, which
    near-dedup should have taken away, lose all; columns but text and n_chars are as they were, whatever their names."""

    def text_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("", lambda: None)
        for batch in batches:
            texts = [x.decode("utf-8", "ignore") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    own = set_apart(docs, ("n_bytes", "spans", "kept"))
    others = [c for c in own.columns if c not in ("text", "n_chars")]
    left = suffix_dedup(own, PASSAGE).select(F.struct(*named(others)).alias("row"), "kept")
    texts = left.mapInArrow(text_of, row_and(left, "text string"))
    counted = texts.select(*(F.col("row")[c].alias(c) for c in others), "text", F.char_length("text").cast("long").alias("n_chars"))
    return counted.select(*named(own.columns)).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window similar to a benchmark item: see contamination(). Null and empty texts have none and stay;
    repeated rows are judged each; further columns stay as they are, whatever their names; no rows give none."""
    own = set_apart(docs, ("matches",))
    return contamination(own, table(spark, sf_dir, "benchmark")).where(F.size("matches") == 0).select(*named(own.columns)).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens: see pack_documents(). A null or empty text is one token; repeated rows
    are packed each; further columns are left out."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("decontamination", decontamination),
    ("packing", packing),
]
ORACLE_SQL = None  # none of the stages can be stated in SQL; tests compare them with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
