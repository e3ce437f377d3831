"""Substring dedup over sliding sentence spans.

Every run of `run` consecutive sentences is hashed (128 bits, white space folded) and joined globally. The first span of
each hash, by (doc_id, the text's digest, place), stays; a sentence covered by any other is removed. A text of fewer sentences is one
span. Spans without a word, and those of fewer than `min_words` words in all if that is asked for, are not hashed.

Counting is an aggregation with map-side combination (a hot span is one row a task), and the join of spans with repeated
hashes is a sort-merge join whose hot keys the adaptive skew join splits. No group is collected but the repeated
places of one document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import table, written

#: A sentence ends behind closing punctuation with white space after it, or at a line's end; that white space belongs to it.
BREAK = r"[.!?…。！？]+[\"'”’)\]]*\s+|\n\s*"


def splitter():
    ends = re.compile(BREAK).finditer

    def split(text: str) -> list[str]:
        out, at = [], 0
        for m in ends(text):
            end = m.end()
            if not out and not text[at:end].strip():
                continue  # white space before the first sentence belongs to it
            out.append(text[at:end])
            at = end
        if at < len(text):
            out.append(text[at:])
        return out

    return split


def sentence_spans(docs: DataFrame, run: int, min_words: int) -> DataFrame:
    """docs: doc_id, th, text. Returns hi, lo (the hash), doc_id, th, pos (of the span's first sentence)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh3_128_digest

        split = splitter()
        for batch in batches:
            digests, rows, places = [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                words = [x.split() for x in split(text)]
                sizes = list(map(len, words))
                joined = [" ".join(x).encode() for x in words]
                for i in range(max(len(words) - run, 0) + 1):
                    if sum(sizes[i: i + run]) >= max(min_words, 1):
                        digests.append(xxh3_128_digest(b"\n".join(joined[i: i + run])))
                        rows.append(row)
                        places.append(i)
            key = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            taken = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), batch.column(0).take(taken), batch.column(1).take(taken), pa.array(places, pa.int32())],
                ["hi", "lo", "doc_id", "th", "pos"],
            )

    return docs.select("doc_id", "th", "text").mapInArrow(hashed, "hi long, lo long, doc_id long, th long, pos int")


def sentence_dedup(docs: DataFrame, run: int = 2, min_words: int = 0, *, text: str = "text") -> DataFrame:
    """doc_id, text (what is left), n_sentences, n_removed: one row per row of docs.

    A document is a (doc_id, text) pair: rows repeated in both are one document and get the same result, not each
    other's repeats. A null text is empty, has no sentences and stays null. A null doc_id sorts first. Documents of
    fewer than `run` sentences repeat only as a whole. Other columns of docs are ignored.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), F.col(text).cast("string").alias("text"))
    spans = written(sentence_spans(rows.select("doc_id", "th", F.coalesce("text", F.lit("")).alias("text")), run, min_words), "spans")
    place = F.struct("doc_id", "th", "pos")
    first = spans.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    later = spans.join(first, ["hi", "lo"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "th", "pos")
    gone = later.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone")).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "gone")
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["d"]) & (rows["th"] == gone["t"]), "left").select("doc_id", "text", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for batch in batches:
            out, counts, removed = [], [], []
            for body, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts = split(body or "")
                covered = {i for at in gone or () for i in range(at, min(at + run, len(parts)))}
                out.append("".join(x for i, x in enumerate(parts) if i not in covered) if covered else body)
                counts.append(len(parts))
                removed.append(len(covered))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "text", "n_sentences", "n_removed"])

    return joined.mapInArrow(cut, "doc_id long, text string, n_sentences long, n_removed long")


def op10_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sentence_dedup() of all documents, two sentences to a span."""
    return sentence_dedup(table(spark, sf_dir, "documents"))
