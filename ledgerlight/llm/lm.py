"""LM scoring: stupid backoff, computed as joins between n-gram count tables and the documents' n-grams.

Documents are gathered into blocks of a few MB, as they are read. A block's distinct n-grams, with their counts in it, are sent to the
partition that owns their hash range; there the counts of all blocks are added up (the count table), and each block gets
the counts of its n-grams back by the same join, in its own order. The block then looks up each position's n-gram, backs
off where the count is below `min_count`, and sums the logarithms per document.

A block and a hash range exchange two rows, each an array column: sorted hashes as differences and counts, both
compressed. So a distinct n-gram of a block costs about four bytes, however often it occurs, and hot n-grams cost no
more than others. Rows are never more than the plain join of exploded n-grams would have. Hashes have
log2(n-grams) + 20 bits: one n-gram in a million shares its count with another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import free_shuffles, kept_by_worker, small_batches, table, written

BLOCK = 6_000_000  # bytes of text
MIX = np.uint64(0x9E3779B97F4A7C15)


def planes(values: np.ndarray) -> bytes:
    """Compressed numbers: their lowest bytes, then the next, up to the highest that is used, each compressed by itself."""
    import zstandard

    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    out = [zstandard.compress(raw[:, i].tobytes(), 1) for i in range(width)]
    return bytes([width]) + np.array(list(map(len, out)), "<u4").tobytes() + b"".join(out)


def from_planes(data: bytes, n: int) -> np.ndarray:
    import zstandard

    out, at = np.zeros((n, 8), np.uint8), 1 + 4 * data[0]
    for i, size in enumerate(np.frombuffer(data[1:at], "<u4").tolist()):
        out[:, i] = np.frombuffer(zstandard.decompress(data[at: at + size]), np.uint8)
        at += size
    return out.view("<u8").ravel()


def blocks(rows: DataFrame) -> DataFrame:
    """rows: doc_id, text. Returns block, ids, sizes (bytes of each text; -1: null), texts (compressed), stored."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        number, ids, texts, size = TaskContext.get().partitionId() << 20, [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, size
            data = zstandard.compress(b"".join(x or b"" for x in texts), 3)
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            values = [number], [ids[:]], [[-1 if x is None else len(x) for x in texts]], [data]
            ids.clear(), texts.clear()
            number, size = number + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], ["block", "ids", "sizes", "texts"])

        for batch in batches:
            for doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                ids.append(doc_id)
                texts.append(None if text is None else text.encode())
                size += len(text or "")
                if size >= BLOCK:
                    yield block()
        if ids:
            yield block()

    return written(rows.mapInArrow(gather, "block long, ids array<long>, sizes array<int>, texts binary"), "blocks")


def unpacked(sizes: list[int], data: bytes) -> list[bytes]:
    import zstandard

    raw, at, out = zstandard.decompress(data), 0, []
    for size in sizes:
        out.append(raw[at: at + max(0, size)])
        at += max(0, size)
    return out


def block_ngrams(texts: list[bytes], order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (order, words): that of the n-gram of n words ending at each word, zero where its text has too few before
    it; and the number of words of each text. Hashes are never zero, and those of n-grams differ by n."""
    from xxhash import xxh64_intdigest

    vocabulary: dict[bytes, int] = {}
    place = vocabulary.setdefault
    ids, sizes = [], []
    for text in texts:
        words = text.lower().split()
        sizes.append(len(words))
        ids += [place(w, len(vocabulary)) for w in words]
    hashes = np.array([xxh64_intdigest(w) for w in vocabulary] or [0], np.uint64)
    one = hashes[np.array(ids, np.int64)]
    sizes = np.array(sizes, np.int64)
    at = np.arange(len(one)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((order, len(one)), np.uint64)
    running = np.zeros(len(one), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(order):
            # running: the hash of the n words up to here, extended to the left
            running = running * MIX + np.append(np.zeros(n, np.uint64), one)[: len(one)]
            mixed = (running ^ (running >> np.uint64(31))) * (MIX + np.uint64(2 * n))
            mixed ^= mixed >> np.uint64(29)
            out[n] = np.where(at >= n, np.maximum(mixed >> np.uint64(64 - bits), np.uint64(1)), np.uint64(0))
    return out, sizes


def stupid_backoff(docs: DataFrame, order: int = 3, alpha: float = 0.4, min_count: int = 2, *, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, score (sum over tokens of the natural log of the stupid-backoff score), per_token (its mean).

    The score of a word after its context is count(context, word) / count(context) for the longest context of up to
    order - 1 words of the same document whose n-gram occurs at least min_count times in all documents, times alpha for
    every word of context given up; with no context it is count(word) / number of all words. Words are lower-cased
    (A-Z) and split at ASCII white space. Null and empty texts have no tokens, score 0 and a null mean. Every row is
    counted and scored, repeated ones too; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    parts = max(1, -(-n_bytes // BLOCK))
    bits = min(63, math.ceil(math.log2(n_bytes * order)) + 20)
    held = blocks(rows)

    def owners(found: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The partitions that own some of the sorted hashes, and where these stand; zero belongs to none. A block has no
        more of them than n-grams, however many partitions there are."""
        top = found >> np.uint64(max(0, bits - 31))
        part = (top * np.uint64(parts)) >> np.uint64(min(bits, 31))
        first = int(np.searchsorted(found, 1))
        names, starts = np.unique(part[first:], return_index=True)
        ends = np.append(starts[1:], len(found) - first)
        for p, a, b in zip(names.tolist(), (starts + first).tolist(), (ends + first).tolist()):
            yield p, slice(a, b)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for to, sizes, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found, counts = np.unique(block_ngrams(unpacked(sizes, data), order, bits)[0].ravel(), return_counts=True)
                for part, mine in owners(found):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), pa.array([to], pa.int64()), pa.array([mine.stop - mine.start], pa.int32()), pa.array([planes(np.diff(found[mine], prepend=np.uint64(0)))], pa.binary()), pa.array([planes(counts[mine])], pa.binary())],
                        ["part", "block", "n", "hashes", "counts"],
                    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(r["part"], r["block"], np.cumsum(from_planes(r["hashes"], r["n"])), from_planes(r["counts"], r["n"])) for b in batches for r in b.to_pylist()]
        if not got:
            return
        every = np.concatenate([x[2] for x in got])
        keys, inverse = np.unique(every, return_inverse=True)
        total = np.bincount(inverse, np.concatenate([x[3] for x in got]).astype(float)).astype(np.uint64)[inverse]
        at = 0
        for part, to, hashes, _ in got:
            mine = total[at: at + len(hashes)]
            at += len(hashes)
            yield pa.RecordBatch.from_arrays([pa.array([to], pa.int64()), pa.array([part], pa.int32()), pa.array([len(mine)], pa.int32()), pa.array([planes(mine)], pa.binary())], ["to", "part", "n", "counts"])

    def score(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("", lambda: None)
        waiting: dict[int, list] = {}
        for batch in groups:
            # a row is a block or an answer to one; a partition has all rows of its few blocks
            for row in batch.to_pylist():
                waiting.setdefault(row["block"], []).append(row)
        for block in waiting.values():
            asked = next(x for x in block if x["texts"] is not None)
            yield block_scores(asked, {x["part"]: from_planes(x["counts"], x["n"]) for x in block if x["texts"] is None})

    def block_scores(asked: dict, answers: dict) -> pa.RecordBatch:
        ids = asked["ids"]
        hashes, sizes = block_ngrams(unpacked(asked["sizes"], asked["texts"]), order, bits)
        found, inverse = np.unique(hashes.ravel(), return_inverse=True)
        inverse = inverse.reshape(hashes.shape)
        counts = np.zeros(len(found))
        for part, mine in owners(found):
            counts[mine] = answers[part]
        counts = counts[inverse]  # (order, words), of the n-grams ending at each word
        doc = np.repeat(np.arange(len(sizes)), sizes)
        logs, open_ = np.zeros(len(doc)), np.ones(len(doc), bool)
        for n in range(order - 1, 0, -1):
            have = open_ & (counts[n] >= min_count)
            context = np.append(1.0, counts[n - 1][:-1])
            logs[have] += np.log(counts[n][have] / context[have])
            open_ &= ~have
            # a word near its text's start has no such context, so there is nothing to give up
            logs[open_ & (found[inverse[n]] != 0)] += math.log(alpha)
        logs[open_] += np.log(counts[0][open_])
        n = len(sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes), pa.array(np.bincount(doc, logs, n)), pa.array(np.bincount(doc, open_, n).astype(np.int64))],
            ["doc_id", "n_tokens", "logs", "n_bare"],
        )

    asked = held.select("block", "sizes", "texts").mapInArrow(ask, "part int, block long, n int, hashes binary, counts binary")
    answers = written(asked.repartitionById(parts, "part").mapInArrow(answer, "block long, part int, n int, counts binary"), "counts")
    free_shuffles(spark)
    nothing = [F.lit(None).cast(t).alias(k) for k, t in (("ids", "array<long>"), ("sizes", "array<int>"), ("texts", "binary"))]
    both = held.select("*", *(F.lit(None).cast(t).alias(k) for k, t in (("part", "int"), ("n", "int"), ("counts", "binary")))).unionByName(answers.select("block", *nothing, "part", "n", "counts"))
    dealt = both.repartitionById(parts, F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    scored = written(dealt.mapInArrow(score, "doc_id long, n_tokens long, logs double, n_bare long"), "scores")
    total = scored.agg(F.sum("n_tokens")).first()[0] or 1
    value = F.col("logs") - F.col("n_bare") * math.log(total)
    return scored.select("doc_id", "n_tokens", value.alias("score"), F.when(F.col("n_tokens") > 0, value / F.col("n_tokens")).alias("per_token"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stupid_backoff() of documents; sums are rounded, as their last digits depend on the order of adding."""
    scored = stupid_backoff(table(spark, sf_dir, "documents"))
    return scored.withColumn("score", F.round("score", 4)).withColumn("per_token", F.round("per_token", 6))
