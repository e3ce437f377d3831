"""Quality rules: an isolation forest on rule statistics.

The rules count, over whole texts, words, their characters, symbols, repeated lines and words in repeated windows. An
isolation forest is grown by random splits on these statistics of labelled rows that pass the base rules; a document
that few splits set apart is an anomaly. The threshold is calibrated on the same rows' labels: it gives the greatest share
of bad rows caught, less `cost` times the share of good rows lost.

The threshold comes from the scores of all labelled rows, counted in BINS. The forest's trees are grown, as the method has it,
on subsamples of 256 rows, drawn from `sample` rows that are themselves drawn from all. Statistics and scores are a map over
whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import drop_written, row_and, small_batches, table, texts_of, with_row, written

WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
#: Scores that share a bin are not told apart by the threshold: it is the greatest score of a bin.
BINS = 1 << 17
BLANK = b" \t\n\v\f\r"


def repeated_words(ids: np.ndarray, texts: np.ndarray, n_texts: int) -> np.ndarray:
    """For each text, how many of its words lie in a window of five words that its text has twice or more. Exact.

    ids: numbers of the words of all texts in a row; texts: the text of each. Pairs, then fours, then fives of words are
    numbered; a window can only repeat where all its pairs do.
    """
    out = np.zeros(n_texts, np.int64)
    n = len(ids)
    if n < WINDOW:
        return out
    words = int(ids.max()) + 1
    _, pair, often = np.unique((texts[:-1] * words + ids[:-1]) * words + ids[1:], return_inverse=True, return_counts=True)
    twice = often[pair] > 1
    starts = np.flatnonzero(twice[:-3] & twice[1:-2] & twice[2:-1] & twice[3:])
    starts = starts[texts[starts] == texts[starts + WINDOW - 1]]
    if len(starts):
        _, four = np.unique(pair[starts] * n + pair[starts + 2], return_inverse=True)
        _, five, often = np.unique(four * words + ids[starts + 4], return_inverse=True, return_counts=True)
        starts = starts[often[five] > 1]
        marks = np.zeros(n + 1, np.int32)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + WINDOW, -1)
        out += np.bincount(texts[np.cumsum(marks)[:n] > 0], minlength=n_texts)
    return out


def statistics(texts: list[str | None]) -> np.ndarray:
    """COUNTS of each text, as columns; all zero for null and empty ones."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    number: dict[bytes, int] = {}
    ids, rows, size = [], [], 0

    def flush():
        nonlocal size
        if rows:
            sizes = out[rows, 0]
            out[rows, 4] = repeated_words(np.array(ids, np.int64), np.repeat(np.arange(len(rows)), sizes), len(rows))
        number.clear(), ids.clear(), rows.clear()
        size = 0

    for row, text in enumerate(texts):
        if not text:
            continue
        data = text.encode()
        words = data.split()
        lines = [x for x in data.split(b"\n") if x.strip()]
        out[row, :4] = len(words), len(text) - sum(data.count(x) for x in BLANK), sum(data.count(x) for x in SYMBOLS), len(lines) - len(set(lines))
        ids += [number.setdefault(w, len(number)) for w in words]
        rows.append(row)
        size += len(words)
        if size > 200_000:
            flush()
    flush()
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """What the forest splits on: the counts per word."""
    return counts[:, 1:] / np.maximum(counts[:, :1], 1)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


class Forest:
    """Isolation trees as arrays: feature, value, left child (the right one follows); depths at leaves have the expected rest."""

    def __init__(self, x: np.ndarray, trees: int = 100, size: int = 256, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.size, self.depth = min(size, len(x)), max(1, int(np.ceil(np.log2(max(2, min(size, len(x)))))))
        self.trees = [self.grow(x[rng.choice(len(x), self.size, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def expected(n):
        """Mean path length of an unsuccessful search among n."""
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def grow(self, x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, value, left, path = [0], [0.0], [0], [0.0]
        todo = [(0, x, 0)]
        while todo:
            node, rows, depth = todo.pop()
            low, high = rows.min(0), rows.max(0)
            split = np.flatnonzero(high > low)
            if depth >= self.depth or not len(split):
                left[node], path[node] = node, depth + float(self.expected(len(rows)))
                continue
            f = int(rng.choice(split))
            v = rng.uniform(low[f], high[f])
            feature[node], value[node], left[node] = f, v, len(feature)
            for side in (rows[rows[:, f] < v], rows[rows[:, f] >= v]):
                todo.append((len(feature), side, depth + 1))
                feature.append(0), value.append(0.0), left.append(0), path.append(0.0)
        return np.array(feature), np.array(value), np.array(left), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly from 0 to 1: 2 ** (- mean path / expected path)."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                leaf = left[at] == at
                at = np.where(leaf, at, left[at] + (x[rows, feature[at]] >= value[at]))
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(1.0, float(self.expected(self.size))))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 25_600, cost: float = 10.0) -> tuple[Forest | None, float]:
    """The forest and the greatest score of documents to keep. labels: doc_id, quality (1: good). Null ids, qualities and
    texts are not learned from. With fewer than two rows of either kind there is no forest, and the base rules alone decide."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i]) for i in range(len(COUNTS)))], ["doc_id", *COUNTS])

    small_batches(docs.sparkSession)
    # counted before the join, so that no text is shuffled
    counted = rows.mapInArrow(count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))
    fine = written(counted.where("n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words").join(known, "doc_id"), "labelled")
    good, bad = (fine.where(f"{x} (quality = 1)").limit(2).count() for x in ("", "NOT"))
    if min(good, bad) < 2:
        drop_written(fine)
        return None, 1.0
    drawn = fine.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *COUNTS).limit(sample).select("quality", *COUNTS).collect()
    forest = Forest(features(np.array(sorted(map(tuple, drawn)), np.int64)[:, 1:]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([batch.column(i).to_numpy() for i in range(1, 1 + len(COUNTS))], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(features(counts)))], ["quality", "score"])

    scores = fine.select("quality", *COUNTS).mapInArrow(score, "quality int, score double")
    kinds = [F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad")]
    found = scores.groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(F.max("score").alias("step"), *kinds).collect()
    drop_written(fine)
    # a row is kept up to the threshold: each bin's greatest score is one, and none at all drops nothing
    steps = np.array(sorted((r["step"], r["good"], r["bad"]) for r in found) + [(1.0, 0, 0)])
    lost, caught = (1 - np.cumsum(steps[:, i]) / steps[:, i].sum() for i in (1, 2))
    return forest, float(steps[::-1, 0][np.argmax((caught - cost * lost)[::-1])])


def quality_rules(docs: DataFrame, forest: Forest | None, threshold: float, text: str = "text", without: tuple[str, ...] = ()) -> DataFrame:
    """All columns of docs but those in `without`, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly, kept;
    columns of these names are replaced. Null and empty texts have no words and so fail; every row is returned."""
    new = (*COUNTS, "base_failed", "anomaly", "kept")
    small_batches(docs.sparkSession)
    packed, kept = with_row(docs, text, (*new, *without))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = statistics(texts_of(batch, text))
            failed = base_failed(counts)
            anomaly = forest.score(features(counts)) if forest else np.zeros(len(counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(failed), pa.array(anomaly), pa.array(~failed & (anomaly <= threshold))], ["row", *new])

    schema = row_and(packed, ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean")
    return packed.mapInArrow(judge, schema).select(*(F.col("row")[c].alias(c) for c in kept), *new)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality_rules() of all documents, with a forest and a threshold from the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest, threshold = fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, forest, threshold, without=("text",))
