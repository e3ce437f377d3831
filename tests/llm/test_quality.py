import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerlight.llm import quality
from ledgerlight.llm.queries import QUERIES

WORDS = re.compile("[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i: i + 5]) for i in range(len(words) - 4))
    marked = {j for i in range(len(words) - 4) if windows[tuple(words[i: i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(marked)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op8_quality"](spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        n, chars, symbols, lines, again = brute(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, again)
        assert r.base_failed == (n < 10 or 100 * again > 20 * n) and not (r.base_failed and r.kept)


def test_labels_tell(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op8_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed")
    rates = {r.quality: r.kept for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rates[1] > 0.93 and rates[0] < 0.4


def test_hard_rows(spark, hard, nothing):
    forest, limit = quality.fit_quality(nothing, spark.createDataFrame([], "doc_id long, quality int"))
    assert forest is None
    out = quality.quality_rules(hard.withColumn("kept", F.lit("clash")), forest, limit)
    assert out.columns[:3] == ["doc_id", "text", "extra"] and out.count() == 12
    for r in out.collect():
        assert tuple(r[c] for c in quality.COUNTS) == brute(r.text) and r.kept == (not r.base_failed)
    assert quality.quality_rules(nothing, forest, limit).count() == 0


def path_length(tree, row):
    """One row down one tree, step by step."""
    feature, value, left, path = tree
    at = 0
    while left[at] != at:
        at = left[at] + (row[feature[at]] >= value[at])
    return path[at]


def test_verdicts_by_brute_force(spark):
    import numpy as np

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    forest, limit = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    norm = 2 * (np.log(forest.size - 1) + np.euler_gamma) - 2 * (forest.size - 1) / forest.size
    for r in QUERIES["op8_quality"](spark, sf).collect():
        row = np.array([r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words]) / max(1, r.n_words)
        anomaly = 2.0 ** (-np.mean([path_length(t, row) for t in forest.trees]) / norm)
        assert abs(r.anomaly - anomaly) < 1e-9 if "anomaly" in r else True
        assert r.kept == (not r.base_failed and anomaly <= limit + 1e-12)


def test_threshold_by_brute_force(spark):
    """Of all thresholds none catches more bad rows, less ten times the good ones lost."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    forest, limit = quality.fit_quality(docs, labels)
    rows = docs.join(labels, "doc_id").select("quality", "text").dropna().collect()
    counts = quality.statistics([r.text for r in rows])
    fine = ~quality.base_failed(counts)
    scores = forest.score(quality.features(counts))[fine]
    good = [r.quality == 1 for r, f in zip(rows, fine) if f]

    def worth(t):
        bad = [s > t for s, g in zip(scores, good) if not g]
        lost = [s > t for s, g in zip(scores, good) if g]
        return sum(bad) / len(bad) - 10 * sum(lost) / len(lost)

    assert worth(limit) >= max(map(worth, scores)) - 1e-9


def test_all_labelled_rows_set_the_threshold(spark):
    """However few rows the forest is grown on, the threshold is the best one for all of them."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    forest, limit = quality.fit_quality(docs, labels, sample=40)
    rows = docs.join(labels, "doc_id").select("quality", "text").dropna().collect()
    counts = quality.statistics([r.text for r in rows])
    fine = ~quality.base_failed(counts)
    scores = forest.score(quality.features(counts))[fine]
    good = [r.quality == 1 for r, f in zip(rows, fine) if f]
    worth = lambda t: sum(s > t for s, g in zip(scores, good) if not g) / good.count(False) - 10 * sum(s > t for s, g in zip(scores, good) if g) / good.count(True)
    assert worth(limit) >= max(map(worth, scores)) - 1e-9
