"""Language identification by word-first backoff.

A known word scores its log frequency in each language. For an unseen word the character n-grams of the longest length of
which any is known score instead, by their mean: four, three, two, then one character. The language with the greatest
sum over all words of the whole text wins.

The model is fitted on a bounded sample of labelled rows (`sample` per language) and has at most `words` words and
`grams` n-grams a language, so what is sent to the executors does not grow with the corpus. Prediction is a map.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import kept_by_worker, row_and, small_batches, table, texts_of, with_row

LONGEST = 4
CACHE = 100_000


def letters():
    """text -> its words: lower-cased runs of word characters other than digits and underscores, with at least one letter."""
    find = re.compile(r"[^\W\d_]+").findall
    # numbers of other kinds (fractions, numerals) are word characters too, though rare
    return lambda text: [w for w in find(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between marks of its start and end; of length one without marks."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i: i + n] for i in range(len(marked) - n + 1)]


def fit(labelled: DataFrame, sample: int = 2000, words: int = 30_000, grams: int = 30_000, text: str = "text", lang: str = "lang") -> dict:
    """{"langs": [...], "words": {word: scores}, "grams": {gram: scores}}, scores a tuple of log frequencies by language.

    labelled: text and lang. Rows with a null in either are not learned from. Of each language about `sample` rows are
    taken, by a hash of their text, or all if it has fewer.
    """
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    sizes = dict(map(tuple, rows.groupBy("lang").count().collect()))
    if not sizes:
        return {"langs": [], "words": {}, "grams": {}}
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))))
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = letters()
        found: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(split(text))
        for lang, seen in found.items():
            parts: Counter = Counter()
            for word, n in seen.items():
                for size in range(1, LONGEST + 1):
                    for gram in grams_of(word, size):
                        parts[gram] += n
            for kind, counts in (("w", seen), ("g", parts)):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array([kind] * len(counts)), pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["lang", "kind", "token", "n"])

    counted = chosen.mapInArrow(count, "lang string, kind string, token string, n long").groupBy("lang", "kind", "token").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "token")
    best = counted.where("n > 1 OR kind = 'g'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.when(F.col("kind") == "w", words).otherwise(grams))
    langs = sorted(sizes)
    tables: dict[str, dict[str, list[int]]] = {"w": {}, "g": {}}
    for lang_, kind, token, n in best.select("lang", "kind", "token", "n").toLocalIterator():
        tables[kind].setdefault(token, [0] * len(langs))[langs.index(lang_)] = n
    model: dict = {"langs": langs}
    for kind, name in (("w", "words"), ("g", "grams")):
        # an n-gram's frequency is that among the n-grams of its length
        length = (lambda t: 0) if kind == "w" else len
        totals: dict[int, np.ndarray] = {}
        for token, n in tables[kind].items():
            totals[length(token)] = totals.get(length(token), 0) + np.array(n, float)
        model[name] = {t: tuple(np.log((np.array(n) + 0.1) / (totals[length(t)] + 0.1 * len(tables[kind]))).tolist()) for t, n in tables[kind].items()}
    return model


class Scorer:
    def __init__(self, model: dict):
        self.langs, self.words, self.grams = model["langs"], model["words"], model["grams"]
        self.split = letters()
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((CACHE, len(self.langs)))

    def row(self, word: str) -> int:
        """Where the word's scores stand."""
        at = self.rows.get(word)
        if at is None:
            if len(self.rows) >= CACHE:
                self.rows.clear()
            at = self.rows[word] = len(self.rows)
            self.scores[at] = self.score(word)
        return at

    def score(self, word: str):
        if known := self.words.get(word):
            return known
        for n in range(LONGEST, 0, -1):
            if found := [x for g in grams_of(word, n) if (x := self.grams.get(g))]:
                return np.mean(found, axis=0)
        return 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        words = self.split(text) if text else []
        if not words or not self.langs:
            return "und", 0.0
        total = np.zeros(len(self.langs))
        for i in range(0, len(words), 10_000):
            part = words[i: i + 10_000]
            if len(self.rows) + len(part) > CACHE:
                self.rows.clear()
            total += self.scores[[self.row(w) for w in part]].sum(0)
        # the posterior as if from ten words at most: words of a text are far from independent
        likely = np.exp((total - total.max()) / len(words) * min(len(words), 10))
        best = int(total.argmax())
        return self.langs[best], float(likely[best] / likely.sum())


def identify(docs: DataFrame, model: dict, text: str = "text", without: tuple[str, ...] = ()) -> DataFrame:
    """All columns of docs but those in `without`, and lang_pred, score (0 to 1); columns of these names are replaced.

    Null texts and texts without a letter, and all texts if the model has no language, are `und` with score 0.
    """
    small_batches(docs.sparkSession)
    packed, kept = with_row(docs, text, ("lang_pred", "score", *without))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex  # a Python worker keeps the scorer, and the words it has seen, for its later tasks

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept_by_worker(name, lambda: Scorer(shared.value))
        for batch in batches:
            found = [scorer.predict(x) for x in texts_of(batch, text)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["row", "lang_pred", "score"])

    out = packed.mapInArrow(predict, row_and(packed, "lang_pred string, score double"))
    return out.select(*(F.col("row")[c].alias(c) for c in kept), "lang_pred", "score")


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text, modulo 3, is one. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() of all documents, by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = fit(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model, without=("text",)).select("doc_id", "held_out", "lang_pred", "score")
