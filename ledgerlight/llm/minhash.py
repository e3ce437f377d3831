"""MinHash near-dedup by bottom-k sketches from one hash function.

A text's sketch is the k least hashes of its set of word shingles. Of two sets with Jaccard similarity s, each of the k
least hashes of their union is in both with probability s, and is then in both sketches; so all but a negligible share of
similar pairs have at least `least_overlap()` values in common. Inverted lists of sketch values find who shares a value.
Of a sketch only so many values are listed that a pair with that overlap still shares a listed one, whatever the order of
values, and the order puts the most frequent values of all sketches last: passages that many texts share are seldom listed.

Candidates are estimated from their sketches (the share of the union's k least hashes that both have) and those that may be
similar are verified on the full sets. Lists of two or three texts are told by an aggregation; in longer lists every text is
compared with its best connected neighbour, and then with all members it isn't connected with yet, in blocks: no link is
lost, and a large group of near copies costs one pair a text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import components, drop_written, free_shuffles, kept_by_worker, small_batches, table, written
from ledgerlight.llm.decontam import shingle_hashes
from ledgerlight.llm.simhash import WORDS, folded_bits, hub_pairs, joined_by_runs, other_pairs, told_and_crowded

#: Values of a sketch, and the probability with which one pair at the least similarity may have a smaller overlap.
K, RISK = 64, 1e-15
#: Most frequent values that are sent to all tasks, to be listed last.
COMMON = 100_000


def least_overlap(k: int, percent: int, risk: float = RISK) -> int:
    """The least c of which at most `risk` remains below: k draws, each a hit with the given percentage, hit c times or more."""
    p, below = percent / 100, 0.0
    for c in range(k + 1):
        below += math.comb(k, c) * p**c * (1 - p) ** (k - c)
        if below > risk:
            return c
    return k


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text's words (A-Z lower-cased, split at ASCII white space);
    of all words as one shingle, if they are fewer; none without a word."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else ()
    return np.unique(shingle_hashes(np.array(list(map(xxh64_intdigest, words)), np.uint64), shingle)) if words else np.zeros(0, np.uint64)


def bottom_k(docs: DataFrame, shingle: int, k: int, text: str) -> DataFrame:
    """doc_id, th (the text's digest), n (set size), same (the set's digest), bits (parity of the set's hashes that fall on
    each of 64 * WORDS places) and sketch (the k least hashes, ascending as unsigned numbers)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh128_digest

        for batch in batches:
            sizes, same, bits, kept, ends = [], [], np.zeros((batch.num_rows, WORDS), np.uint64), [np.zeros(0, np.uint64)], [0]
            for row, body in enumerate(batch.column(2).to_pylist()):
                h = shingle_set(body, shingle)
                odd = np.bincount(((h >> np.uint64(20)) & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
                bits[row] = folded_bits(np.packbits(odd.astype(np.uint8), bitorder="little"), 8 * WORDS).view("<u8")
                sizes.append(len(h)), same.append(xxh128_digest(h.tobytes())), kept.append(h[:k]), ends.append(ends[-1] + len(kept[-1]))
            lists = lambda offsets, x: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), lists(np.arange(0, bits.size + 1, WORDS), bits.ravel()), lists(ends, np.concatenate(kept))],
                ["doc_id", "th", "n", "same", "bits", "sketch"],
            )

    return docs.mapInArrow(compute, "doc_id long, th binary, n long, same binary, bits array<long>, sketch array<long>")


def listed(sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """sketches with `keys`: the values under which a text stands in the inverted lists. Two sketches with an overlap of c
    share one of their first |sketch| - c + 1 values, in any order that is the same for all."""
    often = sketches.select(F.explode("sketch").alias("v")).groupBy("v").agg(F.count("*").alias("n")).where("n > 3")
    top = np.array([r["v"] for r in often.orderBy(F.desc("n"), "v").limit(COMMON).collect()], np.int64)
    shared = sketches.sparkSession.sparkContext.broadcast(top[::-1].copy())
    least = least_overlap(k, percent)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.argsort(shared.value)
        known = shared.value[rank]
        for batch in batches:
            flat, ends = batch.column(2).flatten().to_numpy(), batch.column(2).offsets.to_numpy()
            ends = ends - ends[0]
            place = np.zeros(len(flat), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                place = np.where(known[at] == flat, rank[at] + 1, 0)
            keys, stops = [np.zeros(0, np.int64)], [0]
            for n, a, b in zip(batch.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                # of a set that is known as a whole no more than all similar ones have
                taken = b - a - min(least, -(-percent * n // 100)) + 1
                keys.append(flat[a:b][np.argsort(place[a:b], kind="stable")[:taken]])
                stops.append(stops[-1] + len(keys[-1]))
            lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "keys"])

    return sketches.select("id", "n", "sketch").mapInArrow(compute, "id long, keys array<long>")


def may_be_similar(a: np.ndarray, b: np.ndarray, k: int, percent: int, least: int) -> bool:
    """By two sketches: whether the share of the union's k least hashes that both have allows for the similarity. Where the
    union has no more than k, that share is the similarity itself."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    union = np.union1d(a, b)[:k]
    both = len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True))
    whole = len(a) < k and len(b) < k and len(union) < k
    return 100 * both >= percent * len(union) if whole else both >= least


def estimated(pairs: DataFrame, sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (u, v) those whose sketches allow for the similarity."""
    least = least_overlap(k, percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*((x.values.to_numpy()[i:j] for i, j in zip(x.offsets.to_numpy(), x.offsets.to_numpy()[1:])) for x in (batch.column(2), batch.column(3))))
            yes = pa.array([may_be_similar(a, b, k, percent, least) for a, b in sides], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(yes), batch.column(1).filter(yes)], ["u", "v"])

    of = lambda x: sketches.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    sized = pairs.join(of("u"), "u").join(of("v"), "v").where(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))
    return sized.select("u", "v", "sketch_u", "sketch_v").mapInArrow(compare, "u long, v long")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union. texts: id, text (binary)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, own = None, None
        kept_by_worker("", lambda: None)
        for batch in batches:
            yes = []
            for u, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if u != before:
                    before, own = u, shingle_set(a, shingle)
                other = shingle_set(b, shingle)
                both = len(np.intersect1d(own, other, assume_unique=True))
                yes.append(100 * both >= percent * (len(own) + len(other) - both))
            yes = pa.array(yes, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(yes), batch.column(1).filter(yes)], ["u", "v"])

    of = lambda x, name: texts.select(F.col("id").alias(x), F.col("text").alias(name))
    return pairs.join(of("v", "b"), "v").join(of("u", "a"), "u").select("u", "v", "a", "b").mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 85, k: int = K, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs.

    A text's set are the distinct shingles of its words (A-Z lower-cased, split at ASCII white space), or all words as one
    shingle if they are fewer. Texts are linked if 100 * intersection >= percent * union; component_id is the smallest
    doc_id that is reached over links, the row's own included; kept tells rows whose doc_id that is. Null and empty texts,
    and texts without a word, have no shingle and are linked with nothing. Rows with a null doc_id take part, but are never
    the smallest; a component of nulls alone has a null id and its rows are kept. Rows repeated in doc_id and text are each
    returned, with the same values. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    body = F.col(text).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(body)).alias("th"), body.cast("binary").alias("text"))
    made = written(bottom_k(rows, shingle, k, "text").withColumn("r", F.monotonically_increasing_id()), "sketches")
    # texts with the same set are one, told by one of their rows
    classes = made.where("n > 0").groupBy("same").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "r")).alias("one"))
    classes = written(classes.select("same", "least", F.col("one.r").alias("id")), "classes")
    own = written(made.join(classes.select(F.col("id").alias("r")), "r").select(F.col("r").alias("id"), "doc_id", "th", "n", "bits", "sketch"), "sketches")
    free_shuffles(spark)
    keyed = written(listed(own, k, percent), "listed")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = written(estimated(pairs, own, k, percent), "pairs")
        free_shuffles(spark)
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        wanted = own.join(wanted, "id").select("id", F.col("doc_id").alias("d"), F.col("th").alias("t"))
        texts = rows.join(wanted, (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("id", "text")
        texts = written(texts.dropDuplicates(["id"]) if again else texts, "texts")
        links = written(confirmed(pairs, texts, shingle, percent), "links")
        drop_written(texts, pairs)
        free_shuffles(spark)
        return links

    again = bool(made.groupBy("th", "doc_id").count().where("count > 1").take(1))
    told, crowded = told_and_crowded(keyed)
    links = linked(told.unionByName(hub_pairs(crowded)).distinct())
    links = joined_by_runs(links, linked, keyed, crowded, own, percent / 100)
    more = written(other_pairs(crowded, own, components(links), percent / 100), "pairs")
    if more.take(1):
        links = links.unionByName(linked(more))
    drop_written(told, crowded, keyed, more)
    grouped = classes.join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = grouped.join(least, "root").select("same", "component_id")
    free_shuffles(spark)
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    found = made.select("doc_id", "n", "same").join(labels, "same", "left").select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of near-duplicate documents: see near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "documents"))
