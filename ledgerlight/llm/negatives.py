"""Hard-negative mining by a two-dimensional block matrix multiply.

Anchors and rows are cut into blocks, and both into chunks of dimensions. The scores of a tile (a block of anchors against a
block of rows) are the sum over chunks of partial products: each (anchor block, row block, chunk) is multiplied where its two
panels meet, the partial int64 tiles are shuffled to their tile and added there one after the other, and a tile gives only
the best rows of each anchor, or of each anchor's window under a positive, to be reduced over all tiles.

Blocks hold rows of one bucket of labels. Positives are looked for in tiles of an anchor block's own bucket only, negatives,
once the positives' scores are known, in all tiles. So the product is made about once; a frequent label has many blocks like
any other; and a task holds a batch of panels and one tile.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import drop_written, small_batches, table, written

#: Rows of a block of anchors and of a block of rows, dimensions of a chunk, buckets of labels.
ANCHORS, ROWS, CHUNK, BUCKETS = 64, 1024, 32, 16
#: A block is told by its bucket times this, plus its number in the bucket.
SHIFT = 1 << 32
PANEL = "block long, chunk int, size int, who binary, panel binary"
PARTIAL = "i long, j long, chunk int, who_a binary, who_b binary, tile binary"


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], [f for f, _ in fields])


def narrow(x: np.ndarray) -> bytes:
    """A matrix of integers, in the fewest bytes an entry that hold all of them."""
    most = max(int(x.max(initial=0)), -1 - int(x.min(initial=0)))
    return np.ascontiguousarray(x, f"<i{next(n for n in (1, 2, 4, 8) if most < 1 << (8 * n - 1))}").tobytes()


def wide(data: bytes, rows: int, columns: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (rows * columns)}").reshape(rows, columns).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: in doubles if all sums stay below 2 ** 53."""
    bound = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if bound < 1 << 53 else a @ b.T


def scaled(df: DataFrame, scale: int, vector: str) -> DataFrame:
    """vec_id, label, x (floor(scale * entry) as long) of the rows that take part, one a vec_id."""
    entries = F.col(vector).cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.when(fine, F.transform(entries, lambda c: F.floor(c * scale)))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x")).dropna()
    again = rows.groupBy("vec_id").count().where("count > 1").take(1)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("m")).select("vec_id", "m.*") if again else rows


def blocks_in(n: int, size: int) -> int:
    """Blocks of a bucket with n rows that are dealt out by hash: few get more than `size`."""
    return max(1, -(-5 * n // (4 * size)))


def panels(rows: DataFrame, counts: dict[int, int], size: int, width: int, more: Column) -> DataFrame:
    """PANEL rows of rows (vec_id, label, bucket, x): a block's rows, in the order of vec_id, once for each chunk of dimensions.
    who, with the first chunk only: their ids, labels and `more`. Shorter vectors count as filled up with zeros."""
    # of width * limit ** 2 < 2 ** 62, so that every score is in the range of long
    limit = isqrt((1 << 62) // width)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                held = sorted(r["held"], key=lambda h: h["vec_id"])
                x = np.zeros((len(held), -(-width // CHUNK) * CHUNK), np.int64)
                for to, h in zip(x, held):
                    to[: len(h["x"])] = h["x"]
                x = np.clip(x, -limit, limit)
                who = pickle.dumps((*(np.array([h[k] for h in held], np.int64) for k in ("vec_id", "label")), [h["more"] for h in held]))
                yield batch_of(PANEL, [(r["block"], k // CHUNK, len(held), None if k else who, narrow(x[:, k: k + CHUNK])) for k in range(0, x.shape[1], CHUNK)])

    many = F.create_map(*(F.lit(v) for b, n in counts.items() for v in (b, blocks_in(n, size))))
    block = F.col("bucket") * F.lit(SHIFT) + F.pmod(F.xxhash64("vec_id"), many[F.col("bucket")])
    grouped = rows.groupBy(block.alias("block")).agg(F.collect_list(F.struct("vec_id", "label", "x", more.alias("more"))).alias("held"))
    return grouped.mapInArrow(cut, PANEL)


def every_block(counts: dict[int, int], size: int) -> Column:
    """All blocks of all buckets, as an array: made on the executors from the buckets' counts."""
    runs = [F.sequence(F.lit(b * SHIFT).cast("long"), F.lit(b * SHIFT + blocks_in(n, size) - 1).cast("long")) for b, n in counts.items()]
    return F.concat(*runs)


def tiles(a: DataFrame, b: DataFrame, a_counts: dict[int, int], b_counts: dict[int, int], own: bool, reduce: Callable, schema: str) -> DataFrame:
    """What reduce(who of a, who of b, scores) gives, a list of rows, for each tile; with `own` only tiles within a bucket."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, k, n_a, who_a, panel_a, n_b, who_b, panel_b in zip(*(c.to_pylist() for c in batch.columns)):
                yield batch_of(PARTIAL, [(i, j, k, who_a, who_b, narrow(product(wide(panel_a, n_a, CHUNK), wide(panel_b, n_b, CHUNK))))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, a, b, scores = None, None, None, None

        def reduced() -> Iterator[pa.RecordBatch]:
            found = reduce(a, b, scores) if at else []
            if found:
                yield batch_of(schema, found)

        for batch in batches:
            for i, j, k, who_a, who_b, tile in zip(*(c.to_pylist() for c in batch.columns)):
                if (i, j) != at:
                    yield from reduced()
                    at, a, b = (i, j), pickle.loads(who_a), pickle.loads(who_b)
                    scores = np.zeros((len(a[0]), len(b[0])), np.int64)
                scores += wide(tile, *scores.shape)
        yield from reduced()

    bucket = lambda c: F.floor(F.col(c) / F.lit(SHIFT))
    within = lambda c, counts, size: F.filter(every_block(counts, size), lambda o: F.floor(o / F.lit(SHIFT)) == bucket(c)) if own else every_block(counts, size)
    left = a.select(F.col("block").alias("i"), F.explode(within("block", b_counts, ROWS)).alias("j"), "chunk", "size", "who", "panel")
    right = b.select(F.explode(within("block", a_counts, ANCHORS)).alias("i"), F.col("block").alias("j"), "chunk", *(F.col(c).alias(f"{c}_b") for c in ("size", "who", "panel")))
    # each key has one panel on either side
    partial = left.join(right.hint("merge"), ["i", "j", "chunk"]).select("i", "j", "chunk", "size", "who", "panel", "size_b", "who_b", "panel_b").mapInArrow(multiply, PARTIAL)
    return partial.repartition("i", "j").sortWithinPartitions("i", "j", "chunk").mapInArrow(add, schema)


def best(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, ties in their order."""
    return np.argsort(-scores, kind="stable")[:n]


def hard_negatives(df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null vec_id, label or vector, or with any null or non-finite entry, take no part; of rows with one vec_id the
    least by label and vector does. Entries become floor(scale * entry); a score is the inner product of two vectors. Anchors
    are rows whose vec_id is divisible by `every`; their positives the first `positives` other rows of the same label, by
    falling score and rising vec_id; for each anchor and positive the first `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score are returned, ranked from 1. All if there are fewer.
    Shorter vectors count as filled up with zeros; integers beyond sqrt(2 ** 62 / dimensions) count as that, so that scores
    are in the range of long. Other columns are ignored. Without an anchor, a positive or a negative there is no row.
    """
    spark = df.sparkSession
    small_batches(spark, 256)
    rows = written(scaled(df, scale, vector).withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS))), "rows")
    anchors = rows.where(F.col("vec_id") % every == 0)
    counted = lambda rows: {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    b_counts, a_counts = counted(rows), counted(anchors)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not a_counts:
        return spark.createDataFrame([], out)
    width = max(1, rows.agg(F.max(F.size("x"))).first()[0])
    none = F.lit(None).cast("array<struct<positive_score:long,positive_id:long>>")
    b = written(panels(rows, b_counts, ROWS, width, none), "panels")

    def nearest(a: tuple, b: tuple, scores: np.ndarray) -> list[tuple]:
        found = []
        for anchor, label, row in zip(a[0].tolist(), a[1].tolist(), scores):
            others = np.flatnonzero((b[1] == label) & (b[0] != anchor))
            first = others[best(row[others], positives)]
            found += zip([anchor] * len(first), b[0][first].tolist(), row[first].tolist())
        return found

    def below(a: tuple, b: tuple, scores: np.ndarray) -> list[tuple]:
        found = []
        for anchor, label, under, row in zip(a[0].tolist(), a[1].tolist(), a[2], scores):
            others = np.flatnonzero(b[1] != label)
            others = others[best(row[others], len(others))]
            falling = -row[others]
            for p in under:
                score = p["positive_score"]
                start = int(np.searchsorted(falling, -(high * score // 100)))
                stop = int(np.searchsorted(falling, low * -score // 100, side="right"))
                for at in others[start: min(stop, start + negatives)].tolist():
                    found.append((anchor, p["positive_id"], score, int(b[0][at]), int(row[at])))
        return found

    near = tiles(panels(anchors, a_counts, ANCHORS, width, none), b, a_counts, b_counts, True, nearest, "anchor_id long, positive_id long, positive_score long")
    ranked = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    near = near.withColumn("rank", ranked).where(F.col("rank") <= positives)
    near = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_score", "positive_id")).alias("under"))
    with_positives = written(anchors.join(near, "vec_id"), "anchors")
    if not (a_counts := counted(with_positives)):
        return spark.createDataFrame([], out)
    found = tiles(panels(with_positives, a_counts, ANCHORS, width, F.col("under")), b, a_counts, b_counts, False, below, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    ranked = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", ranked).where(F.col("rank") <= negatives).select(*(f.split()[0] for f in out.split(", ")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of embeddings, with the labels of every seventh row shifted: see hard_negatives()."""
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
