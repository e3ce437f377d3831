"""Embedding whitening by Chan's merging of partial covariances.

Each partition sums up its vectors as count, sums and scatter centred at its own mean; two such summaries are merged by
Chan's pairwise formula, in a tree. The driver gets one matrix (dimensions squared), whose eigenvectors whiten the
vectors; a second pass over the fitted vectors summarises what they become in the same way, and tells how far its
covariance is from the identity. The model is fitted on each distinct vector once, so copies have no weight.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import named, table, written

#: Components with less than this share of the variance are none: they are what rounding leaves of a constant.
LEAST = 1e-12


Summary = tuple[int, list, np.ndarray]  # of vectors: how many, their sums (exact for integers), their scatter centred at their mean


def summed(x: np.ndarray) -> Summary:
    exact = x.dtype.kind == "i" and len(x) * max(abs(int(x.min())), abs(int(x.max()))) >= 1 << 63
    sums = (x.astype(object) if exact else x).sum(axis=0).tolist()
    centred = x - mean_of(len(x), sums)
    return len(x), sums, centred.T @ centred


def mean_of(n: int, sums: list) -> np.ndarray:
    return np.array([s / n for s in sums])


def merged(a: Summary, b: Summary) -> Summary:
    """Chan's formula: the means' distance adds to the scatters."""
    n = a[0] + b[0]
    apart = mean_of(b[0], b[1]) - mean_of(a[0], a[1])
    return n, [s + t for s, t in zip(a[1], b[1])], a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


@dataclass(frozen=True)
class Whitening:
    """basis: the leading components, one a column, by falling variance; each with its largest entry positive."""

    n: int
    sums: list
    mean: np.ndarray
    basis: np.ndarray
    variance: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.basis / np.sqrt(self.variance)


def matrix(column: pa.ListArray) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summary(vectors: DataFrame, model: Whitening | None = None) -> Summary:
    """vectors: x, arrays of one length, one at least. The summary of them all, or of what a model makes of them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                more = summed(x if model is None else model.apply(x))
                found = more if found is None else merged(found, more)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["summary"])

    parts = vectors.select("x").mapInArrow(partial, "summary binary").rdd
    return parts.map(lambda r: pickle.loads(r[0])).treeReduce(merged)


def usable(df: DataFrame, scale: int | None, vector: str = "embedding") -> DataFrame:
    """The rows of df whose vector is not null and has only finite entries, with x: the entries as doubles or, if a scale is
    given, as integers floor(scale * entry), those beyond the range of long at its ends. Vectors of another length than
    the commonest (of two, the longer) and empty ones have no place among the others and are left out."""
    entries = F.col(vector).cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(entries, lambda c: F.floor(c * scale) if scale else c + 0.0)
    rows = df.select(*named([c for c in df.columns if c != "x"]), F.when(fine & (F.size(entries) > 0), x).alias("x")).where("x IS NOT NULL")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (common["d"] if common else 0))


def fit_whitening(vectors: DataFrame, components: int) -> Whitening | None:
    """vectors: x, distinct, of one length. None if there is none, or all variance is zero."""
    if not vectors.take(1):
        return None
    n, sums, scatter = summary(vectors)
    values, basis = np.linalg.eigh(scatter / n)
    trace = float(np.trace(scatter) / n)
    order = [i for i in np.argsort(-values, kind="stable") if values[i] > LEAST * trace][:components]
    if not order:
        return None
    basis = basis[:, order]
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(len(order))])
    return Whitening(n, sums, mean_of(n, sums), basis, values[order], trace)


def deviations(x: np.ndarray, model: Whitening) -> pa.Array:
    """For integer vectors the sum of (n * x - sums) ** 2 over the dimensions, exact; null beyond the range of long."""
    largest = max(abs(int(x.min())), abs(int(x.max()))) * model.n + max(map(abs, model.sums))
    if largest**2 * x.shape[1] < 1 << 63:
        return pa.array(((model.n * x - np.array(model.sums, np.int64)) ** 2).sum(axis=1))
    exact = ((model.n * x.astype(object) - np.array(model.sums, object)) ** 2).sum(axis=1)
    return pa.array([s if s < 1 << 63 else None for s in exact.tolist()], pa.int64())


def whiten(df: DataFrame, components: int = 64, scale: int | None = None, vector: str = "embedding") -> DataFrame:
    """The usable() rows of df (its columns but `x`, `white` and those named below) with white: its whitened vector, a double
    for each of the leading components; and the same for all rows: n (distinct vectors fitted on), explained (each
    component's share of the variance) and identity_error (the largest entry of the whitened vectors' covariance minus the
    identity, from a second pass). With a scale also deviation: see deviations().

    Components without variance are left out; if there are no others, or no row, no row is returned. Rows with a null
    or repeated id are each returned; ids and labels aren't used.
    """
    spark = df.sparkSession
    added = ("x", "white", "n", "explained", "identity_error", "deviation")
    rows = usable(df.select(*named([c for c in df.columns if c not in added or c == vector])), scale, vector)
    fit = written(rows.select("x").distinct(), "vectors")
    model = fit_whitening(fit, components)
    if model is None:
        columns = [f"CAST(NULL AS {t}) AS {c}" for c, t in (("deviation", "long"), ("white", "array<double>"), ("n", "long"), ("explained", "array<double>"), ("identity_error", "double"))]
        return rows.selectExpr("*", *columns).drop("x").limit(0)
    n, _, scatter = summary(fit, model)
    error = float(np.abs(scatter / n - np.eye(len(model.variance))).max())
    shared = spark.sparkContext.broadcast(model)  # components times dimensions

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                white = shared.value.apply(x)
                deviation = deviations(x, shared.value) if x.dtype.kind == "i" else pa.nulls(len(x), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, white.shape[1]), pa.int32()), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], ["row", "deviation", "white"])

    kept = [c for c in rows.columns if c != "x"]
    packed = rows.select(F.struct(*named(kept)).alias("row"), "x")
    kind = packed.schema["row"].dataType.simpleString()
    out = packed.mapInArrow(compute, f"row {kind}, deviation long, white array<double>")
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.variance))
    return out.select(*(F.col("row")[c].alias(c) for c in kept), "deviation", "white", F.lit(model.n).cast("long").alias("n"), explained.alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every usable embedding: see whiten()."""
    found = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=4, scale=256)
    each = found.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("white").alias("place", "whitened"))
    return each.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("place")].alias("explained"), "identity_error")
