"""Aggregations: rates with their denominators, tiers that add up, tables with every level, order-free digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ledgerlight.functions.scalars import wilson


def base_rates(units: DataFrame, by: str, flagged: Column, most: float = 0.2) -> DataFrame:
    """Flags, units and their rate; an indicator tells units apart if it flags at most one in five."""
    out = units.groupBy(by).agg(F.count_if(flagged).alias("flags"), F.count("*").alias("units"))
    return out.withColumn("rate", F.col("flags") / F.col("units")).withColumn("discriminating", F.col("rate") <= most)


def with_interval(rates: DataFrame, hits: str, n: str) -> DataFrame:
    low, high = wilson(F.col(hits), F.col(n))
    return rates.withColumn("low", low).withColumn("high", high)


def coverage_tiers(universe: DataFrame, key: str, **evidence: DataFrame) -> DataFrame:
    """tier, n: each member of the universe in the first tier that has it, or in 'none'. The counts add up to the total."""
    marked = universe.select(key).distinct()
    for name, rows in evidence.items():
        marked = marked.join(rows.select(F.col(key), F.lit(True).alias(name)).distinct(), key, "left")
    tier = reduce(lambda c, name: c.when(F.col(name), name), evidence, F).otherwise("none")
    return zero_filled(marked.select(tier.alias("tier")), "tier", [*evidence, "none"])


def zero_filled(rows: DataFrame, column: str, levels: list) -> DataFrame:
    """column, n: a count for every level, zero if no row has it."""
    kind = rows.schema[column].dataType
    domain = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, levels)).cast(ArrayType(kind))).alias(column))
    return domain.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def funnel(rows: DataFrame, status: str, weight: str) -> DataFrame:
    """One row: how many rows have each status, which exclude each other, and the sum of a weight."""
    return rows.groupBy(status).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))


def field_coverage(rows: DataFrame, status_columns: list[str]) -> DataFrame:
    """indicator, status, n over all status columns."""
    long = rows.unpivot([], status_columns, "indicator", "status")
    return long.groupBy("indicator", "status").agg(F.count("*").alias("n"))


def convergence(flags: DataFrame, least: int = 2) -> DataFrame:
    """Subjects that so many different indicators flag."""
    return flags.groupBy("subject").agg(F.count_distinct("indicator").alias("indicators")).where(F.col("indicators") >= least)


def table_digest(rows: DataFrame, rendered: Column, digits: int = 2) -> DataFrame:
    """One row: a digest over all renderings, the same for any order of rows, and their number.

    A tree: rows whose sha256 begins with the same `digits` hex digits are hashed together in order of it, then up to 16
    such digests, and so on. A group has about rows / 16 ** digits members, so larger tables take more digits."""
    level = rows.select(F.sha2(rendered, 256).alias("d"), F.lit(1).cast("long").alias("n")).withColumn("p", F.col("d"))
    for width in range(digits, -1, -1):
        of = F.array_sort(F.collect_list(F.struct("p", "d")))
        grouped = level.groupBy(F.substring("p", 1, width).alias("p")) if width else level.groupBy(F.lit("").alias("p"))
        level = grouped.agg(F.sha2(F.array_join(F.transform(of, lambda x: x["d"]), ""), 256).alias("d"), F.sum("n").alias("n"))
    return level.select(F.col("d").alias("digest"), "n")


def table_checksum(rows: DataFrame, rendered: Column) -> DataFrame:
    """One row: an order-free checksum of any number of rows, by partial aggregation: count, xor and sum of 60-bit hashes."""
    h = F.conv(F.substring(F.md5(rendered), 1, 15), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("total"))


def attested_only_by(attestation: DataFrame, source: str) -> DataFrame:
    """Edges all of whose attestations have that source."""
    return attestation.groupBy("edge").agg(F.bool_and(F.col("source_name") == source).alias("only"), F.count("*").alias("n")).where("only").select("edge", "n")


def pair_sums(rows: DataFrame, keys: list[str], value: str, floor: int) -> DataFrame:
    """Counts, sums and shares of pairs within the first key, for first keys with so many rows."""
    pairs = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return pairs.withColumn("of", F.sum("n").over(Window.partitionBy(keys[0]))).where(F.col("of") >= floor).withColumn("share", F.col("n") / F.col("of"))
