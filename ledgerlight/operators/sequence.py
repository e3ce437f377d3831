"""Operators over ordered rows: anchored clusters, streaks, ranks, stride pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.sources.workdir import settled


def anchored_clusters(rows: DataFrame, keys: list[str], date: str, window: int) -> DataFrame:
    """rows with `anchor`, the first date of their cluster: rows of a key within `window` days of that date; the first row
    beyond starts the next. That is not a session, which gaps would end.

    Anchors are folded over a key's distinct dates, of which there are few however many rows the key has; each date then
    takes the last anchor up to it, by a window over the same dates.
    """
    dates = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(date)).alias("dates"))
    start = F.array().cast("array<date>")
    anchors = F.aggregate("dates", start, lambda done, d: F.when((F.size(done) > 0) & (F.date_diff(d, F.try_element_at(done, F.lit(-1))) <= window), done).otherwise(F.concat(done, F.array(d))))
    # folded before the dates are taken apart: in one select the fold would run again for each of them
    folded = dates.select(*keys, "dates", anchors.alias("anchors"))
    each = folded.select(*keys, "anchors", F.explode("dates").alias(date))
    marked = each.select(*keys, date, F.when(F.array_contains("anchors", F.col(date)), F.col(date)).alias("mark"))
    owner = marked.select(*keys, date, F.last("mark", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(date)).alias("anchor"))
    return rows.join(owner, [*keys, date])


def failure_streaks(runs: DataFrame, key: str, order: list[str], failed: Column, succeeded: Column) -> DataFrame:
    """key and each row's number of failures since the last success (gaps and islands); other rows leave it as it is."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    island = runs.withColumn("island", F.sum(F.when(succeeded, 1).otherwise(0)).over(w))
    own = Window.partitionBy(key, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("streak", F.sum(F.when(failed, 1).otherwise(0)).over(own)).drop("island")


def competition_rank(rows: DataFrame, by: str, score: str) -> DataFrame:
    """1, 1, 3 within each group: rank() leaves gaps behind ties."""
    return rows.withColumn("rank", F.rank().over(Window.partitionBy(by).orderBy(F.desc(score))))


def placed(rows: DataFrame, order: list, place: Column, name: str) -> DataFrame:
    """rows with `name`, a place over all of them: row_number() or rank(), counted within ranges of the order and added to
    what lies before the range. The ranges are stored, since they are read twice; equal rows lie in one range."""
    ranged = settled(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    ahead = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))  # a row for each range
    within = place.over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(ahead, "_range").select(*rows.columns, (within + F.col("_ahead")).alias(name))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the greatest order; rows with a null order come last."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def last_write(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Upsert by natural key: the last row in input order stays. An aggregation, so map-side combined."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), sequence).alias("row")).select("row.*")


def first_write(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Get or create: the first row in input order stays."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), sequence).alias("row")).select("row.*")


def stride_pairs(people: DataFrame, companies: DataFrame, adjacent: DataFrame, n: int, most: int = 20) -> DataFrame:
    """n pairs (person 7i, company 13i, each modulo their number) in order of i, adjacent pairs left out; i ends at most * n.

    people, companies: id; adjacent: source, target, in either direction.
    """
    numbered = lambda df, name: placed(df.select(F.col("id").alias(name)), [name], F.row_number(), "place").withColumn(f"{name}_no", F.col("place") - 1).drop("place")
    p, c = numbered(people, "person"), numbered(companies, "company")
    sizes = p.agg(F.count("*").alias("persons")).crossJoin(c.agg(F.count("*").alias("companys")))  # one row
    steps = people.sparkSession.range(most * n).crossJoin(F.broadcast(sizes)).select("id", (F.col("id") * 7 % F.col("persons")).alias("person_no"), (F.col("id") * 13 % F.col("companys")).alias("company_no"))
    pairs = steps.join(p, "person_no").join(c, "company_no")
    both = adjacent.select("source", "target").union(adjacent.select("target", "source"))
    free = pairs.join(both, (F.col("person") == F.col("source")) & (F.col("company") == F.col("target")), "left_anti")
    return free.orderBy("id").limit(n).select(F.col("id").alias("i"), "person", "company")
