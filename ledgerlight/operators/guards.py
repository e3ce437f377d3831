"""Guards on what leaves the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN = ("open", "attribution")


def open_export(rows: DataFrame) -> DataFrame:
    """Only rows of tier a whose licence lets them be passed on; unknown tiers and licences are not."""
    return rows.where((F.col("tier") == "a") & F.col("redistribution").isin(*OPEN))


def require_open(tier: str, redistribution: str) -> None:
    """The same for one record: raises."""
    if tier != "a" or redistribution not in OPEN:
        raise PermissionError(f"tier {tier}, redistribution {redistribution}: not for export")


def entity_summary(entity: DataFrame) -> DataFrame:
    """What may be shown of an entity: its properties are never read."""
    return entity.select("id", "entity_type", "name", "scheme", "registry_id")


def with_provenance(flags: DataFrame, **record: str) -> DataFrame:
    """flags with a provenance struct; raises if a field is empty."""
    if missing := [k for k, v in record.items() if not v]:
        raise ValueError(f"provenance without {missing}")
    return flags.withColumn("provenance", F.struct(*(F.lit(v).alias(k) for k, v in record.items())))


def registry_problems(entries: DataFrame) -> DataFrame:
    """source_id, problems of a source register's entries: what keeps one from being used. entries: source_id, tier,
    redistribution, url, sla_days, all strings."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    n = entries.groupBy(F.col("source_id").alias("_s")).agg(F.count("*").alias("_n"))
    rules = [
        (blank("source_id"), "no source_id"), (F.col("_n") > 1, "source_id used twice"), (~F.coalesce(F.col("tier").isin("a", "b", "c"), F.lit(False)), "unknown tier"), (blank("redistribution"), "no licence"),
        (~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)), "no url"), (F.coalesce(F.col("sla_days").try_cast("int") <= 0, F.lit(True)), "no agreed days")]
    found = F.filter(F.array(*(F.when(cond, F.lit(what)) for cond, what in rules)), lambda x: x.isNotNull())
    return entries.join(n, F.col("source_id").eqNullSafe(F.col("_s"))).select("source_id", found.alias("problems"))
