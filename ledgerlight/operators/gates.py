"""Gates and verdicts: what is not measured does not pass, and malformed counts raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(counts: DataFrame) -> DataFrame:
    """counts: family, ingested, failed, missing, total. Adds accounted and passed (all accounted for, and some to account for).

    Raises at once if a count is negative or parts do not add up to the total."""
    parts = F.col("ingested") + F.col("failed") + F.col("missing")
    bad = counts.where(F.coalesce((F.least("ingested", "failed", "missing", "total") < 0) | (parts != F.col("total")), F.lit(True)))
    if wrong := bad.take(1):
        raise ValueError(f"coverage counts do not add up: {wrong[0]}")
    done = F.col("ingested") + F.col("failed")
    return counts.withColumn("accounted", done).withColumn("passed", (F.col("total") > 0) & (done == F.col("total")))


def stratum(batteries: DataFrame, least: int = 12, share: float = 0.9) -> DataFrame:
    """batteries: stratum, recovered, total. Adds available (a full battery with sane counts), rate and passed."""
    ok = F.coalesce((F.col("total") >= least) & (F.col("recovered") >= 0) & (F.col("recovered") <= F.col("total")), F.lit(False))
    rate = F.when(ok, F.col("recovered") / F.col("total"))
    return batteries.withColumn("available", ok).withColumn("rate", rate).withColumn("passed", F.coalesce(rate >= share, F.lit(False)))


def blockers(families: DataFrame, required: list[str]) -> DataFrame:
    """family, reason for each required family that is missing, unmeasured or failing. families: family, measured, passed."""
    domain = families.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, required))).alias("family"))
    joined = domain.join(families, "family", "left")
    reason = F.when(F.col("measured").isNull(), "missing").when(~F.col("measured"), "unmeasured").when(~F.coalesce("passed", F.lit(False)), "failing")
    return joined.select("family", reason.alias("reason")).where("reason IS NOT NULL")


def verdict(recovered: Column, total: Column, untestable: Column, no_trace: Column, coverage_passed: Column, any_stratum: Column, all_strata: Column, cohort: int, by_design: int, confirm: int = 4) -> Column:
    """The outcome of a case cohort, in strict order of priority."""
    testable = total - untestable - no_trace
    return (
        F.when((total != cohort) | (testable < cohort - by_design), "INSUFFICIENT-COHORT").when(~F.coalesce(coverage_passed, F.lit(False)), "INVALID")
        .when(~F.coalesce(any_stratum, F.lit(False)), "INSTRUMENT-LIMITED").when(recovered >= confirm, "CONFIRMED")
        .when((recovered == 0) & F.coalesce(all_strata, F.lit(False)), "REFUTED").when(recovered == 0, "INSTRUMENT-LIMITED")
        .when(recovered.between(1, confirm - 1), "PARTIAL").otherwise("UNDEFINED-OUTCOME")
    )


def switches_country(outcome: Column) -> Column:
    return outcome.isin("PARTIAL", "REFUTED", "INSTRUMENT-LIMITED")


def taint(paths: DataFrame, attestation: DataFrame, excluded: list[str]) -> DataFrame:
    """start, goal, path, taint: tainted if an attestation's source and an excluded name contain one another (case aside),
    else unverifiable if an edge has no attestation, else clean."""
    names = [x.lower() for x in excluded if x.strip()]
    source = F.lower(F.coalesce("source_name", F.lit("")))
    hit = F.lit(False)
    for x in names:
        hit = hit | F.contains(source, F.lit(x)) | F.contains(F.lit(x), source)
    per_edge = attestation.groupBy("edge").agg(F.bool_or(hit).alias("hit"))
    each = paths.select("start", "goal", F.transform("edges", lambda e: e["edge"]).alias("path"), F.explode("edges").alias("e")).select("start", "goal", "path", F.col("e.edge").alias("edge"))
    of = each.join(per_edge, "edge", "left").groupBy("start", "goal", "path").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("hit"), F.bool_or(F.col("hit").isNull()).alias("gap"))
    return of.select("start", "goal", "path", F.when(F.col("hit"), "tainted").when(F.col("gap"), "unverifiable").otherwise("clean").alias("taint"))


def separation(tainted: DataFrame) -> DataFrame:
    """start, goal, separation: ok if one path is clean, else cannot_verify if one is unverifiable, else violation."""
    best = F.when(F.bool_or(F.col("taint") == "clean"), "ok").when(F.bool_or(F.col("taint") == "unverifiable"), "cannot_verify").otherwise("violation")
    return tainted.groupBy("start", "goal").agg(best.alias("separation"))


def qualifies(taint_: Column, strata: Column, passing: list[str]) -> Column:
    """A path counts if it is clean and touches a stratum, and only passing ones."""
    return (taint_ == "clean") & (F.size(strata) > 0) & (F.size(F.array_except(strata, F.array(*map(F.lit, passing)).cast("array<string>"))) == 0)


def snapshot_integrity(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """key, ok, reason of each file of a manifest (key, sha256): missing or changed files are refused, not read.
    files: key, content (binary)."""
    j = manifest.join(files.select("key", F.sha2("content", 256).alias("found")), "key", "left")
    reason = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed")
    return j.select("key", reason.isNull().alias("ok"), reason.alias("reason"))


def pending_roster(universe: DataFrame, cached: DataFrame, attempted: DataFrame, key: str) -> DataFrame:
    """One row of counts (ingested, failed, missing, total) for coverage(): a member tried but not cached has failed."""
    mark = lambda df, name: df.select(key, F.lit(True).alias(name)).distinct()
    j = universe.select(key).distinct().join(mark(cached, "c"), key, "left").join(mark(attempted, "a"), key, "left")
    return j.agg(F.count_if(F.col("c")).alias("ingested"), F.count_if(F.col("c").isNull() & F.col("a")).alias("failed"), F.count_if(F.col("c").isNull() & F.col("a").isNull()).alias("missing"), F.count("*").alias("total"))
