"""The kill test of indicators: a published cohort joined to awards, every record scored by what can be scored, and rates,
strata and ranks from that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.scalars import is_placeholder
from ledgerlight.operators import indicators as I
from ledgerlight.sources.workdir import settled

INDICATORS = ("i002", "i003", "i004")
FLAGGED, NOT_FLAGGED, WEAK = "flagged", "not_flagged", "flagged_weak"
SCORED = (FLAGGED, NOT_FLAGGED, WEAK)


def procedure(method: Column, details: Column) -> Column:
    """competitive, noncompetitive (limited, direct, or without prior publication), or unknown if nothing is said."""
    said = F.lower(F.trim(F.concat_ws(" ", method, details)))
    return F.when(said == "", "unknown").when(said.rlike("limited|direct|without prior publication"), "noncompetitive").otherwise("competitive")


def matched(cohort: DataFrame, tender: DataFrame, award: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """cohort's columns, join_status, tender_id and award (award_id, supplier_name, value_cents, award_date, and more): for each
    record the award it means. Of a tender's awards the only one; else the first of the record's supplier; else the first of its value.

    cohort: record (unique), cohort, ocid, supplier, value (pounds); tender: ocid, tender_id; award: tender_id and the above."""
    known = tender.groupBy("ocid").agg(F.min("tender_id").alias("tender_id"))
    counts = award.groupBy("tender_id").agg(F.count("*").alias("n"))
    asked = cohort.join(known, "ocid", "left").join(counts, "tender_id", "left")
    way = F.when(F.col("n") == 1, 1).when(F.col("supplier_name") == F.col("supplier"), 2).when(F.col("value_cents") == F.round(F.col("value") * 100).cast("long"), 3)
    candidates = asked.select("record", "tender_id", "supplier", "value", "n").join(award.select("tender_id", "award_id", "supplier_name", "value_cents", "award_date", *more), "tender_id")
    best = candidates.withColumn("way", way).where("way IS NOT NULL").groupBy("record").agg(F.min(F.struct("way", "award_id", "supplier_name", "value_cents", "award_date", *more)).alias("award"))
    j = asked.join(best, "record", "left")
    status = F.when(F.col("tender_id").isNull(), "tender_missing").when(F.col("award").isNull(), "award_not_matched").otherwise("matched")
    return j.select(*cohort.columns, status.alias("join_status"), "tender_id", "award")


def scored_records(cohort: DataFrame, tender: DataFrame, award: DataFrame, buyer: str, emergency: tuple[str, str], min_days: int = 15, least: int = 4) -> DataFrame:
    """record, cohort, supplier, join_status, stratum, indicator, status: three rows for each record of the cohort.

    status: flagged, flagged_weak (a price below the estimate), not_flagged, or why it can't be scored: not_joined,
    missing_window, missing_estimate, framework, no_buyer, placeholder_supplier, buyer_below_floor. The indicators are run over
    all tenders and awards, as they run elsewhere. stratum: procedure and time (before, in and after the emergency), null
    for records that were not joined, unknown_date for awards without one."""
    # the price is compared beside the award, which costs no shuffle where tenders lie together; of awards with one id a flag counts
    estimates = I.framework(tender).select("tender_id", F.col("framework").alias("_framework"), F.col("value_cents").alias("_estimate"))
    off = I.off_estimate(F.col("_framework"), F.col("value_cents"), F.col("_estimate"))
    weak = F.max(F.when(off, F.col("value_cents") < F.col("_estimate"))).over(Window.partitionBy("tender_id", "award_id"))
    judged = award.join(estimates, "tender_id", "left").select("tender_id", "award_id", "supplier_name", "value_cents", "award_date", F.when(F.col("award_id").isNotNull(), weak).alias("weak"))
    m = matched(cohort, tender, judged, ("weak",))
    flags = lambda found: found.select("subject").distinct()
    f2 = flags(I.short_bid_window.parts(tender, min_days)[0]).select(F.col("subject").alias("tender_id"), F.lit(True).alias("f2"))
    i002 = F.when(F.col("tender_start").isNull() | F.col("tender_end").isNull(), "missing_window").when(F.col("f2"), FLAGGED).otherwise(NOT_FLAGGED)
    facts = I.framework(tender).join(f2, "tender_id", "left").select("tender_id", "framework", i002.alias("i002"), F.col("value_cents").alias("estimate"), F.col(buyer).alias("buyer"), procedure(F.col("method"), F.lit(None).cast("string")).alias("procedure"))
    named = tender.select("tender_id", F.col(buyer).alias("buyer")).join(award.select("tender_id", "supplier_name"), "tender_id").where(F.col("supplier_name").isNotNull() & ~is_placeholder(F.col("supplier_name")))
    # by tender first: where tenders lie together, that needs no shuffle
    totals = named.groupBy("tender_id", "buyer").agg(F.count("*").alias("n")).groupBy("buyer").agg(F.sum("n").alias("buyer_awards"))
    f3 = settled(flags(I.repeat_winner_share.parts(tender, award, buyer, least)[0]).select(F.col("subject").alias("s3"), F.lit(True).alias("f3")))
    day = F.col("award.award_date")
    time = F.when(day.between(*emergency), "emergency").when(day < emergency[0], "before").otherwise("after")
    joined = F.col("join_status") == "matched"
    stratum = F.when(joined, F.when(day.isNull(), "unknown_date").otherwise(F.concat_ws("__", "procedure", time)))
    priced = (F.coalesce("estimate", F.lit(0)) > 0) & (F.coalesce("award.value_cents", F.lit(0)) > 0)
    # what a record is scored by is narrowed down before it is joined to flags
    j = m.join(facts, "tender_id", "left").select(
        "record", "cohort", "supplier", "join_status", stratum.alias("stratum"), "buyer", F.col("award.supplier_name").alias("winner"), "i002", "framework", priced.alias("priced"),
        F.concat("buyer", F.lit("→"), "award.supplier_name").alias("s3"), "award.weak")
    j = j.join(totals, "buyer", "left").join(f3, "s3", "left")
    i003 = (
        F.when(F.coalesce("buyer", F.lit("")) == "", "no_buyer").when(F.col("winner").isNull() | is_placeholder(F.col("winner")), "placeholder_supplier")
        .when(F.coalesce("buyer_awards", F.lit(0)) < least, "buyer_below_floor").when(F.col("f3"), FLAGGED).otherwise(NOT_FLAGGED))
    i004 = F.when(F.col("framework"), "framework").when(~F.col("priced"), "missing_estimate").when(F.col("weak").isNull(), NOT_FLAGGED).when(F.col("weak"), WEAK).otherwise(FLAGGED)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("indicator"), F.when(joined, s).otherwise("not_joined").alias("status")) for i, s in zip(INDICATORS, (F.col("i002"), i003, i004)))))
    return j.select("record", "cohort", "supplier", "join_status", "stratum", each.alias("e")).select("record", "cohort", "supplier", "join_status", "stratum", "e.*")


def coverage_table(scored: DataFrame) -> DataFrame:
    """indicator, status, n."""
    return scored.groupBy("indicator", "status").agg(F.count("*").alias("n"))


def firing_rates(scored: DataFrame, most: float = 0.2) -> DataFrame:
    """stratum, indicator, population, scoreable, flagged, rate, stratifier: how often an indicator fires among the records of a
    stratum that can be scored (null if none can), and whether that is more than a fifth. Weak flags count as scored only."""
    known = scored.where("stratum IS NOT NULL").groupBy("stratum", "indicator").agg(F.count("*").alias("population"), F.count_if(F.col("status").isin(*SCORED)).alias("scoreable"), F.count_if(F.col("status") == FLAGGED).alias("flagged"))
    rate = F.col("flagged") / F.nullif("scoreable", F.lit(0))
    return known.withColumn("rate", rate).withColumn("stratifier", F.coalesce(rate > most, F.lit(False)))


def ranking(scored: DataFrame, cohort: str) -> DataFrame:
    """stratum, rank, supplier, n_flagged, flagged, n_scored, alone: the cohort's suppliers within each stratum by the number of
    indicators that flag them; ties share a rank, and the next ranks leave a gap. alone: first, flagged, and nobody else so often."""
    mine = scored.where((F.col("cohort") == cohort) & F.col("stratum").isNotNull())
    hit = lambda *states: F.array_sort(F.collect_set(F.when(F.col("status").isin(*states), F.col("indicator"))))  # noqa: E731  of three indicators
    each = mine.groupBy("stratum", "supplier").agg(hit(FLAGGED).alias("flagged"), F.size(hit(*SCORED)).alias("n_scored"))
    each = each.withColumn("n_flagged", F.size("flagged"))
    tops = each.groupBy("stratum", "n_flagged").agg(F.count("*").alias("alike"))
    # a stratum has a few numbers of flags, however many suppliers: ranks are counted from these
    ahead = F.coalesce(F.sum("alike").over(Window.partitionBy("stratum").orderBy(F.desc("n_flagged")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = tops.select("stratum", "n_flagged", (ahead + 1).alias("rank"), "alike")
    j = each.join(ranks, ["stratum", "n_flagged"])
    alone = (F.col("rank") == 1) & (F.col("n_flagged") > 0) & (F.col("alike") == 1)
    return j.select("stratum", "rank", "supplier", "n_flagged", "flagged", "n_scored", alone.alias("alone"))
