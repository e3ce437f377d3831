"""The nine red-flag indicators. Each returns the flagged units and, in every row, the denominator `units`.

Flags carry numbers, not sentences: text for readers is formatted where it is shown. All are joins, aggregations and
windows; nothing is collected. Denominators are one-row aggregates joined to the flags.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.scalars import contains_any, floored_days, is_framework, is_placeholder, safe_int, severity_band
from ledgerlight.operators.sequence import anchored_clusters
from ledgerlight.sources.workdir import settled

# Words of direct awards by source, accounts categories, thresholds in cents and days.
DIRECT_KEYWORDS = {"ua_prozorro": ("limited", "negotiation", "reporting", "direct"), "co_secop_ii": ("directa",), "uk_contracts_finder": ("direct", "single_tender")}
COMPETITIVE_KEYWORDS = ("open", "competitive", "restricted")
DORMANT = ("dormant", "dormant company", "dormant no significant accounting")
MICRO, SMALL = ("micro-entity", "micro entity"), ("small", "small company")
MICRO_CENTS, SMALL_CENTS = 50_000_00, 5_000_000_00
STALE_DAYS = 18 * 30.44


def counted(indicator: Callable[..., tuple[DataFrame, DataFrame]]) -> Callable[..., DataFrame]:
    """An indicator that gives its flags and its one row of counts (units, and unscoreable where there are such) as one that
    gives the flags with these as columns. What it was stays in `parts`: counts are known there if nothing is flagged too."""

    @wraps(indicator)
    def flagged(*tables, **parameters) -> DataFrame:
        flags, counts = indicator(*tables, **parameters)
        return flags.crossJoin(F.broadcast(counts))

    flagged.parts = indicator
    return flagged


def units(population: DataFrame) -> DataFrame:
    return population.agg(F.count("*").alias("units"))


def framework(tender: DataFrame) -> DataFrame:
    return tender.withColumn("framework", is_framework(F.col("title"), F.col("method"), F.lit(None).cast("string"), F.col("raw_json")))


@counted
def single_bidder_by_bids(tender: DataFrame, award: DataFrame, bid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tenders with just one row in awards x bids: no distinct, as in the join that is counted. Units are award rows."""
    mine = tender.select("tender_id").join(award.select("tender_id"), "tender_id")
    awards = award.groupBy("tender_id").agg(F.count("*").alias("awards"))
    bids = bid.groupBy("tender_id").agg(F.count("*").alias("bids"))
    # the product of two counts is the size of the fan-out, which need not be made
    flags = tender.join(awards, "tender_id").join(bids, "tender_id").where(F.col("awards") * F.col("bids") == 1).select(F.col("tender_id").alias("subject"))
    return flags, units(mine)


@counted
def single_bidder_stated(tender: DataFrame, award: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stated numbers of bidders of which the greater is one: a flag for each award row. Units are award rows."""
    mine = tender.join(award.select("tender_id"), "tender_id")
    flags = mine.where(F.greatest(safe_int("bidders_stated"), safe_int("bidders_unique")) == 1).select(F.col("tender_id").alias("subject"))
    return flags, units(mine)


@counted
def single_award_competitive(tender: DataFrame, award: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Competitive, not a framework, and one award. Units are all tenders with one award."""
    one = award.groupBy("tender_id").agg(F.count("*").alias("awards")).where("awards = 1")
    mine = framework(tender.join(one, "tender_id"))
    return mine.where(~F.col("framework") & contains_any(F.col("method"), COMPETITIVE_KEYWORDS)).select(F.col("tender_id").alias("subject")), units(mine)


@counted
def short_bid_window(tender: DataFrame, min_days: int = 15) -> tuple[DataFrame, DataFrame]:
    """Whole days from start to end, rounded down, below the least; negative ones too."""
    dated = tender.where("tender_start IS NOT NULL AND tender_end IS NOT NULL").withColumn("days", floored_days(F.col("tender_start"), F.col("tender_end")))
    return dated.where(F.col("days") < min_days).select(F.col("tender_id").alias("subject"), "days"), units(dated)


@counted
def repeat_winner_share(tender: DataFrame, award: DataFrame, buyer: str, least_awards: int = 4, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Suppliers with half or more of a buyer's awards, where the buyer has four or more. Units are pairs before that floor."""
    named = tender.select("tender_id", "source_id", F.col(buyer).alias("buyer")).join(award.select("tender_id", "supplier_name", "value_cents"), "tender_id")
    named = named.where(F.col("buyer").isNotNull() & F.col("supplier_name").isNotNull() & ~is_placeholder(F.col("supplier_name")))
    pairs = named.groupBy("source_id", "buyer", "supplier_name").agg(F.count("*").alias("won"), F.sum("value_cents").alias("value_cents"))
    shares = pairs.withColumn("total", F.sum("won").over(Window.partitionBy("source_id", "buyer"))).withColumn("share", F.col("won") / F.col("total"))
    flags = shares.where((F.col("total") >= least_awards) & (F.col("share") >= share))
    return flags.select("source_id", F.concat("buyer", F.lit("→"), "supplier_name").alias("subject"), "won", "total", "share", "value_cents"), units(pairs)


def off_estimate(framework: Column, price: Column, estimate: Column, deviation: float = 0.25) -> Column:
    """A price so much off the estimate, of no framework; both are above zero."""
    return (price > 0) & (estimate > 0) & ~framework & (F.abs(price - estimate) / F.nullif(estimate, F.lit(0)) >= deviation)


@counted
def price_vs_estimate(tender: DataFrame, award: DataFrame, deviation: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Awards a quarter or more off the estimate, either way; those below are weak. Units include frameworks."""
    priced = framework(tender).select("tender_id", "framework", F.col("value_cents").alias("estimate")).join(award.select("tender_id", "award_id", F.col("value_cents").alias("price")), "tender_id")
    priced = priced.where("price > 0 AND estimate > 0").withColumn("deviation", F.abs(F.col("price") - F.col("estimate")) / F.col("estimate"))
    flags = priced.where(off_estimate(F.col("framework"), F.col("price"), F.col("estimate"), deviation))
    return flags.select(F.concat("tender_id", F.lit(":"), "award_id").alias("subject"), "deviation", (F.col("price") < F.col("estimate")).alias("weak")), units(priced)


@counted
def direct_award_share(tender: DataFrame, source_id: str, least: int = 4, share: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Buyers with three in ten or more direct awards, of four or more tenders. Units are buyers."""
    direct = contains_any(F.col("method"), DIRECT_KEYWORDS.get(source_id, ("direct",)))
    buyers = tender.where((F.col("source_id") == source_id) & F.col("buyer_name").isNotNull()).groupBy("buyer_name").agg(F.count("*").alias("total"), F.count_if(direct).alias("direct"), F.min_by("title", "tender_key").alias("first_title"))
    flags = buyers.withColumn("share", F.col("direct") / F.col("total")).where((F.col("total") >= least) & (F.col("share") >= share))
    return flags.select(F.col("buyer_name").alias("subject"), "direct", "total", "share", "first_title"), units(buyers)


def evaluable(award: DataFrame, resolution: DataFrame) -> DataFrame:
    """Active awards with a supplier's name and a company number, stored: flags and their denominator read it, and so can
    several indicators, each with resolution None. Only what indicators ask for is kept."""
    if resolution is None:
        return award
    active = award.where("status = 'active' AND supplier_name IS NOT NULL AND supplier_name <> ''")
    known = resolution.where("company_number IS NOT NULL").select("award_id", "company_number", "match_confidence", "match_method")
    return settled(active.join(known, "award_id").select("tender_id", "award_id", "value_cents", "value_kind", "award_date", "company_number", "match_confidence", "match_method"))


def require_resolution(award: DataFrame, resolution: DataFrame) -> None:
    """Evaluated at once: without resolved awards a result would look like no flags."""
    if award.take(1) and not resolution.take(1):
        raise RuntimeError("awards have no resolution rows: resolve suppliers first")


@counted
def incorporation_proximity(award: DataFrame, resolution: DataFrame | None, company: DataFrame, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """Won within so many days of the company's incorporation, not before it."""
    mine = evaluable(award, resolution)
    age = F.date_diff("award_date", "incorporation_date")
    flags = mine.join(company, "company_number").withColumn("days", age.cast("long")).where(f"days >= 0 AND days < {days}")
    return flags.select(F.concat("tender_id", F.lit(":"), "award_id").alias("subject"), "company_number", "days", "match_confidence"), units(mine)


@counted
def value_vs_company_size(award: DataFrame, resolution: DataFrame | None, company: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Too much for a dormant, micro or small company. Shared ceilings cannot be scored and are counted as such."""
    mine = evaluable(award, resolution)
    category = F.lower(F.trim("accounts_category"))
    reason = (
        F.when(category.isin(*DORMANT) & (F.col("value_cents") > 0), "dormant").when(category.isin(*MICRO) & (F.col("value_cents") > MICRO_CENTS), "micro")
        .when(category.isin(*SMALL) & (F.col("value_cents") > SMALL_CENTS), "small")
    )
    flags = mine.where("value_kind <> 'shared_ceiling'").join(company, "company_number").withColumn("reason", reason).where("reason IS NOT NULL")
    counts = mine.agg(F.count("*").alias("units"), F.count_if(F.col("value_kind") == "shared_ceiling").alias("unscoreable"))
    return flags.select(F.concat("tender_id", F.lit(":"), "award_id").alias("subject"), "reason", "value_cents", "match_confidence"), counts


@counted
def dormancy_delinquency(award: DataFrame, resolution: DataFrame | None, company: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dormant accounts, or accounts made up more than eighteen months before the award."""
    mine = evaluable(award, resolution)
    age = F.date_diff("award_date", "last_made_up").cast("long")
    dormant = F.coalesce(F.lower(F.trim("accounts_category")).isin(*DORMANT), F.lit(False))
    stale = F.coalesce(age > STALE_DAYS, F.lit(False))
    flags = mine.join(company, "company_number").withColumn("dormant", dormant).withColumn("stale", stale).where("dormant OR stale")
    months = F.when(F.col("stale"), F.floor(age / 30))
    return flags.select(F.concat("tender_id", F.lit(":"), "award_id").alias("subject"), "dormant", "stale", months.alias("months")), units(mine)


@counted
def contract_splitting(tender: DataFrame, award: DataFrame, resolution: DataFrame | None, buyer: str, threshold: int | None, window: int = 30, pieces: int = 3) -> tuple[DataFrame, DataFrame]:
    """Clusters of awards by one buyer to one company within `window` days of the first, of three or more tenders each
    below the threshold that together exceed it. Without a threshold there are no flags, and no units."""
    mine = framework(tender).where(F.col(buyer).isNotNull() & (F.col(buyer) != "")).select("tender_id", "framework", F.col(buyer).alias("buyer"))
    mine = evaluable(award, resolution).join(mine, "tender_id").where("NOT framework AND value_cents > 0 AND award_date IS NOT NULL")
    if threshold is None:
        mine = mine.where("false")
        threshold = 0
    clusters = anchored_clusters(mine, ["buyer", "company_number"], "award_date", window)
    piece = clusters.groupBy("buyer", "company_number", "anchor", "tender_id").agg(
        F.sum("value_cents").alias("value"), F.max("award_date").alias("last"), F.min("match_confidence").alias("confidence"), F.count("*").alias("awards"))
    found = piece.groupBy("buyer", "company_number", "anchor").agg(
        F.count("*").alias("pieces"), F.sum("value").alias("total_cents"), F.max("value").alias("largest"), F.max("last").alias("last"), F.min("confidence").alias("confidence"), F.sum("awards").alias("awards"))
    flags = found.where((F.col("pieces") >= pieces) & (F.col("largest") < threshold) & (F.col("total_cents") > threshold))
    subject = F.concat("company_number", F.lit("@"), "buyer", F.lit(":"), F.col("anchor").cast("string"))
    groups = mine.select("buyer", "company_number").distinct()
    return flags.select(subject.alias("subject"), "pieces", "awards", "total_cents", severity_band(F.date_diff("last", "anchor"), window).alias("band"), "confidence"), units(groups)


def unscoreable(tender: DataFrame, least: int = 4) -> DataFrame:
    """tender with i002, i003 and i004: why the bid window, the buyer's shares and the price cannot be scored, or "scored"."""
    buyer = tender.groupBy("buyer_name").agg(F.count("*").alias("of_buyer"))
    known = framework(tender).join(buyer, "buyer_name", "left")
    return known.select(
        *tender.columns, F.when(F.col("tender_start").isNull(), "no_start").when(F.col("tender_end").isNull(), "no_end").otherwise("scored").alias("i002"),
        F.when(F.col("buyer_name").isNull(), "no_buyer").when(F.col("of_buyer") < least, "few_awards").otherwise("scored").alias("i003"),
        F.when(F.col("framework"), "framework").when(F.coalesce("value_cents", F.lit(0)) <= 0, "no_value").otherwise("scored").alias("i004"))
