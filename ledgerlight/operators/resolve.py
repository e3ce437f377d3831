"""Entity resolution: identifiers first, names only where a name is no one else's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.scalars import normalise_company_number, normalise_name


def name_tier(company: DataFrame) -> DataFrame:
    """Each name with what the uniqueness guard needs: how many companies bear it, how many of them active, and whose it is."""
    active = F.col("company_status") == "Active"
    return company.groupBy("normalised_name").agg(
        F.count("*").alias("n"), F.count_if(active).alias("n_active"), F.min("company_number").alias("only_number"), F.min(F.when(active, F.col("company_number"))).alias("only_active"))


def resolve_awards(award: DataFrame, company: DataFrame) -> DataFrame:
    """One row per award. Its own identifier decides, and is kept with confidence 0 if no company has it: it never falls
    back to the name. A name decides if one company bears it, or one active company; otherwise none does."""
    number, name = F.col("supplier_number"), F.col("supplier_name")
    own = F.coalesce(F.col("supplier_scheme") == "GB-COH", F.lit(False))
    keyed = award.select("award_id", "tender_id", own.alias("own"), F.when(own, normalise_company_number(number)).alias("number"), F.when(~own, normalise_name(name)).alias("name"))
    known = company.select(F.col("company_number").alias("number"), F.lit(True).alias("known")).distinct()
    names = name_tier(company).withColumnRenamed("normalised_name", "name")
    found = keyed.join(known, "number", "left").join(names, "name", "left")
    unique, one_active = F.coalesce(F.col("n") == 1, F.lit(False)), F.coalesce(F.col("n_active") == 1, F.lit(False))
    by_name = F.when(unique, F.col("only_number")).when(one_active, F.col("only_active"))
    return found.select(
        "award_id", "tender_id", F.when(F.col("own"), F.col("number")).otherwise(by_name).alias("company_number"),
        F.when(F.col("own"), F.when(F.col("known"), 1.0).otherwise(0.0)).when(unique | one_active, 0.9).otherwise(0.0).alias("match_confidence"),
        F.when(F.col("own"), "identifier").when(unique | one_active, "exact_name").when(F.col("n") > 1, "ambiguous").otherwise("unmatched").alias("match_method"),
    )


def resolution_stats(resolution: DataFrame) -> DataFrame:
    matched = F.col("match_confidence") > 0
    return resolution.agg(
        F.count_if(matched & (F.col("match_method") == "identifier")).alias("tier1"), F.count_if(matched & (F.col("match_method") == "exact_name")).alias("tier2"),
        F.count_if(~matched).alias("unmatched"), F.count("*").alias("total"))


def former_names(slots: DataFrame, current: DataFrame) -> DataFrame:
    """former (normalised), company_number, first_seen: names that one company alone has had and none bears now.

    slots: company_number, former, seq. A name used by two companies, or now by another, is dropped."""
    used = slots.where("former IS NOT NULL AND former <> ''").groupBy("former").agg(F.count_distinct("company_number").alias("n"), F.min("company_number").alias("company_number"), F.min("seq").alias("first_seen"))
    taken = current.select(F.col("normalised_name").alias("former"), F.col("company_number").alias("owner"))
    other = used.where("n = 1").join(taken, "former").where(F.col("owner") != F.col("company_number")).select("former").distinct()
    return used.where("n = 1").join(other, "former", "left_anti").select("former", "company_number", "first_seen")


def first_existing(lists: DataFrame, known: DataFrame, key: str, ids: str) -> DataFrame:
    """key and the first of its identifiers, in their order, that is known."""
    each = lists.select(key, F.posexplode(ids).alias("place", "candidate"))
    return each.join(known.select(F.col("id").alias("candidate")).distinct(), "candidate").groupBy(key).agg(F.min_by("candidate", "place").alias("found"))


def reconcile(persisted: DataFrame, desired: DataFrame, key: str, floor: int = 20, share: float = 0.5) -> DataFrame:
    """One row: how many to delete, create and leave, and whether deleting is refused (over half of twenty or more)."""
    p, d = persisted.select(key).distinct(), desired.select(key).distinct()
    both = p.withColumn("p", F.lit(1)).join(d.withColumn("d", F.lit(1)), key, "full")
    counts = both.agg(F.count_if(F.col("d").isNull()).alias("stale"), F.count_if(F.col("p").isNull()).alias("create"), F.count_if(F.col("p").isNotNull() & F.col("d").isNotNull()).alias("keep"))
    total = F.col("stale") + F.col("keep")
    return counts.withColumn("refused", (total >= floor) & (F.col("stale") > share * total))


def alias_report(slots: DataFrame, current: DataFrame) -> DataFrame:
    """One row: former names, those that two companies had, those that another bears now, and the aliases that are left.
    slots: company_number, former, seq; empty slots do not count."""
    used = slots.where("former IS NOT NULL AND former <> ''").groupBy("former").agg(F.count_distinct("company_number").alias("n"))
    kept = former_names(slots, current).select("former", F.lit(True).alias("kept"))
    j = used.join(kept, "former", "left")
    alone = F.col("n") == 1
    return j.agg(F.count("*").alias("names"), F.count_if(~alone).alias("shared"), F.count_if(alone & F.col("kept").isNull()).alias("borne"), F.count("kept").alias("aliases"))
