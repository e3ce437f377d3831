"""Identity across registers: which officer records are a member of parliament, and what that changes in the stored links.

A member and an officer record can only be one person if surname and title agree: they share a bucket. What else is needed
depends on the member. Every way is an equi-join, and who claims a record is counted before claims are made, so a crowded
bucket costs its rows and not their product:

* a member with a forename takes the records of that forename;
* a member without one, alone in the bucket, takes all its records if they are of one forename (the register lists a person
  more than once), but none that carries another seat;
* a member without one among several takes the records that carry the member's own seat, if these are of one forename. A
  record's seat may go on behind the member's, so records are joined under each beginning of theirs.

A record that more than one member claims goes to none of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.names import common_title, member_name, officer_name, same_territory
from ledgerlight.sources.workdir import settled

BUCKET = ["surname", "rank"]
# Ways of a match and their confidence.
TIERS = {"surname_forename_title": 0.85, "surname_title_territorial": 0.85, "surname_title_only": 0.6}
LINK = "member long, officer long, tier string, confidence double"


def _parsed(rows: DataFrame, key: str, parsed) -> DataFrame:
    """One row of each key, its name taken to pieces. Without a title the rank is a blank, so that it joins."""
    one = rows.groupBy(key).agg(F.min("name").alias("name")).withColumn("p", parsed)
    return one.select(key, "p.surname", "p.forename", F.coalesce(common_title(F.col("p.title")), F.lit(" ")).alias("rank"), "p.seat", *(["p.office"] if key == "member" else []))


def parsed_members(members: DataFrame) -> DataFrame:
    """member, surname, forename, rank, seat, office, contested (another member has this surname and rank)."""
    rows = _parsed(members, "member", member_name(F.col("name")))
    crowd = rows.where("surname <> ''").groupBy(*BUCKET).agg((F.count("*") > 1).alias("contested"))
    return rows.join(crowd, BUCKET, "left")


def parsed_officers(officers: DataFrame) -> DataFrame:
    """officer, surname, forename, rank, seat of records with a surname."""
    return _parsed(officers, "officer", officer_name(F.col("name"))).where("surname <> ''")


#: What a member and a record must share for a claim: the tier it makes, and the bucket's forename or seat, if that tier needs one.
KEY = ["tier", *BUCKET, "detail"]


def _keyed_members(members: DataFrame) -> DataFrame:
    """The one key of each member that can have claims, with member and the seat that records must not contradict."""
    tier = (
        F.when(F.col("forename").isNotNull(), "surname_forename_title").when(~F.col("contested"), "surname_title_only")
        .when(F.col("seat").isNotNull(), "surname_title_territorial")
    )
    detail = F.when(F.col("forename").isNotNull(), F.col("forename")).when(F.col("contested"), F.col("seat")).otherwise("")
    return members.where("surname <> ''").select("member", tier.alias("tier"), *BUCKET, detail.alias("detail"), F.when(~F.col("contested"), F.col("seat")).alias("own_seat")).where("tier IS NOT NULL")


def _keyed_officers(officers: DataFrame) -> DataFrame:
    """Each record under every key it has: its forename, each beginning of its seat, and the bucket alone."""
    words = F.split("seat", " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    entry = lambda tier, detail: F.struct(F.lit(tier).alias("tier"), detail.alias("detail"))
    with_forename, by_seat, alone = TIERS
    none = F.array().cast("array<struct<tier:string,detail:string>>")
    keys = F.concat(
        F.when(F.col("forename").isNotNull(), F.array(entry(with_forename, F.col("forename")))).otherwise(none),
        F.when(F.col("seat").isNotNull(), F.transform(starts, lambda s: entry(by_seat, s))).otherwise(none), F.array(entry(alone, F.lit(""))))
    each = officers.select("officer", *BUCKET, "forename", "seat", F.explode(keys).alias("key"))
    return each.select("officer", *BUCKET, F.col("forename").alias("given"), F.col("seat").alias("record_seat"), "key.*")


def _claimed(members: DataFrame, officers: DataFrame) -> DataFrame:
    """KEY, officer, dropped: the records that members of a key claim, and whether more than one member claims the record.

    Members of a key claim the same records, so claims are told from the keys and numbers of their members: pairs of a crowded
    key are not made. members, officers: parsed."""
    with_forename, _, alone = TIERS
    held = _keyed_members(members).groupBy(*KEY).agg(F.count("*").alias("members"), F.min("own_seat").alias("own_seat"))
    records = _keyed_officers(officers)
    known = F.count_distinct("given") + F.max(F.col("given").isNull()).cast("int")
    one_forename = records.where(F.col("tier") != with_forename).groupBy(*KEY).agg(known.alias("known")).where("known = 1").drop("known")
    able = held.where(F.col("tier") == with_forename).unionByName(held.join(one_forename, KEY, "left_semi"))
    # there is one member to a key of the last tier, so own_seat is that member's
    agrees = (F.col("tier") != alone) | same_territory(F.col("own_seat"), F.col("record_seat"))
    found = records.select(*KEY, "officer", "record_seat").join(able, KEY).where(agrees)
    return found.select(*KEY, "officer", (F.sum("members").over(Window.partitionBy("officer")) > 1).alias("dropped"))


def identity_claims(members: DataFrame, officers: DataFrame) -> DataFrame:
    """member, officer, tier, confidence, dropped: every claim of a member on a record; dropped where another member has a
    claim on it too. members: member, name; officers: officer, name. Ids are unique; of a repeated one the least name counts.

    Claims are made last, and not moved then: with `NOT dropped` there are as many as records, whatever the crowd."""
    m, o = settled(parsed_members(members)), settled(parsed_officers(officers))
    confidence = F.create_map(*(F.lit(x) for pair in TIERS.items() for x in pair))[F.col("tier")]
    pairs = _claimed(m, o).join(_keyed_members(m).select(*KEY, "member"), KEY)
    return pairs.select("member", "officer", "tier", confidence.alias("confidence"), "dropped")


def member_outcomes(members: DataFrame, officers: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """member, outcome, linked, dropped: for each member how it came out, its links and the claims it lost to a collision.
    Without claims (identity_claims()) these are counted for each key, not made.

    outcome: a tier; officer_collision (all claims lost); ambiguous (records in the bucket, none of them certain);
    no_candidate (no record, or no surname); functional_title (named by a church or house office alone)."""
    m, o = settled(parsed_members(members)), settled(parsed_officers(officers))
    there = o.select(*BUCKET).distinct().withColumn("there", F.lit(True))
    counts = F.count_if(~F.col("dropped")).alias("linked"), F.count_if("dropped").alias("dropped")
    if claims is None:
        sums = _keyed_members(m).join(_claimed(m, o).groupBy(*KEY).agg(*counts), KEY).select("member", "tier", "linked", "dropped")
    else:
        sums = claims.groupBy("member").agg(F.min("tier").alias("tier"), *counts)
    j = m.join(there, BUCKET, "left").join(sums, "member", "left").fillna(0, ["linked", "dropped"])
    outcome = (
        F.when(F.col("office"), "functional_title").when((F.col("surname") == "") | F.col("there").isNull(), "no_candidate")
        .when(F.col("linked") > 0, F.col("tier")).when(F.col("dropped") > 0, "officer_collision").otherwise("ambiguous")
    )
    return j.select("member", outcome.alias("outcome"), "linked", "dropped")


def link_changes(stored: DataFrame, claims: DataFrame) -> DataFrame:
    """member, officer, action, tier, confidence: what turns the stored links (LINK) into those that claims leave.

    action: create, delete (no longer claimed), update (another tier or confidence than stored), keep."""
    desired = claims.where("NOT dropped").select("member", "officer", "tier", "confidence")
    old = stored.select("member", "officer", F.col("tier").alias("old_tier"), F.col("confidence").alias("old_confidence"), F.lit(True).alias("old"))
    j = desired.withColumn("new", F.lit(True)).join(old, ["member", "officer"], "full")
    same = F.col("tier").eqNullSafe(F.col("old_tier")) & F.col("confidence").eqNullSafe(F.col("old_confidence"))
    action = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").when(same, "keep").otherwise("update")
    return j.select("member", "officer", action.alias("action"), F.coalesce("tier", "old_tier").alias("tier"), F.coalesce("confidence", "old_confidence").alias("confidence"))


def reconciled(changes: DataFrame, least: int = 20, share: float = 0.5, allow_bulk_delete: bool = False) -> DataFrame:
    """The links after changes. Evaluated at once: refuses to delete more than `share` of the stored links where there are
    `least` or more, for then a source is likely to be missing; and refuses links of one record to two members."""
    n = changes.agg(F.count_if(F.col("action") == "delete").alias("gone"), F.count_if(F.col("action") != "create").alias("stored")).first()
    if n["stored"] >= least and n["gone"] > share * n["stored"] and not allow_bulk_delete:
        raise RuntimeError(f"refusing to delete {n['gone']} of {n['stored']} links")
    after = changes.where("action <> 'delete'").select("member", "officer", "tier", "confidence")
    if after.groupBy("officer").agg(F.count_distinct("member").alias("n")).where("n > 1").take(1):
        raise RuntimeError("a record would be linked to more than one member")
    return after
