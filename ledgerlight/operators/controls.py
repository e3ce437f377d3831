"""Control batteries, cross-register checks, cohort lookups, bound gate reports, and the sink that checks what it wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.scalars import legal_name, normalise_company_number, normalise_name, strict_name, strip_suffix
from ledgerlight.operators.aggregates import with_interval
from ledgerlight.operators.substring import substring_pairs

# Product codes and words of protective and medical supplies.
MEDICAL_CODES = ("18", "33", "35", "39530")
MEDICAL_WORDS = ("ppe", "personal protective", "surgical mask", "face mask", "n95", "ffp2", "ffp3", "ventilator", "sanitiser", "sanitizer", "disinfectant", "gown", "apron", "glove", "medical", "covid", "coronavirus", "pandemic")


def is_medical(title: Column, description: Column, codes: Column) -> Column:
    """A product code (array of scheme and id) with one of the prefixes, or a word in title or description."""
    coded = F.exists(F.coalesce(codes, F.array().cast("array<struct<scheme:string,id:string>>")), lambda c: F.coalesce((c["scheme"] == "CPV") & c["id"].rlike(f"^({'|'.join(MEDICAL_CODES)})"), F.lit(False)))
    text = F.lower(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    return coded | text.rlike("|".join(MEDICAL_WORDS))


def officer_controls(controls: DataFrame, entity: DataFrame, edge: DataFrame) -> DataFrame:
    """id, status (recovered, not_found), reason, temporal (matched, mismatch, not_applicable): retrieval and time are told
    apart. controls: id, officer_id, company_number, appointed_on."""
    person = entity.where("entity_type = 'person' AND scheme = 'GB-COH-OFFICER'").groupBy(F.col("registry_id").alias("officer_id")).agg(F.min("id").alias("p"))
    firm = entity.where("entity_type = 'company' AND scheme = 'GB-COH'").groupBy(F.col("registry_id").alias("number")).agg(F.min("id").alias("c"))
    found = edge.where("edge_type = 'officer_of'").groupBy(F.col("source").alias("p"), F.col("target").alias("c")).agg(F.collect_set("valid_from").alias("dates"))
    j = controls.withColumn("number", normalise_company_number(F.col("company_number"))).join(person, "officer_id", "left").join(firm, "number", "left").join(found, ["p", "c"], "left")
    hit = F.col("dates").isNotNull()
    reason = F.when(F.col("p").isNull(), "no officer").when(F.col("c").isNull(), "no company").when(~hit, "no edge")
    return j.select("id", F.when(hit, "recovered").otherwise("not_found").alias("status"), reason.alias("reason"), F.when(~hit, "not_applicable").when(F.array_contains("dates", F.col("appointed_on")), "matched").otherwise("mismatch").alias("temporal"))


def _banned(people: DataFrame, bans: DataFrame, on: Column) -> DataFrame:
    """people with the companies of their first ban in force. A ban without both dates is not in force."""
    current = bans.where(F.coalesce(on.between(F.col("since"), F.col("until")), F.lit(False))).groupBy("person").agg(F.min_by("companies", F.struct("since", "until")).alias("companies"))
    return people.join(current, "person")


def _namesakes(banned: DataFrame, appointments: DataFrame) -> DataFrame:
    """Appointments of people with the birth year and month of a banned person and both names in the title. The surname is
    looked up in titles by its rarest part, so that a month's births aren't compared with one another."""
    born = ["year", "month"]
    asked = banned.withColumn("pattern", F.upper("surname"))
    titles = appointments.withColumn("text", F.upper("title"))
    pairs = substring_pairs(asked.select(*born, "pattern"), titles.select(*born, "text"), born)
    return asked.join(pairs, [*born, "pattern"]).join(titles, [*born, "text"]).where(F.contains("text", F.upper("forename")))


def _live() -> Column:
    return (F.col("status") == "active") & (F.coalesce("resigned", F.lit("")) == "")


def _tied() -> Column:
    return F.coalesce(F.arrays_overlap(F.transform("aliases", strict_name), F.transform("companies", strict_name)), F.lit(False))


def disqualified(people: DataFrame, bans: DataFrame, appointments: DataFrame, on: Column) -> DataFrame:
    """person, company_number of appointments that the register itself ties to a ban in force.

    people: person, forename, surname, year, month; bans: person, since, until, companies; appointments: title, year, month,
    company_number, status, resigned, aliases. Birth year and month must agree and both names stand in the title; the
    company is active, the appointment not resigned, and one of its names is among those of the person's first ban in force.
    A ban without both dates is not in force."""
    return _namesakes(_banned(people, bans, on), appointments).where(_live() & _tied()).select("person", "company_number").distinct()


def disqualified_counts(people: DataFrame, bans: DataFrame, appointments: DataFrame, on: Column) -> DataFrame:
    """One row that says where disqualified() loses people: people; unborn (no birth year or month, so never looked up); lapsed
    (none of their bans is in force, or none has both dates); banned; namesakes (banned people with an appointment of their
    birth and names), live (with one that is held still, of an active company), and tied (with one that a ban names)."""
    known = people.withColumn("born", F.col("year").isNotNull() & F.col("month").isNotNull())
    banned = _banned(people, bans, on)
    in_force = banned.select("person").distinct().withColumn("banned", F.lit(True))
    total = known.join(in_force, "person", "left").agg(F.count_distinct("person").alias("people"), F.count_distinct(F.when(~F.col("born"), F.col("person"))).alias("unborn"), F.count_distinct(F.when(F.col("banned").isNull(), F.col("person"))).alias("lapsed"), F.count_distinct(F.when(F.col("banned"), F.col("person"))).alias("banned"))
    each = _namesakes(banned, appointments).groupBy("person").agg(F.bool_or(_live()).alias("live"), F.bool_or(_live() & _tied()).alias("tied"))
    found = each.agg(F.count("*").alias("namesakes"), F.count_if("live").alias("live"), F.count_if("tied").alias("tied"))
    return total.crossJoin(found)  # one row each


def cohort_lookup(suppliers: DataFrame, company: DataFrame) -> DataFrame:
    """supplier, company_number, outcome (unique, sole_active, ambiguous, unmatched) by the variants of a name: whole, without
    its legal form, and both of what stands before "t/a". A company counts once however many variants it matches."""
    variants = F.array_distinct(F.array(normalise_name(F.col("supplier")), strip_suffix(F.col("supplier")), normalise_name(legal_name(F.col("supplier"))), strip_suffix(legal_name(F.col("supplier")))))
    keys = suppliers.select("supplier").distinct().select("supplier", F.explode(variants).alias("key"))
    names = company.select("company_number", "company_status", F.explode(F.array_distinct(F.array(F.col("normalised_name"), strip_suffix(F.col("normalised_name"))))).alias("key"))
    hits = keys.join(names, "key").select("supplier", "company_number", "company_status").distinct()
    active = F.col("company_status") == "Active"
    best = hits.groupBy("supplier").agg(F.count("*").alias("n"), F.count_if(active).alias("a"), F.min("company_number").alias("one"), F.min(F.when(active, F.col("company_number"))).alias("live"))
    out = suppliers.select("supplier").distinct().join(best, "supplier", "left")
    return out.select("supplier", F.when(F.col("n") == 1, F.col("one")).when(F.col("a") == 1, F.col("live")).alias("company_number"), F.when(F.col("n").isNull(), "unmatched").when(F.col("n") == 1, "unique").when(F.col("a") == 1, "sole_active").otherwise("ambiguous").alias("outcome"))


def named_companies(entries: Column) -> Column:
    """(name, number) pairs of packed entries "NAME (NNNNNNNN) NAME (NNNNNNNN)"; an entry without a number is one name."""
    pattern = r"([^()]+)\(([A-Z0-9]{6,8})\)"
    pair = lambda e: F.arrays_zip(F.transform(F.regexp_extract_all(e, F.lit(pattern), F.lit(1)), lambda x: F.trim(x)).alias("name"), F.regexp_extract_all(e, F.lit(pattern), F.lit(2)).alias("number"))
    shaped = "array<struct<name:string,number:string>>"
    return F.flatten(F.transform(entries, lambda e: F.when(e.rlike(pattern), pair(e).cast(shaped)).otherwise(F.array(F.struct(F.trim(e).alias("name"), F.lit(None).cast("string").alias("number"))).cast(shaped))))


def footprint(outcomes: DataFrame, many: int = 5) -> DataFrame:
    """One row: active, successor and dissolved companies, those at addresses that `many` live ones share, and live ones with
    and without these. outcomes: number (null: unknown), name, outcome, address; each company once."""
    key = F.coalesce("number", strict_name(F.col("name")))
    once = outcomes.withColumn("key", key).groupBy("key").agg(F.min("outcome").alias("outcome"), F.min("address").alias("address"))
    live = F.col("outcome").isin("active", "successor")
    crowded = once.where(live & F.col("address").isNotNull()).groupBy("address").agg(F.count("*").alias("n")).where(F.col("n") >= many).select("address", F.lit(True).alias("crowded"))
    j = once.join(crowded, "address", "left")
    return j.agg(
        F.count_if(F.col("outcome") == "active").alias("active"), F.count_if(F.col("outcome") == "successor").alias("successor"), F.count_if(~live).alias("dissolved"),
        F.count_if(live & F.coalesce("crowded", F.lit(False))).alias("flagged"), F.count_if(live).alias("live"), F.count_if(live & F.col("crowded").isNull()).alias("live_without_flagged"))


def capped_name_lookup(entity: DataFrame, names: DataFrame, most: int = 200) -> DataFrame:
    """name, id, outcome: entities whose normalised name equals; refused if over `most` names contain it, for then the window
    that a prefilter would look at is cut; none and several are told apart. Names of under three characters are not counted."""
    wanted = names.select("name").distinct().withColumn("n", normalise_name(F.col("name")))
    have = entity.select("id", normalise_name(F.col("name")).alias("h"))
    exact = wanted.join(have, F.col("n") == F.col("h"), "left").groupBy("name", "n").agg(F.count("id").alias("hits"), F.min("id").alias("id"))
    texts = have.groupBy(F.col("h").alias("text")).agg(F.count_distinct("id").alias("ids"))
    pairs = substring_pairs(wanted.where(F.char_length("n") >= 3).select(F.col("n").alias("pattern")), texts)
    near = pairs.join(texts, "text").groupBy(F.col("pattern").alias("n")).agg(F.sum("ids").alias("seen"))
    outcome = F.when(F.col("seen") > most, "refused").when(F.col("hits") == 0, "none").when(F.col("hits") > 1, "ambiguous").otherwise("unique")
    return exact.join(near, "n", "left").select("name", F.when(outcome == "unique", F.col("id")).alias("id"), outcome.alias("outcome"))


def one_of_each(rows: DataFrame, key: str) -> DataFrame:
    """Of rows with the same key the least by all columns."""
    return rows.groupBy(key).agg(F.min(F.struct(*rows.columns)).alias("_row")).select("_row.*")


def backfill(current: DataFrame, bulk: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """current with the columns of bulk where it has the key and a value; keys that only bulk has are ignored."""
    extra = one_of_each(bulk.select(key, *(F.col(c).alias(f"new_{c}") for c in columns)), key)
    j = current.join(extra, key, "left")
    return j.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in current.columns))


def temporal_lift(levels: DataFrame, baseline: str) -> DataFrame:
    """cohort, level, n, rate with its interval, and the rate's difference to the baseline cohort; every level in every cohort.
    levels: cohort, level (1 to 4)."""
    totals = levels.groupBy("cohort").agg(F.count("*").alias("total"))
    counts = levels.groupBy("cohort", "level").agg(F.count("*").alias("n"))
    every = totals.select("cohort", "total", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("level"))
    filled = every.join(counts, every["cohort"].eqNullSafe(counts["cohort"]) & (every["level"] == counts["level"]), "left").select(every["cohort"], every["level"], "total", F.coalesce("n", F.lit(0)).alias("n"))
    rated = with_interval(filled, "n", "total").withColumn("rate", F.col("n") / F.col("total"))
    base = rated.where(F.col("cohort") == baseline).select("level", F.col("rate").alias("base"))
    return rated.join(base, "level", "left").select("cohort", "level", "n", "rate", "low", "high", (F.col("rate") - F.col("base")).alias("delta"))


def bound_gates(report: DataFrame, strata: list[str], code: str, graph: str, manifest: str) -> DataFrame:
    """stratum, passed, reason for every stratum: a report counts only if it is bound to this code, graph and manifest, and
    "true", "1" and "yes" alone are true. report: stratum, passed (string), code, graph, manifest."""
    domain = report.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, strata))).alias("stratum"))
    j = domain.join(one_of_each(report, "stratum"), "stratum", "left")
    same = (F.col("code") == code) & (F.col("graph") == graph) & (F.col("manifest") == manifest)
    reason = F.when(F.col("code").isNull(), "missing").when(~F.coalesce(same, F.lit(False)), "stale binding").when(~F.lower(F.trim("passed")).isin("true", "1", "yes"), "failing")
    return j.select("stratum", F.coalesce(reason.isNull(), F.lit(False)).alias("passed"), reason.alias("reason"))


def ceiling(controls: DataFrame, reachable: DataFrame, needed: float = 0.9) -> DataFrame:
    """One row: of a battery's controls, those any source could recover at all, and whether that can reach what is needed."""
    n = controls.join(reachable.select("id").distinct().withColumn("r", F.lit(1)), "id", "left").agg(F.count("*").alias("total"), F.count("r").alias("reachable"))
    rate = F.col("reachable") / F.nullif("total", F.lit(0))
    return n.withColumn("ceiling", rate).withColumn("can_pass", F.coalesce(rate >= needed, F.lit(False)))


def blocked_controls(controls: DataFrame, company: DataFrame) -> DataFrame:
    """id, company_number, reason: controls of companies that the register's bulk file does not have, whatever else is fetched."""
    known = company.select(F.col("company_number").alias("known")).distinct()
    absent = controls.join(known, normalise_company_number(F.col("company_number")) == F.col("known"), "left_anti")
    return absent.select("id", "company_number", F.lit("not in the bulk file").alias("reason"))


def threshold_table(totals: DataFrame, needed: float = 0.9) -> DataFrame:
    """total, recovered, pct, passes: every score that is possible out of each total, and whether it reaches what is needed."""
    each = totals.select("total").distinct().select("total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total").cast("long"))).alias("recovered"))
    share = F.col("recovered") / F.nullif("total", F.lit(0))
    return each.select("total", "recovered", F.round(100 * F.col("recovered") / F.nullif("total", F.lit(0)), 1).alias("pct"), F.coalesce(share >= needed, F.lit(False)).alias("passes"))
