"""The benchmark against sealed cases: evaluation of pairs, protocol, reports, control batteries and what binds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.scalars import wilson
from ledgerlight.operators.controls import one_of_each


def evaluate_pairs(rows: DataFrame, suppliers: DataFrame, referrers: DataFrame, paths: DataFrame) -> DataFrame:
    """rows (key, cutoff, label_only) with status: untestable without a supplier (key, found) or a referrer (key, person);
    recovered by a path (start, goal, edges) dated before the cutoff; undated_only by one whose dates are missing; else not
    recovered, which is expected (no_trace_by_design) of a source that gives labels only."""
    ends = suppliers.where("found IS NOT NULL").select("key", F.col("found").alias("goal"))
    tried = referrers.select("key", F.col("person").alias("start"))
    costed = F.filter("edges", lambda e: e["edge_type"] != "same_as")
    hit = rows.select("key", "cutoff").join(ends, "key").join(tried, "key").join(paths, ["start", "goal"])
    dated = (F.size(costed) > 0) & F.forall(costed, lambda e: F.coalesce(e["valid_from"] < F.col("cutoff"), F.lit(False)))
    undecided = F.forall(costed, lambda e: e["valid_from"].isNull() | (e["valid_from"] < F.col("cutoff"))) & ~dated
    seen = hit.groupBy("key").agg(F.bool_or(dated).alias("dated"), F.bool_or(undecided).alias("undated"), F.count("*").alias("paths"))
    testable = ends.select("key").distinct().join(tried.select("key").distinct(), "key").withColumn("testable", F.lit(True))
    j = rows.join(testable, "key", "left").join(seen, "key", "left")
    status = F.when(F.col("testable").isNull(), "untestable").when(F.col("dated"), "recovered").when(F.col("undated"), "undated_only").when(F.col("label_only"), "no_trace_by_design").otherwise("not_recovered")
    return j.select("key", status.alias("status"), F.coalesce("paths", F.lit(0).cast("long")).alias("paths"))


def protocol_violations(cases: DataFrame, sealed: DataFrame, hops: int, locked: int = 2) -> DataFrame:
    """violation, company_number: a hop budget that is not the locked one, and cases missing from or foreign to the sealed set."""
    a, b = cases.select("company_number").distinct(), sealed.select("company_number").distinct()
    missing = b.join(a, "company_number", "left_anti").select(F.lit("missing").alias("violation"), "company_number")
    extra = a.join(b, "company_number", "left_anti").select(F.lit("extra").alias("violation"), "company_number")
    budget = cases.sparkSession.range(1).where(F.lit(hops != locked)).select(F.lit("hops").alias("violation"), F.lit(None).cast("string").alias("company_number"))
    return missing.unionByName(extra).unionByName(budget)


def corroboration_reports(attestation: DataFrame, origins: DataFrame) -> DataFrame:
    """One row: edges corroborated by two attestations, by two independent origins, and what taking copies for one costs."""
    per_edge = attestation.join(origins, "id").groupBy("edge").agg(F.count("*").alias("n"), F.count_distinct("origin").alias("m"))
    counts = per_edge.agg(F.count_if(F.col("n") >= 2).alias("without_collapse"), F.count_if(F.col("m") >= 2).alias("with_collapse"))
    return counts.withColumn("delta", F.col("with_collapse") - F.col("without_collapse"))


def diagnostics(cases: DataFrame, negatives: DataFrame) -> DataFrame:
    """One row of figures that decide nothing: precision over cases and negatives, sensitivity over all cases, the rate of
    false positives and its upper bound. Both tables have `recovered`, measured alike."""
    c = cases.agg(F.count("*").alias("cases"), F.count_if("recovered").alias("hits")).crossJoin(negatives.agg(F.count("*").alias("negatives"), F.count_if("recovered").alias("false_hits")))  # one row each
    rate = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    _, high = wilson(F.col("false_hits"), F.col("negatives"))
    return c.select("cases", "hits", "negatives", "false_hits", rate("hits", F.col("hits") + F.col("false_hits")).alias("precision"), rate("hits", F.col("cases")).alias("sensitivity"), rate("false_hits", F.col("negatives")).alias("false_positive_rate"), high.alias("false_positive_high"))


def batteries(controls: DataFrame, recovered: DataFrame) -> DataFrame:
    """battery, total, recovered, on_time, reason counts of control batteries. controls: battery, id, expected (a date or null:
    time does not apply); recovered: battery, id, found (date). A control that is found without its date counts as recovered,
    not as on time."""
    hits = recovered.groupBy("battery", "id").agg(F.lit(True).alias("hit"), F.collect_set("found").alias("dates"))
    j = controls.join(hits, ["battery", "id"], "left")
    timely = F.when(F.col("expected").isNull(), "not_applicable").when(F.col("hit").isNull(), "not_found").when(F.array_contains("dates", F.col("expected")), "matched").otherwise("mismatch")
    return j.withColumn("time", timely).groupBy("battery").agg(
        F.count("*").alias("total"), F.count("hit").alias("recovered"), F.count_if(F.col("time") == "matched").alias("on_time"), F.count_if(F.col("time") == "mismatch").alias("off_time"), F.count_if(F.col("time") == "not_applicable").alias("untimed"))


def recovered_split(paths: DataFrame, passing: list[str]) -> DataFrame:
    """case_id, outcome by the best of its paths (case_id, taint, strata): qualifying if one path is clean and touches only
    passing strata, at least one; instrument_limited if clean paths touch others; unverifiable; else circular."""
    inside = (F.size("strata") > 0) & (F.size(F.array_except("strata", F.array(*map(F.lit, passing)).cast("array<string>"))) == 0)
    rank = F.when((F.col("taint") == "clean") & inside, 4).when(F.col("taint") == "clean", 3).when(F.col("taint") == "unverifiable", 2).otherwise(1)
    named = F.element_at(F.array(*map(F.lit, ("circular", "unverifiable", "instrument_limited", "qualifying"))), F.col("best"))
    return paths.groupBy("case_id").agg(F.max(rank).alias("best"), F.count("*").alias("paths")).select("case_id", named.alias("outcome"), "paths")


def ratio_gates(counts: DataFrame, share: float = 0.9) -> DataFrame:
    """family, passed: covered / total of at least `share`, for sane counts only. Looser than gates.coverage(), on purpose."""
    sane = F.coalesce((F.col("total") > 0) & F.col("covered").between(0, F.col("total")), F.lit(False))
    return counts.select("family", F.coalesce(sane & (F.col("covered") / F.nullif("total", F.lit(0)) >= share), F.lit(False)).alias("passed"))


def windowed_coverage(attestation: DataFrame, advertised: DataFrame) -> DataFrame:
    """family, covered, total, source: distinct references that are attested against the total that a source advertises for
    the window they were fetched in; without such a total the one over all time stands in, and says so.
    attestation: family, reference; advertised: family, window_total, total."""
    seen = attestation.groupBy("family").agg(F.count_distinct("reference").alias("covered"))
    j = advertised.join(seen, "family", "left")
    return j.select("family", F.coalesce("covered", F.lit(0).cast("long")).alias("covered"), F.coalesce("window_total", "total").alias("total"), F.when(F.col("window_total").isNotNull(), "window").otherwise("all").alias("source"))


def bound_to(records: DataFrame, state: dict[str, str]) -> DataFrame:
    """records with bound and stale: whether each of a frozen state's hashes is the recorded one, and which are not."""
    wrong = F.filter(F.array(*(F.when(~F.coalesce(F.col(k) == v, F.lit(False)), F.lit(k)) for k, v in state.items())), lambda x: x.isNotNull())
    return records.withColumn("stale", wrong).withColumn("bound", F.size("stale") == 0)


def families_measured(report: DataFrame, required: list[str], state: dict[str, str]) -> DataFrame:
    """family, measured, reason: no entry, a stale binding or no figures leave a family unmeasured. report: family, passed, and
    the hashes of state."""
    domain = report.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, required))).alias("family"))
    j = domain.join(bound_to(one_of_each(report, "family"), state), "family", "left")
    reason = F.when(F.col("bound").isNull(), "missing entry").when(~F.col("bound"), "stale binding").when(F.col("passed").isNull(), "no figures")
    return j.select("family", reason.isNull().alias("measured"), reason.alias("reason"))


def fixture_digest(rows: DataFrame, columns: list[str]) -> Column:
    """sha256 of a row's columns in which a missing value differs from every text."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("missing")) for c in columns)), 256)


def attrition(rows: DataFrame, cohort: str, steps: list[tuple[str, Column]]) -> DataFrame:
    """cohort, total and after each step how many are left, and the share of the last: a row that fails a step is out."""
    left, counted = F.lit(True), []
    for name, passed in steps:
        left = left & F.coalesce(passed, F.lit(False))
        counted.append(F.count_if(left).alias(name))
    out = rows.groupBy(cohort).agg(F.count("*").alias("total"), *counted)
    return out.withColumn("rate", F.col(steps[-1][0]) / F.col("total"))


def kill_test(flags: DataFrame, units: DataFrame, stratum: str) -> DataFrame:
    """indicator, n, flagged, rate, spread, rank: how often each fires over units (unit, stratum), how far its rates differ
    between strata, and its rank by that. flags: indicator, unit."""
    sizes = units.groupBy(stratum).agg(F.count("*").alias("n"))
    fired = flags.select("indicator", "unit").distinct().join(units, "unit").groupBy("indicator", stratum).agg(F.count("*").alias("flagged"))
    every = flags.select("indicator").distinct().crossJoin(F.broadcast(sizes))  # indicators and strata are few
    rates = every.join(fired, ["indicator", stratum], "left").withColumn("flagged", F.coalesce("flagged", F.lit(0))).withColumn("rate", F.col("flagged") / F.col("n"))
    out = rates.groupBy("indicator").agg(F.sum("n").alias("n"), F.sum("flagged").alias("flagged"), (F.max("rate") - F.min("rate")).alias("spread"))
    return out.withColumn("rate", F.col("flagged") / F.col("n")).withColumn("rank", F.rank().over(Window.orderBy(F.desc("spread"))).cast("long"))  # a row for each indicator


def cohort_flags(awards: DataFrame) -> DataFrame:
    """awards with i006, i007 and i008 by the cohort test's own limits: won within 90 days of incorporation; over a million to
    a dormant or micro company, or over a hundred thousand to one younger than 540 days; dormant, or accounts older than 18
    months. awards: award_date, value (pounds), incorporated, category, made_up."""
    age = F.date_diff("award_date", "incorporated")
    idle = F.lower(F.trim("category")).isin("dormant", "micro-entity")
    return awards.withColumn("i006", F.coalesce(age.between(0, 89), F.lit(False))).withColumn(
        "i007", F.coalesce(idle & (F.col("value") > 1_000_000), F.lit(False)) | F.coalesce(age.between(0, 539) & (F.col("value") > 100_000), F.lit(False))).withColumn(
        "i008", F.coalesce(F.lower(F.trim("category")) == "dormant", F.lit(False)) | F.coalesce(F.date_diff("award_date", "made_up") > 18 * 30.44, F.lit(False)))


def path_report(paths: DataFrame, most: int = 5) -> DataFrame:
    """start, goal, n, tier, shown: the number of paths, the name of the best one's weakest level, and the first few as text.
    paths: start, goal, edges, level (1 to 3 or null)."""
    text = F.array_join(F.transform("edges", lambda e: F.concat(e["edge_type"], F.lit("@"), F.coalesce(e["valid_from"].cast("string"), F.lit("undated")))), " > ")
    tier = F.element_at(F.array(*map(F.lit, ("dated", "observed", "undated"))), F.col("best"))
    g = paths.withColumn("text", text).groupBy("start", "goal").agg(F.count("*").alias("n"), F.min("level").alias("best"), F.sort_array(F.collect_set("text")).alias("all"))
    return g.select("start", "goal", "n", tier.alias("tier"), F.array_join(F.slice("all", 1, most), " | ").alias("shown"))


def pending_fetches(universe: DataFrame, cached: DataFrame, key: str, now: Column, most_days: int) -> DataFrame:
    """key of what a resumed run still has to fetch: never fetched, or longer ago than most_days. cached: key, fetched_at."""
    fresh = cached.where(F.timestamp_diff("SECOND", F.col("fetched_at"), now) / 86400 <= most_days).select(key)
    return universe.select(key).distinct().join(fresh, key, "left_anti")


def citation_report(checked: DataFrame) -> DataFrame:
    """status, n over all citations (url, quote, status): one without a URL or a quote is skipped."""
    missing = F.coalesce(F.trim("url") == "", F.lit(True)) | F.coalesce(F.trim("quote") == "", F.lit(True))
    return checked.groupBy(F.when(missing, "SKIPPED").otherwise(F.coalesce("status", F.lit("ABSENT"))).alias("status")).agg(F.count("*").alias("n"))
