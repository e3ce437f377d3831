"""Scoring against external truth: golden relationships, cohorts, curated lists, manifests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.scalars import normalise_name

PRIORITY = ("no_trace_by_design", "untestable", "not_recovered", "undated_only", "recovered")  # fixed order, least first
RELATIONSHIPS = ("directorship", "shareholding", "donation", "family", "employment", "consultancy")


def golden_matches(golden: DataFrame, edge: DataFrame, days: int = 30) -> DataFrame:
    """g, edge, method, temporal (match, miss or null_date): each golden relationship with the first edge, in the order of
    both ids, that no earlier one took.

    Both: id, edge_type, and source and target name, scheme and registry_id, valid_from. An end matches by identifier, else
    by normalised name; the weaker of both is the method. Candidates are found by equi-joins on each way of matching. A
    golden relationship and an edge can only compete within one edge type and pair of ends, so the taking in turn runs
    per connected pair of ends rather than over all."""
    ends = ("source", "target")

    def keyed(df: DataFrame, way: tuple[str, str]) -> DataFrame:
        keys = []
        for end, how in zip(ends, way):
            keys.append(F.concat_ws("|", f"{end}_scheme", f"{end}_registry_id") if how == "registry_id" else normalise_name(F.col(f"{end}_name")))
        usable = [F.col(f"{e}_registry_id").isNotNull() & F.col(f"{e}_scheme").isNotNull() if h == "registry_id" else F.col(f"{e}_name").isNotNull() for e, h in zip(ends, way)]
        return df.where(usable[0] & usable[1]).select("id", "edge_type", keys[0].alias("a"), keys[1].alias("b"))

    found = None
    for way in (("registry_id", "registry_id"), ("registry_id", "name"), ("name", "registry_id"), ("name", "name")):
        g = keyed(golden, way).withColumnRenamed("id", "g")
        e = keyed(edge, way).withColumnRenamed("id", "e")
        pairs = g.join(e, ["edge_type", "a", "b"]).select("g", "e", F.lit("name" if "name" in way else "registry_id").alias("method"))
        found = pairs if found is None else found.unionByName(pairs)
    found = found.groupBy("g", "e").agg(F.max("method").alias("method"))  # registry_id after name: the better way wins
    # pairs that share a golden relationship or an edge compete: those of one source name and edge type are a superset
    bucket = golden.select(F.col("id").alias("g"), F.concat_ws("|", "edge_type", normalise_name(F.col("source_name")), normalise_name(F.col("target_name"))).alias("bucket"))
    dates = golden.select(F.col("id").alias("g"), F.col("valid_from").alias("gd")), edge.select(F.col("id").alias("e"), F.col("valid_from").alias("ed"))
    full = found.join(bucket, "g").join(dates[0], "g").join(dates[1], "e")

    def take(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["g"], r["e"]))
        used_g, used_e, out = set(), set(), []
        for r in rows:
            if r["g"] not in used_g and r["e"] not in used_e:
                used_g.add(r["g"])
                used_e.add(r["e"])
                out.append(r)
        return pa.Table.from_pylist(out, schema=table.schema)

    taken = full.groupBy("bucket").applyInArrow(take, full.schema)
    temporal = F.when(F.col("gd").isNull(), "match").when(F.col("ed").isNull(), "null_date").when(F.abs(F.date_diff("ed", "gd")) <= days, "match").otherwise("miss")
    return taken.select("g", F.col("e").alias("edge"), "method", temporal.alias("temporal"))


def precision_recall(matches: DataFrame, golden: DataFrame, tested_edges: DataFrame) -> DataFrame:
    """One row: true positives, tested edges that matched nothing, and the rates; 0 where there is nothing to divide by."""
    counts = matches.agg(F.count("*").alias("tp"), F.count_if(F.col("temporal") == "match").alias("on_time")).crossJoin(golden.agg(F.count("*").alias("asked"))).crossJoin(
        tested_edges.join(matches.select(F.col("edge").alias("id")), "id", "left_anti").agg(F.count("*").alias("fp")))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return counts.select("tp", "fp", "asked", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("asked")).alias("recall"), ratio(F.col("on_time"), F.col("tp")).alias("temporal_accuracy"))


def case_status(rows: DataFrame, case: str) -> DataFrame:
    """The best status of a case's rows, with the numbers of rows and award dates and the earliest of these."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("status"))
    return rows.groupBy(case).agg(F.max_by("status", rank).alias("status"), F.count("*").alias("n_rows"), F.count_distinct("award_date").alias("n_awards"), F.min("award_date").cast("string").alias("earliest"))


def manifest(rows: DataFrame) -> DataFrame:
    """case_id, verdict (admissible, out_of_scope, inadmissible), reasons: every rule that a row breaks, in order.

    Only an explicit yes confirms an awardee; a start that is unknown or not before the award does not count; an office not
    yet held, or no longer, at the award is out of scope, which is no refutation."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    said = lambda c: F.when(F.lower(text(c)).isin("yes", "true", "y", "1"), True).when(F.lower(text(c)).isin("no", "false", "n", "0"), False)
    day = lambda c: F.try_to_date(F.nullif(text(c), F.lit("")), "yyyy-MM-dd")
    again = F.row_number().over(Window.partitionBy("case_id").orderBy("seq")) > 1
    award, start, held = day("award_date"), day("relationship_start"), said("held_office_at_award")
    rules = [
        (text("case_id") == "", "missing case_id"), ((text("case_id") != "") & F.col("again"), "duplicate case_id"), (text("company_number") == "", "missing company_number"), (~F.coalesce(said("awardee_confirmed"), F.lit(False)), "awardee not confirmed"),
        (text("label_source_url") == "", "missing label_source_url"), (award.isNull(), "missing award_date"), (text("relationship_start") == "", "missing relationship_start"),
        (F.lower(text("relationship_start")) == "unknown", "relationship_start unknown"), (~F.lower(text("relationship_start")).isin("", "unknown") & start.isNull(), "relationship_start unreadable"),
        (F.coalesce(start >= award, F.lit(False)), "relationship_start not before award"), (~F.lower(text("relationship_type")).isin(*RELATIONSHIPS), "relationship_type not in vocabulary"),
        (held.isNull(), "held_office_at_award not stated"), (day("office_holding_start_date").isNull(), "missing office_holding_start_date"),
        ((text("office_holding_end_date") != "") & day("office_holding_end_date").isNull(), "office_holding_end_date unreadable"),
    ]
    reasons = F.filter(F.array(*(F.when(cond, F.lit(what)) for cond, what in rules)), lambda x: x.isNotNull())
    outside = ~held | (day("office_holding_start_date") > award) | F.coalesce(day("office_holding_end_date") < award, F.lit(False))
    return rows.withColumn("again", again).withColumn("reasons", reasons).select("seq", "case_id", F.when(F.size("reasons") > 0, "inadmissible").when(outside, "out_of_scope").otherwise("admissible").alias("verdict"), "reasons")


def fisher(tables: DataFrame) -> DataFrame:
    """tables (key, a, b, c, d) with p, Fisher's exact two-sided probability: all tables no likelier than the one observed, up
    to a part in 10**9. Tables that are 1e-320 times as likely as the likeliest one, or less, add nothing to the sum, so those
    are weighed that lie about the likeliest: as many as the square root of the counts asks for."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def away(start: int, end: int, ratio) -> np.ndarray:
            """Logarithms of what lies from the likeliest table on, against it, until it is nothing."""
            step, found = (1 if end >= start else -1), [np.zeros(0)]
            at, last = start, 0.0
            while at != end and last > -740.0:
                k = np.arange(at, at + step * min(65_536, abs(end - at)), step, dtype=np.float64)
                found.append(last + np.cumsum(np.log(ratio(k))))
                at, last = at + step * len(k), float(found[-1][-1])
            return np.concatenate(found)

        for batch in batches:
            out = []
            for a, b, c, d in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                n, row, col = a + b + c + d, a + b, a + c
                low, high = max(0, row + col - n), min(row, col)
                if low == high:
                    out.append(1.0)
                    continue
                top = min(high, max(low, (row + 1) * (col + 1) // (n + 2)))
                up = away(top, high, lambda k: (row - k) / (k + 1) * ((col - k) / (n - row - col + k + 1)))  # noqa: B023
                down = away(top, low, lambda k: k / (row - k + 1) * ((n - row - col + k) / (col - k + 1)))  # noqa: B023
                weights = np.concatenate([down[::-1], [0.0], up])
                at = a - (top - len(down))
                seen = weights[at] if 0 <= at < len(weights) else -np.inf
                likely = np.exp(weights)
                out.append(min(1.0, float(likely[weights <= seen + 1e-9].sum() / likely.sum())))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(out, pa.float64())], ["key", "a", "b", "c", "d", "p"])

    return tables.select("key", "a", "b", "c", "d").mapInArrow(compute, "key string, a long, b long, c long, d long, p double")


def flag_scores(flags: DataFrame) -> DataFrame:
    """flags (indicator, jurisdiction, subject, value_cents, length, has_url) with score: rarity, value at stake, detail,
    convergence and traceability."""
    total = flags.agg(F.count("*").alias("total"))
    share = lambda k: flags.groupBy(k).agg(F.count("*").alias(f"{k}_n"))
    many = flags.groupBy("subject").agg(F.count_distinct("indicator").alias("kinds"))
    j = flags.join(share("indicator"), "indicator").join(share("jurisdiction"), "jurisdiction").join(many, "subject").crossJoin(F.broadcast(total))
    rarity = (1 - F.col("indicator_n") / F.col("total")) + (1 - F.col("jurisdiction_n") / F.col("total"))
    value = F.when(F.col("value_cents") > 0, F.log10("value_cents")).otherwise(0.0)
    score = rarity * 3 + value * 2 + F.least(F.col("length") / 200, F.lit(2.0)) + F.when(F.col("kinds") >= 2, 4.0).otherwise(0.0) + F.when(F.col("has_url"), 1.0).otherwise(-1.0)
    return j.select(*flags.columns, score.alias("score"))


def curated(scored: DataFrame, top: int = 10) -> list:
    """At most `top` flags: the best of each indicator and jurisdiction first, then by score within the caps of 40 and 50
    in 100; never padded. A subject is taken once in the second pass.

    The second pass takes by score in turn. Of a combination's rows with one subject only the best can ever be taken, so
    the others go first. Of those left, no more than `top` are passed over for their subject, for so many are chosen at
    most, and no more than `top` are taken; where a cap passes one over, the combination has ended. So the best 2 x top of
    each combination decide, and that times the number of combinations bounds what comes to the driver.
    """
    columns = scored.columns
    place = Window.partitionBy("indicator", "jurisdiction").orderBy(F.desc("score"), "subject")
    best = scored.groupBy("indicator", "jurisdiction", "subject").agg(F.max_by(F.struct(*columns), F.struct("score", *(c for c in columns if c not in ("score", "indicator", "jurisdiction", "subject")))).alias("row")).select("row.*")
    rows = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= 2 * top).orderBy(F.desc("score"), "subject", "indicator", "jurisdiction").collect()
    per_indicator, per_place = max(1, int(top * 0.4)), max(1, int(top * 0.5))
    chosen, by_indicator, by_place = [], {}, {}

    def take(r):
        chosen.append(r)
        by_indicator[r["indicator"]] = by_indicator.get(r["indicator"], 0) + 1
        by_place[r["jurisdiction"]] = by_place.get(r["jurisdiction"], 0) + 1

    for r in rows:
        if r["rank"] == 1 and len(chosen) < top:
            take(r)
    subjects = {r["subject"] for r in chosen}
    for r in rows:
        if len(chosen) < top and r["subject"] not in subjects and by_indicator.get(r["indicator"], 0) < per_indicator and by_place.get(r["jurisdiction"], 0) < per_place:
            take(r)
            subjects.add(r["subject"])
    return chosen


def path_strata(edge_type: Column, sources: Column) -> Column:
    """The register that an edge's evidence belongs to, or null."""
    return F.when(edge_type == "officer_of", "ch_officer_appointment").when((edge_type == "declared_interest") & F.array_contains(sources, "UK Parliament Register of Interests"), "commons_declared_interest").when(
        (edge_type == "declared_interest") & F.array_contains(sources, "UK House of Lords Register of Interests"), "lords_declared_interest")
