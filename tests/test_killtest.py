"""The kill test on literal rows."""

from pyspark.sql import functions as F

from ledgerlight.operators import killtest as K

EMERGENCY = ("2020-03-01", "2020-06-30")


def tables(spark):
    tender = spark.sql("""SELECT * FROM VALUES ('o1', 't1', 'b', 'open', 100L, TIMESTAMP '2020-04-01', TIMESTAMP '2020-04-05'), ('o2', 't2', 'b', 'Limited', 100L, NULL, NULL), ('o3', 't3', '', NULL, 0L, TIMESTAMP '2020-04-01', TIMESTAMP '2020-07-01'), ('o4', 't4', 'b', 'open', 100L, TIMESTAMP '2020-04-01', TIMESTAMP '2020-07-01')
     AS t(ocid, tender_id, buyer, method, value_cents, tender_start, tender_end)""").withColumns({"source_id": F.lit("s"), "title": F.lit("x"), "raw_json": F.lit("{}")})
    award = spark.sql("""SELECT * FROM VALUES ('t1', 'a1', 'Firm', 300L, DATE '2020-04-10'), ('t2', 'a2', 'Firm', 50L, DATE '2020-01-01'), ('t2', 'a3', 'Other', 70L, DATE '2020-09-01'), ('t2', 'a4', 'Firm', 90L, DATE '2020-09-01'), ('t3', 'a5', 'n/a', 10L, CAST(NULL AS DATE)), ('t4', 'a6', 'Firm', 100L, DATE '2020-04-10'), ('t4', 'a7', 'Firm', 100L, DATE '2020-04-10')
     AS t(tender_id, award_id, supplier_name, value_cents, award_date)""")
    return tender, award


def cohort(spark, *rows):
    return spark.createDataFrame(rows, "record int, cohort string, ocid string, supplier string, value double")


def test_which_award_a_record_means(spark):
    records = cohort(spark, (1, "vip", "o1", "nobody", 0.0), (2, "vip", "o2", "Other", 0.9), (3, "vip", "o2", "Firm", 0.7), (4, "vip", "o2", "nobody", 0.7), (5, "vip", "o2", "nobody", 9.9), (6, "vip", "zz", "Firm", 3.0), (7, "vip", None, "Firm", 3.0))
    got = {r.record: (r.join_status, r.award and r.award.award_id) for r in K.matched(records, *tables(spark)).collect()}
    assert got == {1: ("matched", "a1"), 2: ("matched", "a3"), 3: ("matched", "a2"), 4: ("matched", "a3"), 5: ("award_not_matched", None), 6: ("tender_missing", None), 7: ("tender_missing", None)}


def test_scores_rates_and_ranks(spark):
    records = cohort(spark, (1, "vip", "o1", "Firm", 3.0), (2, "vip", "o2", "Other", 0.7), (3, "control", "o2", "Firm", 0.5), (4, "vip", "o3", "n/a", 0.1), (5, "vip", "zz", "Firm", 3.0), (6, "vip", "o4", "Firm", 1.0))
    scored = K.scored_records(records, *tables(spark), "buyer", EMERGENCY)
    got = {}
    for r in scored.collect():
        got.setdefault(r.record, [r.stratum]).append(r.status)
    assert got == {
        1: ["competitive__emergency", "flagged", "flagged", "flagged"], 2: ["noncompetitive__after", "missing_window", "not_flagged", "flagged_weak"], 3: ["noncompetitive__before", "missing_window", "flagged", "flagged_weak"],
        4: ["unknown_date", "not_flagged", "no_buyer", "missing_estimate"], 5: [None, "not_joined", "not_joined", "not_joined"], 6: ["competitive__emergency", "not_flagged", "flagged", "not_flagged"]}
    rates = {(r.stratum, r.indicator): (r.population, r.scoreable, r.flagged, r.rate, r.stratifier) for r in K.firing_rates(scored).collect()}
    assert rates["competitive__emergency", "i002"] == (2, 2, 1, 0.5, True) and rates["noncompetitive__after", "i002"] == (1, 0, 0, None, False) and rates["noncompetitive__after", "i004"] == (1, 1, 0, 0.0, False)
    assert {(r.indicator, r.status): r.n for r in K.coverage_table(scored).collect()}["i002", "missing_window"] == 2
    rank = {(r.stratum, r.supplier): (r.rank, r.n_flagged, list(r.flagged), r.n_scored, r.alone) for r in K.ranking(scored, "vip").collect()}
    assert rank["competitive__emergency", "Firm"] == (1, 3, ["i002", "i003", "i004"], 3, True) and rank["noncompetitive__after", "Other"] == (1, 0, [], 2, False)


def test_ties_leave_a_gap(spark):
    rows = [(s, "vip", "x", i, "flagged" if n > k else "not_flagged") for s, n in (("a", 2), ("b", 2), ("c", 1), ("d", 0)) for k, i in enumerate(K.INDICATORS)]
    ranked = K.ranking(spark.createDataFrame(rows, "supplier string, cohort string, stratum string, indicator string, status string"), "vip")
    assert {r.supplier: (r.rank, r.alone) for r in ranked.collect()} == {"a": (1, False), "b": (1, False), "c": (3, False), "d": (4, False)}


def test_prices_are_judged_where_tenders_lie(spark):
    """Awards are not moved again by their ids to learn their flags, and of two awards with one id the stronger flag's word counts."""
    from ledgerlight.sources.workdir import laid_out

    tender, award = tables(spark)
    twice = award.unionByName(award.where("award_id = 'a6'").withColumn("value_cents", F.lit(10).cast("long")))
    records = cohort(spark, (6, "vip", "o4", "Firm", 1.0))
    scored = K.scored_records(records, laid_out(tender, "tender_id"), laid_out(twice, "tender_id"), "buyer", EMERGENCY)
    assert {r.indicator: r.status for r in scored.collect()}["i004"] == "flagged_weak"
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "award_id" in x.split("hashpartitioning")[1]] and "s4" not in plan
