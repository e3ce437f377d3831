"""Control batteries and cross-register checks on literal rows."""

from pyspark.sql import functions as F

from ledgerlight.operators import controls


def test_medical(spark):
    rows = spark.createDataFrame([("Face masks", None, None), ("x", "COVID", None), ("x", "", [("CPV", "33140000")]), ("x", "", [("OTHER", "33140000"), (None, None)]), (None, None, [])], "t string, d string, c array<struct<scheme:string,id:string>>")
    got = [r[0] for r in rows.select(controls.is_medical(F.col("t"), F.col("d"), F.col("c"))).collect()]
    assert got == [True, True, True, False, False]


def test_officer_controls(spark):
    entity = spark.createDataFrame([(1, "person", "GB-COH-OFFICER", "o1"), (2, "company", "GB-COH", "00000007"), (3, "person", "GB-COH-OFFICER", "o2")], "id long, entity_type string, scheme string, registry_id string")
    edge = spark.createDataFrame([(9, "officer_of", 1, 2, "2020-01-01")], "id long, edge_type string, source long, target long, valid_from string")
    rows = spark.createDataFrame([(1, "o1", "7", "2020-01-01"), (2, "o1", "7", "2021-01-01"), (3, "o2", "7", "2020-01-01"), (4, "zz", "7", "2020-01-01"), (5, "o1", "8", "2020-01-01")], "id int, officer_id string, company_number string, appointed_on string")
    got = {r.id: (r.status, r.reason, r.temporal) for r in controls.officer_controls(rows, entity, edge).collect()}
    assert got == {1: ("recovered", None, "matched"), 2: ("recovered", None, "mismatch"), 3: ("not_found", "no edge", "not_applicable"), 4: ("not_found", "no officer", "not_applicable"), 5: ("not_found", "no company", "not_applicable")}


def test_disqualified(spark):
    people = spark.createDataFrame([(1, "Ann", "Example", 1970, 5)], "person int, forename string, surname string, year int, month int")
    bans = spark.createDataFrame([(1, "2019-01-01", "2022-01-01", ["Old Name Ltd"]), (1, None, "2022-01-01", ["X"])], "person int, since string, until string, companies array<string>")
    rows = [("EXAMPLE, Ann Mary", 1970, 5, "c1", "active", None, ["New Ltd", "OLD NAME LTD."]), ("EXAMPLE, Ann", 1970, 5, "c2", "dissolved", None, ["Old Name Ltd"]), ("EXAMPLE, Bob", 1970, 5, "c3", "active", None, ["Old Name Ltd"]), ("EXAMPLE, Ann", 1970, 5, "c4", "active", "2020-01-01", ["Old Name Ltd"]), ("EXAMPLE, Ann", 1970, 6, "c5", "active", None, ["Old Name Ltd"])]
    apps = spark.createDataFrame(rows, "title string, year int, month int, company_number string, status string, resigned string, aliases array<string>")
    assert [tuple(r) for r in controls.disqualified(people, bans, apps, F.lit("2020-06-01")).collect()] == [(1, "c1")]
    assert controls.disqualified(people, bans, apps, F.lit("2023-06-01")).count() == 0


def test_cohort_lookup(spark):
    company = spark.createDataFrame([("1", "ALPHA LTD", "Active"), ("2", "BETA", "Active"), ("3", "BETA LIMITED", "Closed"), ("4", "GAMMA", "Active"), ("5", "GAMMA", "Active")], "company_number string, normalised_name string, company_status string")
    names = spark.createDataFrame([("Alpha Ltd",), ("beta",), ("Gamma",), ("Nobody",), ("Alpha t/a Shop",)], "supplier string")
    got = {r.supplier: (r.company_number, r.outcome) for r in controls.cohort_lookup(names, company).collect()}
    assert got == {"Alpha Ltd": ("1", "unique"), "beta": ("2", "sole_active"), "Gamma": (None, "ambiguous"), "Nobody": (None, "unmatched"), "Alpha t/a Shop": ("1", "unique")}


def test_named_companies_and_footprint(spark):
    row = spark.createDataFrame([(["A LTD (01234567)  B LTD (SC123456)", " plain "],)], "e array<string>")
    assert [tuple(x) for x in row.select(controls.named_companies(F.col("e"))).first()[0]] == [("A LTD", "01234567"), ("B LTD", "SC123456"), ("plain", None)]
    o = spark.createDataFrame([("1", "a", "active", "x"), ("1", "a", "active", "x"), ("2", "b", "successor", "x"), (None, "C.", "dissolved", None), (None, "c", "dissolved", None), ("4", "d", "active", "y")], "number string, name string, outcome string, address string")
    assert controls.footprint(o, 2).first().asDict() == {"active": 2, "successor": 1, "dissolved": 1, "flagged": 2, "live": 3, "live_without_flagged": 1}


def test_lookup_refuses_a_cut_window(spark):
    entity = spark.createDataFrame([(i, f"Common {i}") for i in range(5)] + [(9, "Only"), (10, "Twin"), (11, "twin")], "id long, name string")
    names = spark.createDataFrame([("common",), ("only",), ("twin",), ("zzz",)], "name string")
    got = {r.name: (r.id, r.outcome) for r in controls.capped_name_lookup(entity, names, 4).collect()}
    assert got == {"common": (None, "refused"), "only": (9, "unique"), "twin": (None, "ambiguous"), "zzz": (None, "none")}


def test_gates_bound_to_their_inputs(spark):
    report = spark.createDataFrame([("a", "True", "c", "g", "m"), ("b", "true", "old", "g", "m"), ("c", "on", "c", "g", "m")], "stratum string, passed string, code string, graph string, manifest string")
    got = {r.stratum: (r.passed, r.reason) for r in controls.bound_gates(report, ["a", "b", "c", "d"], "c", "g", "m").collect()}
    assert got == {"a": (True, None), "b": (False, "stale binding"), "c": (False, "failing"), "d": (False, "missing")}
    n = controls.ceiling(spark.range(12), spark.range(10)).first()
    assert (n.reachable, n.can_pass) == (10, False)


def test_lift_and_backfill(spark):
    levels = spark.createDataFrame([("base", 4), ("base", 3), ("vip", 1), ("vip", 1)], "cohort string, level int")
    got = {(r.cohort, r.level): (r.n, r.delta) for r in controls.temporal_lift(levels, "base").collect()}
    assert len(got) == 8 and got["vip", 1] == (2, 1.0) and got["vip", 2] == (0, 0.0)
    current = spark.createDataFrame([("1", "old", "s"), ("2", None, "s")], "k string, a string, b string")
    bulk = spark.createDataFrame([("1", None), ("2", "new"), ("3", "x")], "k string, a string")
    assert sorted(map(tuple, controls.backfill(current, bulk, "k", ["a"]).collect())) == [("1", "old", "s"), ("2", "new", "s")]


def test_scores_are_divided_once(spark):
    """23 of 80 are 28.75 percent exactly, 28.749999999999996 if the share is multiplied."""
    got = {r.recovered: r.pct for r in controls.threshold_table(spark.createDataFrame([(80,)], "total long")).collect()}
    assert (got[23], got[41], got[80]) == (28.8, 51.3, 100.0)
