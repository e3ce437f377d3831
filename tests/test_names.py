"""Names, counterparties, appointments and register pages on invented rows."""

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import names
from ledgerlight.operators import registers


def apply(spark, f, *values):
    schema = ", ".join(f"v{i} string" for i in range(len(values)))
    got = spark.createDataFrame([values], schema).select(f(*(F.col(f"v{i}") for i in range(len(values))))).first()[0]
    return tuple(got) if hasattr(got, "asDict") else got


@pytest.mark.parametrize("name,want", [
    ("Viscountess  Quill of Upper & Nether Marl", ("quill", None, "viscountess", "upper & nether marl", False)), ("Dame Ivy Rook", ("rook", "ivy", "dame", None, False)), ("Prof Sir Abel  Tarn-Moss", ("tarn-moss", "abel", "sir", None, False)),
    ("Mr A. B. O'Dell", ("o'dell", "a", None, None, False)), ("The Lord Archbishop of Fen", ("", None, "lord", None, True)), ("Earl of Wick", ("", None, "earl", None, False)), ("Offord", ("offord", None, None, None, False)), (" ", ("", None, None, None, False)), (None, ("", None, None, None, False)),
])
def test_member_name(spark, name, want):
    assert apply(spark, names.member_name, name) == want


@pytest.mark.parametrize("name,want", [
    ("ROOK, Ivy May, Dame", ("rook", "ivy", "dame", None)), ("QUILL, Zoe, Viscountess Quill Of Nether Marl Obe", ("quill", "zoe", "viscountess", "nether marl obe")), ("TARN MOSS, Sir Abel", ("tarnmoss", "abel", "sir", None)), ("O'DELL", ("o'dell", None, None, None)), (", Ivy", ("", None, None, None)), (None, ("", None, None, None)),
])
def test_officer_name(spark, name, want):
    assert apply(spark, names.officer_name, name) == want


def test_rank(spark):
    assert [apply(spark, names.common_title, x) for x in ("baron", "lady", "earl", None)] == ["lord", "lady", "earl", None]


def test_territory(spark):
    same = lambda a, b: apply(spark, names.same_territory, a, b)
    assert same("new place", "new place kg") and same("x", None) and not same(None, "x") and not same("new", "newplace")


@pytest.mark.parametrize("text,category,want", [
    ("Chairman, Sample PC (UK) Ltd (computing (and software))", None, ("Sample PC (UK) Ltd", False)), ("Director, Sample plc (food, drink)", None, ("Sample plc", False)), ("Sample, Inc.", None, ("Sample, Inc.", False)),
    ("Halmond", "Category 2: Shareholdings", ("Halmond", False)), ("Halmond", "Category 1", (None, False)), ("Director, family company Example Ltd", None, ("family company Example Ltd", False)), ("Director of family firm, Example Ltd", None, (None, True)),
    ("the member has no shares", "Category 2", (None, False)), ("18 December 2025", "Category 2", (None, False)), ("", None, (None, False)),
])
def test_counterparty(spark, text, category, want):
    assert apply(spark, names.counterparty, text, category) == want


def test_ceased(spark):
    assert str(apply(spark, names.ceased_on, "X (interest ceased 5 March 2020)")) == "2020-03-05"
    assert apply(spark, names.ceased_on, "X (interest ceased 5 Mar 2020)") is None and apply(spark, names.ceased_on, "X") is None


def test_appointments_and_owners(spark):
    rows = spark.createDataFrame([("o1", "7", "2020-01-01", "2019-01-01"), ("o1", "7", "2020-01-01", "soon"), ("o1", "99", "2020-01-01", None), ("zz", "7", "2020-01-01", None)], "officer_id string, company_number string, appointed string, resigned string")
    got = registers.appointments(rows, spark.createDataFrame([("o1",)], "officer_id string"), spark.createDataFrame([("00000007",)], "company_number string"))
    assert sorted((r.status, str(r.valid_from), str(r.valid_to)) for r in got.collect()) == [("ended_date_unknown", "2020-01-01", "None"), ("inconsistent_source_dates", "None", "None")]
    owners = spark.createDataFrame([("e", "owner", "corporate-entity-beneficial-owner", "A", "7", None), ("e", "officer", "corporate-managing-officer", "B", None, None), ("e", "owner", "individual-beneficial-owner", "P", None, None), ("e", "owner", "individual-beneficial-owner", "Q", None, "2020-01-01")], "entity string, role string, kind string, name string, number string, ceased string")
    edges, people = registers.overseas_owners(owners)
    assert sorted(map(tuple, edges.collect())) == [("e", "00000007", "ownership"), ("e", "e:B", "officer_of")] and people.first().individuals == 1 and people.columns == ["entity", "individuals"]


def test_register_pages(spark):
    html = """<div><a href="/member/12/x"><div class="primary-info">Lord Sample</div></a><div class="expand-area"><div class="card card-child"><div class="primary-info">Category 1: Directorships</div>
      <ul><li>Director, Sample Ltd</li><li>Chair, <b>Other</b> plc</li></ul></div><div class="card card-child"><div class="primary-info">Category 2: Shares</div><ul><li>Sample Ltd</li></ul></div></div></div>
      <div><a href="/member/13/y"><div class="primary-info">Lady Example</div></a><div class="card card-child"><div class="primary-info">Nil</div><p>No registrable interests</p></div></div>"""
    got = [(r.member_id, r.name, r.category, r.description) for r in registers.register_pages(spark.createDataFrame([("p", html), ("q", None)], "page string, html string")).orderBy("place").collect()]
    assert got == [("12", "Lord Sample", "Category 1: Directorships", "Director, Sample Ltd"), ("12", "Lord Sample", "Category 1: Directorships", "Chair,Otherplc"), ("12", "Lord Sample", "Category 2: Shares", "Sample Ltd")]


def test_referrers_are_given_once(spark):
    """Ids that are asserted decide; pairs under several surnames or ways come once, without a shuffle of pairs."""
    from ledgerlight.operators import ladders

    rows = [("a", "1", "rook"), ("b", None, "rook"), ("b", " ", "tarn"), ("c", "gone", "rook"), ("d", "2", "x"), ("d", None, "tarn"), ("e", None, ""), ("f", None, None), ("b", None, "rook"), (None, None, "rook")]
    people = [(1, "1", "rook"), (2, "2", "tarn"), (3, "3", "rook"), (3, "3", "tarn"), (3, "3", "rook"), (4, None, ""), (None, "5", "tarn")]
    found = ladders.resolve_referrers(spark.createDataFrame(rows, "key string, registry_id string, surname string"), spark.createDataFrame(people, "id long, registry_id string, surname string"))
    got = [tuple(r) for r in found.collect()]
    want = {(k, 1 if i == "1" else 2) for k, i, _ in rows if i in ("1", "2")} | {(k, p) for k, i, s in rows if not (i or "").strip() and s for p, _, t in people if t == s}
    assert sorted(got, key=repr) == sorted(want, key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "HashAggregate(keys=[key" not in plan.split("Union")[0]


def test_no_table_of_referrers_is_sent_to_all(spark):
    """However small tables are thought to be: none is broadcast, and people of a surname meet those who ask for it as lists."""
    from ledgerlight.operators import ladders

    people = spark.range(40).selectExpr("id", "CAST(id AS STRING) AS registry_id", "concat('quill', id % 2) AS surname")
    rows = spark.range(60).selectExpr("id AS key", "CASE WHEN id % 3 = 0 THEN CAST(id AS STRING) END AS registry_id", "concat('quill', id % 2) AS surname")
    found = ladders.resolve_referrers(rows, people)
    got = [tuple(r) for r in found.collect()]
    assert sorted(got) == sorted([(k, k) for k in range(0, 40, 3)] + [(k, p) for k in range(60) if k % 3 for p in range(k % 2, 40, 2)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "explode(people" in plan
