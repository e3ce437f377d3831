"""The store of flags and the runs that fill it."""

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import plugins
from ledgerlight.operators.plugins import INDICATORS, LOCALES, VALIDATED, Indicator, enabled_for, run_indicators
from ledgerlight.sources.flags import FlagStore
from ledgerlight.sources.store import Conflict

KIND = "indicator_id string, subject string, tender_id string, details string"


@pytest.fixture
def store(spark, tmp_path):
    return FlagStore(spark, str(tmp_path / "flags"))


def flags(spark, *pairs):
    return spark.createDataFrame([(i, s, None, "{}") for i, s in pairs], KIND)


def held(store, version=None):
    return sorted((r.source_id, r.indicator_id, r.subject) for r in store.read(version).collect())


def test_a_run_replaces_all_its_indicators(spark, store):
    assert held(store) == []
    assert store.replace(flags(spark, ("i1", "a"), ("i2", "b")), "s", ["i1", "i2", "i3"]) == {"i1": {"flags": 1, "persisted": 1}, "i2": {"flags": 1, "persisted": 1}, "i3": {"flags": 0, "persisted": 0}}
    store.replace(flags(spark, ("i1", "x")), "other", ["i1"])
    store.replace(flags(spark, ("i1", "c"), ("i1", "c")), "s", ["i1", "i2"])  # i2 flags nothing any more
    assert held(store) == [("other", "i1", "x"), ("s", "i1", "c"), ("s", "i1", "c")]
    store.replace(flags(spark), "s", ["i1"])  # a run without any flag
    assert held(store) == [("other", "i1", "x")]
    assert held(store, 1) == [("s", "i1", "a"), ("s", "i2", "b")]  # a reader of an earlier version isn't disturbed
    store.vacuum(keep=1)
    assert held(store) == [("other", "i1", "x")]


def test_indicators_that_did_not_run_keep_their_flags(spark, store):
    store.replace(flags(spark, ("i1", "a"), ("i2", "b")), "s", ["i1", "i2"])
    store.replace(flags(spark, ("i1", "z")), "s", ["i1"])
    assert held(store) == [("s", "i1", "z"), ("s", "i2", "b")]


def test_a_dry_run_changes_nothing(spark, store):
    assert store.replace(flags(spark, ("i1", "a")), "s", ["i1"], dry_run=True) == {"i1": {"flags": 1, "persisted": 0}}
    assert held(store) == [] and store.versions.latest() == 0


def test_a_failed_count_leaves_the_old_flags(spark, store, monkeypatch):
    store.replace(flags(spark, ("i1", "a")), "s", ["i1"])
    monkeypatch.setattr(FlagStore, "stored", lambda self, folder: {"i1": 7})
    with pytest.raises(RuntimeError):
        store.replace(flags(spark, ("i1", "b")), "s", ["i1"])
    assert held(store) == [("s", "i1", "a")] and store.versions.latest() == 1


def test_flags_of_others_and_odd_names_are_refused(spark, store):
    for rows, source in ((flags(spark, ("i2", "b")), "s"), (flags(spark, (None, "b")), "s"), (flags(spark, ("i1", "b")), "a/b")):
        with pytest.raises(ValueError):
            store.replace(rows, source, ["i1"])
    assert held(store) == []


def test_two_writers(spark, store, monkeypatch):
    store.replace(flags(spark, ("i1", "a")), "s", ["i1"])
    monkeypatch.setattr(type(store.versions), "latest", lambda self: 0)  # as seen before the first was published
    with pytest.raises(Conflict):
        store.replace(flags(spark, ("i1", "b")), "s", ["i1"])
    monkeypatch.undo()
    assert held(store) == [("s", "i1", "a")]


def test_validated_places():
    assert [i.indicator_id for i in enabled_for("gb")] == [f"i00{k}" for k in range(1, 9)]
    assert [i.indicator_id for i in enabled_for("ua")] == [f"i00{k}" for k in range(1, 6)] == [i.indicator_id for i in enabled_for("co")]
    assert enabled_for("eu") == [] and len(INDICATORS) == 9
    assert not Indicator("x", (), None).runs_in("gb")
    with pytest.raises(ValueError):
        plugins.register("i002", ("tender",), None, {})
    with pytest.raises(ValueError):
        plugins.register("new", ("tender",), None, {"gb": "perhaps"})
    assert "new" not in INDICATORS and LOCALES["br"].min_bid_days is None


def tables(spark):
    tender = spark.createDataFrame([("t1", "s", "open", "b", 100, "2020-01-01", "2020-01-05"), ("t2", "s", "open", "b", 100, "2020-01-01", "2020-06-01"), ("t3", "other", "open", "b", 100, "2020-01-01", "2020-01-02")], "tender_id string, source_id string, method string, buyer_name string, value_cents long, tender_start string, tender_end string")
    tender = tender.selectExpr("*", "tender_id AS tender_key", "'x' AS title", "'{}' AS raw_json", "CAST(tender_start AS TIMESTAMP) AS a", "CAST(tender_end AS TIMESTAMP) AS b").drop("tender_start", "tender_end").withColumnsRenamed({"a": "tender_start", "b": "tender_end"})
    award = spark.sql("SELECT * FROM VALUES ('t1', 'a1', 'Firm', 300L, 'active', DATE '2020-02-01', 'per_supplier'), ('t3', 'a3', 'Firm', 300L, 'active', DATE '2020-02-01', 'per_supplier') AS t(tender_id, award_id, supplier_name, value_cents, status, award_date, value_kind)")
    resolution = spark.sql("SELECT * FROM VALUES ('a1', '1', 1.0D, 'identifier'), ('a3', '1', 1.0D, 'identifier') AS t(award_id, company_number, match_confidence, match_method)")
    company = spark.sql("SELECT '1' AS company_number, DATE '2020-01-15' AS incorporation_date, 'Full' AS accounts_category, CAST(NULL AS DATE) AS last_made_up")
    bid = spark.sql("SELECT 't1' AS tender_id, 'x' AS bidder")
    return {"tender": tender, "award": award, "resolution": resolution, "company": company, "bid": bid}


def test_a_run_of_one_source(spark, store):
    report = run_indicators(tables(spark), "s", "gb", store)
    assert report["skipped"] == ["i009"] and report["ran"][0] == "i001"
    n = report["per_indicator"]
    assert n["i002"] == {"flags": 1, "persisted": 1, "units": 2, "unscoreable": 0}  # below thirty days in this country
    assert n["i006"] == {"flags": 1, "persisted": 1, "units": 1, "unscoreable": 0}
    assert n["i003"] == {"flags": 0, "persisted": 0, "units": 1, "unscoreable": 0}  # units are known without flags too
    rows = {(r.indicator_id, r.subject): (r.tender_id, r.details) for r in store.read().collect()}
    assert rows["i006", "t1:a1"][0] == "t1" and '"days":17' in rows["i006", "t1:a1"][1]
    assert rows["i002", "t1"][0] == "t1"
    assert {s for _, s in rows} == {"t1", "t1:a1"}


def test_a_failing_indicator_stores_nothing(spark, store):
    run_indicators(tables(spark), "s", "gb", store)
    before = held(store)
    broken = tables(spark) | {"resolution": tables(spark)["resolution"].limit(0)}
    with pytest.raises(RuntimeError):
        run_indicators(broken, "s", "gb", store)
    with pytest.raises(ValueError):
        run_indicators({k: v for k, v in tables(spark).items() if k != "company"}, "s", "gb", store)
    assert held(store) == before
    assert run_indicators(tables(spark), "s", "eu", store)["per_indicator"] == {}
    assert run_indicators(tables(spark), "s", "gb", store, dry_run=True)["per_indicator"]["i002"]["persisted"] == 0


@pytest.mark.parametrize("mark", ["", ":x"])
def test_tenders_of_flags_are_looked_up_only_where_they_must_be(spark, mark):
    """Flags of tenders are as many as tenders and awards: they are joined with tenders again only if ids have a colon."""
    some = {n: t.withColumn("tender_id", F.concat("tender_id", F.lit(mark))) if "tender_id" in t.columns else t for n, t in tables(spark).items()}
    context = plugins.Context("s", LOCALES["gb"], plugins.of_source(some, "s"))
    flags, _ = plugins.evaluated(context, [INDICATORS[i] for i in ("i001", "i002", "i004", "i006")])
    assert ("LeftOuter" in flags._jdf.queryExecution().optimizedPlan().toString()) == bool(mark)
    rows = sorted((r.indicator_id, r.subject, r.tender_id) for r in flags.collect())
    tender = None if mark else "t1"  # what stands before the first colon is no tender's id then
    assert rows == [("i001", f"t1{mark}", tender), ("i002", f"t1{mark}", tender), ("i004", f"t1{mark}:a1", tender), ("i006", f"t1{mark}:a1", tender)]


def test_runs_of_all_sources_lay_tenders_and_awards_out_once(spark, monkeypatch):
    from ledgerlight.plans import runs

    seen, laid_out = [], runs.laid_out
    monkeypatch.setattr(runs, "laid_out", lambda df, key: (seen.append((key, len(df.columns))), laid_out(df, key))[1])
    assert runs.k01(spark, "/root/testdata/sf0.001").count() == 18
    assert seen == [("tender_id", 12), ("tender_id", 7)]
