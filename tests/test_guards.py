"""Each guard of the operators, on a few literal rows."""

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import scalars as S
from ledgerlight.operators import aggregates, documents, gates, graph, guards, indicators, resolve, sequence
from ledgerlight.sources import ingest


def one(spark, column, **values):
    row = {k: v for k, v in values.items()}
    schema = ", ".join(f"{k} string" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("raw,want", [("7015428", "07015428"), ("sc123", "SC000123"), ("  12345678 ", "12345678"), ("123456789", "123456789"), ("", None), (None, None), ("AB-1", "AB-1")])
def test_company_number(spark, raw, want):
    assert one(spark, S.normalise_company_number(F.col("v")), v=raw) == want


@pytest.mark.parametrize("raw,want", [("1.005", 101), ("-1.005", -101), ("", 0), ("abc", 0), (None, 0), ("12", 1200)])
def test_cents(spark, raw, want):
    assert one(spark, S.to_cents(F.col("v")), v=raw) == want


@pytest.mark.parametrize("raw,want", [("£7,500.00", 750000), ("x", None), ("", None)])
def test_donation_cents(spark, raw, want):
    assert one(spark, S.donation_cents("v"), v=raw) == want


@pytest.mark.parametrize("raw,want", [("Lord Example of Placeton", "example"), ("SAMPLE, John, Sir", "sample"), ("Jane Instance MP", "instance"), ("Dr X", ""), (None, "")])
def test_surname(spark, raw, want):
    assert one(spark, S.surname(F.col("v")), v=raw) == want


def test_names(spark):
    assert one(spark, S.loose_name(F.col("v")), v="The Example & Co. (UK) Limited") == "EXAMPLE"
    assert one(spark, S.strip_suffix(F.col("v")), v="example  ltd") == "EXAMPLE"
    assert one(spark, S.legal_name(F.col("v")), v="Example Ltd t/a Sample") == "Example Ltd"
    assert one(spark, S.is_placeholder(F.col("v")), v=" N/A ")


def test_floored_days(spark):
    row = spark.sql("SELECT TIMESTAMP'2024-01-02 00:00:00' a, TIMESTAMP'2024-01-01 23:00:00' b")
    assert row.select(S.floored_days(F.col("a"), F.col("b"))).first()[0] == -1


def test_two_active_namesakes_are_not_guessed(spark):
    company = spark.createDataFrame([("1", "A", "Active"), ("2", "A", "Active"), ("3", "B", "Active"), ("4", "B", "Closed"), ("5", "C", "Closed")], "company_number string, normalised_name string, company_status string")
    award = spark.createDataFrame([("w1", "t", "a", None, None), ("w2", "t", " b ", None, None), ("w3", "t", "c", None, None), ("w4", "t", "b", "GB-COH", "9"), ("w5", "t", None, None, None)], "award_id string, tender_id string, supplier_name string, supplier_scheme string, supplier_number string")
    got = {r.award_id: (r.company_number, r.match_confidence, r.match_method) for r in resolve.resolve_awards(award, company).collect()}
    assert got == {"w1": (None, 0.0, "ambiguous"), "w2": ("3", 0.9, "exact_name"), "w3": ("5", 0.9, "exact_name"), "w4": ("00000009", 0.0, "identifier"), "w5": (None, 0.0, "unmatched")}


def test_clusters_are_anchored_not_gapped(spark):
    rows = spark.createDataFrame([("k", d) for d in ("2024-01-01", "2024-01-25", "2024-02-10", "2024-03-05")], "k string, d string").withColumn("d", F.to_date("d"))
    got = {str(r.d): str(r.anchor) for r in sequence.anchored_clusters(rows, ["k"], "d", 30).collect()}
    assert got == {"2024-01-01": "2024-01-01", "2024-01-25": "2024-01-01", "2024-02-10": "2024-02-10", "2024-03-05": "2024-02-10"}


def edges(spark, rows):
    return spark.createDataFrame(rows, "id long, edge_type string, source long, target long, valid_from string").withColumn("valid_from", F.to_date("valid_from"))


def test_identity_is_free_before_the_budget_is_spent_only(spark):
    e = edges(spark, [(1, "officer_of", 1, 2, None), (2, "same_as", 2, 3, None), (3, "officer_of", 3, 9, None), (4, "officer_of", 2, 5, None), (5, "officer_of", 5, 6, None), (6, "same_as", 6, 9, None), (7, "officer_of", 1, 2, "2020-01-01")])
    one_, goal = spark.createDataFrame([(1,)], "start long"), spark.createDataFrame([(9,)], "goal long")
    got = sorted([x.edge for x in r.edges] for r in graph.bounded_paths(e, one_, goal, 2).collect())
    assert got == [[1, 2, 3], [7, 2, 3]]
    assert sorted(len(r.edges) for r in graph.bounded_paths(e, one_, goal, 3).collect()) == [3, 3]
    assert graph.bounded_paths(e, one_, spark.createDataFrame([(1,)], "goal long"), 2).count() == 0


def test_all_identity_path_has_no_level(spark):
    e = edges(spark, [(1, "same_as", 1, 9, None)])
    paths = graph.bounded_paths(e, spark.createDataFrame([(1,)], "start long"), spark.createDataFrame([(9,)], "goal long"))
    attestation = spark.createDataFrame([], "id long, edge long, observed_at date, match_confidence double")
    level = graph.path_levels(paths, graph.edge_levels(e, attestation, F.lit("2020-01-01").cast("date")))
    assert level.first().level is None
    pairs = spark.createDataFrame([(1, 9), (1, 8)], "start long, goal long")
    assert {r.goal: r.level for r in graph.relationship_levels(pairs, level).collect()} == {9: None, 8: 4}
    assert graph.identity_confidence(paths, attestation).first().confidence is None


def test_two_cycle_has_two_origins(spark):
    a = spark.createDataFrame([(1, 2), (2, 1), (3, None), (4, 3), (5, 99)], "id long, derived_from long")
    got = {r.id: r.origin for r in graph.origins(a).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5}


def test_coverage_raises_on_counts_that_do_not_add_up(spark):
    schema = "family string, ingested long, failed long, missing long, total long"
    assert [r.passed for r in gates.coverage(spark.createDataFrame([("a", 5, 0, 0, 5), ("b", 4, 0, 1, 5), ("c", 0, 0, 0, 0)], schema)).orderBy("family").collect()] == [True, False, False]
    with pytest.raises(ValueError):
        gates.coverage(spark.createDataFrame([("a", 5, 0, 0, 6)], schema))


def test_small_battery_is_unavailable(spark):
    got = gates.stratum(spark.createDataFrame([("a", 11, 11), ("b", 11, 12), ("c", 10, 12), ("d", 13, 12)], "stratum string, recovered long, total long"))
    assert {r.stratum: (r.available, r.passed) for r in got.collect()} == {"a": (False, False), "b": (True, True), "c": (True, False), "d": (False, False)}


def test_path_qualifies_by_subset_not_intersection(spark):
    rows = spark.createDataFrame([("clean", ["x"]), ("clean", ["x", "y"]), ("unverifiable", ["x"]), ("clean", [])], "t string, s array<string>")
    assert [r[0] for r in rows.select(gates.qualifies(F.col("t"), F.col("s"), ["x"])).collect()] == [True, False, False, False]


def test_missing_resolution_raises(spark):
    award = spark.createDataFrame([("a",)], "award_id string")
    with pytest.raises(RuntimeError):
        indicators.require_resolution(award, award.limit(0))


def test_digest_is_order_free(spark):
    rows = spark.createDataFrame([("b",), ("a",), (None,)], "x string")
    text = F.coalesce("x", F.lit("None"))
    assert aggregates.table_digest(rows, text).first() == aggregates.table_digest(rows.orderBy(F.desc("x")), text).first()
    assert aggregates.table_checksum(rows, text).first() == aggregates.table_checksum(rows.orderBy("x").repartition(3), text).first()


def test_reconcile_refuses_large_deletes(spark):
    k = lambda n: spark.range(n).select(F.col("id").alias("k"))
    assert resolve.reconcile(k(40), k(10), "k").first().refused
    assert not resolve.reconcile(k(40), k(30), "k").first().refused
    assert not resolve.reconcile(k(10), k(1), "k").first().refused


def test_open_export(spark):
    rows = spark.createDataFrame([("a", "open"), ("a", "non_commercial"), ("b", "open"), (None, "open"), ("a", None)], "tier string, redistribution string")
    assert guards.open_export(rows).count() == 1
    with pytest.raises(PermissionError):
        guards.require_open("b", "open")
    with pytest.raises(ValueError):
        guards.with_provenance(rows, source_id="")


def test_one_award_row_per_supplier(spark):
    doc = '{"ocid":"o1","tender":{"id":"t1","value":{"amount":"10.005"}},"parties":[{"id":"p1","name":"Firm","roles":["supplier"],"identifier":{"id":"111","scheme":"GB-COH"}},{"id":"p1","name":"Firm","roles":["supplier"],"identifier":{"id":"222"}},{"id":"b","name":"Town","roles":["buyer"]}],"awards":[{"id":"a","suppliers":[{"id":"p1","name":"X","identifier":{"id":""}},{"name":"Firm"}]},{"id":"","suppliers":[{"id":"p1"}]},{"id":"c","suppliers":[{"id":"z","name":"Q","identifier":{"id":"9"}}]}]}'
    out = ingest.ingest("uk_contracts_finder", spark.createDataFrame([(doc,), ("{}",), ("not json",)], "document string"))
    assert [(r.tender_id, r.buyer_name, r.value_cents, r.currency) for r in out["tender"].collect()] == [("t1", "Town", 1001, "GBP")]
    assert sorted((r.award_id, r.supplier_number, r.value_kind) for r in out["award"].collect()) == [("a:0", "222", "shared_ceiling"), ("a:1", "222", "shared_ceiling"), ("c", "9", "per_supplier")]
    with pytest.raises(ValueError):
        ingest.ingest("other", out["tender"])


def test_prozorro_and_secop(spark):
    ua = '{"data":{"id":"t","value":{"amount":5,"currency":""},"awards":[{"id":"a","suppliers":[{"name":"S1"},{"name":"S2"}],"value":{"amount":1.5}},{"id":""}],"bids":[{"id":"b"}]}}'
    out = ingest.prozorro(spark.createDataFrame([(ua,)], "document string"))
    assert out["tender"].first().currency == "UAH" and out["award"].first().supplier_name == "S1" and out["award"].first().value_cents == 150 and out["bid"].count() == 1
    co = ['{"id_del_proceso":"p","adjudicado":"Sí","valor_total_adjudicacion":"7"}', '{"id_del_proceso":"q","adjudicado":"No"}']
    out = ingest.secop(spark.createDataFrame([(x,) for x in co], "document string"))
    assert out["tender"].count() == 2 and [(r.award_id, r.value_cents) for r in out["award"].collect()] == [("p-award", 700)]


def test_companies_csv_and_cache(spark, tmp_path):
    (tmp_path / "c.csv").write_text('CompanyName, CompanyNumber,CompanyStatus,IncorporationDate,Accounts.AccountCategory,SICCode.SicText_1,SICCode.SicText_2\n"A, B",123,Active,01/02/2003,DORMANT,x,\nNo number,,Active,,,,\n')
    rows = ingest.companies_csv(spark, str(tmp_path / "c.csv")).collect()
    assert [(r.company_number, r.company_name, str(r.incorporation_date), r.sic_codes) for r in rows] == [("00000123", "A, B", "2003-02-01", ["x"])]
    lines = spark.createDataFrame([('{"a":1}',), ("bad",), ("[1]",)], "document string")
    assert tuple(ingest.scan_counts(lines).first()) == (3, 2)
    import hashlib

    content = spark.createDataFrame([(k, b"x") for k in "abcde"], "key string, content binary")
    digest = hashlib.sha256(b"x").hexdigest()
    side = spark.createDataFrame([("a", f'{{"sha256":"{digest}","fetched_at":"2024-01-01T00:00:00Z"}}'), ("b", f'{{"sha256":"{digest}","fetched_at":"2020-01-01T00:00:00Z"}}'), ("c", '{"sha256":"0","fetched_at":"2024-01-01T00:00:00Z"}'), ("d", "{")], "key string, json string")
    got = {r.key: r.reason for r in ingest.cached_fetches(content, side, F.lit("2024-01-05").cast("timestamp"), 30).collect()}
    assert got == {"a": None, "b": "stale", "c": "mismatch", "d": "corrupt", "e": "missing"}


def test_citations(spark):
    pairs = spark.createDataFrame([("v", "the very words", "these are the very words."), ("n", "the quick brown fox", "A tale. The quick brown box ran off."), ("a", "nothing like it at all", "zzz"), ("e", "", "x")], "pair string, quote string, text string")
    assert {r.pair for r in documents.verbatim(pairs).where("status = 'VERBATIM' AND quote <> ''").collect()} == {"v"}
    got = {r.pair: r.status for r in documents.fuzzy(pairs.where("pair <> 'v'")).collect()}
    assert got == {"n": "NEAR", "a": "ABSENT", "e": "ABSENT"}
    assert one(spark, documents.plain_quotes(F.col("v")), v="“It’s” – so  .") == "\"It's\" - so."


def test_visible_text(spark):
    pages = spark.createDataFrame([(1, "<p>a <b>b</b></p><script>x</script><!-- c --> d"), (2, ""), (3, None)], "page_id long, html string")
    assert {r.page_id: r.text for r in documents.visible_text(pages).collect()} == {1: "a b d", 2: "", 3: None}


def test_tokens_need_a_key(spark):
    with pytest.raises(ValueError):
        documents.keyed_tokens(spark.range(1), "x", b"")


def test_importable_without_text_operators():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['ledgerlight.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 60 and len(e.oracle_sql()) > 60"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_work_folder_without_a_configured_one(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = "from ledgerlight.session import session; from ledgerlight.sources.workdir import settled; s = session('local[1]', partitions=1, memory='1g'); assert settled(s.range(3)).count() == 3"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, check=True, timeout=300)


def test_company_numbers_of_long_keys(spark, tmp_path):
    """h13 as its SQL has it for keys of seven and more digits."""
    from ledgerlight.plans.registry import ORACLE_SQL, QUERIES
    from parity import rows

    spark.createDataFrame([(k,) for k in (4, 5, 6, 7, 1_000_000, 1_000_001, 1_199_997, 123_456_789, 1_234_567_888)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    df, rel = QUERIES["h13_company_number"](spark, str(tmp_path)), con.sql(ORACLE_SQL["h13_company_number"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())
