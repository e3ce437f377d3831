"""Registers, scoring, connectors and streams on literal rows."""

from pyspark.sql import functions as F

from ledgerlight.operators import read_api, registers, scoring
from ledgerlight.sources import connectors
from ledgerlight.streaming import sources as streaming

COMPANY = "company_number string, normalised_name string"


def lines(spark, *docs):
    return spark.createDataFrame([(d,) for d in docs], "document string")


def companies(spark):
    return spark.createDataFrame([("00000001", "ALPHA"), ("00000002", "TWIN"), ("00000003", "TWIN")], COMPANY)


def test_a_number_that_misses_never_falls_back_to_the_name(spark):
    rows = spark.createDataFrame(
        [(1, "Company", "alpha", "9", "£1,000.50", "01/02/2020", ""), (2, "Company", " alpha ", "", "x", "", "03/02/2020"), (3, "Company", "twin", None, "", "bad", "03/02/2020"), (4, "Individual", "alpha", "1", "1", None, None), (5, "Trade Union", "", "1", "£2", None, None)],
        "k int, donor_status string, donor_name string, number string, value string, received string, accepted string")
    got = {r.k: (r.outcome, r.company_number, r.match_confidence, r.amount_cents, str(r.donated_on), r.invalid_received) for r in registers.donations(rows, companies(spark)).collect()}
    assert got[1] == ("unmatched_donor", None, 0.0, 100050, "2020-02-01", False)
    assert got[2] == ("matched", "00000001", 0.9, None, "2020-02-03", False)
    assert got[3] == ("unmatched_donor", None, 0.0, None, "None", True)
    assert got[4][0] == "skipped_individual" and got[5][:3] == ("matched", "00000001", 1.0)


def test_numbers_link_only_from_the_companies_register(spark):
    one = lambda lei, place, authority, number: f'{{"id":"{lei}","attributes":{{"entity":{{"legalName":{{"name":""}},"jurisdiction":"{place}","registeredAt":{{"id":"{authority}"}},"registeredAs":"{number}"}}}}}}'
    got = {r.lei: (r.name, r.company_number, r.outcome) for r in registers.legal_entities(lines(spark, one("A", "GB", "RA000585", "1"), one("B", "GB", "RA000999", "1"), one("C", "FR", "RA000585", "1"), "{}"), companies(spark)).collect()}
    assert got == {"A": ("A", "00000001", "gb_linked"), "B": ("B", None, "gb_other_authority"), "C": ("C", None, "unlinked")}


def test_first_existing_identifier_wins(spark):
    docs = ['{"id":"x","schema":"Company","caption":"X","properties":{"leiCode":["no","L2","L1"],"country":["GB"],"registrationNumber":["77","1"]}}', '{"id":"y","schema":"Company","properties":{"country":["fr"],"registrationNumber":["1"]}}', '{"id":"p","schema":"Person"}']
    lei = spark.createDataFrame([("L1",), ("L2",)], "lei string")
    got = {r.id: (r.name, r.lei, r.company_number) for r in registers.sanctioned(lines(spark, *docs), lei, companies(spark)).collect()}
    assert got == {"x": ("X", "L2", "00000001"), "y": ("y", None, None)}


def test_children_override_their_parent(spark):
    doc = '{"id":"1","fields":[{"name":"Payer","value":"P"},{"name":"Value","value":"1"}],"childInterests":[{"id":"2","fields":[{"name":"Value","value":"5"}]},{"id":"3"}]}'
    got = {r.interest: r.fields for r in registers.leaf_interests(lines(spark, doc, '{"id":"9","fields":[{"name":"a","value":"b"}]}')).collect()}
    assert got == {"2": {"Payer": "P", "Value": "5"}, "3": {"Payer": "P", "Value": "1"}, "9": {"a": "b"}}


def test_bands_and_times(spark):
    rows = spark.createDataFrame([("Between £1,000 and £2,000",), ("more than £70,000",), ("Less than £5",), ("over 15%",)], "t string")
    low, high = registers.value_band(F.col("t"))
    assert [tuple(r) for r in rows.select(low, high).collect()] == [(100000, 200000), (7000000, None), (None, 500), (None, None)]
    times = spark.createDataFrame([("20200102030405",), ("2020",), ("202013",), ("20200",), ("2020010203",)], "t string")
    got = [str(r[0]) for r in times.select(F.date_format(registers.wayback_time("t"), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2020-01-02 03:04:05", "2020-01-01 00:00:00", "None", "None", "2020-01-02 03:00:00"]


def test_unreadable_end_is_not_still_serving(spark):
    rows = spark.createDataFrame([("c", "o1", "N", "2020-01-01"), ("c", "", " n  m ", "soon"), ("c", None, "N", None)], "company_number string, officer_id string, officer_name string, resigned string")
    assert [(r.registry_id, r.confidence, r.status) for r in registers.officers(rows).collect()] == [("o1", 1.0, "ended"), ("c:N M", 0.5, "ended_date_unknown"), ("c:N", 0.5, "serving")]


def test_golden_takes_each_edge_once(spark):
    schema = "id long, edge_type string, source_name string, source_scheme string, source_registry_id string, target_name string, target_scheme string, target_registry_id string, valid_from string"
    golden = spark.createDataFrame([(1, "o", "A", "S", "1", "X", None, None, "2020-01-01"), (2, "o", "a", None, None, "x", None, None, None), (3, "p", "A", None, None, "X", None, None, None)], schema).withColumn("valid_from", F.to_date("valid_from"))
    edge = spark.createDataFrame([(7, "o", "Other", "S", "1", "X", None, None, None), (8, "o", "A", "S", "2", "X", None, None, "2020-01-20"), (9, "q", "A", None, None, "X", None, None, None)], schema).withColumn("valid_from", F.to_date("valid_from"))
    got = sorted(map(tuple, scoring.golden_matches(golden, edge).collect()))
    assert got == [(1, 7, "name", "null_date"), (2, 8, "name", "match")]
    out = scoring.precision_recall(scoring.golden_matches(golden, edge), golden, edge.where("id <= 8")).first()
    assert (out.tp, out.fp, out.asked, round(out.recall, 3)) == (2, 0, 3, 0.667)


def test_manifest(spark):
    columns = "seq int, case_id string, company_number string, awardee_confirmed string, label_source_url string, award_date string, relationship_start string, relationship_type string, held_office_at_award string, office_holding_start_date string, office_holding_end_date string"
    ok = ("1", "yes", "u", "2020-05-01", "2019-01-01", "directorship", "yes", "2018-01-01", "")
    rows = [(1, "a", *ok), (2, "a", *ok), (3, "b", *ok[:4], "unknown", *ok[5:]), (4, "c", *ok[:6], "no", *ok[7:]), (5, "d", *ok[:8], "2019-12-31"), (6, "", None, "maybe", "", "x", "2021-01-01", "pal", "", "", "y")]
    got = {r.seq: (r.verdict, len(r.reasons)) for r in scoring.manifest(spark.createDataFrame(rows, columns)).collect()}
    assert got == {1: ("admissible", 0), 2: ("inadmissible", 1), 3: ("inadmissible", 1), 4: ("out_of_scope", 0), 5: ("out_of_scope", 0), 6: ("inadmissible", 9)}


def test_fisher_and_curated(spark):
    got = scoring.fisher(spark.createDataFrame([("k", 8, 2, 1, 5), ("z", 0, 0, 0, 0)], "key string, a long, b long, c long, d long")).collect()
    assert abs(got[0].p - 0.034965) < 1e-5 and got[1].p == 1.0
    flags = spark.createDataFrame([(f"i{k % 3}", f"j{k % 2}", f"s{k % 30}", 1000 * k + 1, 100, True) for k in range(60)], "indicator string, jurisdiction string, subject string, value_cents long, length int, has_url boolean")
    top = scoring.curated(scoring.flag_scores(flags), 10)
    assert len(top) <= 10 and len({(r["indicator"], r["jurisdiction"]) for r in top[:6]}) == 6


def test_fisher_of_large_and_tied_tables(spark):
    """Against exact integers; a table of millions takes as long as the square root of its counts asks for."""
    import time
    from math import comb

    tables = [(3, 1, 1, 3), (0, 5, 5, 0), (40, 60, 25, 75), (0, 7, 3, 0), (300, 400, 500, 450), (7, 0, 0, 0), (900, 10, 12, 800)]
    rows = spark.createDataFrame([(f"k{i}", *x) for i, x in enumerate(tables)], "key string, a long, b long, c long, d long")
    got = {r.key: r.p for r in scoring.fisher(rows).collect()}
    for i, (a, b, c, d) in enumerate(tables):
        n, row, col = a + b + c + d, a + b, a + c
        ways = {k: comb(row, k) * comb(n - row, col - k) for k in range(max(0, row + col - n), min(row, col) + 1)}
        want = sum(w for w in ways.values() if w <= ways[a]) / sum(ways.values())
        assert abs(got[f"k{i}"] - want) <= 1e-9 * want
    large = spark.createDataFrame([("k", 4_000_000, 6_000_000, 4_003_000, 5_997_000)], "key string, a long, b long, c long, d long")
    start = time.time()
    assert 0.15 < scoring.fisher(large).first().p < 0.2 and time.time() - start < 20


def test_case_takes_its_best_status(spark):
    rows = spark.createDataFrame([("c", "not_recovered", "2020-01-02"), ("c", "recovered", "2020-01-01"), ("d", "untestable", None)], "case string, status string, award_date string")
    assert {r.case: (r.status, r.n_rows, r.n_awards) for r in scoring.case_status(rows, "case").collect()} == {"c": ("recovered", 2, 2), "d": ("untestable", 1, 0)}


def test_connectors():
    pages = {0: [{}] * 1000, 1000: [{}] * 3}
    tasks = list(connectors.Secop(lambda url, p: (200, b"", pages[p["$offset"]])).discover())
    assert [t.params["$offset"] for t in tasks] == [0, 1000]
    books = {None: {"data": [{"id": "a"}], "next_page": {"offset": "1"}}, "1": {"data": []}}
    pro = connectors.ProZorro(lambda url, p: (200, b"{}", books[p.get("offset")]))
    assert [t.key.rsplit("/", 1)[1] for t in pro.discover()] == ["a"] and len(list(pro.fetch(connectors.FetchTask("u")))) == 1
    assert list(connectors.ProZorro(lambda u, p: (404, b"", {})).fetch(connectors.FetchTask("u"))) == []
    assert connectors.problems(object(), set()) == ["no source_id", "no jurisdictions", "no discover()", "no fetch()"]
    assert connectors.problems(pro, {"ua_prozorro"}) == []


def test_read_api(spark):
    entity = spark.createDataFrame([(1, "company", "Alpha Ltd", "S", "77", "secret"), (2, "person", "Beta", "S", "78", "secret")], "id long, entity_type string, name string, scheme string, registry_id string, properties string")
    alias = spark.createDataFrame([(2, "alpha friend")], "id long, alias string")
    got = read_api.resolve_entity(entity, alias, "alpha", 999)
    assert [r.id for r in got.collect()] == [1, 2] and "properties" not in got.columns
    assert read_api.clamp(0) == 1 and read_api.clamp(999) == 200
    flags = spark.createDataFrame([(i, f"s{i:02d}", "pending") for i in range(60)], "id long, subject string, review_status string")
    assert [r.id for r in read_api.list_flags(flags, page=2).collect()] == list(range(50, 60))
    done = read_api.review(flags, spark.createDataFrame([(1, "confirmed", 1), (1, "rejected", 2), (2, "nonsense", 1)], "id long, status string, seq int"))
    assert {r.id: r.review_status for r in done.where("id < 3").collect()} == {0: "pending", 1: "rejected", 2: "pending"}


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT 'a' AS source_id, CASE WHEN id % 4 = 0 THEN 'success' ELSE 'failed' END AS status, timestamp_seconds(id * 600) AS finished_at, id AS event_id FROM range(39)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert [(r.streak, r.open) for r in run(streaming.circuit_breaker(stream, 2), "breaker", "update")] == [(2, True)]
    by = run(streaming.runs_by_window(stream), "windows", "append")
    assert by and all(r.runs == 6 for r in by)
    assert run(streaming.sessions(stream), "sessions", "complete")[0].runs == 39


def plainly_curated(rows, top):
    """rows: indicator, jurisdiction, subject, score; the whole table, in turn."""
    rows = sorted(rows, key=lambda r: (-r[3], r[2], r[0], r[1]))
    best = {}
    for r in rows:
        best.setdefault(r[:2], r)
    chosen = [r for r in rows if best[r[:2]] is r][:top]
    for r in rows:
        if len(chosen) < top and r[2] not in {c[2] for c in chosen} and sum(c[0] == r[0] for c in chosen) < max(1, int(top * 0.4)) and sum(c[1] == r[1] for c in chosen) < max(1, int(top * 0.5)):
            chosen.append(r)
    return chosen


def test_curated_where_subjects_repeat(spark):
    import random

    r = random.Random(2)
    for case in range(4):
        # one subject has the best sixty rows of its combination; others repeat under several indicators
        rows = [("a", "x", "same", 100.0 - i / 7) for i in range(60)] + [(r.choice("ab"), r.choice("xyz"), f"s{r.randrange(12)}", float(r.randrange(90))) for _ in range(80)]
        flags = spark.createDataFrame(rows, "indicator string, jurisdiction string, subject string, score double")
        for top in (3, 10):
            assert [tuple(x)[:4] for x in scoring.curated(flags, top)] == plainly_curated(rows, top)


def test_places_over_ranges(spark):
    from pyspark.sql import functions as F

    from ledgerlight.operators.sequence import placed

    rows = spark.createDataFrame([(i * 37 % 101 // 3,) for i in range(101)], "v int").repartition(5)
    ranked = placed(rows, ["v"], F.rank(), "place").collect()
    values = sorted(r.v for r in ranked)
    assert all(r.place == values.index(r.v) + 1 for r in ranked) and len(ranked) == 101
    assert sorted(r.place for r in placed(rows, [F.desc("v")], F.row_number(), "place").collect()) == list(range(1, 102))


def test_quotes_of_few_words(spark):
    from ledgerlight.operators.documents import citation_pairs, quoted

    texts = {1: "the cat sat on the mat", 2: "concatenate on", 3: "a b", 4: "nothing", 5: None}
    quotes = {1: "cat", 2: "at on", 3: "cat sat on the", 4: "t s", 5: "b", 6: " ", 7: "on the m", 8: "", 9: "absent words here"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame(list(quotes.items()), "item_id long, quote string")
    got = {tuple(r) for r in quoted(docs, items).collect()}
    assert got == {(d, i) for d, t in texts.items() for i, q in quotes.items() if t and q and q in t}
    near = {(r.doc_id, r.item_id) for r in citation_pairs(docs, items).collect()}
    assert {(1, 3)} <= near and not any(i == 9 for _, i in near)
