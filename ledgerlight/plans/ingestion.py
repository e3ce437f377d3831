"""Queries on scans and ingestion: the sample tables are written as source documents, read back by the operators, and SQL
says from the tables what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.operators import controls, registers
from ledgerlight.plans.base import query
from ledgerlight.sources import ingest as I
from ledgerlight.sources.views import Tables

NUMBER = "lpad(CAST(s_suppkey AS STRING), 8, '0')"


def _documents(t: Tables, build) -> "DataFrame":  # noqa: F821
    """document: one JSON text per order, with its lines gathered as `lines`."""
    lines = t.read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(F.struct("l_linenumber", "l_suppkey", "l_extendedprice", F.col("l_shipdate").cast("date").cast("string").alias("day")))).alias("lines"))
    return build(t.read("orders").join(lines, "o_orderkey"))


def _ua(t: Tables):
    award = "transform(lines, (x, i) -> named_struct('id', CASE WHEN x.l_linenumber = 7 THEN '' ELSE concat(o_orderkey, '-', i) END, 'status', 'active', 'value', named_struct('amount', CAST(CAST(x.l_extendedprice AS DECIMAL(18,2)) AS STRING)), 'suppliers', array(named_struct('name', concat('S', x.l_suppkey)), named_struct('name', 'second'))))"
    body = f"named_struct('id', CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey AS STRING) END, 'title', o_orderpriority, 'value', named_struct('amount', CAST(o_totalprice AS DECIMAL(18,2)), 'currency', CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' END), 'procuringEntity', named_struct('name', concat('B', o_custkey)), 'awards', {award})"
    return _documents(t, lambda o: o.select(F.expr(f"CASE WHEN o_orderkey % 5 = 0 THEN to_json({body}) ELSE to_json(named_struct('data', {body})) END").alias("document")))


@query("a08_scan_counts", "SELECT count(*) FILTER (event_id % 9 > 0) AS lines, count(*) FILTER (event_id % 9 > 0 AND event_id % 7 = 0) AS malformed FROM events")
def a08(spark, sf_dir):
    raw = Tables(spark, sf_dir).read("events").selectExpr("CASE WHEN event_id % 9 = 0 THEN '  ' WHEN event_id % 7 = 0 THEN concat('{\"id\": ', event_id) ELSE concat('{\"id\": ', event_id, '}') END AS document")
    return I.scan_counts(raw.where(F.trim("document") != ""))


@query("a10_company_rows", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS company_number, s_name AS company_name, CASE WHEN s_suppkey % 5 > 0 THEN CAST(DATE '1990-01-01' + CAST(s_suppkey % 900 AS INTEGER) AS VARCHAR) END AS incorporated, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS codes FROM supplier WHERE s_suppkey % 11 > 0")
def a10(spark, sf_dir):
    day = "date_add(DATE '1990-01-01', CAST(s_suppkey % 900 AS INT))"
    raw = Tables(spark, sf_dir).read("supplier").selectExpr(
        "concat(' ', s_name, ' ') AS CompanyName", "CASE WHEN s_suppkey % 11 = 0 THEN ' ' ELSE CAST(s_suppkey AS STRING) END AS ` CompanyNumber`", f"CASE s_suppkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN date_format({day}, 'dd/MM/yyyy') ELSE CAST({day} AS STRING) END AS IncorporationDate",
        "'62020 - IT' AS `SICCode.SicText_1`", "CASE WHEN s_suppkey % 2 = 0 THEN '1 - Crops' ELSE ' ' END AS `SICCode.SicText_2`")
    return I.company_rows(raw).select("company_number", "company_name", F.col("incorporation_date").cast("string").alias("incorporated"), F.size("sic_codes").alias("codes"))


@query("a11_backfill", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END AS status FROM supplier")
def a11(spark, sf_dir):
    supplier = Tables(spark, sf_dir).read("supplier")
    bulk = supplier.where("s_suppkey % 3 = 0").selectExpr("s_suppkey AS k", "CASE WHEN s_suppkey % 2 = 0 THEN 'new' END AS status").unionByName(spark.sql("SELECT -1L AS k, 'new' AS status"))
    return controls.backfill(supplier.selectExpr("s_suppkey AS k", "'old' AS status"), bulk, "k", ["status"])


@query("a12_cached_fetches", "SELECT CAST(item_id AS VARCHAR) AS key, item_id % 5 = 4 AS hit, CASE item_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'corrupt' WHEN 2 THEN 'stale' WHEN 3 THEN 'mismatch' END AS reason FROM benchmark")
def a12(spark, sf_dir):
    items = Tables(spark, sf_dir).read("benchmark").select(F.col("item_id").cast("string").alias("key"), "item_id", F.encode("text", "utf-8").alias("content"))
    digest = F.when(F.col("item_id") % 5 == 3, "0").otherwise(F.sha2("content", 256))
    at = F.when(F.col("item_id") % 5 == 2, "2020-01-01T00:00:00Z").otherwise("2024-01-30T00:00:00Z")
    sidecar = items.where("item_id % 5 > 0").select("key", F.when(F.col("item_id") % 5 == 1, "{not json").otherwise(F.to_json(F.struct(digest.alias("sha256"), at.alias("fetched_at")))).alias("json"))
    return I.cached_fetches(items.select("key", "content"), sidecar, F.lit("2024-02-01").cast("timestamp"), 7)


@query("a13_donation_file", "SELECT o_orderkey % 5 AS kind, count(*) AS n FROM orders WHERE o_orderkey % 8 > 0 GROUP BY 1")
def a13(spark, sf_dir):
    """One file of one request, as cells: rows without a reference are no donations."""
    raw = Tables(spark, sf_dir).read("orders").selectExpr("CASE WHEN o_orderkey % 8 = 0 THEN ' ' ELSE concat('C', o_orderkey) END AS ECRef", "CAST(o_orderkey % 5 AS STRING) AS DonorStatus")
    return I.donation_rows(raw).groupBy(F.col("donor_status").cast("long").alias("kind")).agg(F.count("*").alias("n"))


@query("a14_cursor_pages", "SELECT s_suppkey AS k, s_name AS name FROM supplier")
def a14(spark, sf_dir):
    """Pages of a cursor file as JSON lines: each holds records under data; the same record on two pages counts once."""
    supplier = Tables(spark, sf_dir).read("supplier").withColumn("page", F.col("s_suppkey") % 7)
    again = supplier.where("s_suppkey % 10 = 0").withColumn("page", F.col("page") + 1)
    pages = supplier.unionByName(again).groupBy("page").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("s_suppkey").cast("string").alias("id"), F.to_json(F.struct("s_name")).alias("attributes"))).alias("data"))).alias("document"))
    return I.page_records(pages).select(F.col("id").cast("long").alias("k"), F.get_json_object("attributes", "$.s_name").alias("name"))


@query("a17_enumeration", "SELECT count(*) FILTER (s_suppkey % 4 = 0) AS oversea, count(*) FILTER (s_suppkey % 4 > 0) AS other FROM supplier")
def a17(spark, sf_dir):
    rows = Tables(spark, sf_dir).read("supplier").selectExpr(f"CASE s_suppkey % 4 WHEN 0 THEN concat('oe', lpad(s_suppkey, 6, '0')) ELSE {NUMBER} END AS company_number")
    return I.enumerated(rows, "OE").agg(F.count_if("wanted").alias("oversea"), F.count_if(~F.col("wanted")).alias("other"))


@query("a18_wayback_rows", "SELECT user_id % 50 AS site, count(DISTINCT event_id // 2) AS captures FROM events GROUP BY 1")
def a18(spark, sf_dir):
    rows = Tables(spark, sf_dir).read("events").selectExpr("user_id % 50 AS site", "array(date_format(ts, 'yyyyMMddHHmmss'), concat('https://site', user_id % 50, '.invalid/'), concat(user_id % 50, '-', event_id div 2)) AS row")
    head = F.array(F.array(F.lit("timestamp"), F.lit("original"), F.lit("digest")))
    arrays = rows.groupBy("site").agg(F.to_json(F.concat(head, F.collect_list("row"))).alias("document"))
    return I.wayback_rows(arrays).groupBy(F.regexp_extract("original", r"site(\d+)", 1).cast("long").alias("site")).agg(F.count("*").alias("captures"))


@query("a19_cache_count", "SELECT count(*) AS records, count(DISTINCT item_id % 20) AS files FROM benchmark")
def a19(spark, sf_dir):
    items = Tables(spark, sf_dir).read("benchmark").selectExpr("concat('f', item_id % 20) AS file", "to_json(named_struct('id', item_id)) AS document")
    return items.agg(F.count("*").alias("records"), F.count_distinct("file").alias("files"))


@query("a21_medical", "SELECT p_partkey AS k, p_partkey % 4 IN (0, 1) AS medical FROM part")
def a21(spark, sf_dir):
    rows = Tables(spark, sf_dir).read("part").selectExpr("p_partkey AS k", "CASE WHEN p_partkey % 4 = 1 THEN 'Supply of Face Masks' ELSE 'Supply of chairs' END AS title", "array(named_struct('scheme', 'CPV', 'id', CASE WHEN p_partkey % 4 = 0 THEN '33140000' ELSE '45000000' END), named_struct('scheme', CASE WHEN p_partkey % 4 = 2 THEN 'OTHER' END, 'id', '33140000')) AS codes")
    return rows.select("k", controls.is_medical(F.col("title"), F.lit(None).cast("string"), F.col("codes")).alias("medical"))


LINES = "l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, CAST(l_shipdate AS DATE) AS day FROM lineitem), a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_extendedprice, day) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM l)"


@query("b01_tender", "SELECT CAST(o_orderkey AS VARCHAR) AS tender_id, o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' ELSE 'UAH' END AS currency, 'B' || CAST(o_custkey AS VARCHAR) AS buyer_name, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS value_cents FROM orders WHERE o_orderkey % 13 > 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def b01(spark, sf_dir):
    return I.prozorro(_ua(Tables(spark, sf_dir)))["tender"].select("tender_id", "title", "currency", "buyer_name", "value_cents")


@query("b01_award", f"WITH {LINES} SELECT CAST(l_orderkey AS VARCHAR) AS tender_id, CAST(l_orderkey AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS award_id, 'S' || CAST(l_suppkey AS VARCHAR) AS supplier_name, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS value_cents FROM a WHERE l_orderkey % 13 > 0 AND l_linenumber <> 7")
def b01_award(spark, sf_dir):
    return I.prozorro(_ua(Tables(spark, sf_dir)))["award"].select("tender_id", "award_id", "supplier_name", "value_cents")


def _ocds(t: Tables):
    suppliers = "transform(lines, x -> named_struct('id', CASE WHEN x.l_suppkey % 3 > 0 THEN concat('P', x.l_suppkey) END, 'name', concat('S', x.l_suppkey)))"
    parties = "concat(array(named_struct('id', 'B', 'name', concat('B', o_custkey), 'roles', array('buyer'), 'identifier', named_struct('id', concat('N', o_custkey)))), transform(lines, x -> named_struct('id', concat('P', x.l_suppkey), 'name', concat('S', x.l_suppkey), 'roles', array('supplier'), 'identifier', named_struct('id', concat('N', x.l_suppkey)))))"
    award = f"array(named_struct('id', concat('a', o_orderkey), 'status', 'active', 'date', concat(lines[0].day, 'T10:00:00Z'), 'value', named_struct('amount', CAST(o_totalprice AS DECIMAL(18,2))), 'suppliers', {suppliers}))"
    body = f"named_struct('ocid', CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE concat('ocds-', o_orderkey) END, 'tender', named_struct('id', CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS STRING) END, 'title', o_orderpriority, 'value', named_struct('amount', CAST(o_totalprice AS DECIMAL(18,2)))), 'parties', {parties}, 'awards', {award})"
    return _documents(t, lambda o: o.select(F.to_json(F.expr(body)).alias("document")))


TENDER_ID = "CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE 'ocds-' END || CAST(l_orderkey AS VARCHAR)"


@query("b02_award", f"WITH {LINES} SELECT {TENDER_ID} AS tender_id, 'a' || CAST(l_orderkey AS VARCHAR) || CASE WHEN n > 1 THEN ':' || CAST(i AS VARCHAR) ELSE '' END AS award_id, 'S' || CAST(l_suppkey AS VARCHAR) AS supplier_name, 'N' || CAST(l_suppkey AS VARCHAR) AS supplier_number, CASE WHEN n > 1 THEN 'shared_ceiling' ELSE 'per_supplier' END AS value_kind FROM a WHERE l_orderkey % 17 > 0")
def b02(spark, sf_dir):
    """Also the lookup of a party by its id, and by its name where a supplier has no id."""
    return I.contracts_finder(_ocds(Tables(spark, sf_dir)))["award"].select("tender_id", "award_id", "supplier_name", "supplier_number", "value_kind")


@query("b02_tender", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'ocds-' END || CAST(o_orderkey AS VARCHAR) AS tender_id, 'B' || CAST(o_custkey AS VARCHAR) AS buyer_name, 'N' || CAST(o_custkey AS VARCHAR) AS buyer_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS value_cents, 'GBP' AS currency FROM orders WHERE o_orderkey % 17 > 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def b02_tender(spark, sf_dir):
    return I.contracts_finder(_ocds(Tables(spark, sf_dir)))["tender"].select("tender_id", "buyer_name", "buyer_id", "value_cents", "currency")


def _secop(t: Tables):
    return t.read("orders").selectExpr("to_json(named_struct('id_del_proceso', CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE concat('CO1.', o_orderkey) END, 'entidad', concat('B', o_custkey), 'precio_base', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), 'adjudicado', element_at(array('Sí', 'si', 'No', 'SI'), CAST(o_orderkey % 4 AS INT) + 1), 'id_adjudicacion', CASE WHEN o_orderkey % 3 = 0 THEN concat('A', o_orderkey) ELSE '' END, 'valor_total_adjudicacion', CAST(o_custkey AS STRING))) AS document")


@query("b03_secop_award", "SELECT 'CO1.' || CAST(o_orderkey AS VARCHAR) AS tender_id, CASE WHEN o_orderkey % 3 = 0 THEN 'A' || CAST(o_orderkey AS VARCHAR) ELSE 'CO1.' || CAST(o_orderkey AS VARCHAR) || '-award' END AS award_id, o_custkey * 100 AS value_cents FROM orders WHERE o_orderkey % 19 > 0 AND o_orderkey % 4 < 2")
def b03(spark, sf_dir):
    return I.secop(_secop(Tables(spark, sf_dir)))["award"].select("tender_id", "award_id", "value_cents")


@query("b04_ingest_counts", "SELECT count(*) AS documents, count(*) FILTER (o_orderkey % 19 > 0) AS tenders, count(*) FILTER (o_orderkey % 19 > 0 AND o_orderkey % 4 < 2) AS awards, count(*) FILTER (o_orderkey % 19 > 0) AS ingested, count(*) FILTER (o_orderkey % 19 = 0) AS failed FROM orders")
def b04(spark, sf_dir):
    return I.ingest_counts("co_secop_ii", _secop(Tables(spark, sf_dir)))


def _lei(t: Tables):
    attributes = f"named_struct('lei', concat('L', s_suppkey), 'entity', named_struct('legalName', named_struct('name', CASE WHEN s_suppkey % 7 > 0 THEN s_name ELSE ' ' END), 'jurisdiction', CASE WHEN s_suppkey % 3 > 0 THEN 'GB' ELSE 'FR' END, 'registeredAt', named_struct('id', CASE WHEN s_suppkey % 2 = 0 THEN 'RA000586' ELSE 'RA000001' END), 'registeredAs', CAST(s_suppkey + CASE WHEN s_suppkey % 10 = 0 THEN 900000 ELSE 0 END AS STRING)))"
    return t.read("supplier").selectExpr(f"to_json(named_struct('id', concat('x', s_suppkey), 'attributes', {attributes})) AS document")


LEI = "lei AS (SELECT s_suppkey, 'L' || CAST(s_suppkey AS VARCHAR) AS lei, CASE WHEN s_suppkey % 7 > 0 THEN s_name ELSE 'L' || CAST(s_suppkey AS VARCHAR) END AS name, CASE WHEN s_suppkey % 3 > 0 AND s_suppkey % 2 = 0 AND s_suppkey % 10 > 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 8, '0') END AS company_number FROM supplier)"


@query("b08_legal_entities", f"WITH {LEI} SELECT lei, name, company_number, CASE WHEN company_number IS NOT NULL THEN 'gb_linked' WHEN s_suppkey % 3 > 0 THEN 'gb_other_authority' ELSE 'unlinked' END AS outcome FROM lei")
def b08(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return registers.legal_entities(_lei(t), t.company)


@query("b09_relinked", f"WITH {LEI}, s AS (SELECT lei, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'ZZ000001' ELSE company_number END AS was, company_number AS now FROM lei) SELECT count(*) FILTER (was IS NOT NULL AND now IS NULL) AS removed, count(*) FILTER (was IS NULL AND now IS NOT NULL) AS added, count(*) FILTER (was <> now) AS changed, count(*) FILTER (was IS NOT DISTINCT FROM now) AS unchanged FROM s")
def b09(spark, sf_dir):
    t = Tables(spark, sf_dir)
    fresh = registers.legal_entities(_lei(t), t.company)
    k = F.substring("lei", 2, 20).cast("long") % 5
    return registers.relinked(fresh.select("lei", F.when(k == 1, "ZZ000001").when(k > 1, F.col("company_number")).alias("company_number")), fresh)


@query("b10_sanctioned", """SELECT 'q' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CASE WHEN s_suppkey % 4 < 2 THEN 'L' || CAST(s_suppkey AS VARCHAR) END AS lei, CASE WHEN s_suppkey % 3 = 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 8, '0') END AS company_number FROM supplier WHERE s_suppkey % 5 > 0""")
def b10(spark, sf_dir):
    t = Tables(spark, sf_dir)
    body = "named_struct('id', concat('q', s_suppkey), 'schema', CASE WHEN s_suppkey % 5 = 0 THEN 'Person' ELSE 'Company' END, 'caption', s_name, 'properties', named_struct('leiCode', array('none', CASE WHEN s_suppkey % 4 < 2 THEN concat('L', s_suppkey) ELSE 'other' END), 'country', array(CASE WHEN s_suppkey % 3 = 0 THEN ' GB' ELSE 'fr' END), 'registrationNumber', array('99999999', CAST(s_suppkey AS STRING))))"
    lines = t.read("supplier").selectExpr(f"to_json({body}) AS document")
    return registers.sanctioned(lines, t.read("supplier").selectExpr("concat('L', s_suppkey) AS lei"), t.company)


@query("b11_interests", """WITH p AS (SELECT c_custkey AS k, c_name, c_custkey % 3 AS kids FROM customer WHERE c_custkey % 7 > 0), u AS (SELECT k, c_name, unnest(CASE WHEN kids = 0 THEN [0] ELSE range(1, kids + 1) END) AS i FROM p)
SELECT CAST(k AS VARCHAR) || CASE WHEN i = 0 THEN '' ELSE '.' || CAST(i AS VARCHAR) END AS interest, CASE WHEN i = 2 THEN 'child ' ELSE '' END || c_name AS donor, i < 2 AS organisation, '2020-01-01' AS since, CASE WHEN k % 2 = 0 THEN '2021-01-01' END AS until, k % 2 > 0 AS inverted FROM u""")
def b11(spark, sf_dir):
    field = lambda name, value: f"named_struct('name', '{name}', 'value', {value})"
    fields = f"array({field('OrganisationName', 'c_name')}, {field('Status', chr(39) + 'Company' + chr(39))}, {field('StartDate', chr(39) + '2020-01-01' + chr(39))}, {field('EndDate', 'CASE WHEN c_custkey % 2 = 0 THEN ' + chr(39) + '2021-01-01' + chr(39) + ' ELSE ' + chr(39) + '2019-01-01' + chr(39) + ' END')})"
    over = "CASE WHEN i = 2 THEN array(named_struct('name', 'OrganisationName', 'value', concat('child ', c_name)), named_struct('name', 'Status', 'value', 'Individual')) ELSE array() END"
    kids = f"CASE WHEN c_custkey % 3 = 0 THEN array() ELSE transform(sequence(1, CAST(c_custkey % 3 AS INT)), i -> named_struct('id', concat(c_custkey, '.', i), 'fields', {over})) END"
    rows = Tables(spark, sf_dir).read("customer")
    lines = rows.selectExpr(f"to_json(named_struct('id', CAST(c_custkey AS STRING), 'fields', {fields}, 'childInterests', {kids})) AS document")
    leaves = registers.leaf_interests(lines)
    category = F.when(F.split_part("interest", F.lit("."), F.lit(1)).cast("long") % 7 == 0, "9. Family members employed").otherwise("1. Employment")
    out = registers.interest_edges(leaves.withColumn("category", category))
    return out.withColumn("since", F.col("since").cast("string")).withColumn("until", F.col("until").cast("string"))


def _pages(t: Tables):
    """Ten members to a page of a register's HTML, each with one or two entries, or none."""
    member = "concat('<div><a href=\"/member/', c_custkey, '/x\"><div class=\"primary-info\">', c_name, '</div></a><div class=\"card card-child\"><div class=\"primary-info\">Category 1</div>', CASE WHEN c_custkey % 4 = 0 THEN '<p>No registrable interests</p>' ELSE concat('<ul><li>Director, ', c_mktsegment, ' Ltd</li>', CASE WHEN c_custkey % 4 = 1 THEN '<li>Chair, Example plc</li>' ELSE '' END, '</ul>') END, '</div></div>')"
    return t.read("customer").groupBy((F.col("c_custkey") % 40).cast("string").alias("page")).agg(F.array_join(F.array_sort(F.collect_list(F.expr(member))), "").alias("html"))


@query("b12_register_pages", "SELECT CAST(c_custkey AS VARCHAR) AS member_id, c_name AS name, unnest(CASE WHEN c_custkey % 4 = 1 THEN ['Director, ' || c_mktsegment || ' Ltd', 'Chair, Example plc'] ELSE ['Director, ' || c_mktsegment || ' Ltd'] END) AS description FROM customer WHERE c_custkey % 4 > 0")
def b12(spark, sf_dir):
    return registers.register_pages(_pages(Tables(spark, sf_dir))).select("member_id", "name", "description")


@query("b13_snapshots", "SELECT c_custkey % 40 AS page, count(*) AS attestations FROM customer, (VALUES ('2020'), ('2021')) s(y) WHERE c_custkey % 4 > 0 GROUP BY 1")
def b13(spark, sf_dir):
    entries = registers.register_pages(_pages(Tables(spark, sf_dir))).where("place = 0")
    twice = entries.withColumn("captured", F.explode(F.array(F.lit("20200101000000"), F.lit("20210101000000")))).withColumn("page_no", F.col("page").cast("int"))
    out = registers.snapshot_attestations(twice)
    return out.groupBy(F.regexp_extract("reference", r":p0*(\d+)$", 1).cast("long").alias("page")).agg(F.count("*").alias("attestations"))


@query("b15_appointments", """SELECT 'o' || CAST(c_custkey AS VARCHAR) AS officer_id, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS company_number, CASE WHEN c_custkey % 4 <> 1 THEN '2019-05-01' END AS valid_from, CASE WHEN c_custkey % 4 = 0 THEN '2020-01-01' END AS valid_to, CASE c_custkey % 4 WHEN 0 THEN 'ended' WHEN 1 THEN 'inconsistent_source_dates' WHEN 2 THEN 'ended_date_unknown' ELSE 'serving' END AS status FROM customer JOIN supplier ON s_suppkey = c_custkey WHERE c_custkey % 5 > 0""")
def b15(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.read("customer").selectExpr("concat('o', c_custkey) AS officer_id", "CAST(c_custkey AS STRING) AS company_number", "'2019-05-01' AS appointed", "element_at(array('2020-01-01', '2018-01-01', 'some day', ''), CAST(c_custkey % 4 AS INT) + 1) AS resigned")
    known = t.read("supplier").selectExpr("lpad(CAST(s_suppkey AS STRING), 8, '0') AS company_number")
    out = registers.appointments(rows, t.read("customer").where("c_custkey % 5 > 0").selectExpr("concat('o', c_custkey) AS officer_id"), known)
    return out.withColumn("valid_from", F.col("valid_from").cast("string")).withColumn("valid_to", F.col("valid_to").cast("string"))


def _owners(t: Tables):
    return t.read("supplier").selectExpr("concat('OE', s_nationkey) AS entity", "CASE WHEN s_suppkey % 2 = 0 THEN 'owner' ELSE 'officer' END AS role", "CASE WHEN s_suppkey % 3 = 0 THEN 'individual-beneficial-owner' ELSE 'corporate-entity-beneficial-owner' END AS kind", "s_name AS name", "CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_suppkey AS STRING) END AS number", "CASE WHEN s_suppkey % 7 = 0 THEN '2020-01-01' END AS ceased")


@query("b16_overseas", "SELECT 'OE' || CAST(s_nationkey AS VARCHAR) AS entity, CASE WHEN s_suppkey % 5 > 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 8, '0') ELSE 'OE' || CAST(s_nationkey AS VARCHAR) || ':' || upper(s_name) END AS other, CASE WHEN s_suppkey % 2 = 0 THEN 'ownership' ELSE 'officer_of' END AS edge_type FROM supplier WHERE s_suppkey % 3 > 0")
def b16(spark, sf_dir):
    return registers.overseas_owners(_owners(Tables(spark, sf_dir)))[0]


@query("b16_individuals", "SELECT 'OE' || CAST(s_nationkey AS VARCHAR) AS entity, count(*) AS individuals FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 7 > 0 GROUP BY 1")
def b16_individuals(spark, sf_dir):
    return registers.overseas_owners(_owners(Tables(spark, sf_dir)))[1]


@query("b18_cohort_awards", f"WITH {LINES} SELECT {TENDER_ID} AS tender_id, 'S' || CAST(l_suppkey AS VARCHAR) AS supplier_name, CAST(d AS VARCHAR) AS award_date, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS value FROM (SELECT *, first_value(day) OVER (PARTITION BY l_orderkey ORDER BY i) AS d FROM a) a JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 17 > 0")
def b18(spark, sf_dir):
    return I.cohort_awards(_ocds(Tables(spark, sf_dir))).select("tender_id", "supplier_name", "award_date", "value")


@query("b19_allowed_fields", "SELECT c_custkey AS id, c_name AS name FROM customer")
def b19(spark, sf_dir):
    rows = Tables(spark, sf_dir).read("customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS address", "c_nationkey AS nationality")
    return I.without_personal(rows, ["id", "name", "nationality"])
