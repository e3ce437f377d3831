"""Queries on scalar rules: texts made from the sample tables go through the rule, and SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions import names
from ledgerlight.functions import scalars as S
from ledgerlight.operators import documents as P
from ledgerlight.operators import registers
from ledgerlight.operators.freshness import read_note
from ledgerlight.plans.base import query
from ledgerlight.sources.views import Tables


def _read(spark, sf_dir, name: str, *columns: str):
    return Tables(spark, sf_dir).read(name).selectExpr(*columns)


@query("h02_donation_cents", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) END AS cents FROM orders")
def h02(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders", "o_orderkey AS k", "CASE WHEN o_orderkey % 9 = 0 THEN 'about £5' ELSE concat('£', format_number(CAST(o_totalprice AS DECIMAL(18,2)), 2)) END AS said")
    return rows.select("k", S.donation_cents("said").alias("cents"))


@query("h03_value_band", "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 100 * p_size WHEN 1 THEN 100000 * p_size END AS low, CASE p_partkey % 4 WHEN 0 THEN 1000000 * p_size WHEN 2 THEN 100 * p_size END AS high FROM part")
def h03(spark, sf_dir):
    said = "CASE p_partkey % 4 WHEN 0 THEN concat('Between £', p_size, ' and £', format_number(10000 * p_size, 0)) WHEN 1 THEN concat('more than £', format_number(1000 * p_size, 0)) WHEN 2 THEN concat('Less than £', p_size) ELSE 'some' END AS said"
    low, high = registers.value_band(F.col("said"))
    return _read(spark, sf_dir, "part", "p_partkey AS k", said).select("k", low.alias("low"), high.alias("high"))


@query("h04_money", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 100 AS BIGINT) END AS exact, CASE WHEN p_partkey % 3 = 1 THEN 100000 * p_size END AS low FROM part")
def h04(spark, sf_dir):
    rows = _read(spark, sf_dir, "part", "p_partkey AS k", "map('Value', CASE WHEN p_partkey % 3 = 0 THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING) ELSE '' END, 'ValueBand', CASE WHEN p_partkey % 3 < 2 THEN concat('More than £', 1000 * p_size) ELSE 'none' END) AS fields")
    money = registers.money_of(F.col("fields"))
    return rows.select("k", money["exact"].alias("exact"), money["low"].alias("low"))


@query("h05_safe_int", "SELECT p_partkey AS k, CASE WHEN p_partkey % 5 > 0 THEN CAST(trunc(p_retailprice) AS BIGINT) * CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END END AS n, CASE WHEN p_partkey % 5 > 0 THEN CAST(trunc(p_retailprice) AS BIGINT) * CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END ELSE 0 END AS zero FROM part")
def h05(spark, sf_dir):
    rows = _read(spark, sf_dir, "part", "p_partkey AS k", "CASE WHEN p_partkey % 5 = 0 THEN 'few' ELSE concat(CASE WHEN p_partkey % 2 = 0 THEN ' -' ELSE '' END, CAST(p_retailprice AS STRING)) END AS said")
    return rows.select("k", S.int_or_null("said").alias("n"), S.safe_int("said").alias("zero"))


@query("h06_instant", "SELECT event_id AS k, CASE event_id % 4 WHEN 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') END AS at FROM events")
def h06(spark, sf_dir):
    said = "CASE event_id % 4 WHEN 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") WHEN 1 THEN date_format(ts, 'yyyy-MM-dd') WHEN 2 THEN concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+02:00') ELSE 'yesterday' END AS said"
    return _read(spark, sf_dir, "events", "event_id AS k", said).select("k", F.date_format(S.instant("said"), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("h07_any_date", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 < 3 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders")
def h07(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders", "o_orderkey AS k", "CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 2 THEN date_format(o_orderdate, 'yyyy/MM/dd') ELSE '31/02/2020' END AS said")
    return rows.select("k", S.any_date("said", "yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd").cast("string").alias("day"))


@query("h08_register_dates", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def h08(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders", "o_orderkey AS k", "CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE date_format(o_orderdate, 'dd/MM/yyyy') END AS said")
    return rows.select("k", F.date_format(S.any_date("said", "dd/MM/yyyy"), "yyyy-MM-dd").alias("iso"))


@query("h10_ceased", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 < 2 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS ceased FROM orders")
def h10(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders", "o_orderkey AS k", "concat('Sample Ltd ', CASE o_orderkey % 3 WHEN 0 THEN concat('(Interest ceased ', date_format(o_orderdate, 'd MMMM yyyy'), ')') WHEN 1 THEN concat('(interest ceased ', date_format(o_orderdate, 'dd MMMM yyyy'), ')') ELSE '(interest continues)' END) AS said")
    return rows.select("k", names.ceased_on(F.col("said")).cast("string").alias("ceased"))


@query("h15_days_between", "SELECT l_orderkey * 10 + l_linenumber AS k, min(CASE WHEN l_orderkey % 7 > 0 THEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) END) AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def h15(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.read("lineitem").join(t.read("orders"), F.col("o_orderkey") == F.col("l_orderkey")).selectExpr("l_orderkey * 10 + l_linenumber AS k", "CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE CAST(o_orderdate AS STRING) END AS a", "CAST(CAST(l_shipdate AS DATE) AS STRING) AS b")
    return rows.select("k", S.days_between("a", "b").alias("days")).groupBy("k").agg(F.min("days").alias("days"))


@query("h19_surname", "SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 3 THEN '' ELSE 'quill' || chr(CAST(97 + c_custkey % 26 AS INT)) END AS surname FROM customer")
def h19(spark, sf_dir):
    letter = "chr(97 + c_custkey % 26)"
    rows = _read(spark, sf_dir, "customer", "c_custkey AS k", f"CASE c_custkey % 4 WHEN 0 THEN concat('QUILL', upper({letter}), ', Ivy May, Dame') WHEN 1 THEN concat('Lord Quill', {letter}, ' of Nether Marl') WHEN 2 THEN concat('Rt Hon Ivy J Quill', {letter}, ' OBE MP') ELSE 'The Lord' END AS said")
    return rows.select("k", S.surname(F.col("said")).alias("surname"))


@query("h20_person_names", "SELECT c_custkey AS k, 'quill' || chr(CAST(97 + c_custkey % 26 AS INT)) AS surname, CASE WHEN c_custkey % 3 > 0 THEN 'ivy' END AS forename, CASE c_custkey % 3 WHEN 0 THEN 'viscountess' WHEN 1 THEN 'dame' END AS title, CASE WHEN c_custkey % 3 = 0 THEN 'nether marl' END AS seat, 'quill' || chr(CAST(97 + c_custkey % 26 AS INT)) AS listed, c_custkey % 3 = 0 AS same_seat FROM customer")
def h20(spark, sf_dir):
    letter = "chr(97 + c_custkey % 26)"
    rows = _read(spark, sf_dir, "customer", "c_custkey AS k", f"CASE c_custkey % 3 WHEN 0 THEN concat('The Viscountess Quill', {letter}, ' of  Nether Marl') WHEN 1 THEN concat('Dame Ivy Quill', {letter}) ELSE concat('Ivy  May Quill', {letter}) END AS member", f"concat('QUILL', upper({letter}), ', Ivy, Lady Quill of Nether Marl DBE') AS officer")
    m, o = names.member_name(F.col("member")), names.officer_name(F.col("officer"))
    return rows.select("k", m["surname"].alias("surname"), m["forename"].alias("forename"), m["title"].alias("title"), m["seat"].alias("seat"), o["surname"].alias("listed"), names.same_territory(m["seat"], o["seat"]).alias("same_seat"))


@query("h21_as_published", "SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'Quill' WHEN 1 THEN 'Ivy Quill' ELSE 'Baron Rook' END AS name FROM customer")
def h21(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer", "c_custkey AS k", "CASE c_custkey % 3 WHEN 0 THEN ' Lord Quill of Marl' WHEN 1 THEN 'Dr Ivy Quill' ELSE 'Lord Baron Rook  of the Fen' END AS said")
    return rows.select("k", names.as_published(F.col("said")).alias("name"))


@query("h22_counterparty", "SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN s_name || ' Ltd' WHEN 1 THEN s_name || ' plc' END AS name, s_suppkey % 4 = 3 AS private FROM supplier")
def h22(spark, sf_dir):
    rows = _read(spark, sf_dir, "supplier", "s_suppkey AS k", "CASE s_suppkey % 4 WHEN 0 THEN concat('Director, ', s_name, ' Ltd (parts (new and old)) (unpaid)') WHEN 1 THEN concat(s_name, ' plc') WHEN 2 THEN 'the member has no shares' ELSE concat('Partner in family firm, ', s_name, ' Ltd') END AS said")
    who = names.counterparty(F.col("said"), F.lit("Category 1"))
    return rows.select("k", who["name"].alias("name"), who["private"].alias("private"))


@query("h24_strict_name", "SELECT s_suppkey AS k, upper(replace(s_name, '#', '')) || 'COLTD' AS name FROM supplier")
def h24(spark, sf_dir):
    return _read(spark, sf_dir, "supplier", "s_suppkey AS k", "concat(' ', s_name, ' & Co. Ltd.') AS said").select("k", S.strict_name(F.col("said")).alias("name"))


@query("h25_tri_state", "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS said, p_partkey % 3 + 1 AS n, 'r' || CAST(p_partkey % 3 AS VARCHAR) AS last FROM part")
def h25(spark, sf_dir):
    rows = _read(spark, sf_dir, "part", "p_partkey AS k", "element_at(array(' Yes', 'N', 'maybe', ''), CAST(p_partkey % 4 AS INT) + 1) AS said", "array_join(transform(sequence(0, p_partkey % 3), i -> concat(' r', i)), '+ +') AS sources")
    parts = S.listed(F.col("sources"), "+")
    return rows.select("k", S.tri_state(F.col("said")).alias("said"), F.size(parts).cast("long").alias("n"), F.element_at(parts, -1).alias("last"))


@query("h30_unscoreable", """SELECT tender_id, CASE WHEN tender_end IS NULL THEN 'no_end' ELSE 'scored' END AS i002, CASE WHEN framework THEN 'framework' WHEN value_cents <= 0 THEN 'no_value' ELSE 'scored' END AS i004, CASE WHEN n < 4 THEN 'few_awards' ELSE 'scored' END AS i003
 FROM (SELECT tender_id, tender_end, value_cents, buyer_nation, tender_key % 20 IN (0, 1) AS framework, count(*) OVER (PARTITION BY buyer_name) AS n FROM tender)""")
def h30(spark, sf_dir):
    from ledgerlight.operators.indicators import unscoreable

    return unscoreable(Tables(spark, sf_dir).tender).select("tender_id", "i002", "i003", "i004")


@query("h32_plain_quotes", "SELECT item_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) || ' - \"it''s\", done.' AS plain FROM benchmark")
def h32(spark, sf_dir):
    rows = _read(spark, sf_dir, "benchmark", "item_id", "concat('  ', text, '\\u00a0\\u2013  \\u201cit\\u2019s\\u201d , done .') AS said")
    return rows.select("item_id", P.plain_quotes(F.col("said")).alias("plain"))


@query("h33_explained", "SELECT o_orderkey AS k, CAST(round_even(CAST(o_orderkey % 1000 AS DOUBLE) / 800 * 100, 0) AS BIGINT)::VARCHAR || '%' AS share, format('{:,.2f}', CAST(o_orderkey AS DOUBLE) * 12345 / 100) AS money FROM orders")
def h33(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders", "o_orderkey AS k", "CAST(o_orderkey % 1000 AS DOUBLE) / 800 AS ratio", "o_orderkey * 12345 AS cents")
    return rows.select("k", S.percent_text(F.col("ratio")).alias("share"), S.money_text(F.col("cents")).alias("money"))


@query("h34_confidence_note", "SELECT award_id, '[match_confidence=' || CAST(match_confidence AS VARCHAR) || ', method=' || match_method || ']' AS note FROM resolution")
def h34(spark, sf_dir):
    from ledgerlight.operators.resolve import resolve_awards

    t = Tables(spark, sf_dir)
    return resolve_awards(t.award, t.company).select("award_id", S.confidence_note(F.col("match_confidence"), F.col("match_method")).alias("note"))


@query("h36_fetch_problem", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://(?:www\\.)?([^/:?#]+)', 1)) AS domain, CASE page_id % 5 WHEN 0 THEN 'not_found' WHEN 1 THEN 'http_error' WHEN 2 THEN 'challenge_page' END AS problem FROM pages")
def h36(spark, sf_dir):
    rows = _read(spark, sf_dir, "pages", "page_id", "url", "CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS status", "CASE WHEN page_id % 5 = 2 THEN '<p>Just a Moment...' ELSE 'text' END AS body")
    problem = P.content_outcome(F.col("status"), F.lit("text/html"), F.col("url"), F.col("body"), ["blocked.invalid"], ["just a moment"])
    return rows.select("page_id", S.domain(F.col("url")).alias("domain"), problem.alias("problem"))


@query("h37_locale_name", "SELECT c_custkey AS k, c_name AS name FROM customer")
def h37(spark, sf_dir):
    return _read(spark, sf_dir, "customer", "c_custkey AS k", "concat('  ', c_name, ' ') AS said").select("k", F.trim("said").alias("name"))


@query("h38_completeness", "SELECT event_id AS k, CASE WHEN event_id % 3 = 0 THEN 'partial' WHEN event_id % 3 = 1 THEN 'unverifiable' END AS state, CASE WHEN event_id % 3 < 2 THEN event_id % 100 END AS seen, CASE WHEN event_id % 3 = 0 THEN 100 END AS advertised FROM events")
def h38(spark, sf_dir):
    rows = _read(spark, sf_dir, "events", "event_id AS k", "CASE event_id % 3 WHEN 0 THEN concat('completeness=partial;seen=', event_id % 100, ';advertised=100') WHEN 1 THEN concat('completeness=unverifiable;seen=', event_id % 100, ';advertised=') ELSE 'ValueError: no' END AS note")
    read = read_note(F.col("note"))
    return rows.select("k", read["state"].alias("state"), read["seen"].alias("seen"), read["advertised"].alias("advertised"))


FRAMEWORK_TITLES = ["Supply Framework 2", "A DPS for cleaning", "Call-Off order", "Dynamic Purchasing of beds", "Approved Supplier List", "Frame works", "Spare parts", "Call centre"]


@query("h16_framework_words", f"SELECT p_partkey AS k, regexp_matches(lower({FRAMEWORK_TITLES}[p_partkey % 8 + 1] || ' ' || p_type), 'framework|dynamic purchasing|dps|call-off|call off|supplier list') AS framework FROM part")
def h16_words(spark, sf_dir):
    rows = Tables(spark, sf_dir).read("part").select(F.col("p_partkey").alias("k"), F.element_at(F.array(*map(F.lit, FRAMEWORK_TITLES)), (F.col("p_partkey") % 8 + 1).cast("int")).alias("title"), "p_type")
    return rows.select("k", S.is_framework(F.col("title"), F.col("p_type"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("framework"))


@query("f06_sorted_aliases", "SELECT company_number, normalised_name, row_number() OVER (ORDER BY company_number DESC, normalised_name) AS place FROM company")
def f06(spark, sf_dir):
    from ledgerlight.operators.sequence import placed

    rows = Tables(spark, sf_dir).company.select("company_number", "normalised_name")
    return placed(rows, [F.desc("company_number"), F.col("normalised_name")], F.row_number(), "place").withColumn("place", F.col("place").cast("long"))


@query("k04_adjudicated", "SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'VERBATIM' WHEN 1 THEN 'NEAR' ELSE 'ABSENT' END AS status, CASE WHEN item_id % 3 = 1 THEN 'asked' END AS note FROM benchmark")
def k04(spark, sf_dir):
    rows = Tables(spark, sf_dir).read("benchmark").selectExpr("item_id", "element_at(array('VERBATIM', 'NEAR', 'ABSENT'), CAST(item_id % 3 AS INT) + 1) AS status")
    return P.adjudicated(rows, lambda row: F.when(row["item_id"] >= 0, "asked"))
