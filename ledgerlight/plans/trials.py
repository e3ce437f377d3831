"""Queries on resolution ladders, path reports, cohorts, control batteries, gates and what binds them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions import names
from ledgerlight.functions import scalars as S
from ledgerlight.operators import controls, gates, guards, ladders, read_api, scoring, trials
from ledgerlight.operators import documents as P
from ledgerlight.operators import graph as G
from ledgerlight.operators import resolve as R
from ledgerlight.operators.freshness import freshness
from ledgerlight.operators.sequence import stride_pairs
from ledgerlight.plans.base import ORACLE_SQL, QUERIES, query
from ledgerlight.plans.graph import PATH_LEVELS, PATHS, _leveled, _paths
from ledgerlight.sources.views import Tables
from ledgerlight.sources.workdir import settled

NUMBER = "lpad(CAST(s_suppkey AS VARCHAR), 8, '0')"
SPARK_NUMBER = "lpad(CAST(s_suppkey AS STRING), 8, '0')"


def _twins(t: Tables):
    """Companies in two registers: each in the companies register but every fifth, each in a second one, every tenth twice."""
    s = t.read("supplier")
    own = s.where("s_suppkey % 5 > 0").selectExpr("s_suppkey AS id", "'company' AS entity_type", "s_name AS name", "'GB-COH' AS scheme", f"{SPARK_NUMBER} AS registry_id", f"{SPARK_NUMBER} AS company_number")
    twin = s.selectExpr("1000000 + s_suppkey AS id", "'company' AS entity_type", "s_name AS name", "'LEI' AS scheme", "concat('L', s_suppkey) AS registry_id", f"{SPARK_NUMBER} AS company_number")
    again = s.where("s_suppkey % 10 = 0").selectExpr("2000000 + s_suppkey AS id", "'company' AS entity_type", "s_name AS name", "'LEI' AS scheme", "concat('M', s_suppkey) AS registry_id", f"{SPARK_NUMBER} AS company_number")
    return own.unionByName(twin).unionByName(again)


FOUND = "CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey WHEN s_suppkey % 10 > 0 THEN 1000000 + s_suppkey END"


@query("l07_by_number", f"SELECT {NUMBER} AS number, {FOUND} AS found FROM supplier WHERE s_suppkey % 10 > 0")
def l07(spark, sf_dir):
    return ladders.by_number(_twins(Tables(spark, sf_dir))).where("found IS NOT NULL")


@query("l08_resolve_suppliers", f"""SELECT s_suppkey AS key, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE {FOUND} END AS found, CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'number' WHEN s_suppkey % 3 = 1 THEN 'cache' ELSE 'name' END AS way FROM supplier""")
def l08(spark, sf_dir):
    """A third of the rows has its own number, a third one in the cache, a third only its name."""
    t = Tables(spark, sf_dir)
    rows = t.read("supplier").selectExpr("s_suppkey AS key", "concat(' ', lower(s_name)) AS name", "CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS STRING) END AS company_number")
    cache = rows.where("key % 3 = 1").selectExpr("name", "CAST(key AS STRING) AS company_number")
    return ladders.resolve_suppliers(rows, cache, _twins(t)).select("key", "found", "way")


@query("l06_counterparties", f"""SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN {NUMBER} WHEN 1 THEN {NUMBER} WHEN 2 THEN {NUMBER} ELSE CAST(s_suppkey AS VARCHAR) || ':NOBODY ' || CAST(s_suppkey AS VARCHAR) END AS registry_id, CASE s_suppkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM supplier""")
def l06(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.read("supplier").selectExpr("CAST(s_suppkey AS STRING) AS interest", "s_suppkey AS k", "CASE s_suppkey % 4 WHEN 0 THEN 'whoever' WHEN 1 THEN lower(s_name) WHEN 2 THEN concat('The ', s_name, ' Ltd.') ELSE concat('Nobody  ', s_suppkey) END AS name", "CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey AS STRING) END AS number")
    company = t.read("supplier").selectExpr(f"{SPARK_NUMBER} AS company_number", "upper(s_name) AS normalised_name")
    return ladders.resolve_counterparties(rows, company).select("k", "registry_id", "confidence")


@query("l09_referrers", "WITH r AS (SELECT c_custkey AS key, c_custkey % 3 AS way, 'quill' || chr(CAST(97 + c_custkey % 26 AS INT)) AS surname FROM customer) SELECT r.key, p.key AS person FROM r JOIN r p ON (r.way = 0 AND p.key = r.key) OR (r.way = 1 AND p.surname = r.surname)")
def l09(spark, sf_dir):
    """A third asserts an id, a third an id that no one has, a third none."""
    c = Tables(spark, sf_dir).read("customer")
    surname = "concat('quill', chr(97 + c_custkey % 26)) AS surname"
    rows = c.selectExpr("c_custkey AS key", "CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey AS STRING) WHEN 2 THEN concat('gone', c_custkey) END AS registry_id", surname)
    return ladders.resolve_referrers(rows, c.selectExpr("c_custkey AS id", "CAST(c_custkey AS STRING) AS registry_id", surname))


@query("l10_names_a_person", "SELECT c_custkey AS k, c_custkey % 5 IN (0, 3) AS person FROM customer")
def l10(spark, sf_dir):
    rows = Tables(spark, sf_dir).read("customer").selectExpr("c_custkey AS k", "element_at(array(c_name, 'PPE mailbox', '', 'Lord Quill, Buy Team', 'DHSC'), CAST(c_custkey % 5 AS INT) + 1) AS said")
    return rows.select("k", ladders.names_a_person(F.col("said")).alias("person"))


@query("l03_alias_lookup", f"SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN {NUMBER} WHEN s_suppkey % 4 = 1 THEN {NUMBER} END AS company_number FROM supplier")
def l03(spark, sf_dir):
    """Half of the texts are asked for in the other kind's lookup, and so not found."""
    s = Tables(spark, sf_dir).read("supplier")
    asked = s.selectExpr("s_suppkey AS k", "CASE WHEN s_suppkey % 4 IN (0, 2) THEN 'name' ELSE 'identifier' END AS kind", "CASE WHEN s_suppkey % 4 IN (0, 3) THEN concat('Old ', s_name) ELSE concat('fc', s_suppkey) END AS value")
    former = s.selectExpr("upper(concat('Old ', s_name)) AS former", f"{SPARK_NUMBER} AS company_number")
    legacy = s.selectExpr("concat('FC', lpad(CAST(s_suppkey AS STRING), 6, '0')) AS legacy", f"{SPARK_NUMBER} AS company_number")
    return ladders.alias_lookup(asked, former, legacy).select("k", "company_number")


OUTCOMES = "CASE s_suppkey % 7 WHEN 0 THEN 'unfetched' WHEN 1 THEN 'not_found' WHEN 2 THEN 'unfetched' WHEN 3 THEN 'not_oversea_company' WHEN 4 THEN 'no_cross_reference' WHEN 5 THEN 'self_referential' ELSE 'resolved' END"


@query("l04_oversea_aliases", f"SELECT {OUTCOMES} AS outcome, count(*) AS n, count(*) FILTER (s_suppkey % 7 = 6) AS targets FROM supplier WHERE s_suppkey % 10 > 0 GROUP BY 1")
def l04(spark, sf_dir):
    s = Tables(spark, sf_dir).read("supplier")
    legacy = s.selectExpr("CASE WHEN s_suppkey % 10 = 0 THEN concat('OC', lpad(CAST(s_suppkey AS STRING), 6, '0')) ELSE concat('FC', lpad(CAST(s_suppkey AS STRING), 6, '0')) END AS legacy")
    profiles = s.where("s_suppkey % 7 > 0").selectExpr("concat('FC', lpad(CAST(s_suppkey AS STRING), 6, '0')) AS legacy", "CASE s_suppkey % 7 WHEN 1 THEN 'not_found' WHEN 2 THEN 'error' ELSE 'ok' END AS status", "CASE WHEN s_suppkey % 7 = 3 THEN 'ltd' ELSE 'oversea-company' END AS type", "CASE s_suppkey % 7 WHEN 4 THEN ' ' WHEN 5 THEN concat('fc', s_suppkey) ELSE CAST(s_suppkey AS STRING) END AS registration")
    return ladders.oversea_aliases(legacy, profiles).groupBy("outcome").agg(F.count("*").alias("n"), F.count("target").alias("targets"))


@query("l12_candidates", "SELECT r.company_number, CAST(min(award_date) AS VARCHAR) AS earliest FROM resolution r JOIN award USING (award_id) WHERE r.company_number IN (SELECT company_number FROM company) GROUP BY 1")
def l12(spark, sf_dir):
    """Also the candidate universe (its first column)."""
    t = Tables(spark, sf_dir)
    found = R.resolve_awards(t.award, t.company)
    return ladders.candidate_companies(t.award, found, t.company).withColumn("earliest", F.col("earliest").cast("string"))


@query("l13_cohort_lookup", """WITH c AS (SELECT s_suppkey, company_number, normalised_name AS n, company_status FROM company JOIN supplier ON upper(s_name) = normalised_name), u AS (SELECT s_suppkey, count(*) AS n, count(*) FILTER (company_status = 'Active') AS a, min(company_number) AS one, min(company_number) FILTER (company_status = 'Active') AS live FROM c GROUP BY 1)
SELECT s_suppkey AS k, CASE WHEN s_suppkey % 6 = 5 THEN NULL WHEN n = 1 THEN one WHEN a = 1 THEN live END AS company_number, CASE WHEN s_suppkey % 6 = 5 THEN 'unmatched' WHEN n = 1 THEN 'unique' WHEN a = 1 THEN 'sole_active' ELSE 'ambiguous' END AS outcome FROM u""")
def l13(spark, sf_dir):
    t = Tables(spark, sf_dir)
    said = "CASE s_suppkey % 6 WHEN 0 THEN lower(s_name) WHEN 1 THEN concat(s_name, '  Ltd') WHEN 2 THEN concat(s_name, ' Limited t/a Shop') WHEN 5 THEN concat('Not ', s_name) ELSE s_name END AS supplier"
    asked = t.read("supplier").selectExpr("s_suppkey AS k", said)
    return asked.join(controls.cohort_lookup(asked, t.company), "supplier").select("k", "company_number", "outcome")


@query("l14_footprint", """WITH c AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'successor' ELSE 'dissolved' END AS o, s_nationkey % 8 AS addr FROM supplier), f AS (SELECT *, count(*) FILTER (o <> 'dissolved') OVER (PARTITION BY addr) >= 5 AS crowded FROM c)
SELECT count(*) FILTER (o = 'active') AS active, count(*) FILTER (o = 'successor') AS successor, count(*) FILTER (o = 'dissolved') AS dissolved, count(*) FILTER (o <> 'dissolved' AND crowded) AS flagged, count(*) FILTER (o <> 'dissolved') AS live, count(*) FILTER (o <> 'dissolved' AND NOT crowded) AS live_without_flagged FROM f""")
def l14(spark, sf_dir):
    """Packed names are taken to pieces first; companies named twice count once."""
    s = Tables(spark, sf_dir).read("supplier")
    packed = s.selectExpr(f"array(concat(upper(replace(s_name, '#', ' ')), ' (', {SPARK_NUMBER}, ')')) AS entries", "CASE s_suppkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'successor' ELSE 'dissolved' END AS outcome", "CAST(s_nationkey % 8 AS STRING) AS address")
    each = packed.select(F.explode(controls.named_companies(F.col("entries"))).alias("c"), "outcome", "address").select("c.number", "c.name", "outcome", "address")
    return controls.footprint(each.unionByName(each))


@query("h23_named_companies", f"SELECT s_suppkey AS k, unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['FIRM', 'OTHER LTD'] ELSE ['Nameless'] END) AS name, unnest(CASE WHEN s_suppkey % 3 = 0 THEN [{NUMBER}, 'SC123456'] ELSE [NULL] END) AS number FROM supplier")
def h23(spark, sf_dir):
    rows = Tables(spark, sf_dir).read("supplier").selectExpr("s_suppkey AS k", f"array(CASE WHEN s_suppkey % 3 = 0 THEN concat('FIRM (', {SPARK_NUMBER}, ') OTHER LTD (SC123456)') ELSE ' Nameless ' END) AS e")
    return rows.select("k", F.explode(controls.named_companies(F.col("e"))).alias("c")).select("k", "c.name", "c.number")


def _bans(t: Tables):
    """Customers as people, some banned now, some without a birth or an end; and appointments of theirs."""
    c = t.read("customer")
    born = ["CASE WHEN c_custkey % 11 > 0 THEN 1900 + c_custkey % 90 END AS year", "c_custkey % 12 AS month"]
    people = c.selectExpr("c_custkey AS person", "'Ivy' AS forename", "concat('Quill', c_custkey, 'x') AS surname", *born)
    bans = c.selectExpr("c_custkey AS person", "DATE '2019-01-01' AS since", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE DATE '2022-01-01' END AS until", "array(concat('Firm ', c_custkey, ' Ltd.')) AS companies")
    held = c.selectExpr("concat('Ms ', CASE WHEN c_custkey % 13 = 0 THEN 'EVE' ELSE 'IVY' END, ' QUILL', c_custkey, 'X') AS title", *born, "lpad(CAST(c_custkey AS STRING), 8, '0') AS company_number", "CASE WHEN c_custkey % 4 = 0 THEN 'dissolved' ELSE 'active' END AS status", "CASE WHEN c_custkey % 5 = 0 THEN '2020-01-01' END AS resigned", "array(concat('FIRM ', c_custkey + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END, ' LTD')) AS aliases")
    return people, bans, held, F.lit("2020-06-01").cast("date")


@query("l15_disqualified", "SELECT c_custkey AS person, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS company_number FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 4 > 0 AND c_custkey % 5 > 0 AND c_custkey % 7 > 0 AND c_custkey % 11 > 0 AND c_custkey % 13 > 0")
def l15(spark, sf_dir):
    return controls.disqualified(*_bans(Tables(spark, sf_dir)))


@query("l15_counts", """WITH f AS (SELECT c_custkey % 11 = 0 AS unborn, c_custkey % 3 > 0 AS banned, c_custkey % 3 > 0 AND c_custkey % 11 > 0 AND c_custkey % 13 > 0 AS namesake, c_custkey % 4 > 0 AND c_custkey % 5 > 0 AS live, c_custkey % 7 > 0 AS tied FROM customer)
SELECT count(*) AS people, count(*) FILTER (unborn) AS unborn, count(*) FILTER (NOT banned) AS lapsed, count(*) FILTER (banned) AS banned, count(*) FILTER (namesake) AS namesakes, count(*) FILTER (namesake AND live) AS live, count(*) FILTER (namesake AND live AND tied) AS tied FROM f""")
def l15_counts(spark, sf_dir):
    return controls.disqualified_counts(*_bans(Tables(spark, sf_dir)))


@query("l02_alias_report", f"""WITH slots AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'OLD ' || CAST(s_suppkey % 40 AS VARCHAR) WHEN s_suppkey % 3 = 1 THEN upper(s_name) ELSE 'FORMER ' || CAST(s_suppkey AS VARCHAR) END AS former FROM supplier UNION ALL SELECT s_suppkey, 'EARLIER ' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 2 = 0),
u AS (SELECT former, count(DISTINCT k) AS n, min(k) AS k FROM slots GROUP BY 1), x AS (SELECT *, EXISTS (SELECT 1 FROM supplier s WHERE upper(s_name) = former AND s_suppkey <> k) AS taken FROM u) SELECT count(*) AS names, count(*) FILTER (n > 1) AS shared, count(*) FILTER (n = 1 AND taken) AS borne, count(*) FILTER (n = 1 AND NOT taken) AS aliases FROM x""")
def l02(spark, sf_dir):
    s = Tables(spark, sf_dir).read("supplier")
    slots = s.selectExpr(f"{SPARK_NUMBER} AS company_number", "array(CASE WHEN s_suppkey % 3 = 0 THEN concat('OLD ', s_suppkey % 40) WHEN s_suppkey % 3 = 1 THEN upper(s_name) ELSE concat('FORMER ', s_suppkey) END, CASE WHEN s_suppkey % 2 = 0 THEN concat('EARLIER ', s_suppkey) END) AS slots", "s_suppkey AS seq")
    each = slots.select("company_number", F.explode("slots").alias("former"), "seq")
    return R.alias_report(each, s.selectExpr(f"{SPARK_NUMBER} AS company_number", "upper(s_name) AS normalised_name"))


@query("e05_first_seen", "SELECT method AS name, arg_min(title, tender_key) AS raw, CAST(min(tender_start) AS DATE)::VARCHAR AS day FROM tender GROUP BY 1")
def e05(spark, sf_dir):
    rows = Tables(spark, sf_dir).tender
    return rows.groupBy(F.col("method").alias("name")).agg(F.min_by("title", "tender_key").alias("raw"), F.min("tender_start").cast("date").cast("string").alias("day"))


@query("c09_capped_lookup", """SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'unique' WHEN s_suppkey % 3 = 1 AND (SELECT count(*) FROM supplier) > 8 THEN 'refused' ELSE 'none' END AS outcome FROM supplier""")
def c09(spark, sf_dir):
    """Also the refusal of a window that is cut (at eight here)."""
    t = Tables(spark, sf_dir)
    asked = t.read("supplier").selectExpr("s_suppkey AS k", "CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'supplier' ELSE concat('nothing ', s_name) END AS name")
    return asked.join(controls.capped_name_lookup(t.entity.where("entity_type = 'company'"), asked, 8), "name").select("k", "id", "outcome")


@query("c10_alias_search", "SELECT id, min(way) AS way FROM (SELECT id, 1 AS way FROM (SELECT id FROM entity WHERE contains(lower(name), 'supplier#00000000') ORDER BY id LIMIT 20) UNION ALL SELECT id, 2 FROM (SELECT DISTINCT 1000000000 + c_custkey AS id FROM customer WHERE contains(lower('known as supplier#00000000' || CAST(c_custkey AS VARCHAR)), 'supplier#00000000') ORDER BY id LIMIT 20)) GROUP BY 1 ORDER BY way, id LIMIT 20")
def c10(spark, sf_dir):
    t = Tables(spark, sf_dir)
    alias = t.read("customer").selectExpr("1000000000 + c_custkey AS id", "concat('Known as Supplier#00000000', c_custkey) AS alias")
    return read_api.resolve_entity(t.entity, alias, " Supplier#00000000").select("id", F.col("way").cast("int").alias("way"))


@query("c13_linked", "SELECT DISTINCT e.source AS id FROM edge e JOIN entity x ON x.id = e.target WHERE x.entity_type = 'person' AND CAST(x.registry_id AS BIGINT) % 3 = 0")
def c13(spark, sf_dir):
    t = Tables(spark, sf_dir)
    people = t.entity.where("entity_type = 'person'").select("id", F.col("registry_id").alias("company_number"))
    return ladders.linked_to(people, t.edge, people.where("CAST(company_number AS BIGINT) % 3 = 0").select("company_number"))


@query("c14_surname_join", "WITH m AS (SELECT c_custkey AS member, c_custkey % 300 AS s, c_custkey % 2 = 0 AS lord FROM customer), o AS (SELECT s_suppkey AS officer, s_suppkey % 300 AS s, s_suppkey % 3 = 0 AS lord FROM supplier) SELECT member, officer FROM m JOIN o USING (s) WHERE m.lord = o.lord")
def c14(spark, sf_dir):
    t = Tables(spark, sf_dir)
    letters = lambda k: f"concat(chr(97 + {k} % 300 div 26), chr(97 + {k} % 300 % 26))"
    m = t.read("customer").selectExpr("c_custkey AS member", f"concat(CASE WHEN c_custkey % 2 = 0 THEN 'Baron' ELSE 'Dame Ivy' END, ' Quill', {letters('c_custkey')}) AS said").select("member", names.member_name(F.col("said")).alias("m"))
    o = t.read("supplier").selectExpr("s_suppkey AS officer", f"concat('QUILL', upper({letters('s_suppkey')}), ', Ivy, ', CASE WHEN s_suppkey % 3 = 0 THEN 'Lord' ELSE 'Dame' END) AS said").select("officer", names.officer_name(F.col("said")).alias("o"))
    return m.join(o, (F.col("m.surname") == F.col("o.surname")) & (names.common_title(F.col("m.title")) == names.common_title(F.col("o.title")))).select("member", "officer")


@query("d23_precision_recall", "WITH s AS (SELECT s_suppkey AS k FROM supplier), c AS (SELECT count(*) FILTER (k % 2 = 0) AS tp, count(*) FILTER (k % 2 = 1 AND k % 3 = 0) AS fp, count(*) FILTER (k % 2 = 0) AS asked, count(*) FILTER (k % 6 = 0) AS hit FROM s) SELECT tp, fp, asked, tp / (tp + fp) AS precision, tp / asked AS recall, hit / tp AS temporal_accuracy FROM c")
def d23(spark, sf_dir):
    t = Tables(spark, sf_dir)
    golden = t.read("supplier").where("s_suppkey % 2 = 0").selectExpr("10 * s_suppkey AS id")
    tested = t.read("supplier").where("s_suppkey % 2 = 0 OR s_suppkey % 3 = 0").selectExpr("10 * s_suppkey + 1 AS id")
    return scoring.precision_recall(QUERIES["c20_golden"](spark, sf_dir), golden, tested)


@query("d25_fixture_digest", "SELECT c_custkey AS k, sha256(concat_ws(chr(31), CASE WHEN c_custkey % 3 = 0 THEN 'missing' ELSE '=' || c_name END, '=' || CAST(c_nationkey AS VARCHAR), CASE WHEN c_custkey % 5 = 0 THEN '=missing' ELSE '=' END)) AS digest FROM customer")
def d25(spark, sf_dir):
    rows = Tables(spark, sf_dir).read("customer").selectExpr("c_custkey AS k", "CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name", "c_nationkey AS nation", "CASE WHEN c_custkey % 5 = 0 THEN 'missing' ELSE '' END AS note")
    return rows.select("k", trials.fixture_digest(rows, ["name", "nation", "note"]).alias("digest"))


@query("d26_attrition", "SELECT o_custkey % 3 AS cohort, count(*) AS total, count(*) FILTER (o_orderkey % 2 = 0) AS named, count(*) FILTER (o_orderkey % 2 = 0 AND o_totalprice > 100000) AS resolved, count(*) FILTER (o_orderkey % 2 = 0 AND o_totalprice > 100000) / count(*) AS rate FROM orders GROUP BY 1")
def d26(spark, sf_dir):
    rows = Tables(spark, sf_dir).read("orders").withColumn("cohort", F.col("o_custkey") % 3)
    return trials.attrition(rows, "cohort", [("named", F.col("o_orderkey") % 2 == 0), ("resolved", F.when(F.col("o_totalprice") > 100_000, True))])


@query("f12_sorted_names", "SELECT edge, array_to_string(list_sort(list(DISTINCT source_name)), ', ') AS sources FROM attestation GROUP BY 1")
def f12(spark, sf_dir):
    return Tables(spark, sf_dir).attestation.groupBy("edge").agg(F.array_join(F.sort_array(F.collect_set("source_name")), ", ").alias("sources"))


@query("g03_any_paths", f"WITH RECURSIVE {PATHS} SELECT start, goal, count(*) AS paths, min(len(edges)) AS shortest FROM found GROUP BY ALL")
def g03(spark, sf_dir):
    return _paths(Tables(spark, sf_dir)).groupBy("start", "goal").agg(F.count("*").alias("paths"), F.min(F.size("edges")).cast("long").alias("shortest"))


@query("g11_path_report", f"""{PATH_LEVELS}, shown AS (SELECT start, goal, array_to_string(edges, ',') AS path, array_to_string(list_transform(list_zip(types, dates), lambda x: x[1] || '@' || coalesce(CAST(x[2] AS VARCHAR), 'undated')), ' > ') AS text FROM found)
SELECT start, goal, count(*) AS n, ['dated', 'observed', 'undated'][min(level)] AS tier, array_to_string(list_sort(list(DISTINCT text))[1:5], ' | ') AS shown FROM shown JOIN pl USING (start, goal, path) GROUP BY ALL""")
def g11(spark, sf_dir):
    """Paths by their best level, and the first five of them in order."""
    t = Tables(spark, sf_dir)
    return trials.path_report(_leveled(t).select("start", "goal", "edges", "level"))


@query("g12_find_paths", f"WITH RECURSIVE {PATHS} SELECT array_to_string(edges, ',') AS path, len(list_filter(list_zip(types, dates), lambda x: x[1] <> 'same_as' AND x[2] IS NULL)) = 0 AS dated FROM found WHERE start = 1 AND goal = 2000000001")
def g12(spark, sf_dir):
    found = read_api.find_paths(Tables(spark, sf_dir).edge, 1, 2_000_000_001, 2)
    return found.select(F.array_join(F.transform("edges", lambda e: e["edge"].cast("string")), ",").alias("path"), "dated")


@query("g12_four_hops", """WITH RECURSIVE adj AS (SELECT source AS node, target AS other, id AS edge, edge_type, valid_from FROM edge UNION ALL SELECT target, source, id, edge_type, valid_from FROM edge WHERE source <> target),
p(node, nodes, edges, undated, spent) AS (SELECT 1::BIGINT, [1::BIGINT], []::BIGINT[], 0, 0
 UNION ALL SELECT a.other, list_append(p.nodes, a.other), list_append(p.edges, a.edge), p.undated + CASE WHEN a.edge_type <> 'same_as' AND a.valid_from IS NULL THEN 1 ELSE 0 END, p.spent + CASE WHEN a.edge_type = 'same_as' THEN 0 ELSE 1 END
 FROM p JOIN adj a ON a.node = p.node WHERE p.spent < 4 AND NOT list_contains(p.nodes, a.other) AND p.node <> 2000000001)
SELECT array_to_string(edges, ',') AS path, undated = 0 AS dated FROM p WHERE node = 2000000001""")
def g12_four(spark, sf_dir):
    """All paths of up to four hops between a company and a public body, other bodies and companies on the way."""
    found = read_api.find_paths(Tables(spark, sf_dir).edge, 1, 2_000_000_001, 4)
    return found.select(F.array_join(F.transform("edges", lambda e: e["edge"].cast("string")), ",").alias("path"), "dated")


@query("i11_subject_tender", "SELECT award_id, t.tender_id, t.buyer_name FROM award a JOIN tender t USING (tender_id)")
def i11(spark, sf_dir):
    t = Tables(spark, sf_dir)
    flags = t.award.select("award_id", F.concat("tender_id", F.lit(":"), "award_id").alias("subject"))
    return flags.withColumn("tender_id", S.subject_tender(F.col("subject"))).join(t.tender.select("tender_id", "buyer_name"), "tender_id").select("award_id", "tender_id", "buyer_name")


#: Subjects of seven kinds: an id, buyers before arrows (whole, a part of them, another case), a name, parts of one, an id and more.
SUBJECT = """CASE tender_key % 7 WHEN 0 THEN tender_id WHEN 1 THEN upper(buyer_name) || ' → someone' WHEN 2 THEN substr(buyer_name, 10) || '→x' WHEN 3 THEN lower(buyer_name)
 WHEN 4 THEN CASE WHEN tender_key % 70 = 4 THEN '#0' WHEN tender_key % 70 = 11 THEN 'R' ELSE substr(buyer_name, 12, 7) END WHEN 5 THEN tender_id || ':' || buyer_name ELSE 'no one ' || tender_id END"""


@query("i12_tender_metadata", f"""WITH s AS (SELECT source_id, tender_id AS k, {SUBJECT} AS subject FROM tender), b AS (SELECT source_id, lower(buyer_name) AS name, min(tender_id) AS first FROM tender GROUP BY ALL),
d AS (SELECT DISTINCT source_id, subject FROM s),
h AS (SELECT d.*, (SELECT min(tender_id) FROM tender t WHERE t.source_id = d.source_id AND t.tender_id = d.subject) AS by_id,
 CASE WHEN contains(subject, '→') THEN (SELECT min(first) FROM b WHERE b.source_id = d.source_id AND contains(name, lower(trim(split_part(subject, '→', 1))))) END AS by_arrow,
 (SELECT min(first) FROM b WHERE b.source_id = d.source_id AND name = lower(subject)) AS by_name, (SELECT min(first) FROM b WHERE b.source_id = d.source_id AND contains(name, lower(left(subject, 50)))) AS by_part,
 CASE WHEN contains(subject, ':') THEN (SELECT min(tender_id) FROM tender t WHERE t.source_id = d.source_id AND t.tender_id = split_part(d.subject, ':', 1)) END AS by_colon FROM d)
SELECT k, coalesce(by_id, by_arrow, by_name, by_part, by_colon) AS tender_id, CASE WHEN by_id IS NOT NULL THEN 'id' WHEN by_arrow IS NOT NULL THEN 'arrow' WHEN by_name IS NOT NULL THEN 'buyer' WHEN by_part IS NOT NULL THEN 'part' WHEN by_colon IS NOT NULL THEN 'colon' END AS way FROM s JOIN h USING (source_id, subject)""")
def i12(spark, sf_dir):
    t = Tables(spark, sf_dir)
    flags = t.tender.select("source_id", F.col("tender_id").alias("k"), F.expr(SUBJECT).alias("subject"))
    return flags.join(ladders.tender_metadata(flags, t.tender), ["source_id", "subject"]).select("k", "tender_id", "way")


@query("c09_substring_join", "SELECT p_name AS pattern, count(*) AS n FROM (SELECT DISTINCT lower(c_mktsegment) AS p_name FROM customer UNION SELECT DISTINCT substr(s_name, 14, 3) FROM supplier UNION SELECT '' UNION SELECT '#' UNION SELECT '00') JOIN (SELECT DISTINCT c_name || ' ' || lower(c_mktsegment) AS name FROM customer) ON contains(name, p_name) GROUP BY 1")
def c09_join(spark, sf_dir):
    """Patterns of all lengths, rare and frequent, against customers' names."""
    from ledgerlight.operators.substring import substring_pairs

    t = Tables(spark, sf_dir)
    patterns = spark.sql("SELECT DISTINCT lower(c_mktsegment) AS pattern FROM {customer} UNION SELECT substr(s_name, 14, 3) FROM {supplier} UNION SELECT explode(array('', '#', '00'))", customer=t.read("customer"), supplier=t.read("supplier"))
    return substring_pairs(patterns, t.read("customer").selectExpr("c_name || ' ' || lower(c_mktsegment) AS text")).groupBy("pattern").agg(F.count("*").alias("n"))


@query("i14_dossier")
def i14(spark, sf_dir):
    return read_api.dossier(QUERIES["f01_curated"](spark, sf_dir), Tables(spark, sf_dir).tender)


ORACLE_SQL["i14_dossier"] = ORACLE_SQL["f01_curated"].replace("SELECT indicator, jurisdiction, subject, score FROM o WHERE pos IN (SELECT unnest(taken) FROM pick)", """SELECT place, 'Flag ' || CAST(place AS VARCHAR) || ': ' || indicator || ' in ' || jurisdiction AS heading, title AS tender, coalesce(buyer_name, '(unknown buyer)') AS buyer,
 CASE WHEN value_cents > 0 THEN format('{:,.2f}', value_cents / 100) ELSE 'not available' END AS value, method, source_id || ' ' || tender_id AS evidence
 FROM (SELECT * EXCLUDE (place), row_number() OVER (ORDER BY round(score, 6) DESC, indicator, subject) AS place FROM o WHERE pos IN (SELECT unnest(taken) FROM pick)) c JOIN tender ON tender_id = split_part(c.subject, ':', 1)""")


@query("i15_cohort_flags", """SELECT award_id, coalesce(age BETWEEN 0 AND 89, false) AS i006, (lower(trim(coalesce(accounts_category, ''))) IN ('dormant', 'micro-entity') AND v > 1000000) OR (age BETWEEN 0 AND 539 AND v > 100000) AS i007, lower(trim(coalesce(accounts_category, ''))) = 'dormant' OR coalesce(late > 547.92, false) AS i008
 FROM (SELECT a.award_id, date_diff('day', incorporation_date, award_date) AS age, date_diff('day', last_made_up, award_date) AS late, accounts_category, value_cents / 5 AS v FROM award a JOIN resolution r USING (award_id) JOIN company c ON c.company_number = r.company_number)""")
def i15(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = R.resolve_awards(t.award, t.company).select("award_id", "company_number").join(t.company, "company_number").join(t.award.select("award_id", "award_date", "value_cents"), "award_id")
    rows = j.select("award_id", "award_date", (F.col("value_cents") / 5).alias("value"), F.col("incorporation_date").alias("incorporated"), F.col("accounts_category").alias("category"), F.col("last_made_up").alias("made_up"))
    return trials.cohort_flags(rows).select("award_id", "i006", "i007", "i008")


@query("i16_kill_test", """WITH u AS (SELECT tender_id, source_id, method, value_cents FROM tender), f AS (SELECT 'direct' AS indicator, tender_id, source_id FROM u WHERE method = 'direct' UNION ALL SELECT 'large', tender_id, source_id FROM u WHERE value_cents > 15000000), n AS (SELECT source_id, count(*) AS n FROM u GROUP BY 1),
r AS (SELECT i.indicator, n.source_id, n.n, (SELECT count(*) FROM f WHERE f.indicator = i.indicator AND f.source_id = n.source_id) AS flagged FROM (VALUES ('direct'), ('large')) i(indicator), n), g AS (SELECT indicator, CAST(sum(n) AS BIGINT) AS n, CAST(sum(flagged) AS BIGINT) AS flagged, max(flagged / n) - min(flagged / n) AS spread FROM r GROUP BY 1) SELECT *, flagged / n AS rate, rank() OVER (ORDER BY spread DESC) AS rank FROM g""")
def i16(spark, sf_dir):
    units = Tables(spark, sf_dir).tender.select(F.col("tender_id").alias("unit"), "source_id", "method", "value_cents")
    flags = units.where("method = 'direct'").select(F.lit("direct").alias("indicator"), "unit").unionByName(units.where("value_cents > 15000000").select(F.lit("large").alias("indicator"), "unit"))
    return trials.kill_test(flags, units.select("unit", "source_id"), "source_id")


@query("j02_schedule")
def j02(spark, sf_dir):
    sla = spark.range(22).selectExpr("concat('src', id) AS source_id", "id % 5 + 1 AS sla_days")
    out = freshness(sla, Tables(spark, sf_dir).run, F.expr("TIMESTAMP_NTZ '2024-02-02 00:00:00'"))
    return out.agg(F.count("*").alias("sources"), F.count_if("due").alias("due"), F.count_if("overdue").alias("overdue"))


ORACLE_SQL["j02_schedule"] = ORACLE_SQL["j01_freshness"].replace("SELECT source_id, sla_days, label, label <> 'fresh' AS due, label IN ('stale', 'critical') AS overdue FROM l", "SELECT count(*) AS sources, count(*) FILTER (label <> 'fresh') AS due, count(*) FILTER (label IN ('stale', 'critical')) AS overdue FROM l")


@query("j04_pending_fetches", "SELECT CAST(s_suppkey AS VARCHAR) AS key FROM supplier WHERE s_suppkey % 3 > 0")
def j04(spark, sf_dir):
    s = Tables(spark, sf_dir).read("supplier").selectExpr("CAST(s_suppkey AS STRING) AS key", "s_suppkey")
    cached = s.where("s_suppkey % 3 < 2").selectExpr("key", "CASE WHEN s_suppkey % 3 = 0 THEN TIMESTAMP '2024-01-30 00:00:00' ELSE TIMESTAMP '2023-01-30 00:00:00' END AS fetched_at")
    return trials.pending_fetches(s.select("key"), cached, "key", F.lit("2024-02-01").cast("timestamp"), 7)


@query("m02_dual_report")
def m02(spark, sf_dir):
    attestation = Tables(spark, sf_dir).attestation
    return trials.corroboration_reports(attestation, G.origins(attestation.groupBy("id").agg(F.min("derived_from").alias("derived_from"))))


ORACLE_SQL["m02_dual_report"] = ORACLE_SQL["d08_corroboration"].replace("SELECT count(*) AS edges, count(*) FILTER (origins >= 2) AS corroborated, count(*) FILTER (attestations >= 2 AND origins < 2) AS laundered FROM", "SELECT count(*) FILTER (attestations >= 2) AS without_collapse, count(*) FILTER (origins >= 2) AS with_collapse, count(*) FILTER (origins >= 2) - count(*) FILTER (attestations >= 2) AS delta FROM")


@query("m05_strata", "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'ch_officer_appointment' WHEN 1 THEN 'commons_declared_interest' WHEN 2 THEN 'lords_declared_interest' END AS stratum FROM orders")
def m05(spark, sf_dir):
    rows = Tables(spark, sf_dir).read("orders").selectExpr("o_orderkey AS k", "CASE o_orderkey % 4 WHEN 0 THEN 'officer_of' WHEN 3 THEN 'supplier_of' ELSE 'declared_interest' END AS edge_type", "CASE o_orderkey % 4 WHEN 1 THEN array('UK House of Lords Register of Interests', 'UK Parliament Register of Interests') ELSE array('UK House of Lords Register of Interests') END AS sources")
    return rows.select("k", scoring.path_strata(F.col("edge_type"), F.col("sources")).alias("stratum"))


@query("m06_evaluated_pairs", f"""WITH RECURSIVE {PATHS}, r AS (SELECT s_suppkey AS key, 2000000000 + s_nationkey AS goal, DATE '1996-01-01' + CAST(s_suppkey % 900 AS INTEGER) AS cutoff, s_suppkey % 6 = 1 AS label_only, s_suppkey % 11 = 0 AS lost FROM supplier),
h AS (SELECT key, len(list_filter(types, lambda t: t <> 'same_as')) > 0 AND len(list_filter(list_zip(types, dates), lambda x: x[1] <> 'same_as' AND (x[2] IS NULL OR x[2] >= cutoff))) = 0 AS dated, len(list_filter(list_zip(types, dates), lambda x: x[1] <> 'same_as' AND x[2] >= cutoff)) = 0 AS open FROM r JOIN found f ON f.start = r.key AND f.goal = r.goal WHERE NOT lost),
s AS (SELECT key, bool_or(dated) AS dated, bool_or(open AND NOT dated) AS undated, count(*) AS paths FROM h GROUP BY 1)
SELECT key, CASE WHEN lost THEN 'untestable' WHEN dated THEN 'recovered' WHEN undated THEN 'undated_only' WHEN label_only THEN 'no_trace_by_design' ELSE 'not_recovered' END AS status, coalesce(paths, 0) AS paths FROM r LEFT JOIN s USING (key)""")
def m06(spark, sf_dir):
    """Each supplier (here the referrer) and its nation; every eleventh does not resolve."""
    t = Tables(spark, sf_dir)
    rows = t.read("supplier").selectExpr("s_suppkey AS key", "date_add(DATE '1996-01-01', CAST(s_suppkey % 900 AS INT)) AS cutoff", "s_suppkey % 6 = 1 AS label_only")
    goals = t.read("supplier").selectExpr("s_suppkey AS key", "CASE WHEN s_suppkey % 11 > 0 THEN 2000000000L + s_nationkey END AS found")
    return trials.evaluate_pairs(rows, goals, t.read("supplier").selectExpr("s_suppkey AS key", "CAST(s_suppkey AS BIGINT) AS person"), _paths(t))


@query("m07_recovered_split", "WITH p AS (SELECT o_custkey AS case_id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 = 1 THEN 4 WHEN o_orderkey % 3 = 0 THEN 3 WHEN o_orderkey % 3 = 1 THEN 2 ELSE 1 END AS r FROM orders) SELECT case_id, ['circular', 'unverifiable', 'instrument_limited', 'qualifying'][max(r)] AS outcome, count(*) AS paths FROM p GROUP BY 1")
def m07(spark, sf_dir):
    paths = Tables(spark, sf_dir).read("orders").selectExpr("o_custkey AS case_id", "element_at(array('clean', 'unverifiable', 'tainted'), CAST(o_orderkey % 3 AS INT) + 1) AS taint", "CASE o_orderkey % 4 WHEN 0 THEN CAST(array() AS ARRAY<STRING>) WHEN 1 THEN array('a', 'b') WHEN 2 THEN array('a', 'c') ELSE array('c') END AS strata")
    return trials.recovered_split(paths, ["a", "b"])


@query("m09_protocol", "SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'missing' ELSE 'extra' END AS violation, CAST(s_suppkey AS VARCHAR) AS company_number FROM supplier WHERE s_suppkey % 5 < 2 UNION ALL SELECT 'hops', NULL")
def m09(spark, sf_dir):
    """Also the symmetric difference to a sealed cohort."""
    s = Tables(spark, sf_dir).read("supplier").selectExpr("s_suppkey", "CAST(s_suppkey AS STRING) AS company_number")
    return trials.protocol_violations(s.where("s_suppkey % 5 > 0"), s.where("s_suppkey % 5 <> 1"), hops=3)


@query("m10_negative_rate")
def m10(spark, sf_dir):
    """The share of stride pairs, which have no direct edge, that a path of two hops joins all the same."""
    t = Tables(spark, sf_dir)
    firms, bodies = t.read("supplier").select(F.col("s_suppkey").alias("id")), t.entity.where("entity_type = 'public_body'").select("id")
    pairs = stride_pairs(firms, bodies, t.edge, 200)
    seen = _paths(t).select(F.col("start").alias("person"), F.col("goal").alias("company")).distinct().withColumn("hit", F.lit(True))
    return pairs.join(seen, ["person", "company"], "left").agg(F.count("*").alias("pairs"), F.count("hit").alias("hits"))


ORACLE_SQL["m10_negative_rate"] = ORACLE_SQL["g03_any_paths"].replace("SELECT start, goal, count(*) AS paths, min(len(edges)) AS shortest FROM found GROUP BY ALL", """, firm AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS k FROM supplier), body AS (SELECT 2000000000 + n_nationkey AS id, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation),
steps AS (SELECT i, i * 7 % (SELECT count(*) FROM firm) AS pk, i * 13 % (SELECT count(*) FROM body) AS ck FROM range(4000) r(i)), pairs AS (SELECT i, firm.id AS person, body.id AS company FROM steps JOIN firm ON firm.k = pk JOIN body ON body.k = ck ORDER BY i LIMIT 200)
SELECT count(*) AS pairs, count(*) FILTER (EXISTS (SELECT 1 FROM found WHERE start = person AND goal = company)) AS hits FROM pairs""")


@query("m11_batteries", "SELECT ['officers', 'donations', 'commons', 'lords'][c_custkey % 4 + 1] AS battery, count(*) AS total, count(*) FILTER (c_custkey % 3 > 0) AS recovered, count(*) FILTER (c_custkey % 4 < 3 AND c_custkey % 3 = 1) AS on_time, count(*) FILTER (c_custkey % 4 < 3 AND c_custkey % 3 = 2) AS off_time, count(*) FILTER (c_custkey % 4 = 3) AS untimed FROM customer GROUP BY 1")
def m11(spark, sf_dir):
    c = Tables(spark, sf_dir).read("customer")
    battery = "element_at(array('officers', 'donations', 'commons', 'lords'), CAST(c_custkey % 4 AS INT) + 1) AS battery"
    asked = c.selectExpr(battery, "c_custkey AS id", "CASE WHEN c_custkey % 4 < 3 THEN DATE '2020-01-01' END AS expected")
    found = c.where("c_custkey % 3 > 0").selectExpr(battery, "c_custkey AS id", "CASE WHEN c_custkey % 3 = 1 THEN DATE '2020-01-01' ELSE DATE '2020-02-01' END AS found")
    return trials.batteries(asked, found)


@query("m12_temporal_lift")
def m12(spark, sf_dir):
    t = Tables(spark, sf_dir)
    levels = G.edge_levels(t.edge, t.attestation, F.lit("1996-06-01").cast("date")).select(F.col("edge_type").alias("cohort"), "level")
    return controls.temporal_lift(levels, "supplier_of").select("cohort", "level", "n", "rate", F.round("delta", 9).alias("delta"))


ORACLE_SQL["m12_temporal_lift"] = ORACLE_SQL["g04_edge_level"].replace("SELECT edge_type, level, count(*) AS n FROM levels GROUP BY ALL", """SELECT cohort, level, n, rate, round(rate - max(rate) FILTER (cohort = 'supplier_of') OVER (PARTITION BY level), 9) AS delta FROM (SELECT c.edge_type AS cohort, d.level, count(levels.level) AS n, count(levels.level) / max(c.total) AS rate
 FROM (SELECT edge_type, count(*) AS total FROM levels GROUP BY 1) c CROSS JOIN (VALUES (1), (2), (3), (4)) d(level) LEFT JOIN levels ON levels.edge_type = c.edge_type AND levels.level = d.level GROUP BY 1, 2)""")


@query("m13_diagnostics", "WITH c AS (SELECT count(*) AS cases, count(*) FILTER (s_suppkey % 3 = 0) AS hits FROM supplier), n AS (SELECT count(*) AS negatives, count(*) FILTER (c_custkey % 50 = 0) AS false_hits FROM customer) SELECT cases, hits, negatives, false_hits, hits / (hits + false_hits) AS precision, hits / cases AS sensitivity, false_hits / negatives AS false_positive_rate FROM c, n")
def m13(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return trials.diagnostics(t.read("supplier").selectExpr("s_suppkey % 3 = 0 AS recovered"), t.read("customer").selectExpr("c_custkey % 50 = 0 AS recovered")).drop("false_positive_high")


@query("n02_roster", "SELECT count(*) FILTER (s_suppkey % 3 = 0) AS ingested, count(*) FILTER (s_suppkey % 3 > 0 AND s_suppkey % 2 = 0) AS failed, count(*) FILTER (s_suppkey % 3 > 0 AND s_suppkey % 2 = 1) AS missing, count(*) AS total FROM supplier")
def n02(spark, sf_dir):
    s = Tables(spark, sf_dir).read("supplier")
    return gates.pending_roster(s, s.where("s_suppkey % 3 = 0"), s.where("s_suppkey % 2 = 0"), "s_suppkey")


@query("n03_windowed_coverage", "SELECT status AS family, count(DISTINCT event_id // 2) AS covered, CASE WHEN status = 'failed' THEN count(*) ELSE 2 * count(*) END AS total, CASE WHEN status = 'failed' THEN 'window' ELSE 'all' END AS source FROM run GROUP BY 1")
def n03(spark, sf_dir):
    run = Tables(spark, sf_dir).run
    seen = run.select(F.col("status").alias("family"), F.floor(F.col("event_id") / 2).alias("reference"))
    advertised = run.groupBy(F.col("status").alias("family")).agg(F.count("*").alias("n")).select("family", F.when(F.col("family") == "failed", F.col("n")).alias("window_total"), (2 * F.col("n")).alias("total"))
    return trials.windowed_coverage(seen, advertised)


@query("n04_snapshots", "SELECT CAST(item_id AS VARCHAR) AS key, item_id % 3 = 0 AS ok, CASE item_id % 3 WHEN 1 THEN 'missing' WHEN 2 THEN 'changed' END AS reason FROM benchmark")
def n04(spark, sf_dir):
    b = Tables(spark, sf_dir).read("benchmark").selectExpr("CAST(item_id AS STRING) AS key", "item_id", "encode(text, 'utf-8') AS content")
    return gates.snapshot_integrity(b.where("item_id % 3 <> 1"), b.select("key", F.when(F.col("item_id") % 3 == 2, "0").otherwise(F.sha2("content", 256)).alias("sha256")))


@query("n06_ratio_gates", "SELECT source_id AS family, count(*) FILTER (event_id % 20 > 1) / count(*) >= 0.9 AS passed FROM run GROUP BY 1")
def n06(spark, sf_dir):
    counts = Tables(spark, sf_dir).run.groupBy(F.col("source_id").alias("family")).agg(F.count_if(F.col("event_id") % 20 > 1).alias("covered"), F.count("*").alias("total"))
    return trials.ratio_gates(counts)


def _reports(t: Tables):
    return t.read("supplier").selectExpr("concat('f', s_suppkey) AS family", "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey % 7 > 0 END AS passed", "CASE WHEN s_suppkey % 3 = 0 THEN 'old' ELSE 'c1' END AS code", "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'g1' END AS graph")


@query("n08_bound_to", "SELECT 'f' || CAST(s_suppkey AS VARCHAR) AS family, s_suppkey % 3 > 0 AND s_suppkey % 4 > 0 AS bound, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS stale FROM supplier")
def n08(spark, sf_dir):
    return trials.bound_to(_reports(Tables(spark, sf_dir)), {"code": "c1", "graph": "g1"}).select("family", "bound", F.size("stale").alias("stale"))


@query("n09_ceiling", "SELECT count(*) AS total, count(*) FILTER (s_suppkey % 10 > 0) AS reachable, count(*) FILTER (s_suppkey % 10 > 0) / count(*) AS ceiling, count(*) FILTER (s_suppkey % 10 > 0) / count(*) >= 0.9 AS can_pass FROM supplier")
def n09(spark, sf_dir):
    s = Tables(spark, sf_dir).read("supplier").select(F.col("s_suppkey").alias("id"))
    return controls.ceiling(s, s.where("id % 10 > 0"))


@query("n09_thresholds", "WITH t AS (SELECT DISTINCT count(*) AS total FROM supplier GROUP BY s_nationkey) SELECT total, recovered, round(100 * recovered / total, 1) AS pct, recovered / total >= 0.9 AS passes FROM (SELECT total, unnest(range(0, total + 1)) AS recovered FROM t)")
def n09_thresholds(spark, sf_dir):
    return controls.threshold_table(Tables(spark, sf_dir).read("supplier").groupBy("s_nationkey").agg(F.count("*").alias("total")))


@query("n09_blocked", "SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_suppkey + CASE WHEN l_partkey % 10 = 0 THEN 900000 ELSE 0 END AS VARCHAR) AS company_number, 'not in the bulk file' AS reason FROM lineitem WHERE l_partkey % 2 = 0 AND l_suppkey + CASE WHEN l_partkey % 10 = 0 THEN 900000 ELSE 0 END NOT IN (SELECT s_suppkey FROM supplier)")
def n09_blocked(spark, sf_dir):
    """Awards' stated numbers as controls against the companies there are."""
    t = Tables(spark, sf_dir)
    stated = t.read("lineitem").where("l_partkey % 2 = 0").selectExpr("l_orderkey * 10 + l_linenumber AS id", "CAST(l_suppkey + CASE WHEN l_partkey % 10 = 0 THEN 900000 ELSE 0 END AS STRING) AS company_number")
    return controls.blocked_controls(stated, t.company)


@query("n10_bound_gates", """WITH r AS (SELECT source_id, count(*) AS runs, count(*) FILTER (status = 'failed') AS failed FROM run GROUP BY 1), d AS (SELECT 'src' || CAST(i AS VARCHAR) AS stratum FROM range(25) t(i))
SELECT stratum, coalesce(runs % 3 > 0 AND failed % 4 IN (0, 1, 2), false) AS passed, CASE WHEN runs IS NULL THEN 'missing' WHEN runs % 3 = 0 THEN 'stale binding' WHEN failed % 4 = 3 THEN 'failing' END AS reason FROM d LEFT JOIN r ON stratum = source_id""")
def n10(spark, sf_dir):
    """A gate of each source, what it says and is bound to counted from the source's runs; five sources have no report."""
    passed = F.element_at(F.array(*map(F.lit, (" Yes", "TRUE", "1", "ok"))), (F.count_if(F.col("status") == "failed") % 4 + 1).cast("int"))
    report = Tables(spark, sf_dir).run.groupBy(F.col("source_id").alias("stratum")).agg(passed.alias("passed"), F.when(F.count("*") % 3 == 0, "old").otherwise("c1").alias("code"), F.lit("g1").alias("graph"), F.lit("m1").alias("manifest"))
    return controls.bound_gates(report, [f"src{i}" for i in range(25)], "c1", "g1", "m1")


@query("q01_coverage_report", """WITH c AS (SELECT s_suppkey AS k FROM supplier), f AS (SELECT k, k % 3 = 0 AS cached, k % 2 = 0 AS attempted, k IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate >= DATE '1998-06-01') AS supplies FROM c),
u AS (SELECT 'all' AS universe, * FROM f UNION ALL SELECT 'procurement_supplier', * FROM f WHERE supplies)
SELECT universe, count(*) FILTER (cached) AS ingested, count(*) FILTER (NOT cached AND attempted) AS failed, count(*) FILTER (NOT cached AND NOT attempted) AS missing, count(*) AS total, count(*) FILTER (cached) / count(*) AS share FROM u GROUP BY 1""")
def q01_coverage(spark, sf_dir):
    """Officer coverage of both universes; suppliers are those with an award of the last months."""
    t = Tables(spark, sf_dir)
    numbers = t.read("supplier").selectExpr("s_suppkey", f"{SPARK_NUMBER} AS company_number")
    suppliers = t.read("lineitem").where("l_shipdate >= DATE '1998-06-01'").selectExpr("l_suppkey AS s_suppkey").distinct().join(numbers, "s_suppkey")
    report = lambda universe: read_api.coverage_report(universe, t.entity, suppliers, numbers.where("s_suppkey % 3 = 0"), numbers.where("s_suppkey % 2 = 0"))
    return report("all").unionByName(report("procurement_supplier"))


@query("n11_families", "SELECT 'f' || CAST(i AS VARCHAR) AS family, CASE WHEN i > (SELECT count(*) FROM supplier) THEN 'missing entry' WHEN i % 3 = 0 OR i % 4 = 0 THEN 'stale binding' WHEN i % 5 = 0 THEN 'no figures' END AS reason FROM (SELECT CASE WHEN i = 0 THEN 1000000000 ELSE i END AS i FROM range(0, 10) r(i))")
def n11(spark, sf_dir):
    required = ["f1000000000", *(f"f{i}" for i in range(1, 10))]
    return trials.families_measured(_reports(Tables(spark, sf_dir)), required, {"code": "c1", "graph": "g1"}).select("family", "reason")


@query("o02_registry_problems", "SELECT s_suppkey AS k, CAST(s_suppkey % 5 = 0 AS INTEGER) + CAST(s_suppkey % 3 = 0 AS INTEGER) + CAST(s_suppkey % 7 = 0 AS INTEGER) AS problems FROM supplier")
def o02(spark, sf_dir):
    entries = Tables(spark, sf_dir).read("supplier").selectExpr("CAST(s_suppkey AS STRING) AS source_id", "CASE WHEN s_suppkey % 5 = 0 THEN 'z' ELSE 'a' END AS tier", "'open' AS redistribution", "CASE WHEN s_suppkey % 3 = 0 THEN 'ftp:x' ELSE 'https://x.invalid' END AS url", "CASE WHEN s_suppkey % 7 = 0 THEN 'soon' ELSE '7' END AS sla_days")
    return guards.registry_problems(entries).select(F.col("source_id").cast("long").alias("k"), F.size("problems").alias("problems"))


@query("o03_summary", "SELECT id, entity_type, name, scheme, registry_id FROM entity")
def o03(spark, sf_dir):
    private = Tables(spark, sf_dir).entity.withColumn("properties", F.create_map(F.lit("date_of_birth"), F.lit("secret")))
    return guards.entity_summary(private)


@query("o04_provenance", "SELECT tender_id AS subject, 'reg' AS source, 'OGL' AS licence FROM tender WHERE method = 'direct'")
def o04(spark, sf_dir):
    flags = Tables(spark, sf_dir).tender.where("method = 'direct'").select(F.col("tender_id").alias("subject"))
    return guards.with_provenance(flags, source="reg", licence="OGL").select("subject", "provenance.source", "provenance.licence")


@query("p03_extraction", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'FAILED' WHEN doc_id % 5 IN (1, 2) THEN 'TEXT_LAYER' WHEN doc_id % 5 = 3 THEN 'OCR' ELSE 'EXTRACTION_UNRELIABLE' END AS status FROM documents")
def p03(spark, sf_dir):
    prose = F.repeat(F.lit("plain words of prose "), 10)
    docs = Tables(spark, sf_dir).read("documents").select("doc_id", (F.col("doc_id") % 5).alias("m"))
    layer = F.when(F.col("m") == 0, F.lit(None)).when(F.col("m").isin(1, 2), prose).otherwise(F.lit("# $ %"))
    return docs.select("doc_id", P.extraction_outcome(layer, F.lit(1), True, F.when(F.col("m") == 3, prose))["status"].alias("status"))


#: Of every ten citations: blank, never fetched, gone, blocked, a challenge, an empty page, word for word (two), altered, of no one.
CITED = """CASE {k} % 10 WHEN 0 THEN 'SKIPPED' WHEN 1 THEN 'UNFETCHABLE' WHEN 2 THEN 'UNFETCHABLE' WHEN 3 THEN 'UNFETCHABLE' WHEN 4 THEN 'UNFETCHABLE' WHEN 5 THEN 'EXTRACTION_UNRELIABLE' WHEN 6 THEN 'VERBATIM' WHEN 7 THEN 'VERBATIM' WHEN 8 THEN 'NEAR' ELSE CASE WHEN length(quote) < 200 THEN 'EXTRACTION_UNRELIABLE' ELSE 'ABSENT' END END"""


@query("p05_citations", f"""WITH q AS (SELECT s_suppkey AS k, text AS quote FROM supplier JOIN benchmark ON item_id = s_suppkey % (SELECT count(*) FROM benchmark))
SELECT CAST(k AS VARCHAR) AS citation, {CITED.format(k='k')} AS status, CASE k % 10 WHEN 1 THEN 'not_fetched' WHEN 2 THEN 'not_found' WHEN 3 THEN 'blocked_domain' WHEN 4 THEN 'challenge_page' WHEN 5 THEN 'low_text_to_markup_ratio' WHEN 9 THEN CASE WHEN length(quote) < 200 THEN 'extracted_text_implausibly_short' END END AS detail FROM q""")
def p05_citations(spark, sf_dir):
    """Each supplier cites an item from a page of its own: the whole chain from fetch to verdict. Altered quotes have every
    seventh word left out; those of no one are cited from a page of digits."""
    t = Tables(spark, sf_dir)
    items = t.read("benchmark")
    n = items.count()
    cited = t.read("supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % n).alias("item_id")).join(items.select("item_id", "text"), "item_id")
    kind = F.col("k") % 10
    url = F.concat(F.when(kind == 3, "https://blocked.invalid/").otherwise("https://x.invalid/"), "k")
    altered = F.array_join(F.filter(F.split("text", " "), lambda w, i: i % 7 != 6), " ")
    digits = F.repeat(F.lit("0123456789 "), 1 + F.floor(F.char_length("text") / 11).cast("int"))
    body = F.when(kind == 4, "<html>are you a robot</html>").when(kind == 5, F.concat(F.lit("<html><script>"), F.repeat(F.lit("x"), 5000), F.lit("</script></html>"))).when(kind == 7, F.concat(F.lit("<html><p>before</p> <p>"), "text", F.lit("</p></html>"))).when(kind == 9, F.substring(digits, 1, F.char_length("text"))).otherwise(F.concat_ws(" ", F.lit("before"), F.when(kind == 8, altered).otherwise(F.col("text")), F.lit("after")))
    fetches = cited.where(kind != 1).select(url.alias("url"), F.when(kind == 2, 404).otherwise(200).alias("status_code"), F.lit("text/plain").alias("content_type"), F.encode(body, "UTF-8").alias("body"))
    citations = cited.select(F.col("k").alias("citation"), url.alias("url"), F.when(kind == 0, " ").otherwise(F.col("text")).alias("quote"))
    return P.citation_verdicts(citations, fetches, ["blocked.invalid"], ["are you a robot"]).select("citation", "status", "detail")


@query("p08_citation_report", "SELECT CASE WHEN item_id % 4 = 0 THEN 'SKIPPED' WHEN item_id % 4 = 1 THEN 'VERBATIM' ELSE 'ABSENT' END AS status, count(*) AS n FROM benchmark GROUP BY 1")
def p08(spark, sf_dir):
    rows = Tables(spark, sf_dir).read("benchmark").selectExpr("CASE WHEN item_id % 8 = 0 THEN ' ' ELSE 'https://x.invalid' END AS url", "CASE WHEN item_id % 8 = 4 THEN NULL ELSE text END AS quote", "text", "item_id")
    checked = P.verbatim(rows.withColumn("text", F.when(F.col("item_id") % 4 == 1, F.concat(F.lit("x "), "text")).otherwise("elsewhere")))
    return trials.citation_report(checked.select("url", "quote", "status"))


@query("p10_dispatch", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'pdf' WHEN 2 THEN 'html' ELSE 'text' END AS kind, CASE WHEN page_id % 2 = 0 THEN 'caf' || chr(233) ELSE 'ca' || chr(195) END AS text FROM pages")
def p10(spark, sf_dir):
    rows = Tables(spark, sf_dir).read("pages").selectExpr("page_id", "CASE page_id % 4 WHEN 0 THEN 'application/PDF' ELSE 'text/plain' END AS content_type", "CASE page_id % 4 WHEN 1 THEN 'https://x.invalid/a.PDF?b' ELSE 'https://x.invalid/a' END AS url", "CASE page_id % 4 WHEN 2 THEN ' <!DOCTYPE html>' ELSE 'words' END AS head", "CASE WHEN page_id % 2 = 0 THEN X'636166C3A9' ELSE X'6361C3' END AS body")
    return rows.select("page_id", P.content_kind(F.col("content_type"), F.col("url"), F.col("head")).alias("kind"), P.decoded_text(F.col("body")).alias("text"))


@query("p09_citation_text")
def p09(spark, sf_dir):
    """Text of pages for citations, without script, style and noscript; templates stay, unlike in p02."""
    return P.visible_text(Tables(spark, sf_dir).read("pages"), drop=("script", "style", "noscript"))
