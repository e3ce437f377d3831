"""Queries on registers, scoring, windows over text and the read surface, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions.scalars import normalise_name
from ledgerlight.operators import read_api, registers, scoring
from ledgerlight.operators import resolve as R
from ledgerlight.operators.sequence import placed
from ledgerlight.plans.base import query
from ledgerlight.sources.views import Tables


@query("b07_donations", """WITH d AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'Individual' WHEN 1 THEN 'Trade Union' ELSE 'Company' END AS donor_status, c.normalised_name AS n, CASE WHEN o_orderkey % 3 = 0 THEN lpad(CAST(o_custkey % 40 AS VARCHAR), 8, '0') END AS wanted, o_totalprice,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'bad' ELSE 'ok' END AS r, CAST(o_orderdate AS DATE) AS d FROM orders JOIN (SELECT normalised_name, row_number() OVER (ORDER BY company_number) - 1 AS i FROM company) c ON c.i = o_custkey % (SELECT count(*) FROM company)),
m AS (SELECT *, CASE WHEN donor_status = 'Individual' THEN NULL WHEN wanted IS NOT NULL THEN (SELECT min(company_number) FROM company WHERE company_number = wanted) ELSE (SELECT min(company_number) FROM company WHERE normalised_name = d.n HAVING count(*) = 1) END AS number FROM d)
SELECT k, CASE WHEN donor_status = 'Individual' THEN 'skipped_individual' WHEN number IS NULL THEN 'unmatched_donor' ELSE 'matched' END AS outcome, number AS company_number, CASE WHEN number IS NULL THEN 0.0 WHEN wanted IS NOT NULL THEN 1.0 ELSE 0.9 END::DOUBLE AS match_confidence,
 CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS amount_cents, CAST(CASE WHEN r IS NULL THEN d + 1 WHEN r = 'bad' THEN NULL ELSE d END AS VARCHAR) AS donated_on, coalesce(r = 'bad', false) AS invalid_received FROM m""")
def b07(spark, sf_dir):
    t = Tables(spark, sf_dir)
    numbered = placed(t.company.select("normalised_name", "company_number"), ["company_number"], F.row_number(), "place").select("normalised_name", (F.col("place") - 1).alias("i"))
    size = t.company.agg(F.count("*").alias("n"))  # one row
    donors = t.read("orders").crossJoin(F.broadcast(size)).withColumn("i", F.col("o_custkey") % F.col("n")).join(numbered, "i")
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    rows = donors.select(
        F.col("o_orderkey").alias("k"), F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'Individual' WHEN 1 THEN 'Trade Union' ELSE 'Company' END").alias("donor_status"), F.lower("normalised_name").alias("donor_name"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 40 AS STRING) END").alias("number"), F.concat(F.lit("£"), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)).alias("value"),
        F.when(F.col("o_orderkey") % 7 == 0, "").when(F.col("o_orderkey") % 11 == 0, "soon").otherwise(day).alias("received"), F.date_format(F.date_add("o_orderdate", 1), "dd/MM/yyyy").alias("accepted"))
    return registers.donations(rows, t.company).select("k", "outcome", "company_number", "match_confidence", "amount_cents", F.col("donated_on").cast("string").alias("donated_on"), "invalid_received")


@query("b14_officers", """SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_nationkey AS VARCHAR), 8, '0') || ':' || upper(c_name) ELSE CAST(c_custkey AS VARCHAR) END AS registry_id, CASE WHEN c_custkey % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence,
 CASE c_custkey % 4 WHEN 0 THEN 'serving' WHEN 1 THEN 'ended_date_unknown' ELSE 'ended' END AS status FROM customer""")
def b14(spark, sf_dir):
    rows = Tables(spark, sf_dir).read("customer").selectExpr("c_custkey AS k", "lpad(CAST(c_nationkey AS STRING), 8, '0') AS company_number", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey AS STRING) END AS officer_id", "concat('  ', c_name) AS officer_name", "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'last year' ELSE '2020-01-31' END AS resigned")
    return registers.officers(rows).select("k", "registry_id", "confidence", "status")


@query("b17_value_kind", "SELECT tender_id, CASE WHEN count(*) > 1 THEN 'shared_ceiling' ELSE 'per_supplier' END AS value_kind FROM award GROUP BY 1")
def b17(spark, sf_dir):
    """Kinds from stored documents: the number of suppliers in each one's JSON."""
    documents = Tables(spark, sf_dir).award.groupBy("tender_id").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("supplier_name").alias("name"))).alias("suppliers"))).alias("raw_json"))
    n = F.size(F.from_json("raw_json", "STRUCT<suppliers: ARRAY<STRUCT<name: STRING>>>")["suppliers"])
    return documents.select("tender_id", F.when(n > 1, "shared_ceiling").when(n >= 0, "per_supplier").alias("value_kind"))


@query("a09_hex_snapshot", "SELECT item_id, lower(hex(encode(text))) AS payload, strlen(text) AS n FROM benchmark")
def a09(spark, sf_dir):
    packed = Tables(spark, sf_dir).read("benchmark").select("item_id", F.lower(F.hex(F.encode("text", "utf-8"))).alias("payload"))
    return packed.withColumn("n", F.octet_length(F.unhex("payload")).cast("long"))


@query("c15_cohort_join", """WITH cohort AS (SELECT tender_id, min(supplier_name) AS wanted, max(value_cents) AS value FROM award GROUP BY 1), j AS (SELECT c.tender_id, a.award_id, CASE WHEN count(*) OVER (PARTITION BY c.tender_id) = 1 THEN 1 WHEN a.supplier_name = c.wanted THEN 2 WHEN a.value_cents = c.value THEN 3 END AS way FROM cohort c JOIN award a USING (tender_id)),
p AS (SELECT tender_id, arg_min(award_id, struct_pack(way := way, id := award_id)) AS award_id, min(way) AS way FROM j WHERE way IS NOT NULL GROUP BY 1) SELECT * FROM p""")
def c15(spark, sf_dir):
    award = Tables(spark, sf_dir).award
    cohort = award.groupBy("tender_id").agg(F.min("supplier_name").alias("wanted"), F.max("value_cents").alias("value"), F.count("*").alias("n"))
    way = F.when(F.col("n") == 1, 1).when(F.col("supplier_name") == F.col("wanted"), 2).when(F.col("value_cents") == F.col("value"), 3)
    return award.join(cohort, "tender_id").withColumn("way", way).where("way IS NOT NULL").groupBy("tender_id").agg(F.min_by("award_id", F.struct("way", "award_id")).alias("award_id"), F.min("way").alias("way"))


@query("c17_temporal_exists", "SELECT e.id, EXISTS (SELECT 1 FROM attestation a WHERE a.edge = e.id AND a.observed_at < DATE '1996-01-01') AS seen FROM edge e WHERE e.edge_type = 'supplier_of'")
def c17(spark, sf_dir):
    t = Tables(spark, sf_dir)
    seen = t.attestation.where("observed_at < DATE '1996-01-01'").select(F.col("edge").alias("id")).distinct().withColumn("s", F.lit(True))
    return t.edge.where("edge_type = 'supplier_of'").select("id").join(seen, "id", "left").select("id", F.coalesce("s", F.lit(False)).alias("seen"))


@query("c22_pair_scope", """WITH g AS (SELECT source, target FROM edge WHERE id % 10 = 0) SELECT e.id, (EXISTS (SELECT 1 FROM g WHERE g.source = e.source AND g.target = e.target)) AS in_scope FROM edge e""")
def c22(spark, sf_dir):
    edge = Tables(spark, sf_dir).edge
    scope = edge.where("id % 10 = 0").select("source", "target").distinct().withColumn("s", F.lit(True))
    return edge.join(scope, ["source", "target"], "left").select("id", F.coalesce("s", F.lit(False)).alias("in_scope"))


@query("c20_golden", """SELECT 10 * k AS g, 10 * k + 1 AS edge, 'registry_id' AS method, CASE WHEN k % 3 = 0 THEN 'match' WHEN k % 3 = 1 THEN 'null_date' ELSE 'miss' END AS temporal FROM (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 0)""")
def c20(spark, sf_dir):
    ends = ["concat('S', s_suppkey) AS source_name", "'A' AS source_scheme", "CAST(s_suppkey AS STRING) AS source_registry_id", "s_name AS target_name", "'B' AS target_scheme", "CAST(s_suppkey AS STRING) AS target_registry_id"]
    supplier = Tables(spark, sf_dir).read("supplier")
    golden = supplier.where("s_suppkey % 2 = 0").selectExpr("10 * s_suppkey AS id", "'supplier_of' AS edge_type", *ends, "DATE '2020-01-01' AS valid_from")
    edge = supplier.selectExpr("10 * s_suppkey + 1 AS id", "'supplier_of' AS edge_type", *ends, "CASE s_suppkey % 3 WHEN 0 THEN DATE '2020-01-20' WHEN 2 THEN DATE '2021-01-01' END AS valid_from")
    return scoring.golden_matches(golden, edge)


CASES = "SELECT o_custkey AS case_id, CASE o_orderkey % 5 WHEN 0 THEN 'no_trace_by_design' WHEN 1 THEN 'untestable' WHEN 2 THEN 'not_recovered' WHEN 3 THEN 'undated_only' ELSE 'recovered' END AS status, o_orderkey % 5 AS p, CAST(o_orderdate AS DATE) AS award_date FROM orders"


@query("d17_case_rollup", f"SELECT case_id, arg_max(status, p) AS status, count(*) AS n_rows, count(DISTINCT award_date) AS n_awards, CAST(min(award_date) AS VARCHAR) AS earliest FROM ({CASES}) GROUP BY 1")
def d17(spark, sf_dir):
    rows = Tables(spark, sf_dir).read("orders").selectExpr("o_custkey AS case_id", "element_at(array('no_trace_by_design', 'untestable', 'not_recovered', 'undated_only', 'recovered'), CAST(o_orderkey % 5 AS INT) + 1) AS status", "CAST(o_orderdate AS DATE) AS award_date")
    return scoring.case_status(rows, "case_id")


@query("d18_case_groups", "SELECT supplier_name, count(*) AS n_rows, count(DISTINCT award_date) AS dates, CAST(min(award_date) AS VARCHAR) AS earliest FROM award GROUP BY 1")
def d18(spark, sf_dir):
    return Tables(spark, sf_dir).award.groupBy("supplier_name").agg(F.count("*").alias("n_rows"), F.count_distinct("award_date").alias("dates"), F.min("award_date").cast("string").alias("earliest"))


@query("d21_fisher", """WITH t AS (SELECT buyer_nation AS key, count(*) FILTER (method = 'direct' AND source_id = 'ua_prozorro') AS a, count(*) FILTER (method <> 'direct' AND source_id = 'ua_prozorro') AS b, count(*) FILTER (method = 'direct' AND source_id <> 'ua_prozorro') AS c, count(*) FILTER (method <> 'direct' AND source_id <> 'ua_prozorro') AS d FROM tender GROUP BY 1),
k AS (SELECT *, unnest(range(greatest(0, 2 * a + b + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS x FROM t),
w AS (SELECT *, exp(lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(c + d - a - c + x + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) AS p FROM k),
s AS (SELECT key, x, p, first_value(p) OVER (PARTITION BY key ORDER BY x = a DESC) AS seen, a, b, c, d FROM w)
SELECT key, a, b, c, d, round(least(1.0, sum(p) FILTER (x = a OR p <= seen * (1 + 1e-9))), 6) AS p FROM s GROUP BY ALL""")
def d21(spark, sf_dir):
    t = Tables(spark, sf_dir).tender.groupBy("buyer_nation").agg(F.count_if((F.col("method") == "direct") & (F.col("source_id") == "ua_prozorro")).alias("a"), F.count_if((F.col("method") != "direct") & (F.col("source_id") == "ua_prozorro")).alias("b"), F.count_if((F.col("method") == "direct") & (F.col("source_id") != "ua_prozorro")).alias("c"), F.count_if((F.col("method") != "direct") & (F.col("source_id") != "ua_prozorro")).alias("d"))
    return scoring.fisher(t.withColumnRenamed("buyer_nation", "key")).withColumn("p", F.round("p", 6))


@query("d22_discrimination", """WITH r AS (SELECT source_id, method = 'direct' AS f, value_cents > 15000000 AS g FROM tender), u AS (SELECT source_id, 'direct' AS indicator, f AS hit FROM r UNION ALL SELECT source_id, 'large', g FROM r), c AS (SELECT source_id = 'ua_prozorro' AS vip, indicator, count(*) AS n, count(*) FILTER (hit) AS flags FROM u GROUP BY ALL)
SELECT a.indicator, a.n AS vip_n, b.n AS control_n, a.flags / a.n AS vip_rate, b.flags / b.n AS control_rate, a.flags / a.n - b.flags / b.n AS separation FROM c a JOIN c b USING (indicator) WHERE a.vip AND NOT b.vip""")
def d22(spark, sf_dir):
    r = Tables(spark, sf_dir).tender.select((F.col("source_id") == "ua_prozorro").alias("vip"), (F.col("method") == "direct").alias("direct"), (F.col("value_cents") > 15_000_000).alias("large"))
    long = r.unpivot(["vip"], ["direct", "large"], "indicator", "hit").groupBy("indicator").agg(*(F.count_if(F.col("vip") == v).alias(f"{k}_n") for k, v in (("vip", True), ("control", False))), *(F.count_if((F.col("vip") == v) & F.col("hit")).alias(f"{k}_f") for k, v in (("vip", True), ("control", False))))
    rate = lambda k: F.col(f"{k}_f") / F.col(f"{k}_n")
    return long.select("indicator", "vip_n", "control_n", rate("vip").alias("vip_rate"), rate("control").alias("control_rate"), (rate("vip") - rate("control")).alias("separation"))


@query("e06_sentence_windows", """WITH s AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1\x01', 'g'), '\x01'), lambda x: trim(x)), lambda x: x <> '') AS s FROM benchmark), w AS (SELECT item_id, unnest([1, 2, 3]) AS n, s FROM s)
SELECT item_id, n, array_to_string(s[i:i + n - 1], ' ') AS run FROM (SELECT *, unnest(range(1, len(s) - n + 2)) AS i FROM w)""")
def e06(spark, sf_dir):
    parts = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    runs = Tables(spark, sf_dir).read("benchmark").select("item_id", parts.alias("s"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n")).where(F.size("s") >= F.col("n"))
    return runs.select("item_id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("s") - F.col("n") + 1), lambda i: F.array_join(F.slice("s", i, F.col("n")), " "))).alias("run"))


@query("e07_char_windows", "SELECT item_id, substring(text, i, 40) AS w FROM (SELECT item_id, text, unnest(range(1, greatest(length(text) - 40 + 2, 2), 10)) AS i FROM benchmark)")
def e07(spark, sf_dir):
    last = F.greatest(F.char_length("text") - 39, F.lit(1))
    return Tables(spark, sf_dir).read("benchmark").select("item_id", F.explode(F.transform(F.sequence(F.lit(1), last, F.lit(10)), lambda i: F.substring("text", i, F.lit(40)))).alias("w"))


@query("e10_supplier_ranking", "WITH r AS (SELECT supplier_name, count(DISTINCT value_kind) AS kinds, count(*) AS awards, max(value_cents) AS largest FROM award GROUP BY 1) SELECT *, rank() OVER (ORDER BY kinds DESC, awards DESC) AS rank FROM r")
def e10(spark, sf_dir):
    r = Tables(spark, sf_dir).award.groupBy("supplier_name").agg(F.count_distinct("value_kind").alias("kinds"), F.count("*").alias("awards"), F.max("value_cents").alias("largest"))
    return placed(r, [F.desc("kinds"), F.desc("awards")], F.rank(), "rank").withColumn("rank", F.col("rank").cast("long"))


def _flags(t: Tables):
    direct = t.tender.where("method = 'direct'").select(F.lit("direct").alias("indicator"), "source_id", "tender_id", "value_cents")
    limited = t.tender.where("method IN ('limited', 'direct') AND value_cents > 10000000").select(F.lit("limited").alias("indicator"), "source_id", "tender_id", "value_cents")
    return direct.unionByName(limited).select("indicator", F.col("source_id").alias("jurisdiction"), F.col("tender_id").alias("subject"), "value_cents", F.lit(100).alias("length"), F.lit(True).alias("has_url"))


SCORES = """f AS (SELECT 'direct' AS indicator, source_id AS jurisdiction, tender_id AS subject, value_cents FROM tender WHERE method = 'direct' UNION ALL SELECT 'limited', source_id, tender_id, value_cents FROM tender WHERE method IN ('limited', 'direct') AND value_cents > 10000000),
n AS (SELECT *, count(*) OVER (PARTITION BY indicator) AS i, count(*) OVER (PARTITION BY jurisdiction) AS j, count(*) OVER () AS t FROM f), k AS (SELECT subject, count(DISTINCT indicator) AS kinds FROM f GROUP BY 1),
scored AS (SELECT indicator, jurisdiction, subject, round(((1 - i / t) + (1 - j / t)) * 3 + CASE WHEN value_cents > 0 THEN log10(value_cents) ELSE 0 END * 2 + 0.5 + CASE WHEN kinds >= 2 THEN 4 ELSE 0 END + 1, 6) AS score FROM n JOIN k USING (subject))"""


@query("h31_score", f"WITH {SCORES} SELECT * FROM scored")
def h31(spark, sf_dir):
    return scoring.flag_scores(_flags(Tables(spark, sf_dir))).select("indicator", "jurisdiction", "subject", F.round("score", 6).alias("score"))


@query("f01_curated", f"""WITH RECURSIVE {SCORES}, o AS (SELECT *, row_number() OVER (ORDER BY score DESC, subject, indicator, jurisdiction) AS pos, row_number() OVER (PARTITION BY indicator, jurisdiction ORDER BY score DESC, subject) AS place FROM scored),
pick(k, taken, subjects, inds, places) AS (SELECT count(*), list(pos), list(subject), list(indicator), list(jurisdiction) FROM (SELECT * FROM o WHERE place = 1 ORDER BY pos LIMIT 10)
 UNION ALL SELECT k + 1, list_append(taken, b.pos), list_append(subjects, b.subject), list_append(inds, b.indicator), list_append(places, b.jurisdiction) FROM (SELECT k, taken, subjects, inds, places, arg_min(struct_pack(pos := pos, subject := subject, indicator := indicator, jurisdiction := jurisdiction), pos) AS b
  FROM pick JOIN o ON k < 10 AND NOT list_contains(subjects, subject) AND len(list_filter(inds, lambda x: x = indicator)) < 4 AND len(list_filter(places, lambda x: x = jurisdiction)) < 5 GROUP BY ALL))
SELECT indicator, jurisdiction, subject, score FROM o WHERE pos IN (SELECT unnest(taken) FROM pick)""")
def f01(spark, sf_dir):
    scored = scoring.flag_scores(_flags(Tables(spark, sf_dir))).select("indicator", "jurisdiction", "subject", F.round("score", 6).alias("score"))
    return spark.createDataFrame([tuple(r[c] for c in scored.columns) for r in scoring.curated(scored, 10)], scored.schema)


@query("f09_union_dedup", "SELECT id, min(way) AS way FROM (SELECT id, 0 AS way FROM entity WHERE lower(registry_id) = '00000003' UNION ALL SELECT id, 1 FROM entity WHERE contains(lower(name), 'supplier#00000000')) GROUP BY 1")
def f09(spark, sf_dir):
    e = Tables(spark, sf_dir).entity
    both = e.where(F.lower("registry_id") == "00000003").select("id", F.lit(0).alias("way")).union(e.where(F.contains(F.lower("name"), F.lit("supplier#00000000"))).select("id", F.lit(1)))
    return both.groupBy("id").agg(F.min("way").alias("way"))


@query("g13_export", "SELECT CAST(id AS VARCHAR) AS id, CASE entity_type WHEN 'company' THEN 'Company' WHEN 'person' THEN 'Person' ELSE 'PublicBody' END AS schema, name, coalesce(registry_id, '') AS number FROM entity")
def g13(spark, sf_dir):
    e = Tables(spark, sf_dir).entity
    exported = e.select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.when(F.col("entity_type") == "company", "Company").when(F.col("entity_type") == "person", "Person").otherwise("PublicBody").alias("schema"), F.struct(F.array("name").alias("name"), F.when(F.col("registry_id").isNotNull(), F.array("registry_id")).alias("registrationNumber")).alias("properties"))).alias("j"))
    back = F.from_json("j", "STRUCT<id: STRING, schema: STRING, properties: STRUCT<name: ARRAY<STRING>, registrationNumber: ARRAY<STRING>>>")
    return exported.select(back.alias("b")).select("b.id", "b.schema", F.col("b.properties.name")[0].alias("name"), F.coalesce(F.try_element_at("b.properties.registrationNumber", F.lit(1)), F.lit("")).alias("number"))


@query("h09_wayback_time", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour FROM events")
def h09(spark, sf_dir):
    stamps = Tables(spark, sf_dir).read("events").select("event_id", F.date_format("ts", "yyyyMMddHHmmss").alias("stamp")).withColumn("short", F.substring("stamp", 1, 10))
    return stamps.select("event_id", "stamp", F.date_format(registers.wayback_time("short"), "yyyy-MM-dd HH:mm:ss").alias("hour"))


@query("h27_scoped_id", "SELECT c_custkey AS k, left(c_mktsegment, 64) || ':' || left(sha256(upper(c_name)), 32) AS scoped FROM customer")
def h27(spark, sf_dir):
    return Tables(spark, sf_dir).read("customer").select(F.col("c_custkey").alias("k"), F.concat(F.substring("c_mktsegment", 1, 64), F.lit(":"), F.substring(F.sha2(normalise_name(F.col("c_name")), 256), 1, 32)).alias("scoped"))


@query("l16_unresolved_share", "WITH n AS (SELECT DISTINCT supplier_name FROM award), r AS (SELECT DISTINCT supplier_name FROM award JOIN resolution USING (award_id) WHERE match_confidence > 0) SELECT count(*) AS names, count(*) FILTER (supplier_name NOT IN (SELECT supplier_name FROM r)) AS unresolved, round(100.0::DOUBLE * count(*) FILTER (supplier_name NOT IN (SELECT supplier_name FROM r)) / count(*), 1) AS share FROM n")
def l16(spark, sf_dir):
    t = Tables(spark, sf_dir)
    names = t.award.select("supplier_name").distinct()
    good = R.resolve_awards(t.award, t.company).where("match_confidence > 0").join(t.award.select("award_id", "supplier_name"), "award_id").select(F.col("supplier_name").alias("s")).distinct()
    joined = names.join(good, F.col("supplier_name").eqNullSafe(F.col("s")), "left")
    counts = joined.agg(F.count("*").alias("names"), F.count_if(F.col("s").isNull()).alias("unresolved"))
    return counts.withColumn("share", F.round(100.0 * F.col("unresolved") / F.nullif("names", F.lit(0)), 1))


@query("m03_manifest", """SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 THEN 'inadmissible' WHEN o_orderkey % 3 = 0 OR o_orderkey % 13 = 0 THEN 'out_of_scope' ELSE 'admissible' END AS verdict,
 CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_reasons FROM orders""")
def m03(spark, sf_dir):
    rows = Tables(spark, sf_dir).read("orders").selectExpr(
        "o_orderkey AS seq", "concat('c', o_orderkey) AS case_id", "'00000001' AS company_number", "CASE WHEN o_orderkey % 7 = 0 THEN 'maybe' ELSE 'Yes' END AS awardee_confirmed", "'u' AS label_source_url", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS award_date",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE '1990-01-01' END AS relationship_start", "CASE WHEN o_orderkey % 11 = 0 THEN 'friend' ELSE 'Donation' END AS relationship_type", "CASE WHEN o_orderkey % 3 = 0 THEN 'no' ELSE 'yes' END AS held_office_at_award",
        "'1989-01-01' AS office_holding_start_date", "CASE WHEN o_orderkey % 13 = 0 THEN '1990-01-01' ELSE '' END AS office_holding_end_date")
    return scoring.manifest(rows).select("seq", "verdict", F.size("reasons").alias("n_reasons"))


@query("q01_resolve_entity", "SELECT id, entity_type, name, 1 AS way FROM entity WHERE contains(lower(name), 'customer#00000001') ORDER BY id LIMIT 20")
def q01(spark, sf_dir):
    e = Tables(spark, sf_dir).entity
    return read_api.resolve_entity(e, e.where("false").select("id", F.col("name").alias("alias")), "customer#00000001").select("id", "entity_type", "name", "way")


@query("q02_review_page", "SELECT tender_id AS subject FROM tender WHERE method = 'direct' ORDER BY tender_id LIMIT 50 OFFSET 50")
def q02(spark, sf_dir):
    flags = Tables(spark, sf_dir).tender.select(F.col("tender_id").alias("subject"), "method")
    return read_api.list_flags(flags, page=2, method="direct").select("subject")
