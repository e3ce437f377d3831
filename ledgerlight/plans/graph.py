"""Graph, gate and freshness queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlight.operators import gates as N
from ledgerlight.operators import graph as G
from ledgerlight.operators.freshness import freshness
from ledgerlight.operators.aggregates import attested_only_by, coverage_tiers, zero_filled
from ledgerlight.plans.base import query
from ledgerlight.sources.views import Tables

PATHS = """adj AS (SELECT source AS node, target AS other, id AS edge, edge_type, valid_from FROM edge UNION ALL SELECT target, source, id, edge_type, valid_from FROM edge WHERE source <> target),
p(start, node, nodes, edges, types, dates, spent) AS (SELECT id, id, [id], []::BIGINT[], []::VARCHAR[], []::DATE[], 0 FROM entity WHERE entity_type = 'company'
 UNION ALL SELECT p.start, a.other, list_append(p.nodes, a.other), list_append(p.edges, a.edge), list_append(p.types, a.edge_type), list_append(p.dates, a.valid_from), p.spent + CASE WHEN a.edge_type = 'same_as' THEN 0 ELSE 1 END
 FROM p JOIN adj a ON a.node = p.node WHERE p.spent < 2 AND NOT list_contains(p.nodes, a.other) AND p.node < 2000000000),
found AS (SELECT start, node AS goal, edges, types, dates FROM p WHERE node >= 2000000000)"""


def _paths(t: Tables, edge=None, *carry: str):
    """From every company to every public body, whose ids are those from 2,000,000,000 on. edge: t.edge with columns to carry."""
    of = lambda kind, name: t.entity.where(F.col("entity_type") == kind).select(F.col("id").alias(name))
    return G.bounded_paths(t.edge if edge is None else edge, of("company", "start"), of("public_body", "goal"), 2, carry)


@query("g01_adjacency", "SELECT node, CAST(count(*) AS BIGINT) AS degree, CAST(sum(edge % 1000) AS BIGINT) AS check_sum FROM (SELECT source AS node, id AS edge FROM edge UNION ALL SELECT target, id FROM edge WHERE source <> target) GROUP BY node")
def g01(spark, sf_dir):
    return G.adjacency(Tables(spark, sf_dir).edge).groupBy("node").agg(F.count("*").alias("degree"), F.sum(F.col("edge") % 1000).alias("check_sum"))


@query("g02_paths", f"""WITH RECURSIVE {PATHS}
SELECT start, goal, array_to_string(edges, ',') AS path, len(list_filter(types, lambda t: t <> 'same_as')) > 0 AND len(list_filter(list_zip(types, dates), lambda x: x[1] <> 'same_as' AND (x[2] IS NULL OR x[2] >= DATE '1997-01-01'))) = 0 AS pre_award FROM found""")
def g02(spark, sf_dir):
    cutoff = F.lit("1997-01-01").cast("date")
    return _paths(Tables(spark, sf_dir)).select("start", "goal", F.array_join(F.transform("edges", lambda e: e["edge"].cast("string")), ",").alias("path"), G.is_pre_award(F.col("edges"), cutoff).alias("pre_award"))


LEVELS = "levels AS (SELECT e.id AS edge, edge_type, CASE WHEN valid_from <= DATE '1996-06-01' THEN 1 WHEN first_seen < DATE '1996-06-01' THEN 2 ELSE 3 END AS level FROM edge e LEFT JOIN (SELECT edge, min(observed_at) AS first_seen FROM attestation GROUP BY 1) a ON a.edge = e.id)"


@query("g04_edge_level", f"WITH {LEVELS} SELECT edge_type, level, count(*) AS n FROM levels GROUP BY ALL")
def g04(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.edge_levels(t.edge, t.attestation, F.lit("1996-06-01").cast("date")).groupBy("edge_type", "level").agg(F.count("*").alias("n"))


PATH_LEVELS = f"""WITH RECURSIVE {PATHS}, {LEVELS}, u AS (SELECT start, goal, array_to_string(edges, ',') AS path, unnest(edges) AS edge FROM found),
pl AS (SELECT start, goal, path, max(CASE WHEN edge_type <> 'same_as' THEN level END) AS level FROM u JOIN levels USING (edge) GROUP BY ALL)"""


def _leveled(t: Tables):
    """The paths with their levels. Edges that share an id, as they may in tables of millions of customers, share the worst of their levels."""
    edge = G.with_levels(t.edge, t.attestation, F.lit("1996-06-01").cast("date"))
    worst = F.max(F.when(F.col("edge_type") != "same_as", F.col("level"))).over(Window.partitionBy("id"))
    return G.path_levels(_paths(t, edge.withColumn("level", worst), "level"))


@query("g05_path_level", f"{PATH_LEVELS} SELECT level, count(*) AS n FROM pl GROUP BY ALL")
def g05(spark, sf_dir):
    return _leveled(Tables(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("n"))


@query("g06_relationship_level", f"""{PATH_LEVELS}, pairs AS (SELECT CAST(s_suppkey AS BIGINT) AS start, 2000000000 + s_nationkey AS goal FROM supplier),
b AS (SELECT start, goal, min(level) AS best, count(*) AS paths FROM pl GROUP BY ALL)
SELECT start, goal, CASE WHEN paths IS NULL THEN 4 ELSE best END AS level, coalesce(paths, 0) AS paths FROM pairs LEFT JOIN b USING (start, goal)""")
def g06(spark, sf_dir):
    """Each supplier's relationship with its own nation."""
    t = Tables(spark, sf_dir)
    return G.relationship_levels(t.read("supplier").selectExpr("s_suppkey AS start", "2000000000L + s_nationkey AS goal"), _leveled(t))


@query("g07_identity_confidence", f"""WITH RECURSIVE {PATHS}, u AS (SELECT start, goal, array_to_string(edges, ',') AS path, unnest(CASE WHEN list_contains(types, 'same_as') THEN list_transform(list_filter(list_zip(edges, types), lambda x: x[2] = 'same_as'), lambda x: x[1]) ELSE [NULL] END) AS edge FROM found),
k AS (SELECT edge, min(match_confidence) AS least FROM attestation GROUP BY 1)
SELECT start, goal, path, CASE WHEN NOT bool_or(least IS NULL) THEN min(least) END AS confidence FROM u LEFT JOIN k USING (edge) GROUP BY ALL""")
def g07(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.identity_confidence(_paths(t, G.with_least(t.edge, t.attestation), "least")).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ","))


ORIGINS = """walk(id, here, parent, seen) AS (SELECT a.id, a.id, p.id, []::BIGINT[] FROM att a LEFT JOIN att p ON p.id = a.derived_from
 UNION ALL SELECT w.id, w.parent, n.pid, list_append(w.seen, w.parent) FROM walk w JOIN (SELECT a.id, p.id AS pid FROM att a LEFT JOIN att p ON p.id = a.derived_from) n ON n.id = w.parent WHERE w.parent IS NOT NULL AND NOT list_contains(w.seen, w.parent)),
traced AS (SELECT id, here AS origin FROM walk WHERE parent IS NULL OR list_contains(seen, parent))"""


@query("g08_origins", f"WITH RECURSIVE att AS (SELECT id, min(derived_from) AS derived_from FROM attestation GROUP BY 1), {ORIGINS} SELECT id, origin FROM traced")
def g08(spark, sf_dir):
    one = Tables(spark, sf_dir).attestation.groupBy("id").agg(F.min("derived_from").alias("derived_from"))
    return G.origins(one)


@query("d08_corroboration", f"""WITH RECURSIVE att AS (SELECT id, min(derived_from) AS derived_from FROM attestation GROUP BY 1), {ORIGINS}
SELECT count(*) AS edges, count(*) FILTER (origins >= 2) AS corroborated, count(*) FILTER (attestations >= 2 AND origins < 2) AS laundered FROM (SELECT edge, count(*) AS attestations, count(DISTINCT origin) AS origins FROM attestation JOIN traced USING (id) GROUP BY 1)""")
def d08(spark, sf_dir):
    attestation = Tables(spark, sf_dir).attestation
    traced = G.origins(attestation.groupBy("id").agg(F.min("derived_from").alias("derived_from")))
    return G.corroboration(attestation, traced).agg(F.count("*").alias("edges"), F.count_if(F.col("origins") >= 2).alias("corroborated"), F.count_if((F.col("attestations") >= 2) & (F.col("origins") < 2)).alias("laundered"))


@query("d09_attested_only_by", "SELECT edge, count(*) AS n FROM attestation GROUP BY edge HAVING bool_and(source_name = 'Register B')")
def d09(spark, sf_dir):
    return attested_only_by(Tables(spark, sf_dir).attestation, "Register B")


@query("d06_degree_by_type", "SELECT edge_type, count(*) AS n FROM edge WHERE source = 1000000005 OR target = 1000000005 GROUP BY 1")
def d06(spark, sf_dir):
    return G.neighbours_by_type(Tables(spark, sf_dir).edge, 1_000_000_005)


@query("d07_coverage_tiers", """WITH u AS (SELECT company_number AS k FROM company), t AS (SELECT CASE WHEN k IN (SELECT registry_id FROM entity e JOIN edge g ON g.source = e.id WHERE entity_type = 'company') THEN 'with_edge'
 WHEN k IN (SELECT registry_id FROM entity WHERE entity_type = 'company') THEN 'entity_only' ELSE 'none' END AS tier FROM u)
SELECT d.tier, count(t.tier) AS n FROM (VALUES ('with_edge'), ('entity_only'), ('none')) d(tier) LEFT JOIN t USING (tier) GROUP BY 1""")
def d07(spark, sf_dir):
    t = Tables(spark, sf_dir)
    entity = t.entity.where("entity_type = 'company'").select("id", F.col("registry_id").alias("company_number"))
    linked = entity.join(t.edge.select(F.col("source").alias("id")).distinct(), "id", "left_semi")
    return coverage_tiers(t.company, "company_number", with_edge=linked, entity_only=entity)


@query("d16_zero_filled", f"WITH {LEVELS} SELECT d.level, count(levels.level) AS n FROM (VALUES (1), (2), (3), (4)) d(level) LEFT JOIN levels USING (level) GROUP BY 1")
def d16(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return zero_filled(G.edge_levels(t.edge, t.attestation, F.lit("1996-06-01").cast("date")), "level", [1, 2, 3, 4])


@query("c16_asof_capture", """SELECT CAST(o_custkey AS BIGINT) AS k, o_orderkey AS event, (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem JOIN orders o2 ON l_orderkey = o2.o_orderkey WHERE o2.o_custkey = o.o_custkey AND CAST(l_shipdate AS DATE) < CAST(o.o_orderdate AS DATE)) AS before FROM orders o""")
def c16(spark, sf_dir):
    t = Tables(spark, sf_dir)
    orders = t.read("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("event"), F.col("o_orderdate").cast("date").alias("at"))
    captures = t.read("lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_shipdate").cast("date").alias("captured")).join(orders.select("k", "event"), "event").select("k", "captured")
    return G.latest_before(captures, orders, "k").select("k", "event", "before")


TAINT = """u AS (SELECT start, goal, array_to_string(edges, ',') AS path, unnest(edges) AS edge FROM found), h AS (SELECT edge, bool_or(contains(lower(source_name), 'register b') OR contains('register b', lower(source_name))) AS hit FROM attestation GROUP BY 1),
t AS (SELECT start, goal, path, CASE WHEN bool_or(coalesce(hit, false)) THEN 'tainted' WHEN bool_or(hit IS NULL) THEN 'unverifiable' ELSE 'clean' END AS taint FROM u LEFT JOIN h USING (edge) GROUP BY ALL)"""


@query("m04_taint", f"WITH RECURSIVE {PATHS}, {TAINT} SELECT start, goal, CASE WHEN bool_or(taint = 'clean') THEN 'ok' WHEN bool_or(taint = 'unverifiable') THEN 'cannot_verify' ELSE 'violation' END AS separation FROM t GROUP BY ALL")
def m04(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return N.separation(N.taint(_paths(t), t.attestation, ["Register B"]))


@query("g10_lead_scan", f"""WITH RECURSIVE {PATHS}, f2 AS (SELECT goal, start AS member, types, dates FROM found),
cand AS (SELECT n_nationkey + 2000000000 AS company, n_name AS key, CASE WHEN n_nationkey % 4 <> 0 THEN DATE '1996-01-01' + CAST(n_nationkey * 30 AS INTEGER) END AS award_date FROM nation UNION ALL SELECT NULL, 'nobody', DATE '1996-01-01'),
e AS (SELECT goal, count(*) AS n_paths, bool_or(coalesce(award_date IS NOT NULL AND len(list_filter(types, lambda t: t <> 'same_as')) > 0 AND len(list_filter(list_zip(types, dates), lambda x: x[1] <> 'same_as' AND (x[2] IS NULL OR x[2] >= award_date))) = 0, false)) AS pre,
 bool_or(len(list_filter(types, lambda t: t <> 'same_as')) > 0 AND len(list_filter(list_zip(types, dates), lambda x: x[1] <> 'same_as' AND x[2] IS NULL)) = 0) AS dated, bool_or(award_date IS NULL) AS no_date FROM f2 JOIN cand ON cand.company = f2.goal GROUP BY 1)
SELECT key, company, CASE WHEN company IS NULL THEN 'unresolved' WHEN n_paths IS NULL THEN 'no_path' WHEN no_date THEN 'path_no_award_date' WHEN pre THEN 'pre_award' WHEN dated THEN 'dated_post_award' ELSE 'undated_only' END AS status, coalesce(n_paths, 0) AS n_paths FROM cand LEFT JOIN e ON goal = company""")
def g10(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cand = t.read("nation").selectExpr("2000000000L + n_nationkey AS company", "n_name AS key", "CASE WHEN n_nationkey % 4 <> 0 THEN date_add(DATE '1996-01-01', n_nationkey * 30) END AS award_date")
    cand = cand.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS company, 'nobody' AS key, DATE '1996-01-01' AS award_date"))
    return G.classify_leads(t.entity, cand, _paths(t))


@query("j01_freshness", """WITH sla AS (SELECT 'src' || CAST(i AS VARCHAR) AS source_id, i % 5 + 1 AS sla_days FROM range(22) r(i)), s AS (SELECT source_id, max(finished_at) FILTER (status = 'success') AS last, count(*) AS runs FROM run GROUP BY 1),
d AS (SELECT *, floor(epoch(TIMESTAMP '2024-02-02') - epoch(last)) / 86400 AS days FROM sla LEFT JOIN s USING (source_id)),
l AS (SELECT *, CASE WHEN runs IS NULL THEN 'unknown' WHEN last IS NULL THEN 'critical' WHEN days <= sla_days THEN 'fresh' WHEN days <= 2 * sla_days THEN 'stale' ELSE 'critical' END AS label FROM d)
SELECT source_id, sla_days, label, label <> 'fresh' AS due, label IN ('stale', 'critical') AS overdue FROM l""")
def j01(spark, sf_dir):
    sla = spark.range(22).selectExpr("concat('src', id) AS source_id", "id % 5 + 1 AS sla_days")
    return freshness(sla, Tables(spark, sf_dir).run, F.expr("TIMESTAMP_NTZ '2024-02-02 00:00:00'")).drop("days")


@query("n01_coverage", "SELECT status AS family, count(*) - count(*) FILTER (event_id % 7 = 0) - count(*) FILTER (event_id % 7 = 1) AS ingested, count(*) FILTER (event_id % 7 = 0) AS failed, count(*) FILTER (event_id % 7 = 1) AS missing, count(*) AS total, count(*) - count(*) FILTER (event_id % 7 = 1) AS accounted, count(*) FILTER (event_id % 7 = 1) = 0 AS passed FROM run GROUP BY 1")
def n01(spark, sf_dir):
    k = F.col("event_id") % 7
    counts = Tables(spark, sf_dir).run.groupBy(F.col("status").alias("family")).agg(F.count_if(k > 1).alias("ingested"), F.count_if(k == 0).alias("failed"), F.count_if(k == 1).alias("missing"), F.count("*").alias("total"))
    return N.coverage(counts)


@query("n05_stratum", """WITH b AS (SELECT source_id AS stratum, count(*) FILTER (status = 'success') * 4 AS recovered, count(*) AS total FROM run GROUP BY 1)
SELECT stratum, recovered, total, total >= 12 AND recovered <= total AS available, CASE WHEN total >= 12 AND recovered <= total THEN recovered / total END AS rate, coalesce(CASE WHEN total >= 12 AND recovered <= total THEN recovered / total END >= 0.9, false) AS passed FROM b""")
def n05(spark, sf_dir):
    b = Tables(spark, sf_dir).run.groupBy(F.col("source_id").alias("stratum")).agg((F.count_if(F.col("status") == "success") * 4).alias("recovered"), F.count("*").alias("total"))
    return N.stratum(b)


@query("n07_blockers", """WITH m AS (SELECT source_id AS family, count(*) > 400 AS measured, count(*) FILTER (status = 'failed') < 95 AS passed FROM run GROUP BY 1), d AS (SELECT 'src' || CAST(i AS VARCHAR) AS family FROM range(25) r(i))
SELECT family, CASE WHEN measured IS NULL THEN 'missing' WHEN NOT measured THEN 'unmeasured' ELSE 'failing' END AS reason FROM d LEFT JOIN m USING (family) WHERE measured IS NULL OR NOT measured OR NOT passed""")
def n07(spark, sf_dir):
    m = Tables(spark, sf_dir).run.groupBy(F.col("source_id").alias("family")).agg((F.count("*") > 400).alias("measured"), (F.count_if(F.col("status") == "failed") < 95).alias("passed"))
    return N.blockers(m, [f"src{i}" for i in range(25)])


@query("m08_verdict", """WITH c AS (SELECT o_custkey AS k, CASE WHEN count(*) % 11 = 0 THEN 19 ELSE 20 END AS total, count(*) FILTER (o_orderstatus = 'F') % 6 AS recovered, count(*) FILTER (o_orderpriority = '1-URGENT') % 4 AS untestable, count(*) FILTER (o_orderstatus = 'P') % 2 AS no_trace,
 CASE WHEN count(*) % 13 = 0 THEN NULL ELSE count(*) % 5 <> 0 END AS covered, count(*) FILTER (o_orderpriority = '5-LOW') % 4 <> 0 AS any_stratum, count(*) FILTER (o_orderpriority = '2-HIGH') % 3 = 0 AS all_strata FROM orders GROUP BY 1)
SELECT k, CASE WHEN total <> 20 OR total - untestable - no_trace < 17 THEN 'INSUFFICIENT-COHORT' WHEN NOT coalesce(covered, false) THEN 'INVALID' WHEN NOT any_stratum THEN 'INSTRUMENT-LIMITED' WHEN recovered >= 4 THEN 'CONFIRMED' WHEN recovered > 0 THEN 'PARTIAL' WHEN all_strata THEN 'REFUTED' ELSE 'INSTRUMENT-LIMITED' END AS outcome FROM c""")
def m08(spark, sf_dir):
    """A cohort of each customer, its figures counted from the customer's orders."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    n = F.count("*")
    cohorts = Tables(spark, sf_dir).read("orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.when(n % 11 == 0, 19).otherwise(20).alias("total"), (F.count_if(status == "F") % 6).alias("recovered"), (F.count_if(priority == "1-URGENT") % 4).alias("untestable"), (F.count_if(status == "P") % 2).alias("no_trace"),
        F.when(n % 13 != 0, n % 5 != 0).alias("covered"), (F.count_if(priority == "5-LOW") % 4 != 0).alias("any_stratum"), (F.count_if(priority == "2-HIGH") % 3 == 0).alias("all_strata"))
    return cohorts.select("k", N.verdict(*(F.col(c) for c in ("recovered", "total", "untestable", "no_trace", "covered", "any_stratum", "all_strata")), 20, 3).alias("outcome"))
