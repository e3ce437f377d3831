"""Registering queries, and the views they read: domain tables derived from the sample tables, in Spark and in SQL.

A query is a function of (spark, sf_dir); beside it stands SQL that must give the same rows from the same Parquet files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function as query `name`; names in sql that are views are defined in front of it."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return register


def with_views(sql: str) -> str:
    import re

    needed, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS_SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(VIEWS_SQL[name])
    views = ",\n".join(f"{k} AS ({v})" for k, v in VIEWS_SQL.items() if k in needed)
    if not views:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{body[len('WITH RECURSIVE'):]}"
    return f"WITH {views},\n{body[4:]}" if body.upper().startswith("WITH") else f"WITH {views}\n{body}"


METHOD = """CASE o_orderpriority WHEN '1-URGENT' THEN 'direct' WHEN '2-HIGH' THEN 'limited' WHEN '3-MEDIUM' THEN 'open'
 WHEN '4-NOT SPECIFIED' THEN 'selective' ELSE 'restricted' END"""
SOURCE = "CASE o_custkey % 3 WHEN 0 THEN 'ua_prozorro' WHEN 1 THEN 'uk_contracts_finder' ELSE 'co_secop_ii' END"
RAW = """CASE o_orderkey % 20 WHEN 0 THEN '{"tender":{"techniques":{"hasFrameworkAgreement":true}}}'
 WHEN 1 THEN '{"tender":[],"techniques":{"hasFrameworkAgreement":true}}' WHEN 2 THEN '{"tender":{"techniques":{"hasFrameworkAgreement":false}}}'
 WHEN 3 THEN 'not json' ELSE '{}' END"""

#: The views in DuckDB's SQL.
VIEWS_SQL = {
    "tender": f"""SELECT CAST(o_orderkey AS VARCHAR) AS tender_id, o_orderkey AS tender_key, {SOURCE} AS source_id, c_name AS buyer_name,
 c_name || '-' || CAST(year(o_orderdate) AS VARCHAR) AS buyer_year, n_name AS buyer_nation, o_orderpriority AS title, {METHOD} AS method,
 CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS value_cents, o_orderdate AS tender_start,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate + to_hours(CAST((o_orderkey % 45) * 24 + o_orderkey % 24 - 12 AS BIGINT)) END AS tender_end,
 {RAW} AS raw_json, CAST(o_orderkey % 7 AS VARCHAR) AS bidders_stated, CAST(o_orderkey % 5 AS VARCHAR) AS bidders_unique
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "award": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER), CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS award_id,
 CAST(l_orderkey AS VARCHAR) AS tender_id, CASE l_partkey % 50 WHEN 0 THEN 'Various' WHEN 1 THEN ' N/A ' ELSE s_name END AS supplier_name,
 CASE WHEN l_partkey % 2 = 0 THEN 'GB-COH' END AS supplier_scheme, CASE WHEN l_partkey % 2 = 0 THEN CAST(s_suppkey + CASE WHEN l_partkey % 10 = 0 THEN 900000 ELSE 0 END AS VARCHAR) END AS supplier_number,
 CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * 100) AS BIGINT) AS value_cents,
 CASE l_linestatus WHEN 'O' THEN 'active' ELSE 'complete' END AS status, CAST(l_shipdate AS DATE) AS award_date,
 CASE l_returnflag WHEN 'R' THEN 'shared_ceiling' ELSE 'per_supplier' END AS value_kind, l_suppkey AS supplier_key, l_linenumber AS line
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "bid": "SELECT CAST(l_orderkey AS VARCHAR) AS tender_id, CAST(l_suppkey AS VARCHAR) AS bidder FROM lineitem WHERE l_returnflag = 'A'",
    "company": """SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS company_number, upper(s_name) AS normalised_name, CASE WHEN s_suppkey % 4 = 0 THEN 'Liquidation' ELSE 'Active' END AS company_status,
 DATE '1995-01-01' + CAST(s_suppkey * 17 % 1500 AS INTEGER) AS incorporation_date,
 CASE s_suppkey % 6 WHEN 0 THEN 'Dormant' WHEN 1 THEN 'Micro-Entity' WHEN 2 THEN 'Small' WHEN 3 THEN 'Full' WHEN 5 THEN ' dormant company ' END AS accounts_category,
 CASE WHEN s_suppkey % 7 <> 0 THEN DATE '1994-01-01' + CAST(s_suppkey * 31 % 1200 AS INTEGER) END AS last_made_up FROM supplier
 UNION ALL SELECT 'SC' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0'), upper(s_name), CASE WHEN s_suppkey % 20 = 3 THEN 'Dissolved' ELSE 'Active' END, DATE '1994-06-01', 'Full', NULL FROM supplier WHERE s_suppkey % 10 = 3""",
    "name_tier": """SELECT normalised_name, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (company_status = 'Active') AS BIGINT) AS n_active, min(company_number) AS only_number,
 min(company_number) FILTER (company_status = 'Active') AS only_active FROM company GROUP BY normalised_name""",
    "resolution": """SELECT a.award_id, a.tender_id,
 CASE WHEN supplier_scheme = 'GB-COH' THEN lpad(supplier_number, 8, '0') WHEN n = 1 THEN only_number WHEN n_active = 1 THEN only_active END AS company_number,
 CASE WHEN supplier_scheme = 'GB-COH' THEN (CASE WHEN c.company_number IS NULL THEN 0.0 ELSE 1.0 END) WHEN n = 1 OR n_active = 1 THEN 0.9 ELSE 0.0 END::DOUBLE AS match_confidence,
 CASE WHEN supplier_scheme = 'GB-COH' THEN 'identifier' WHEN n = 1 OR n_active = 1 THEN 'exact_name' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS match_method
 FROM award a LEFT JOIN (SELECT DISTINCT company_number FROM company) c ON a.supplier_scheme = 'GB-COH' AND c.company_number = lpad(a.supplier_number, 8, '0')
 LEFT JOIN name_tier t ON a.supplier_scheme IS NULL AND t.normalised_name = upper(trim(regexp_replace(a.supplier_name, '\\s+', ' ', 'g')))""",
    "entity": """SELECT s_suppkey AS id, 'company' AS entity_type, s_name AS name, 'GB-COH' AS scheme, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS registry_id FROM supplier
 UNION ALL SELECT 1000000000 + c_custkey, 'person', c_name, 'REG', CAST(c_custkey AS VARCHAR) FROM customer
 UNION ALL SELECT 2000000000 + n_nationkey, 'public_body', n_name, NULL, NULL FROM nation""",
    "edge": """SELECT l_suppkey * 1000000 + o_custkey AS id, 'supplier_of' AS edge_type, CAST(l_suppkey AS BIGINT) AS source, 1000000000 + o_custkey AS target, CAST(min(l_shipdate) AS DATE) AS valid_from
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE (l_suppkey * 31 + o_custkey) % 20 = 0 GROUP BY l_suppkey, o_custkey
 UNION ALL SELECT 900000000000000 + c_custkey, 'associate_of', 1000000000 + c_custkey, 2000000000 + c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN DATE '1995-06-01' END FROM customer
 UNION ALL SELECT 800000000000000 + a.c_custkey, 'same_as', 1000000000 + a.c_custkey, 1000000000 + b.c_custkey, NULL FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 5 = 0""",
    "attestation": """SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey * 1000000 + min(o_custkey) AS edge, CASE l_linenumber % 3 WHEN 0 THEN 'Register A' WHEN 1 THEN 'Register B' ELSE 'Register C' END AS source_name,
 CASE WHEN l_linenumber > 1 THEN l_orderkey * 10 + CASE WHEN l_linenumber = 3 THEN 2 WHEN l_linenumber = 2 THEN 3 ELSE l_linenumber - 1 END END AS derived_from, CAST(min(l_shipdate) AS DATE) AS observed_at,
 CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE round(0.5 + 0.05 * l_linenumber, 2) END AS match_confidence
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE (l_suppkey * 31 + o_custkey) % 20 = 0 GROUP BY l_orderkey, l_linenumber, l_suppkey""",
    "run": "SELECT 'src' || CAST(user_id % 20 AS VARCHAR) AS source_id, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, ts AS finished_at, event_id FROM events",
}
