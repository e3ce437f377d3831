"""Queries on identity across registers: customers as members of parliament, orders as officer records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.operators import identity as D
from ledgerlight.plans.base import query
from ledgerlight.sources.views import Tables

# Pieces of names in SQL that both engines read. Numbers become letters; a third of the members share few surnames.
LETTERS = "translate(CAST({0} AS STRING), '0123456789', 'abcdefghij')"
WHO = "CASE WHEN {0} % 3 = 0 THEN {0} % 41 ELSE {0} END"
SURNAME = "concat('sur', " + LETTERS.format(f"({WHO})") + ")"
TITLE = "CASE {0} % 5 WHEN 0 THEN 'Lord' WHEN 1 THEN 'Baroness' WHEN 2 THEN 'Baron' WHEN 3 THEN '' ELSE 'Sir' END"
RANK = "CASE {0} % 5 WHEN 0 THEN 'lord' WHEN 1 THEN 'lady' WHEN 2 THEN 'lord' WHEN 3 THEN ' ' ELSE 'sir' END"
FORENAME = "CASE WHEN {0} % 5 > 2 OR {0} % 4 = 1 THEN concat('fore', " + LETTERS.format("({0} % 7)") + ") END"
SEAT = "CASE WHEN {0} % 5 < 3 AND {0} % 7 < 4 THEN concat('seat', " + LETTERS.format("({0} % 11)") + ") END"
#: An order's record is of its customer, written otherwise: another forename, no seat, a longer or another one.
GIVEN = f"CASE WHEN o_orderkey % 6 = 0 THEN concat('fore', {LETTERS.format('(o_orderkey % 3)')}) WHEN o_orderkey % 31 = 0 THEN NULL ELSE coalesce({FORENAME.format('o_custkey')}, 'any') END"
PLACE = f"CASE WHEN o_custkey % 5 < 3 THEN CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN {SEAT.format('o_custkey')} || ' kg' WHEN o_orderkey % 8 = 2 THEN {SEAT.format('o_custkey')} || 'x' ELSE {SEAT.format('o_custkey')} END END"

SQL = f"""people AS (SELECT c_custkey AS member, {SURNAME.format('c_custkey')} AS surname, {RANK.format('c_custkey')} AS rank, {FORENAME.format('c_custkey')} AS forename, {SEAT.format('c_custkey')} AS seat FROM customer WHERE c_custkey % 50 <> 7),
m AS (SELECT *, count(*) OVER (PARTITION BY surname, rank) > 1 AS contested FROM people),
o AS (SELECT o_orderkey AS officer, {SURNAME.format('o_custkey')} AS surname, {RANK.format('o_custkey')} AS rank, {GIVEN} AS given, {PLACE} AS place FROM orders),
j AS (SELECT *, coalesce(given, '?') AS g, coalesce(place = seat OR starts_with(place, seat || ' '), false) AS confirmed FROM m JOIN o USING (surname, rank)),
k AS (SELECT *, count(DISTINCT g) OVER (PARTITION BY member) AS groups, count(DISTINCT CASE WHEN confirmed THEN g END) OVER (PARTITION BY member) AS confirmed_groups FROM j),
c AS (SELECT member, officer, CASE WHEN forename IS NOT NULL AND given = forename THEN 'surname_forename_title' WHEN forename IS NULL AND contested AND confirmed AND confirmed_groups = 1 THEN 'surname_title_territorial'
 WHEN forename IS NULL AND NOT contested AND groups = 1 AND (place IS NULL OR confirmed) THEN 'surname_title_only' END AS tier FROM k),
claims AS (SELECT *, CASE tier WHEN 'surname_title_only' THEN 0.6 ELSE 0.85 END::DOUBLE AS confidence, count(*) OVER (PARTITION BY officer) > 1 AS dropped FROM c WHERE tier IS NOT NULL)"""


def _named(spark, sf_dir):
    """Members and officer records by their full names, as registers print them."""
    t = Tables(spark, sf_dir)
    style = f"concat_ws(' ', nullif({TITLE.format('c_custkey')}, ''), initcap({FORENAME.format('c_custkey')}), initcap({SURNAME.format('c_custkey')}), concat('of ', initcap({SEAT.format('c_custkey')})))"
    members = t.read("customer").selectExpr("c_custkey AS member", f"CASE WHEN c_custkey % 50 = 7 THEN 'The Lord Bishop of Sample' ELSE {style} END AS name")
    title = TITLE.format("o_custkey")
    titled = f"CASE WHEN {title} = '' THEN NULL WHEN ({PLACE}) IS NULL THEN {title} ELSE concat('The ', {title}, ' ', initcap({SURNAME.format('o_custkey')}), ' Of ', initcap({PLACE})) END"
    officers = t.read("orders").selectExpr("o_orderkey AS officer", f"concat_ws(', ', upper({SURNAME.format('o_custkey')}), coalesce(initcap({GIVEN}), ''), {titled}) AS name")
    return members, officers


@query("l05_contested", f"WITH {SQL} SELECT member, officer, tier, confidence, dropped FROM claims")
def l05(spark, sf_dir):
    return D.identity_claims(*_named(spark, sf_dir))


@query("l05_outcomes", f"""WITH {SQL}, s AS (SELECT member, min(tier) AS tier, count(*) FILTER (NOT dropped) AS linked, count(*) FILTER (dropped) AS dropped FROM claims GROUP BY 1)
SELECT c_custkey AS member, CASE WHEN c_custkey % 50 = 7 THEN 'functional_title' WHEN c_custkey NOT IN (SELECT member FROM j) THEN 'no_candidate' WHEN linked > 0 THEN tier WHEN dropped > 0 THEN 'officer_collision' ELSE 'ambiguous' END AS outcome,
 coalesce(linked, 0) AS linked, coalesce(dropped, 0) AS dropped FROM customer LEFT JOIN s ON member = c_custkey""")
def l05_outcomes(spark, sf_dir):
    return D.member_outcomes(*_named(spark, sf_dir))


#: Stored links: those claimed, without every seventh, with an old tier in every fifth, and some that nothing claims any more.
STORED = "SELECT member, officer, CASE WHEN officer % 5 = 0 THEN 'surname_title_only' ELSE tier END AS tier, CASE WHEN officer % 5 = 0 THEN 0.6D ELSE confidence END AS confidence FROM {0} WHERE NOT dropped AND officer % 7 <> 0 UNION ALL SELECT c_custkey, -c_custkey, 'surname_title_only', 0.6D FROM {1} WHERE c_custkey % 10 = 0"


@query("l05_reconciled", f"""WITH {SQL}, stored AS ({STORED.format('claims', 'customer').replace('0.6D', '0.6::DOUBLE')}), d AS (SELECT * FROM claims WHERE NOT dropped)
SELECT member, officer, CASE WHEN s.tier IS NULL THEN 'create' WHEN d.tier IS NULL THEN 'delete' WHEN s.tier = d.tier AND s.confidence = d.confidence THEN 'keep' ELSE 'update' END AS action, coalesce(d.tier, s.tier) AS tier, coalesce(d.confidence, s.confidence) AS confidence
 FROM d FULL JOIN stored s USING (member, officer)""")
def l05_reconciled(spark, sf_dir):
    claims = D.identity_claims(*_named(spark, sf_dir))
    customer = Tables(spark, sf_dir).read("customer")
    stored = spark.sql(STORED.format("{claims}", "{customer}"), claims=claims, customer=customer)
    return D.link_changes(stored, claims)
