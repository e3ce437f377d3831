"""Indicator queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.operators import indicators as I
from ledgerlight.operators import resolve as R
from ledgerlight.plans.base import query
from ledgerlight.sources.views import Tables

GB_THRESHOLD = 8_000_000  # cents; stands in for the locale's open-tender threshold at the sample's prices

FRAMEWORK = """CASE WHEN regexp_matches(lower(concat_ws(' ', title, method, '')), 'framework|dynamic purchasing|dps|call-off|call off|supplier list') THEN true
 WHEN try_cast(raw_json AS JSON) IS NULL THEN false WHEN json_type(raw_json, '$.tender') = 'OBJECT' THEN coalesce(json_extract_string(raw_json, '$.tender.techniques.hasFrameworkAgreement') = 'true', false)
 ELSE coalesce(json_extract_string(raw_json, '$.techniques.hasFrameworkAgreement') = 'true', false) END"""
PLACEHOLDER = "lower(trim(supplier_name)) IN ('various','multiple','multiple suppliers','n/a','na','none','not applicable','tbc','unknown','-','')"
EVALUABLE = "SELECT a.*, r.company_number, r.match_confidence, r.match_method FROM award a JOIN resolution r USING (award_id) WHERE status = 'active' AND supplier_name <> '' AND r.company_number IS NOT NULL"


def _source(t: Tables, source: str):
    return t.tender.where(F.col("source_id") == source)


def _resolved(t: Tables):
    return R.resolve_awards(t.award, t.company)


@query("i01_single_bidder_ua", """WITH j AS (SELECT t.tender_id FROM tender t JOIN award a USING (tender_id) WHERE source_id = 'ua_prozorro')
SELECT tender_id AS subject, (SELECT count(*) FROM j) AS units FROM (SELECT t.tender_id, count(*) AS n FROM tender t JOIN award a USING (tender_id) JOIN bid b USING (tender_id) WHERE source_id = 'ua_prozorro' GROUP BY ALL) WHERE n = 1""")
def i01_ua(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return I.single_bidder_by_bids(_source(t, "ua_prozorro"), t.award, t.bid)


@query("i01_single_bidder_co", """WITH j AS (SELECT * FROM tender t JOIN award a USING (tender_id) WHERE source_id = 'co_secop_ii')
SELECT tender_id AS subject, (SELECT count(*) FROM j) AS units FROM j WHERE greatest(CAST(bidders_stated AS INT), CAST(bidders_unique AS INT)) = 1""")
def i01_co(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return I.single_bidder_stated(_source(t, "co_secop_ii"), t.award)


@query("i01_single_award_gb", f"""WITH j AS (SELECT * FROM tender WHERE source_id = 'uk_contracts_finder' AND tender_id IN (SELECT tender_id FROM award GROUP BY 1 HAVING count(*) = 1))
SELECT tender_id AS subject, (SELECT count(*) FROM j) AS units FROM j WHERE NOT ({FRAMEWORK}) AND regexp_matches(lower(method), 'open|competitive|restricted')""")
def i01_gb(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return I.single_award_competitive(_source(t, "uk_contracts_finder"), t.award)


@query("i02_short_window", """WITH d AS (SELECT tender_id, CAST(floor((epoch(tender_end) - epoch(tender_start)) / 86400) AS BIGINT) AS days FROM tender WHERE tender_end IS NOT NULL AND tender_start IS NOT NULL)
SELECT tender_id AS subject, days, (SELECT count(*) FROM d) AS units FROM d WHERE days < 15""")
def i02(spark, sf_dir):
    return I.short_bid_window(Tables(spark, sf_dir).tender)


@query("i03_repeat_winner", f"""WITH p AS (SELECT source_id, buyer_year AS buyer, supplier_name, count(*) AS won, CAST(sum(a.value_cents) AS BIGINT) AS value_cents FROM tender t JOIN award a USING (tender_id) WHERE NOT ({PLACEHOLDER}) GROUP BY ALL),
s AS (SELECT *, CAST(sum(won) OVER (PARTITION BY source_id, buyer) AS BIGINT) AS total FROM p)
SELECT source_id, buyer || '→' || supplier_name AS subject, won, total, won / total AS share, value_cents, (SELECT count(*) FROM p) AS units FROM s WHERE total >= 4 AND won / total >= 0.5""")
def i03(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return I.repeat_winner_share(t.tender, t.award, "buyer_year")


@query("i04_price_vs_estimate", f"""WITH p AS (SELECT t.tender_id, award_id, {FRAMEWORK} AS framework, t.value_cents AS estimate, a.value_cents AS price FROM tender t JOIN award a USING (tender_id) WHERE a.value_cents > 0 AND t.value_cents > 0)
SELECT tender_id || ':' || award_id AS subject, abs(price - estimate) / estimate AS deviation, price < estimate AS weak, (SELECT count(*) FROM p) AS units FROM p WHERE NOT framework AND abs(price - estimate) / estimate >= 0.25""")
def i04(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return I.price_vs_estimate(t.tender, t.award)


def _direct(source: str, words: str) -> str:
    return f"""WITH b AS (SELECT buyer_name, count(*) AS total, count(*) FILTER (regexp_matches(lower(method), '{words}')) AS direct, arg_min(title, tender_key) AS first_title FROM tender WHERE source_id = '{source}' GROUP BY 1)
SELECT buyer_name AS subject, direct, total, direct / total AS share, first_title, (SELECT count(*) FROM b) AS units FROM b WHERE total >= 4 AND direct / total >= 0.3"""


@query("i05_direct_share_ua", _direct("ua_prozorro", "limited|negotiation|reporting|direct"))
def i05_ua(spark, sf_dir):
    return I.direct_award_share(Tables(spark, sf_dir).tender, "ua_prozorro")


@query("i05_direct_share_gb", _direct("uk_contracts_finder", "direct|single_tender"))
def i05_gb(spark, sf_dir):
    return I.direct_award_share(Tables(spark, sf_dir).tender, "uk_contracts_finder")


@query("i06_incorporation", f"""WITH e AS ({EVALUABLE})
SELECT tender_id || ':' || award_id AS subject, company_number, CAST(award_date - incorporation_date AS BIGINT) AS days, match_confidence, (SELECT count(*) FROM e) AS units
FROM e JOIN company USING (company_number) WHERE award_date - incorporation_date BETWEEN 0 AND 89""")
def i06(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return I.incorporation_proximity(t.award, _resolved(t), t.company)


@query("i07_value_vs_size", f"""WITH e AS ({EVALUABLE}), f AS (SELECT *, CASE WHEN lower(trim(accounts_category)) IN ('dormant','dormant company','dormant no significant accounting') AND value_cents > 0 THEN 'dormant'
 WHEN lower(trim(accounts_category)) IN ('micro-entity','micro entity') AND value_cents > 5000000 THEN 'micro' WHEN lower(trim(accounts_category)) IN ('small','small company') AND value_cents > 500000000 THEN 'small' END AS reason
 FROM e JOIN company USING (company_number) WHERE value_kind <> 'shared_ceiling')
SELECT tender_id || ':' || award_id AS subject, reason, value_cents, match_confidence, (SELECT count(*) FROM e) AS units, (SELECT count(*) FROM e WHERE value_kind = 'shared_ceiling') AS unscoreable FROM f WHERE reason IS NOT NULL""")
def i07(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return I.value_vs_company_size(t.award, _resolved(t), t.company)


@query("i08_dormancy", f"""WITH e AS ({EVALUABLE}), f AS (SELECT *, coalesce(lower(trim(accounts_category)) IN ('dormant','dormant company','dormant no significant accounting'), false) AS dormant,
 coalesce(award_date - last_made_up > 547.92, false) AS stale FROM e JOIN company USING (company_number))
SELECT tender_id || ':' || award_id AS subject, dormant, stale, CASE WHEN stale THEN CAST((award_date - last_made_up) // 30 AS BIGINT) END AS months, (SELECT count(*) FROM e) AS units FROM f WHERE dormant OR stale""")
def i08(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return I.dormancy_delinquency(t.award, _resolved(t), t.company)


CLUSTERS = """dates AS (SELECT DISTINCT buyer, company_number, award_date AS d FROM e),
anchors(buyer, company_number, anchor) AS (SELECT buyer, company_number, min(d) FROM dates GROUP BY ALL
 UNION ALL SELECT a.buyer, a.company_number, (SELECT min(d) FROM dates x WHERE x.buyer = a.buyer AND x.company_number = a.company_number AND x.d > a.anchor + 30) FROM anchors a WHERE a.anchor IS NOT NULL),
c AS (SELECT e.*, (SELECT max(anchor) FROM anchors a WHERE a.buyer = e.buyer AND a.company_number = e.company_number AND a.anchor <= e.award_date) AS anchor FROM e)"""


@query("i09_splitting", f"""WITH RECURSIVE v AS ({EVALUABLE}), e AS (SELECT v.*, buyer_nation AS buyer FROM v JOIN tender t USING (tender_id) WHERE NOT ({FRAMEWORK}) AND v.value_cents > 0),
{CLUSTERS}, p AS (SELECT buyer, company_number, anchor, tender_id, sum(value_cents) AS value, max(award_date) AS last, min(match_confidence) AS confidence, count(*) AS awards FROM c GROUP BY ALL),
g AS (SELECT buyer, company_number, anchor, count(*) AS pieces, CAST(sum(value) AS BIGINT) AS total_cents, max(value) AS largest, max(last) AS last, min(confidence) AS confidence, CAST(sum(awards) AS BIGINT) AS awards FROM p GROUP BY ALL)
SELECT company_number || '@' || buyer || ':' || CAST(anchor AS VARCHAR) AS subject, pieces, awards, total_cents, CASE WHEN last - anchor <= 1 THEN 'same-day' WHEN last - anchor <= 7 THEN 'same-week' ELSE 'within-30d' END AS band, confidence,
 (SELECT count(*) FROM (SELECT DISTINCT buyer, company_number FROM e)) AS units FROM g WHERE pieces >= 3 AND largest < {GB_THRESHOLD} AND total_cents > {GB_THRESHOLD}""")
def i09(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return I.contract_splitting(t.tender, t.award, _resolved(t), "buyer_nation", GB_THRESHOLD)


@query("i13_base_rate", """WITH j AS (SELECT source_id, count(*) AS units, count(*) FILTER (floor((epoch(tender_end) - epoch(tender_start)) / 86400) < 15) AS flags FROM tender WHERE tender_end IS NOT NULL GROUP BY 1)
SELECT source_id, flags, units, flags / units AS rate, flags / units <= 0.2 AS discriminating FROM j""")
def i13(spark, sf_dir):
    from ledgerlight.operators.aggregates import base_rates

    dated = Tables(spark, sf_dir).tender.where("tender_end IS NOT NULL")
    from ledgerlight.functions.scalars import floored_days

    return base_rates(dated, "source_id", floored_days(F.col("tender_start"), F.col("tender_end")) < 15)
