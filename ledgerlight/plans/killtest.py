"""Queries of the kill test: each order is a record of a cohort, meant to be joined to one of its line items as the award."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.operators import killtest as K
from ledgerlight.plans.base import query
from ledgerlight.plans.indicators import FRAMEWORK, PLACEHOLDER
from ledgerlight.sources.views import Tables
from ledgerlight.sources.workdir import laid_out

EMERGENCY = ("1995-03-01", "1995-06-30")

SQL = f"""aw AS (SELECT tender_id, min(supplier_name) AS least_name, max(value_cents) AS most, count(*) AS n FROM award GROUP BY 1),
co AS (SELECT tender_key AS record, CASE WHEN tender_key % 5 = 0 THEN 'vip' ELSE 'control' END AS cohort, CASE WHEN tender_key % 17 = 0 THEN 'no one' ELSE t.tender_id END AS ocid, CASE WHEN tender_key % 3 = 0 THEN 'nobody' ELSE coalesce(least_name, 'nobody') END AS supplier,
 CASE WHEN tender_key % 4 = 0 THEN 0 ELSE coalesce(most, 0) END AS cents FROM tender t LEFT JOIN aw USING (tender_id)),
ca AS (SELECT record, a.award_id, a.supplier_name, a.value_cents, a.award_date, CASE WHEN n = 1 THEN 1 WHEN a.supplier_name = co.supplier THEN 2 WHEN a.value_cents = co.cents THEN 3 END AS way FROM co JOIN award a ON a.tender_id = co.ocid JOIN aw ON aw.tender_id = co.ocid),
be AS (SELECT * FROM ca WHERE way IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record ORDER BY way, award_id) = 1),
pl AS (SELECT buyer_year, supplier_name, count(*) AS won FROM tender JOIN award USING (tender_id) WHERE NOT ({PLACEHOLDER}) GROUP BY ALL),
sh AS (SELECT *, sum(won) OVER (PARTITION BY buyer_year) AS total FROM pl),
fa AS (SELECT t.*, {FRAMEWORK} AS framework FROM tender t),
wide AS (SELECT co.record, cohort, co.supplier, CASE WHEN f.tender_id IS NULL THEN 'tender_missing' WHEN be.record IS NULL THEN 'award_not_matched' ELSE 'matched' END AS join_status,
 CASE WHEN regexp_matches(method, 'limited|direct') THEN 'noncompetitive' ELSE 'competitive' END || '__' || CASE WHEN be.award_date BETWEEN DATE '{EMERGENCY[0]}' AND DATE '{EMERGENCY[1]}' THEN 'emergency' WHEN be.award_date < DATE '{EMERGENCY[0]}' THEN 'before' ELSE 'after' END AS stratum,
 CASE WHEN tender_start IS NULL OR tender_end IS NULL THEN 'missing_window' WHEN floor((epoch(tender_end) - epoch(tender_start)) / 86400) < 15 THEN 'flagged' ELSE 'not_flagged' END AS i002,
 CASE WHEN be.record IS NULL THEN NULL WHEN lower(trim(be.supplier_name)) IN ('various', 'n/a') THEN 'placeholder_supplier' WHEN coalesce((SELECT sum(won) FROM pl WHERE pl.buyer_year = f.buyer_year), 0) < 4 THEN 'buyer_below_floor'
  WHEN (SELECT max(won / total) FROM sh WHERE sh.buyer_year = f.buyer_year AND sh.supplier_name = be.supplier_name) >= 0.5 THEN 'flagged' ELSE 'not_flagged' END AS i003,
 CASE WHEN framework THEN 'framework' WHEN f.value_cents <= 0 OR be.value_cents <= 0 THEN 'missing_estimate' WHEN abs(be.value_cents - f.value_cents) / f.value_cents < 0.25 THEN 'not_flagged' WHEN be.value_cents < f.value_cents THEN 'flagged_weak' ELSE 'flagged' END AS i004
 FROM co LEFT JOIN fa f ON f.tender_id = co.ocid LEFT JOIN be ON be.record = co.record),
scored AS (SELECT record, cohort, supplier, join_status, CASE WHEN join_status = 'matched' THEN stratum END AS stratum, e.i AS indicator, CASE WHEN join_status = 'matched' THEN e.s ELSE 'not_joined' END AS status FROM (SELECT *, unnest([{{'i': 'i002', 's': i002}}, {{'i': 'i003', 's': i003}}, {{'i': 'i004', 's': i004}}]) AS e FROM wide))"""


def _scored(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tender = laid_out(t.tender.select("tender_key", "tender_id", "source_id", "buyer_year", "title", "method", "value_cents", "tender_start", "tender_end", "raw_json"), "tender_id")
    award = laid_out(t.award.select("award_id", "tender_id", "supplier_name", "value_cents", "award_date"), "tender_id")
    awards = award.groupBy("tender_id").agg(F.min("supplier_name").alias("least_name"), F.max("value_cents").alias("most"))
    cohort = tender.select("tender_key", "tender_id").join(awards, "tender_id", "left").selectExpr(
        "tender_key AS record", "CASE WHEN tender_key % 5 = 0 THEN 'vip' ELSE 'control' END AS cohort", "CASE WHEN tender_key % 17 = 0 THEN 'no one' ELSE tender_id END AS ocid",
        "CASE WHEN tender_key % 3 = 0 THEN 'nobody' ELSE coalesce(least_name, 'nobody') END AS supplier", "CASE WHEN tender_key % 4 = 0 THEN 0 ELSE coalesce(most, 0) END / 100.0BD AS value")
    return K.scored_records(cohort, tender.withColumn("ocid", F.col("tender_id")), award, "buyer_year", EMERGENCY)


@query("i16_scored_records", f"WITH {SQL} SELECT * FROM scored")
def i16_scored(spark, sf_dir):
    return _scored(spark, sf_dir)


@query("i16_firing_rates", f"""WITH {SQL}, r AS (SELECT stratum, indicator, count(*) AS population, count(*) FILTER (status IN ('flagged', 'not_flagged', 'flagged_weak')) AS scoreable, count(*) FILTER (status = 'flagged') AS flagged FROM scored WHERE stratum IS NOT NULL GROUP BY ALL)
SELECT *, flagged / nullif(scoreable, 0) AS rate, coalesce(flagged / nullif(scoreable, 0) > 0.2, false) AS stratifier FROM r""")
def i16_rates(spark, sf_dir):
    return K.firing_rates(_scored(spark, sf_dir))


@query("i16_ranking", f"""WITH {SQL}, e AS (SELECT stratum, supplier, list_sort(list_distinct(list(indicator) FILTER (status = 'flagged'))) AS flagged, count(DISTINCT indicator) FILTER (status IN ('flagged', 'not_flagged', 'flagged_weak')) AS n_scored FROM scored WHERE cohort = 'vip' AND stratum IS NOT NULL GROUP BY ALL),
r AS (SELECT stratum, supplier, coalesce(flagged, []) AS flagged, n_scored FROM e), k AS (SELECT *, rank() OVER (PARTITION BY stratum ORDER BY len(flagged) DESC) AS rank, count(*) OVER (PARTITION BY stratum, len(flagged)) AS alike FROM r)
SELECT stratum, rank, supplier, len(flagged) AS n_flagged, flagged, n_scored, rank = 1 AND len(flagged) > 0 AND alike = 1 AS alone FROM k""")
def i16_ranking(spark, sf_dir):
    return K.ranking(_scored(spark, sf_dir), "vip")
