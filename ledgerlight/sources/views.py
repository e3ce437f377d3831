"""The domain tables as DataFrames over the sample tables (orders as tenders, line items as awards, suppliers as companies)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.scalars import normalise_name, normalise_company_number
from ledgerlight.plans.base import METHOD, RAW, SOURCE
from ledgerlight.sources.workdir import settled


class Tables:
    """Sample tables and views of one folder. Every view is lazy and reads only the columns its user needs, but for what edges
    and attestations are made of, a twentieth of the sales: that is stored when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def tender(self) -> DataFrame:
        orders, customer, nation = self.read("orders"), self.read("customer"), self.read("nation")
        joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(F.broadcast(nation), customer["c_nationkey"] == nation["n_nationkey"])
        return joined.selectExpr(
            "CAST(o_orderkey AS STRING) AS tender_id", "o_orderkey AS tender_key", f"{SOURCE} AS source_id", "c_name AS buyer_name", "concat(c_name, '-', year(o_orderdate)) AS buyer_year",
            "n_name AS buyer_nation", "o_orderpriority AS title", f"{METHOD} AS method", "CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS value_cents", "o_orderdate AS tender_start",
            "CASE WHEN o_orderkey % 11 <> 0 THEN timestampadd(HOUR, CAST((o_orderkey % 45) * 24 + o_orderkey % 24 - 12 AS INT), o_orderdate) END AS tender_end",
            f"{RAW} AS raw_json", "CAST(o_orderkey % 7 AS STRING) AS bidders_stated", "CAST(o_orderkey % 5 AS STRING) AS bidders_unique",
        )

    @property
    def award(self) -> DataFrame:
        lineitem, supplier = self.read("lineitem"), self.read("supplier")
        return lineitem.join(supplier, lineitem["l_suppkey"] == supplier["s_suppkey"]).selectExpr(
            "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_quantity AS INT) AS STRING), CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS STRING)) AS award_id",
            "CAST(l_orderkey AS STRING) AS tender_id", "CASE l_partkey % 50 WHEN 0 THEN 'Various' WHEN 1 THEN ' N/A ' ELSE s_name END AS supplier_name",
            "CASE WHEN l_partkey % 2 = 0 THEN 'GB-COH' END AS supplier_scheme", "CASE WHEN l_partkey % 2 = 0 THEN CAST(s_suppkey + CASE WHEN l_partkey % 10 = 0 THEN 900000 ELSE 0 END AS STRING) END AS supplier_number",
            "CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * 100) AS BIGINT) AS value_cents",
            "CASE l_linestatus WHEN 'O' THEN 'active' ELSE 'complete' END AS status", "CAST(l_shipdate AS DATE) AS award_date",
            "CASE l_returnflag WHEN 'R' THEN 'shared_ceiling' ELSE 'per_supplier' END AS value_kind", "l_suppkey AS supplier_key", "l_linenumber AS line",
        )

    @property
    def bid(self) -> DataFrame:
        return self.read("lineitem").where("l_returnflag = 'A'").selectExpr("CAST(l_orderkey AS STRING) AS tender_id", "CAST(l_suppkey AS STRING) AS bidder")

    @property
    def company(self) -> DataFrame:
        supplier = self.read("supplier")
        first = supplier.select(
            normalise_company_number(F.col("s_suppkey").cast("string")).alias("company_number"), normalise_name(F.col("s_name")).alias("normalised_name"),
            F.expr("CASE WHEN s_suppkey % 4 = 0 THEN 'Liquidation' ELSE 'Active' END").alias("company_status"),
            F.expr("date_add(DATE '1995-01-01', CAST(s_suppkey * 17 % 1500 AS INT))").alias("incorporation_date"),
            F.expr("CASE s_suppkey % 6 WHEN 0 THEN 'Dormant' WHEN 1 THEN 'Micro-Entity' WHEN 2 THEN 'Small' WHEN 3 THEN 'Full' WHEN 5 THEN ' dormant company ' END").alias("accounts_category"),
            F.expr("CASE WHEN s_suppkey % 7 <> 0 THEN date_add(DATE '1994-01-01', CAST(s_suppkey * 31 % 1200 AS INT)) END").alias("last_made_up"),
        )
        again = supplier.where("s_suppkey % 10 = 3").select(
            F.concat(F.lit("SC"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")), normalise_name(F.col("s_name")), F.expr("CASE WHEN s_suppkey % 20 = 3 THEN 'Dissolved' ELSE 'Active' END"),
            F.lit("1994-06-01").cast("date"), F.lit("Full"), F.lit(None).cast("date"),
        )
        return first.union(again)

    @property
    def entity(self) -> DataFrame:
        parts = (
            self.read("supplier").selectExpr("s_suppkey AS id", "'company' AS entity_type", "s_name AS name", "'GB-COH' AS scheme", "lpad(CAST(s_suppkey AS STRING), 8, '0') AS registry_id"),
            self.read("customer").selectExpr("1000000000 + c_custkey AS id", "'person' AS entity_type", "c_name AS name", "'REG' AS scheme", "CAST(c_custkey AS STRING) AS registry_id"),
            self.read("nation").selectExpr("2000000000L + n_nationkey AS id", "'public_body' AS entity_type", "n_name AS name", "CAST(NULL AS STRING) AS scheme", "CAST(NULL AS STRING) AS registry_id"),
        )
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    @cached_property
    def _sold(self) -> DataFrame:
        lineitem, orders = self.read("lineitem"), self.read("orders")
        joined = lineitem.join(orders, lineitem["l_orderkey"] == orders["o_orderkey"]).where("(l_suppkey * 31 + o_custkey) % 20 = 0")
        return settled(joined.select("l_orderkey", "l_linenumber", "l_suppkey", "o_custkey", "l_shipdate"))

    @property
    def edge(self) -> DataFrame:
        customer = self.read("customer")
        sold = self._sold.groupBy("l_suppkey", "o_custkey").agg(F.min("l_shipdate").cast("date").alias("valid_from")).selectExpr(
            "l_suppkey * 1000000 + o_custkey AS id", "'supplier_of' AS edge_type", "l_suppkey AS source", "1000000000 + o_custkey AS target", "valid_from")
        near = customer.selectExpr("900000000000000 + c_custkey AS id", "'associate_of' AS edge_type", "1000000000 + c_custkey AS source", "2000000000L + c_nationkey AS target", "CASE WHEN c_custkey % 3 = 0 THEN DATE '1995-06-01' END AS valid_from")
        same = customer.where("c_custkey % 5 = 0").alias("a").join(customer.select((F.col("c_custkey") - 1).alias("k")), F.col("c_custkey") == F.col("k")).selectExpr(
            "800000000000000 + c_custkey AS id", "'same_as' AS edge_type", "1000000000 + c_custkey AS source", "1000000001 + c_custkey AS target", "CAST(NULL AS DATE) AS valid_from")
        return sold.unionByName(near).unionByName(same)

    @property
    def attestation(self) -> DataFrame:
        return self._sold.groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.min("o_custkey").alias("c"), F.min("l_shipdate").cast("date").alias("observed_at")).selectExpr(
            "l_orderkey * 10 + l_linenumber AS id", "l_suppkey * 1000000 + c AS edge", "CASE l_linenumber % 3 WHEN 0 THEN 'Register A' WHEN 1 THEN 'Register B' ELSE 'Register C' END AS source_name",
            "CASE WHEN l_linenumber > 1 THEN l_orderkey * 10 + CASE WHEN l_linenumber = 3 THEN 2 WHEN l_linenumber = 2 THEN 3 ELSE l_linenumber - 1 END END AS derived_from", "observed_at",
            "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE round(0.5D + 0.05D * l_linenumber, 2) END AS match_confidence",
        )

    @property
    def run(self) -> DataFrame:
        return self.read("events").selectExpr("concat('src', user_id % 20) AS source_id", "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'running' END AS status", "ts AS finished_at", "event_id")
