"""The read-only surface: lookups over entities, edges and attestations. Every result is a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.operators.gates import pending_roster
from ledgerlight.operators.graph import bounded_paths, costed, neighbours_by_type
from ledgerlight.operators.guards import entity_summary


def clamp(limit: int, low: int = 1, high: int = 200) -> int:
    return max(low, min(limit, high))


def resolve_entity(entity: DataFrame, alias: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Entities by id number, name part or alias, best way first, each once; the limit holds for each way and in all."""
    n, wanted = clamp(limit), text.strip().lower()
    ways = [
        entity.where(F.lower("registry_id") == wanted), entity.where(F.contains(F.lower("name"), F.lit(wanted))),
        entity.join(alias.where(F.contains(F.lower("alias"), F.lit(wanted))).select("id").distinct(), "id", "left_semi"),
    ]
    out = None
    for rank, way in enumerate(ways):
        part = entity_summary(way).orderBy("id").limit(n).withColumn("way", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    once = out.groupBy("id").agg(F.min("way").alias("way"), F.first("entity_type").alias("entity_type"), F.first("name").alias("name"))
    return once.orderBy("way", "id").limit(n)


def get_entity(entity: DataFrame, edge: DataFrame, node: int) -> tuple[DataFrame, DataFrame]:
    return entity_summary(entity.where(F.col("id") == node)), neighbours_by_type(edge, node)


def find_paths(edge: DataFrame, start: int, goal: int, hops: int = 2) -> DataFrame:
    """Paths between two entities of at most 1 to 4 hops, those first whose costed edges are all dated, then by their edges."""
    spark = edge.sparkSession
    one = lambda name, v: spark.range(1).select(F.lit(v).cast("long").alias(name))
    found = bounded_paths(edge, one("start", start), one("goal", goal), clamp(hops, 1, 4))
    dated = F.forall(costed("edges"), lambda e: e["valid_from"].isNotNull())
    return found.withColumn("dated", dated).orderBy(F.desc("dated"), F.transform("edges", lambda e: e["edge"]))


def get_attestations(attestation: DataFrame, edge_id: int) -> DataFrame:
    return attestation.where(F.col("edge") == edge_id).orderBy("id")


def list_flags(flags: DataFrame, page: int = 1, size: int = 50, order: str = "subject", **equal) -> DataFrame:
    """A page of flags that have the given values, in a fixed order."""
    for column, value in equal.items():
        flags = flags.where(F.col(column).eqNullSafe(F.lit(value)))
    return flags.orderBy(order).offset((page - 1) * size).limit(size)


def review(flags: DataFrame, decisions: DataFrame) -> DataFrame:
    """flags with the status of their last decision (id, status, seq); only known statuses count."""
    known = decisions.where(F.col("status").isin("pending", "confirmed", "rejected", "escalated")).groupBy("id").agg(F.max_by("status", "seq").alias("decided"))
    return flags.join(known, "id", "left").withColumn("review_status", F.coalesce("decided", "review_status")).drop("decided")


def coverage_report(universe: str, entity: DataFrame, suppliers: DataFrame, cached: DataFrame, attempted: DataFrame) -> DataFrame:
    """One row for a universe of companies, `all` of the register or those that are a `procurement_supplier`: universe, ingested,
    failed, missing, total and the share ingested (null without a company). entity: entity_type, scheme, registry_id; the
    others: company_number."""
    companies = entity.where("entity_type = 'company' AND scheme = 'GB-COH'").select(F.col("registry_id").alias("company_number"))
    if universe not in ("all", "procurement_supplier"):
        raise ValueError(f"no universe {universe!r}: all or procurement_supplier")
    members = companies if universe == "all" else suppliers.select("company_number").dropna()
    counts = pending_roster(members, cached, attempted, "company_number")
    return counts.select(F.lit(universe).alias("universe"), "*", (F.col("ingested") / F.nullif("total", F.lit(0))).alias("share"))


def list_sources(spark: SparkSession, register: DataFrame) -> DataFrame:
    """The register's entries (source_id and whatever it says of each), with whether a connector is there and where it applies."""
    from ledgerlight.sources.connectors import CONNECTORS

    known = spark.createDataFrame([(k, sorted(c.jurisdictions)) for k, c in CONNECTORS.items()], "source_id string, jurisdictions array<string>")
    return register.join(F.broadcast(known), "source_id", "left").withColumn("connected", F.col("jurisdictions").isNotNull()).orderBy("source_id")  # a few rows


def describe_pipeline() -> str:
    """What a new country's source has to bring: the connector contract, as it stands beside the code that checks it."""
    from ledgerlight.sources import connectors

    return f"{connectors.__doc__.strip()}\n\n{connectors.problems.__doc__.strip()}"


def dossier(curated: DataFrame, tender: DataFrame) -> DataFrame:
    """place, heading, tender, buyer, value, method, evidence: what a reviewer is shown of each curated flag, in the list's order.

    curated: indicator, jurisdiction, subject, score, a list of bounded length; tender: tender_id, title, buyer_name,
    value_cents, method, source_id. What isn't known is said to be so, never left blank; a value of nothing isn't one. The
    subject is a tender's id, or begins with one before a colon; of other flags only what they say themselves is shown."""
    known = tender.select(F.col("tender_id").alias("t"), "title", "buyer_name", "value_cents", "method", "source_id")
    place = F.row_number().over(Window.orderBy(F.desc("score"), "indicator", "subject")).cast("long")  # a list of bounded length
    j = curated.withColumn("place", place).withColumn("t", F.substring_index("subject", ":", 1)).join(known, "t", "left")
    said = lambda column, absent: F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(absent))
    value = F.when(F.col("value_cents") > 0, F.format_number(F.col("value_cents") / 100, 2)).otherwise("not available")
    evidence = F.when(F.col("source_id").isNotNull(), F.concat_ws(" ", "source_id", "t")).otherwise("none on record")
    return j.select(
        "place", F.concat(F.lit("Flag "), "place", F.lit(": "), "indicator", F.lit(" in "), said("jurisdiction", "an unknown place")).alias("heading"), said("title", "(no title)").alias("tender"), said("buyer_name", "(unknown buyer)").alias("buyer"),
        value.alias("value"), said("method", "not stated").alias("method"), evidence.alias("evidence"))
