"""Scans and flattening of source documents into tender, award and bid rows.

A document is one JSON text; nothing that cannot be read stops a scan: it is counted and left out. Rows are upserted by
natural key with operators.sequence.last_write().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.scalars import any_date, normalise_company_number, normalise_name, to_cents

PERSONAL = ("date_of_birth", "address", "nationality", "occupation")

UA = """STRUCT<id: STRING, tenderID: STRING, title: STRING, procurementMethod: STRING, procurementMethodType: STRING, value: STRUCT<amount: STRING, currency: STRING>,
 tenderPeriod: STRUCT<startDate: STRING, endDate: STRING>, procuringEntity: STRUCT<name: STRING, identifier: STRUCT<scheme: STRING, id: STRING>>, items: ARRAY<STRING>,
 awards: ARRAY<STRUCT<id: STRING, status: STRING, date: STRING, value: STRUCT<amount: STRING, currency: STRING>, suppliers: ARRAY<STRUCT<name: STRING, identifier: STRUCT<scheme: STRING, id: STRING>>>>>,
 bids: ARRAY<STRUCT<id: STRING, status: STRING, date: STRING, value: STRUCT<amount: STRING, currency: STRING>, tenderers: ARRAY<STRUCT<name: STRING, identifier: STRUCT<scheme: STRING, id: STRING>>>>>>"""
PARTY = "STRUCT<id: STRING, name: STRING, roles: ARRAY<STRING>, identifier: STRUCT<scheme: STRING, id: STRING>>"
OCDS = f"""STRUCT<ocid: STRING, tender: STRUCT<id: STRING, title: STRING, procurementMethod: STRING, procurementMethodDetails: STRING, value: STRUCT<amount: STRING, currency: STRING>, items: ARRAY<STRING>>,
 parties: ARRAY<{PARTY}>, awards: ARRAY<STRUCT<id: STRING, status: STRING, date: STRING, value: STRUCT<amount: STRING, currency: STRING>, suppliers: ARRAY<{PARTY}>>>>"""


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """document, for each line that is not blank; gzipped files are read as such."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("document"))


def scan_counts(lines: DataFrame) -> DataFrame:
    """One row: lines, malformed (not JSON objects)."""
    ok = F.try_parse_json("document").isNotNull() & F.startswith(F.ltrim("document"), F.lit("{"))
    return lines.agg(F.count("*").alias("lines"), F.count_if(~ok).alias("malformed"))


def prozorro(lines: DataFrame) -> dict[str, DataFrame]:
    """tender, award, bid rows. The tender is under `data` or the root; the first supplier or bidder counts; no id, no row."""
    root = F.coalesce(F.get_json_object("document", "$.data"), F.col("document"))
    t = lines.select(F.from_json(root, UA).alias("t")).where("t.id IS NOT NULL AND t.id <> ''")
    tender = t.select(
        F.lit("ua_prozorro").alias("source_id"), F.col("t.id").alias("tender_id"), F.col("t.tenderID").alias("ocid"), F.col("t.title").alias("title"), F.col("t.procurementMethod").alias("method"),
        F.col("t.procurementMethodType").alias("details"), F.coalesce(F.nullif("t.value.currency", F.lit("")), F.lit("UAH")).alias("currency"), F.col("t.value.amount").alias("amount"),
        F.col("t.procuringEntity.name").alias("buyer_name"), F.coalesce(F.size("t.items"), F.lit(0)).alias("item_count"))
    award = t.select("t.id", F.explode("t.awards").alias("a")).where("a.id IS NOT NULL AND a.id <> ''").select(
        F.col("id").alias("tender_id"), F.col("a.id").alias("award_id"), F.col("a.status").alias("status"), F.try_element_at("a.suppliers", F.lit(1))["name"].alias("supplier_name"),
        F.try_element_at("a.suppliers", F.lit(1))["identifier"]["id"].alias("supplier_number"), F.coalesce(F.nullif("a.value.currency", F.lit("")), F.lit("UAH")).alias("currency"), F.col("a.value.amount").alias("amount"))
    bid = t.select("t.id", F.explode("t.bids").alias("b")).where("b.id IS NOT NULL AND b.id <> ''").select(
        F.col("id").alias("tender_id"), F.col("b.id").alias("bid_id"), F.try_element_at("b.tenderers", F.lit(1))["name"].alias("bidder_name"), F.col("b.value.amount").alias("amount"))
    return {k: v.withColumn("value_cents", to_cents(F.col("amount"))).drop("amount") for k, v in (("tender", tender), ("award", award), ("bid", bid))}


def contracts_finder(lines: DataFrame) -> dict[str, DataFrame]:
    """tender and award rows: one award row per supplier, numbered if there are several, whose value is then a shared ceiling.

    A supplier's identifier is its own, else that of the last party with its id, else of the last with its name; an
    identifier that is empty is as good as none. The buyer is the first party with that role."""
    r = lines.select(F.from_json("document", OCDS).alias("r")).where("r.ocid IS NOT NULL AND r.ocid <> ''")
    buyer = F.try_element_at(F.filter("r.parties", lambda p: F.array_contains(F.coalesce(p["roles"], F.array().cast("array<string>")), "buyer")), F.lit(1))
    tender_id = F.coalesce("r.tender.id", "r.ocid")
    tender = r.select(
        F.lit("uk_contracts_finder").alias("source_id"), tender_id.alias("tender_id"), F.col("r.ocid").alias("ocid"), F.col("r.tender.title").alias("title"), F.col("r.tender.procurementMethod").alias("method"),
        F.col("r.tender.procurementMethodDetails").alias("details"), F.coalesce(F.nullif("r.tender.value.currency", F.lit("")), F.lit("GBP")).alias("currency"), F.col("r.tender.value.amount").alias("amount"),
        buyer["name"].alias("buyer_name"), buyer["identifier"]["id"].alias("buyer_id"))
    each = r.select(tender_id.alias("tender_id"), F.col("r.parties").alias("parties"), F.explode("r.awards").alias("a")).where("a.id IS NOT NULL AND a.id <> ''")
    each = each.select("tender_id", "parties", "a", F.size("a.suppliers").alias("n"), F.posexplode("a.suppliers").alias("place", "s"))
    last = lambda field: F.try_element_at(F.filter("parties", lambda p: (p[field] == F.col("s")[field]) & (F.col("s")[field] != "")), F.lit(-1))["identifier"]["id"]
    number = F.coalesce(F.nullif(F.col("s.identifier.id"), F.lit("")), F.nullif(last("id"), F.lit("")), F.nullif(last("name"), F.lit("")))
    award = each.select(
        "tender_id", F.when(F.col("n") > 1, F.concat("a.id", F.lit(":"), F.col("place").cast("string"))).otherwise(F.col("a.id")).alias("award_id"), F.col("s.name").alias("supplier_name"), number.alias("supplier_number"),
        F.when(F.col("n") > 1, "shared_ceiling").otherwise("per_supplier").alias("value_kind"), F.col("a.status").alias("status"), F.coalesce(F.nullif("a.value.currency", F.lit("")), F.lit("GBP")).alias("currency"), F.col("a.value.amount").alias("amount"))
    return {k: v.withColumn("value_cents", to_cents(F.col("amount"))).drop("amount") for k, v in (("tender", tender), ("award", award))}


def secop(lines: DataFrame) -> dict[str, DataFrame]:
    """tender rows, and award rows of those awarded; an award without an id is <tender>-award."""
    field = lambda name: F.get_json_object("document", f"$.{name}")
    rows = lines.select(field("id_del_proceso").alias("tender_id"), field("nombre_del_procedimiento").alias("title"), field("modalidad_de_contratacion").alias("method"), field("precio_base").alias("amount"), field("entidad").alias("buyer_name"),
                        field("adjudicado").alias("awarded"), field("id_adjudicacion").alias("award_id"), field("nombre_del_proveedor").alias("supplier_name"), field("valor_total_adjudicacion").alias("won")).where("tender_id <> ''")
    tender = rows.select("tender_id", "title", "method", "buyer_name", F.lit("COP").alias("currency"), to_cents(F.col("amount")).alias("value_cents"))
    award = rows.where(F.col("awarded").isin("Sí", "Si", "si", "sí")).select(
        "tender_id", F.coalesce(F.nullif("award_id", F.lit("")), F.concat("tender_id", F.lit("-award"))).alias("award_id"), "supplier_name", F.lit("active").alias("status"), F.lit("COP").alias("currency"), to_cents(F.col("won")).alias("value_cents"))
    return {"tender": tender, "award": award}


INGESTERS: dict[str, Callable[[DataFrame], dict[str, DataFrame]]] = {"ua_prozorro": prozorro, "uk_contracts_finder": contracts_finder, "co_secop_ii": secop}


def ingest(source_id: str, lines: DataFrame) -> dict[str, DataFrame]:
    if source_id not in INGESTERS:
        raise ValueError(f"no ingester for source {source_id!r}")
    return INGESTERS[source_id](lines)


def companies_csv(spark: SparkSession, path: str) -> DataFrame:
    """Company rows of a bulk CSV: header names without case, spaces, underscores and dots; rows without a number left out;
    dates as dd/mm/yyyy or ISO; blank cells null; the four activity codes as a list."""
    return company_rows(spark.read.csv(path, header=True, encoding="UTF-8", escape='"'))


def company_rows(raw: DataFrame) -> DataFrame:
    """The same for cells that have been read, all strings."""
    names = {"".join(c for c in n.lower() if c not in " _."): n for n in raw.columns}
    cell = lambda *keys: F.nullif(F.trim(next((F.col(f"`{names[k]}`") for k in keys if k in names), F.lit(None).cast("string"))), F.lit(""))
    flat = raw.select(
        normalise_company_number(cell("companynumber")).alias("company_number"), cell("companyname").alias("company_name"), cell("companystatus").alias("company_status"), cell("incorporationdate").alias("i"),
        cell("accountsaccountcategory", "accountscategory").alias("accounts_category"), cell("accountslastmadeupdate").alias("m"), F.filter(F.array(*(cell(f"siccodesictext{i}") for i in range(1, 5))), lambda x: x.isNotNull()).alias("sic_codes"))
    return flat.where("company_number IS NOT NULL").withColumn("normalised_name", normalise_name(F.col("company_name"))).withColumn("incorporation_date", any_date("i", "dd/MM/yyyy", "yyyy-MM-dd")).withColumn("last_made_up", any_date("m", "dd/MM/yyyy", "yyyy-MM-dd")).drop("i", "m")


def ingest_counts(source_id: str, lines: DataFrame) -> DataFrame:
    """One row: documents that gave a tender (ingested) and those that did not (failed), and rows by kind. One document
    that cannot be read stops no other."""
    made = ingest(source_id, lines)
    out = lines.agg(F.count("*").alias("documents"))
    for kind, rows in made.items():
        out = out.crossJoin(rows.agg(F.count("*").alias(f"{kind}s")))  # one row each
    return out.withColumn("ingested", F.col("tenders")).withColumn("failed", F.col("documents") - F.col("tenders"))


def cohort_awards(lines: DataFrame) -> DataFrame:
    """tender_id, award_id, supplier_name, award_date (text), value (double) of OCDS documents: a supplier without a name has
    that of the party with its id; the date is the first ten characters."""
    r = lines.select(F.from_json("document", OCDS).alias("r")).where("r.ocid IS NOT NULL AND r.ocid <> ''")
    each = r.select(F.coalesce("r.tender.id", "r.ocid").alias("tender_id"), F.col("r.parties").alias("parties"), F.explode("r.awards").alias("a"))
    each = each.select("tender_id", "parties", "a", F.explode_outer("a.suppliers").alias("s"))
    party = F.try_element_at(F.filter("parties", lambda p: p["id"] == F.col("s.id")), F.lit(1))["name"]
    return each.select("tender_id", F.col("a.id").alias("award_id"), F.coalesce(F.nullif("s.name", F.lit("")), party).alias("supplier_name"), F.substring("a.date", 1, 10).alias("award_date"), F.col("a.value.amount").try_cast("double").alias("value"))


def cached_fetches(content: DataFrame, sidecar: DataFrame, now, most_days: int) -> DataFrame:
    """key, hit, reason: a stored fetch is a miss if its record is missing or unreadable, too old, or of other content.

    content: key, content (binary); sidecar: key, json with sha256 and fetched_at."""
    meta = F.from_json("json", "STRUCT<sha256: STRING, fetched_at: TIMESTAMP>")
    joined = content.join(sidecar.select("key", meta.alias("meta"), F.lit(True).alias("there")), "key", "left")
    age = F.floor(F.timestamp_diff("SECOND", F.col("meta.fetched_at"), now) / 86400)
    reason = (
        F.when(F.col("there").isNull(), "missing").when(F.col("meta.sha256").isNull() | F.col("meta.fetched_at").isNull(), "corrupt").when(age > most_days, "stale")
        .when(F.col("meta.sha256") != F.sha2("content", 256), "mismatch")
    )
    return joined.select("key", reason.isNull().alias("hit"), reason.alias("reason"))


def wayback_rows(json_array: DataFrame) -> DataFrame:
    """timestamp, original, digest of each capture; the first row of the array is the header."""
    rows = json_array.select(F.posexplode(F.from_json("document", "ARRAY<ARRAY<STRING>>")).alias("place", "row")).where("place > 0")
    return rows.select(F.col("row")[0].alias("timestamp"), F.col("row")[1].alias("original"), F.col("row")[2].alias("digest")).dropDuplicates(["digest"])


def without_personal(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """Only the columns on the list; what is not on it never leaves the scan."""
    return rows.select(*[c for c in rows.columns if c in allowed and c not in PERSONAL])


def donation_rows(raw: DataFrame) -> DataFrame:
    """reference and cells of a donation file under the names that registers.donations() reads; rows without a reference are left out."""
    keys = {"ecref": "reference", "donorstatus": "donor_status", "donorname": "donor_name", "companyregistrationnumber": "number", "value": "value", "receiveddate": "received", "accepteddate": "accepted"}
    there = {"".join(c for c in n.lower() if c not in " _."): n for n in raw.columns}
    cells = [(F.col(f"`{there[k]}`") if k in there else F.lit(None)).cast("string").alias(name) for k, name in keys.items()]
    return raw.select(*cells).where(F.trim("reference") != "")


def page_records(pages: DataFrame) -> DataFrame:
    """id, attributes (JSON) of the records on pages (document: JSON with an array `data`); one that is on two pages counts once."""
    data = F.from_json("document", "STRUCT<data: ARRAY<STRUCT<id: STRING, attributes: STRING>>>")["data"]
    return pages.select(F.explode(data).alias("d")).select("d.id", "d.attributes").groupBy("id").agg(F.min("attributes").alias("attributes"))


def enumerated(rows: DataFrame, prefix: str) -> DataFrame:
    """rows with `wanted`: whether their number belongs to a kind of company, by its prefix."""
    return rows.withColumn("wanted", F.coalesce(F.startswith(normalise_company_number(F.col("company_number")), F.lit(prefix)), F.lit(False)))
