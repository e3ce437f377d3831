"""Public registers turned into entities and edges. Identity is asserted by identifiers; a name decides only if it is unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.scalars import any_date, normalise_company_number, normalise_name

# Donor statuses of organisations, authorities that stand for the companies register, schemas of organisations.
ORGANISATION_DONORS = ("Company", "Trade Union", "Building Society", "Limited Liability Partnership", "Unincorporated Association", "Friendly Society", "Registered Political Party", "Public Fund")
REGISTER_AUTHORITIES = ("RA000585", "RA000586", "RA000587")
SANCTION_SCHEMAS = ("Company", "Organization", "LegalEntity")


def unique_names(company: DataFrame) -> DataFrame:
    """name, by_name: only names that one company bears."""
    return company.groupBy(F.col("normalised_name").alias("name")).agg(F.count("*").alias("n"), F.min("company_number").alias("by_name")).where("n = 1").drop("n")


def donations(rows: DataFrame, company: DataFrame) -> DataFrame:
    """Each donation with outcome, company_number, match_confidence, amount_cents and donated_on.

    rows: donor_status, donor_name, number, value, received, accepted. Individuals are skipped. A number that is given
    decides, and if no company has it the donor is unmatched; only without a number may a unique name decide. The date
    received counts, and the date accepted only where that is blank; one that cannot be read is null and flagged."""
    known = company.select(F.col("company_number").alias("known")).distinct()
    keyed = rows.withColumn("wanted", normalise_company_number(F.col("number"))).withColumn("name", normalise_name(F.trim("donor_name")))
    joined = keyed.join(known, F.col("wanted") == F.col("known"), "left").join(unique_names(company), "name", "left")
    organisation = F.coalesce(F.trim("donor_status").isin(*ORGANISATION_DONORS), F.lit(False))
    number = F.when(organisation & F.col("wanted").isNotNull(), F.col("known")).when(organisation & (F.col("name") != ""), F.col("by_name"))
    received = F.nullif(F.trim("received"), F.lit(""))
    return joined.select(
        *rows.columns, F.when(~organisation, "skipped_individual").when(number.isNull(), "unmatched_donor").otherwise("matched").alias("outcome"), number.alias("company_number"),
        F.when(number.isNull(), 0.0).when(F.col("wanted").isNotNull(), 1.0).otherwise(0.9).alias("match_confidence"),
        F.expr("CAST(round(try_cast(trim(translate(value, '£,', '')) AS DECIMAL(38,6)) * 100) AS BIGINT)").alias("amount_cents"),
        F.when(received.isNotNull(), any_date("received", "dd/MM/yyyy")).otherwise(any_date("accepted", "dd/MM/yyyy")).alias("donated_on"),
        (received.isNotNull() & any_date("received", "dd/MM/yyyy").isNull()).alias("invalid_received"),
    )


def legal_entities(lines: DataFrame, company: DataFrame) -> DataFrame:
    """lei, name, company_number, outcome of identifier records: linked only in jurisdiction GB and if the number is from
    the companies register; the name falls back to the identifier; records without one are left out."""
    field = lambda path: F.nullif(F.trim(F.get_json_object("document", path)), F.lit(""))
    flat = lines.select(
        F.coalesce(field("$.attributes.lei"), field("$.id")).alias("lei"), field("$.attributes.entity.legalName.name").alias("legal"), field("$.attributes.entity.jurisdiction").alias("jurisdiction"),
        field("$.attributes.entity.registeredAt.id").alias("authority"), field("$.attributes.entity.registeredAs").alias("number")).where("lei IS NOT NULL")
    gb = F.coalesce(F.col("jurisdiction") == "GB", F.lit(False))
    wanted = F.when(gb & F.col("authority").isin(*REGISTER_AUTHORITIES), normalise_company_number(F.col("number")))
    known = company.select(F.col("company_number").alias("known")).distinct()
    out = flat.withColumn("wanted", wanted).join(known, F.col("wanted") == F.col("known"), "left")
    outcome = F.when(F.col("known").isNotNull(), "gb_linked").when(gb & F.col("number").isNotNull(), "gb_other_authority").otherwise("unlinked")
    return out.select("lei", F.coalesce("legal", "lei").alias("name"), F.col("known").alias("company_number"), outcome.alias("outcome"))


def sanctioned(lines: DataFrame, lei: DataFrame, company: DataFrame) -> DataFrame:
    """id, name, lei, company_number of organisations: the first listed identifier that exists, each by itself; company
    numbers only if a country or jurisdiction says GB."""
    kind = "STRUCT<id: STRING, schema: STRING, caption: STRING, properties: STRUCT<name: ARRAY<STRING>, leiCode: ARRAY<STRING>, jurisdiction: ARRAY<STRING>, country: ARRAY<STRING>, registrationNumber: ARRAY<STRING>>>"
    r = lines.select(F.from_json("document", kind).alias("r")).where(F.col("r.id").isNotNull() & (F.col("r.id") != "") & F.col("r.schema").isin(*SANCTION_SCHEMAS))
    none = F.array().cast("array<string>")
    base = r.select(
        F.col("r.id").alias("id"), F.coalesce("r.caption", F.try_element_at("r.properties.name", F.lit(1)), "r.id").alias("name"), F.coalesce("r.properties.leiCode", none).alias("codes"),
        F.transform(F.concat(F.coalesce("r.properties.jurisdiction", none), F.coalesce("r.properties.country", none)), lambda x: F.lower(F.trim(x))).alias("places"), F.coalesce("r.properties.registrationNumber", none).alias("numbers"))
    lists = base.select("id", F.explode(F.array(F.struct(F.lit("lei").alias("kind"), "codes"), F.struct(F.lit("number").alias("kind"), F.when(F.array_contains("places", "gb"), F.col("numbers")).otherwise(none).alias("codes")))).alias("k")).select("id", "k.kind", F.posexplode("k.codes").alias("place", "code"))
    keyed = lists.select("id", "kind", "place", F.when(F.col("kind") == "lei", F.trim("code")).otherwise(normalise_company_number(F.col("code"))).alias("code"))
    known = lei.select(F.lit("lei").alias("kind"), F.col("lei").alias("code")).unionByName(company.select(F.lit("number").alias("kind"), F.col("company_number").alias("code"))).distinct()
    first = keyed.join(known, ["kind", "code"]).groupBy("id").agg(F.min_by(F.when(F.col("kind") == "lei", F.col("code")), F.when(F.col("kind") == "lei", F.col("place"))).alias("lei"), F.min_by(F.when(F.col("kind") == "number", F.col("code")), F.when(F.col("kind") == "number", F.col("place"))).alias("company_number"))
    return base.select("id", "name").join(first, "id", "left")


def leaf_interests(lines: DataFrame) -> DataFrame:
    """interest, fields (map of name to value) of each leaf: a child's fields over its parent's; one without children is its
    own leaf; of several donors each is a unit."""
    kind = "STRUCT<id: STRING, fields: ARRAY<STRUCT<name: STRING, value: STRING>>, childInterests: ARRAY<STRUCT<id: STRING, fields: ARRAY<STRUCT<name: STRING, value: STRING>>>>>"
    r = lines.select(F.from_json("document", kind).alias("r")).where("r.id IS NOT NULL")
    empty = F.array().cast("array<struct<name:string,value:string>>")
    as_map = lambda a: F.map_from_entries(F.filter(F.coalesce(a, empty), lambda f: f["name"].isNotNull()))
    own = F.struct(F.col("r.id").alias("id"), F.col("r.fields").alias("fields"))
    leaves = F.when(F.size(F.coalesce("r.childInterests", F.array().cast("array<struct<id:string,fields:array<struct<name:string,value:string>>>>"))) > 0, F.col("r.childInterests")).otherwise(F.array(own))
    each = r.select(as_map(F.col("r.fields")).alias("parent"), F.explode(leaves).alias("leaf")).select("parent", F.col("leaf.id").alias("interest"), as_map(F.col("leaf.fields")).alias("child"))
    kept = F.map_filter("parent", lambda k, v: ~F.map_contains_key("child", k))
    return each.select("interest", F.map_concat(kept, "child").alias("fields"))


def value_band(text: Column) -> tuple[Column, Column]:
    """Least and greatest cents that a band names; null where it names none. No midpoint is made up."""
    amount = lambda pattern, i: F.regexp_replace(F.regexp_extract(text, pattern, i), ",", "")
    cents = lambda c: F.when(c != "", (F.nullif(c, F.lit("")).cast("decimal(38,2)") * 100).cast("long"))
    both, more, less = r"(?i)between\s*£([\d,]+)\s*and\s*£([\d,]+)", r"(?i)more than\s*£([\d,]+)", r"(?i)less than\s*£([\d,]+)"
    is_both, is_more = amount(both, 1) != "", amount(more, 1) != ""
    low = F.when(is_both, cents(amount(both, 1))).otherwise(cents(amount(more, 1)))
    high = F.when(is_both, cents(amount(both, 2))).when(~is_more, cents(amount(less, 1)))
    return low, high


def wayback_time(text: str) -> Column:
    """The instant of an archive's timestamp of 14, 12, 10, 8, 6 or 4 digits; null for any other."""
    t = F.col(text)
    padded = F.concat(t, F.substring(F.lit("00000101000000"), F.length(t) + 1, F.lit(14)))
    return F.when(F.length(t).isin(4, 6, 8, 10, 12, 14) & t.rlike("^[0-9]+$"), F.try_to_timestamp(padded, F.lit("yyyyMMddHHmmss")))


def officers(rows: DataFrame) -> DataFrame:
    """registry_id, scheme, confidence, status of each appointment: without an officer's id the identity is scoped to the
    company and its name, and weak; an end that cannot be read is unknown, never "still serving"."""
    has_id = F.coalesce(F.col("officer_id") != "", F.lit(False))
    resigned = F.nullif(F.trim("resigned"), F.lit(""))
    status = F.when(resigned.isNull(), "serving").when(any_date("resigned", "yyyy-MM-dd").isNull(), "ended_date_unknown").otherwise("ended")
    return rows.select(
        *rows.columns, F.when(has_id, F.col("officer_id")).otherwise(F.concat_ws(":", "company_number", normalise_name(F.col("officer_name")))).alias("registry_id"),
        F.when(has_id, "GB-COH-OFFICER").otherwise("GB-COH-OFFICER-UNRESOLVED").alias("scheme"), F.when(has_id, 1.0).otherwise(0.5).alias("confidence"), status.alias("status"))


def appointments(rows: DataFrame, persons: DataFrame, company: DataFrame) -> DataFrame:
    """officer_id, company_number, valid_from, valid_to, status of second-hop appointments: persons are never created, companies
    must exist, and dates that contradict each other are both left out.

    rows: officer_id, company_number, appointed, resigned; persons: officer_id."""
    known = company.select(F.col("company_number").alias("known")).distinct()
    mine = rows.join(persons.select("officer_id").distinct(), "officer_id", "left_semi").join(known, normalise_company_number(F.col("company_number")) == F.col("known"))
    since, until = any_date("appointed", "yyyy-MM-dd"), any_date("resigned", "yyyy-MM-dd")
    wrong = F.coalesce(until < since, F.lit(False))
    ended = F.nullif(F.trim("resigned"), F.lit("")).isNotNull()
    status = F.when(wrong, "inconsistent_source_dates").when(ended & until.isNull(), "ended_date_unknown").when(ended, "ended").otherwise("serving")
    return mine.select("officer_id", F.col("known").alias("company_number"), F.when(~wrong, since).alias("valid_from"), F.when(~wrong, until).alias("valid_to"), status.alias("status")).distinct()


def overseas_owners(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of corporate owners and managing officers (entity, other, edge_type), and a count of the individuals still in
    place, of whom nothing else is kept. rows: entity, role (owner, officer), kind, name, number, ceased."""
    corporate = F.contains(F.lower("kind"), F.lit("corporate")) | F.contains(F.lower("kind"), F.lit("legal-person"))
    other = F.coalesce(normalise_company_number(F.col("number")), F.concat_ws(":", "entity", normalise_name(F.col("name"))))
    edges = rows.where(F.coalesce(corporate, F.lit(False))).select("entity", other.alias("other"), F.when(F.col("role") == "owner", "ownership").otherwise("officer_of").alias("edge_type")).distinct()
    people = rows.where(~F.coalesce(corporate, F.lit(False)) & (F.coalesce("ceased", F.lit("")) == "")).groupBy("entity").agg(F.count("*").alias("individuals"))
    return edges, people


def register_pages(pages: DataFrame) -> DataFrame:
    """page, member_id, name, place, category, description of a register's HTML: one row per entry. Members without
    registrable interests have none. pages: page, html."""
    from collections.abc import Iterator

    import pyarrow as pa

    kind = "page string, member_id string, name string, place int, category string, description string"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from html.parser import HTMLParser

        void = {"br", "img", "input", "link", "meta", "hr", "source", "wbr"}

        class Register(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.stack, self.members, self.text = [], [], None

            def handle_starttag(self, tag, attrs):
                attrs = dict(attrs)
                classes = (attrs.get("class") or "").split()
                role = None
                if "member/" in (attrs.get("href") or ""):
                    found = attrs["href"].split("member/", 1)[1]
                    self.members.append({"id": found[: len(found) - len(found.lstrip("0123456789"))] or None, "name": "", "entries": [], "category": "", "nil": False})
                elif self.members and "primary-info" in classes:
                    role = "category" if any(r == "child" for _, r in self.stack) else "name"
                elif self.members and "card-child" in classes:
                    role = "child"
                elif self.members and tag == "li":
                    role = "li"
                if role in ("category", "name", "li"):
                    self.text = []
                if tag not in void:
                    self.stack.append((tag, role))

            def handle_data(self, data):
                if self.text is not None:
                    self.text.append(data.strip())
                if self.members and "No registrable interests" in data:
                    self.members[-1]["nil"] = True

            def handle_endtag(self, tag):
                while self.stack and any(t == tag for t, _ in self.stack):
                    last, role = self.stack.pop()
                    if role in ("category", "name", "li"):
                        said, self.text = "".join(self.text or ()), None
                        member = self.members[-1]
                        if role == "li":
                            if said and member["category"]:
                                member["entries"].append((member["category"], said))
                        elif not member[role]:
                            member[role] = said
                        elif role == "category":
                            member["category"] = said
                    if last == tag:
                        return

        for batch in batches:
            out = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parser = Register()
                parser.feed(html or "")
                parser.close()
                for m in parser.members:
                    found = [] if m["nil"] else m["entries"]
                    out += [{"page": page, "member_id": m["id"], "name": m["name"], "place": i, "category": c, "description": d} for i, (c, d) in enumerate(found)]
            schema = pa.schema([(x.split()[0], pa.int32() if x.endswith("int") else pa.string()) for x in kind.split(", ")])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return pages.select(F.col("page").cast("string").alias("page"), "html").mapInArrow(parse, kind)


def money_of(fields: Column) -> Column:
    """struct(exact, low, high) in cents of an interest's fields: a decimal value counts, else the band that a text names."""
    said = F.coalesce(fields["Value"], F.lit(""))
    exact = F.round(F.nullif(F.translate(F.trim(said), "£,", ""), F.lit("")).try_cast("decimal(38,6)") * 100).cast("long")
    low, high = value_band(F.coalesce(fields["ValueBand"], F.lit("")))
    return F.struct(exact.alias("exact"), F.when(exact.isNull(), low).alias("low"), F.when(exact.isNull(), high).alias("high"))


def relinked(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row: links (lei, company_number) of stored records that a new resolution removes, adds, changes or leaves."""
    j = stored.select("lei", F.col("company_number").alias("was")).join(fresh.select("lei", F.col("company_number").alias("now")), "lei")
    same = F.col("was").eqNullSafe(F.col("now"))
    return j.agg(
        F.count_if(F.col("was").isNotNull() & F.col("now").isNull()).alias("removed"), F.count_if(F.col("was").isNull() & F.col("now").isNotNull()).alias("added"),
        F.count_if(~same & F.col("was").isNotNull() & F.col("now").isNotNull()).alias("changed"), F.count_if(same).alias("unchanged"))


def snapshot_attestations(entries: DataFrame) -> DataFrame:
    """member_id, description, reference: one attestation of the same edge for each snapshot and page on which it stands.
    entries: member_id, description, captured (a timestamp's digits), page_no."""
    reference = F.concat("member_id", F.lit(":"), "captured", F.lit(":p"), F.lpad(F.col("page_no").cast("string"), 2, "0"))
    return entries.select("member_id", "description", reference.alias("reference")).distinct()


def interest_edges(leaves: DataFrame, family: tuple[str, ...] = ("Family",)) -> DataFrame:
    """interest, donor, organisation, since, until, inverted of leaf interests with their fields: categories of family are
    dropped, each of several donors is a unit, only what says so is an organisation, and an end before its start is no end.
    leaves: interest, category, fields (map)."""
    kept = leaves.where(~F.coalesce(F.exists(F.array(*map(F.lit, family)), lambda w: F.contains("category", w)), F.lit(False)))
    donors = F.from_json(F.col("fields")["Donor"], "ARRAY<STRUCT<Name: STRING, Status: STRING>>")
    own = F.array(F.struct(F.col("fields")["OrganisationName"].alias("Name"), F.col("fields")["Status"].alias("Status")))
    each = kept.select("interest", "fields", F.explode(F.when(F.size(donors) > 0, donors).otherwise(own)).alias("d"))
    day = lambda k: F.try_to_date(F.col("fields")[k], "yyyy-MM-dd")
    inverted = F.coalesce(day("EndDate") < day("StartDate"), F.lit(False))
    return each.select("interest", F.col("d.Name").alias("donor"), F.coalesce(F.col("d.Status").isin(*ORGANISATION_DONORS), F.lit(False)).alias("organisation"), day("StartDate").alias("since"), F.when(~inverted, day("EndDate")).alias("until"), inverted.alias("inverted"))
