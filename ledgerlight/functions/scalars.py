"""Scalar functions as Column expressions: all run inside whole-stage code generation, none in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark frameworks, and supplier names that name no one.
FRAMEWORK_KEYWORDS = ("framework", "dynamic purchasing", "dps", "call-off", "call off", "supplier list")
PLACEHOLDER_SUPPLIERS = ("various", "multiple", "multiple suppliers", "n/a", "na", "none", "not applicable", "tbc", "unknown", "-", "")
# Legal forms, in the order in which they are tried.
LEGAL_SUFFIXES = ("LTD", "LIMITED", "PLC", "LLP", "LP", "CIC", "CIO")
LOOSE_WORDS = ("LIMITED", "LTD", "PLC", "LLP", "LP", "INTERNATIONAL", "UK", "THE", "AND", "CO")
# Titles and post-nominals that are no family name.
NOT_SURNAMES = ("of", "the", "lord", "lady", "baroness", "baron", "sir", "dame", "mp", "msp", "qc", "kc", "obe", "cbe", "mbe", "dbe", "kbe", "gbe", "phd", "prof", "dr", "mr", "mrs", "ms", "rt", "hon", "esq")


def normalise_name(name: Column) -> Column:
    """Upper case, white space folded; legal forms stay."""
    return F.trim(F.regexp_replace(F.upper(name), r"\s+", " "))


def loose_name(name: Column) -> Column:
    """Only letters and digits, without words that do not tell companies apart."""
    plain = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, rf"\b({'|'.join(LOOSE_WORDS)})\b", " "), " +", " "))


def strict_name(name: Column) -> Column:
    return F.regexp_replace(F.upper(name), "[^A-Z0-9]", "")


def strip_suffix(name: Column) -> Column:
    """The normalised name without its legal form, if one ends it."""
    return F.regexp_replace(normalise_name(name), f" ({'|'.join(LEGAL_SUFFIXES)})$", "")


def legal_name(name: Column) -> Column:
    """What stands before "t/a", "trading as" or "TA"."""
    return F.trim(F.regexp_replace(name, r"(?is)\b(t/a|trading as|ta)\b.*$", ""))


def surname(name: Column) -> Column:
    """The last word that can be a family name: before a comma, before "of", titles left out; empty if there is none."""
    head = F.regexp_replace(F.substring_index(F.coalesce(name, F.lit("")), ",", 1), r"(?is)\s+of\s+.*$", "")
    words = F.filter(F.split(head, "[^A-Za-z]+"), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*NOT_SURNAMES))
    return F.coalesce(F.lower(F.try_element_at(words, F.lit(-1))), F.lit(""))


def normalise_company_number(value: Column) -> Column:
    """Eight characters: digits padded with zeros, those behind a letter prefix too; what does not fit stays as it is."""
    v = F.upper(F.trim(value))
    prefix, digits = F.regexp_extract(v, "^([A-Z]+)([0-9]+)$", 1), F.regexp_extract(v, "^([A-Z]+)([0-9]+)$", 2)
    return (
        F.when(v == "", None).when(F.length(v) >= 8, v).when(v.rlike("^[0-9]+$"), F.lpad(v, 8, "0"))
        .when(prefix != "", F.concat(prefix, F.lpad(digits, F.greatest(8 - F.length(prefix), F.length(digits)), F.lit("0")))).otherwise(v)
    )


def to_cents(value: Column) -> Column:
    """Cents, half away from zero; zero for null, blank or unreadable values."""
    return F.coalesce(F.round(F.expr("try_cast(`{0}` AS DECIMAL(38,6))".format(_name(value))) * 100).cast("long"), F.lit(0).cast("long"))


def donation_cents(value: str) -> Column:
    """Cents of a value with a pound sign and commas; null if unreadable."""
    return F.expr(f"CAST(round(try_cast(translate(`{value}`, '£,', '') AS DECIMAL(38,6)) * 100) AS BIGINT)")


def _name(value: Column | str) -> str:
    return value if isinstance(value, str) else value._jc.toString()


def safe_int(value: str) -> Column:
    """Cut towards zero; zero if unreadable."""
    return F.expr(f"coalesce(CAST(try_cast(`{value}` AS DOUBLE) AS BIGINT), 0)")


def any_date(value: str, *formats: str) -> Column:
    """The first format that reads the text, else null."""
    return F.coalesce(*(F.try_to_date(F.col(value), f) for f in formats))


def floored_days(start: Column, end: Column) -> Column:
    """Whole days between timestamps, rounded down, so minus one for anything before."""
    return F.floor(F.timestamp_diff("SECOND", start, end) / 86400)


def is_framework(title: Column, method: Column, details: Column, raw_json: Column) -> Column:
    """A keyword in the texts, or the techniques of the tender (of the document, if its tender is no object) say so."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(method, F.lit("")), F.coalesce(details, F.lit(""))))
    said = F.get_json_object(raw_json, "$.tender")
    deep, flat = F.get_json_object(raw_json, "$.tender.techniques.hasFrameworkAgreement"), F.get_json_object(raw_json, "$.techniques.hasFrameworkAgreement")
    value = F.when(F.substring(F.trim(said), 1, 1) == "{", deep).otherwise(flat)
    truthy = value.isNotNull() & ~F.lower(value).isin("false", "null", "0", "", "[]", "{}")
    return F.coalesce(truthy, F.lit(False)) | _any_word(text, FRAMEWORK_KEYWORDS)


def _any_word(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def contains_any(text: Column, words) -> Column:
    return _any_word(F.lower(F.coalesce(text, F.lit(""))), words)


def is_placeholder(name: Column) -> Column:
    return F.lower(F.trim(name)).isin(*PLACEHOLDER_SUPPLIERS)


def severity_band(span_days: Column, window: int) -> Column:
    return F.when(span_days <= 1, "same-day").when(span_days <= 7, "same-week").otherwise(f"within-{window}d")


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The score interval, cut to 0 and 1; null for no trials."""
    p = hits / F.nullif(n, F.lit(0))
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def int_or_null(value: str) -> Column:
    """Cut towards zero; null if unreadable."""
    return F.expr(f"CAST(try_cast(trim(`{value}`) AS DOUBLE) AS BIGINT)")


def instant(value: str) -> Column:
    """A date or an ISO time as a timestamp; without a zone it is UTC; null if unreadable."""
    text = F.trim(F.col(value))
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$") | (F.length(text) <= 10), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d([T ]|$)"), F.try_to_timestamp(zoned))


def days_between(first: str, second: str) -> Column:
    """Days from one ISO date text to another; null if either cannot be read."""
    day = lambda c: F.try_to_date(F.substring(F.trim(F.col(c)), 1, 10), "yyyy-MM-dd")
    return F.date_diff(day(second), day(first)).cast("long")


def percent_text(ratio: Column) -> Column:
    """Whole percent, halves to the even one."""
    return F.concat(F.bround(ratio * 100, 0).cast("long").cast("string"), F.lit("%"))


def money_text(cents: Column) -> Column:
    """Two decimals, with commas between thousands."""
    return F.format_number(cents.cast("decimal(38,0)") / 100, 2)


def confidence_note(confidence: Column, method: Column) -> Column:
    """What is said of a match in every explanation, whether sure or not."""
    return F.concat(F.lit("[match_confidence="), F.coalesce(confidence.cast("string"), F.lit("unknown")), F.lit(", method="), F.coalesce(method, F.lit("unknown")), F.lit("]"))


def tri_state(text: Column) -> Column:
    """True, false, or null for anything that is neither."""
    said = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(said.isin("yes", "true", "y", "1"), True).when(said.isin("no", "false", "n", "0"), False)


def listed(text: Column, mark: str) -> Column:
    """The parts between marks, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\" + mark), lambda x: F.trim(x)), lambda x: x != "")


def subject_tender(subject: Column) -> Column:
    """What stands before the first colon of a flag's subject."""
    return F.substring_index(subject, ":", 1)


def domain(url: Column) -> Column:
    """Host of a URL in lower case without "www."; null if it has none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
