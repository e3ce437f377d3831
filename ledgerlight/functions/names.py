"""Names of people and of organisations in register entries, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles, forms of address, legal forms and kinds of organisation, words of running text, months.
PEERAGE = ("lord", "lady", "baroness", "baron", "earl", "countess", "viscount", "viscountess", "duke", "duchess", "marquess", "marchioness")
TITLES = (*PEERAGE, "sir", "dame")
PREFIXES = ("the", "rt", "hon", "mr", "mrs", "ms", "dr", "prof")
FUNCTIONAL = ("bishop", "archbishop", "speaker")
ORGANISATIONS = (
    "Ltd Limited LLP plc CIC Foundation Trust Society Board Authority Group Association Charity University College School Partnership Holdings Capital Fund Enterprise Enterprises "
    "Council Committee Commission Institute Institution Agency Bureau Church Embassy Ministry Chambers Programme Federation Alliance Network Forum Confederation Systems Corporation Corp Inc LLC LP "
    "GmbH AG SA SE NV BV ASA SRL SpA Oy AB KG Ltda Limitada Company Companies"
).split()
SUFFIXES = "Ltd Limited LLP plc Inc LLC LP Corp GmbH AG SA".split()
PROSE = (" is ", " are ", " was ", " were ", " has ", " have ", "full details", "the member", "The member", "registrar", "Registrar", " no shares", " which ", " who ", " whom ", ";", ":")
CONNECTORS = ("the", "a", "an", "and", "of", "for", "in", "at", "&", "to", "on", "with")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


# A person's name is folded to lower-case words one blank apart, and then one pattern takes it to pieces.
_TITLE, _FRONT, _OFFICE = ("|".join(x) for x in (TITLES, TITLES + PREFIXES, FUNCTIONAL))
_SEATED = rf"^((?:(?:{_FRONT})(?: |$))*+)(.*?) ?(?:\bof (.+))?$"
# Titles that mean the same rank.
SAME_RANK = {"baron": "lord", "baroness": "lady"}


def folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z'&\-]+", " "))


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def same_territory(member: Column, officer: Column) -> Column:
    """Unless both provably disagree: officers' are often left out, members' never; post-nominals may follow an officer's."""
    return F.when(officer.isNull(), True).when(member.isNull(), False).otherwise((officer == member) | F.startswith(officer, F.concat(member, F.lit(" "))))


def common_title(title: Column) -> Column:
    """A title, or the one that stands for its rank."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in SAME_RANK.items() for x in pair))[title], title)


def member_name(name: Column) -> Column:
    """struct(surname, forename, title, seat, office) of "Lord Sample of Place" or "Jane Sample": titles and forms of
    address, then names, then the seat. Who is named by a church office alone has no surname, forename or seat."""
    plain = folded(name)
    core = F.regexp_extract(plain, _SEATED, 2)
    office = core.rlike(f"^(?:{_OFFICE})$")
    person = F.when(~office, core)
    return F.struct(
        F.coalesce(_found(person, r"([^ ]+)$", 1), F.lit("")).alias("surname"), _found(person, r"^([^ ]+) ", 1).alias("forename"),
        _found(F.regexp_extract(plain, _SEATED, 1), rf".*\b({_TITLE})\b", 1).alias("title"), F.when(~office & (core != ""), _found(plain, _SEATED, 3)).alias("seat"), office.alias("office"))


def officer_name(name: Column) -> Column:
    """struct(surname, forename, title, seat) of "SAMPLE, Jane Mary, Dame" or "SAMPLE, Jane, Lord Sample of Place": a surname,
    given names, and behind a second comma what else the person is called."""
    pieces = r"^([^,]*)(?:,([^,]*))?(?:,(.*))?$"
    surname, given, more = (folded(F.regexp_extract(F.coalesce(name, F.lit("")), pieces, k)) for k in (1, 2, 3))
    there = surname != ""
    called = F.when(more != "", more).otherwise(given)
    return F.struct(
        F.replace(surname, F.lit(" "), F.lit("")).alias("surname"), F.when(there, _found(given, rf"^(?:(?:{_TITLE}) )*+([^ ]+)", 1)).alias("forename"),
        F.when(there, _found(called, rf"^(?:.*? )??({_TITLE})(?: |$)", 1)).alias("title"), F.when(there, _found(called, r"\bof (.+)$", 1)).alias("seat"))


def without_notes(text: Column) -> Column:
    """Text without the bracketed notes at its end, however many, and up to four deep."""
    inner = r"[^()]"
    for _ in range(4):
        inner = rf"(?:[^()]|\({inner}*\))"
    return F.regexp_replace(F.rtrim(text), rf"(?:\s*\({inner}*\)\s*)+$", "")


# An entry is a role, a comma and an organisation, or an organisation alone: a comma before a bare legal form is part of it.
_ENTRY = rf"(?is)^(?:([^,]*),(?!\s*(?:{'|'.join(SUFFIXES)})\.?\s*$))?\s*(.*?)\s*$"
_PROSE = "|".join(rf"\Q{marker}\E" for marker in PROSE)
_FORM = rf"(?i)\b(?:{'|'.join(ORGANISATIONS)})\b"
# What could be a name: up to nine words and a hundred characters, from a capital, a number or a letter of a script without case.
_NAMELIKE = r"^(?=.{1,100}$)(?!\p{Ll})[\p{L}\p{N}]\S*(?:\s+\S+){0,8}$"
_AMONG = r"(?i)(?<!\S)[,.\-'()]*(?:%s)[,.\-'()]*(?!\S)"


def counterparty(description: Column, category: Column) -> Column:
    """struct(name, private): the organisation that an entry names, or null; private if it concerns family.

    An organisation is told by its legal form or kind. Without one a name does where a company is to be expected (in the
    category of shareholdings, or behind a role if the entry speaks of a company): no date, and three in five of its words,
    connecting ones aside, in capitals. Running text names nobody."""
    core = without_notes(description)
    role, name = (F.regexp_extract(core, _ENTRY, k) for k in (1, 2))
    family = F.coalesce(F.contains(F.lower(role), F.lit("family")), F.lit(False))
    words = F.regexp_replace(name, _AMONG % "|".join(CONNECTORS), "")
    lettered, capital = (F.regexp_count(words, F.lit(rf"(?<!\S)\p{{{kind}}}")) for kind in ("L", "Lu"))
    looks = name.rlike(_NAMELIKE) & ~name.rlike(_AMONG % "|".join(MONTHS)) & (lettered > 0) & (5 * capital >= 3 * lettered)
    holding = F.coalesce(F.startswith(category, F.lit("Category 2")), F.lit(False))
    company = (role != "") & description.rlike(r"(?i)\b(?:company|corporation|firm)\b")
    told = (name != "") & ~family & ~name.rlike(_PROSE) & (name.rlike(_FORM) | ((holding | company) & looks))
    return F.struct(F.when(told, name).alias("name"), family.alias("private"))


def ceased_on(text: Column) -> Column:
    """The date in "(interest ceased 5 March 2020)", or null."""
    pattern = r"(?i)interest ceased (\d{1,2})\s+(\w+)\s+(\d{4})"
    part = lambda i: F.regexp_extract(text, pattern, i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(2)))
    return F.when(month > 0, F.try_to_date(F.concat_ws("-", part(3), month.cast("string"), part(1)), "yyyy-M-d"))


def as_published(name: Column) -> Column:
    """A name as registers print it: one leading title and what follows "of" left out."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), rf"(?i)^(?:{_FRONT})\.?\s+", ""), r"(?is)\s+of\s.*$", ""))
