"""Indicators as plug-ins: what each needs, where it has been validated, and how a run evaluates and stores all that may run."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.scalars import subject_tender
from ledgerlight.operators import indicators as I
from ledgerlight.sources.flags import FlagStore

VALIDATED, UNVALIDATED, REJECTED = "validated", "unvalidated", "rejected"


@dataclass(frozen=True)
class Locale:
    """What law and practice of a country set: least days for bids, and the threshold (cents) of open tenders, if any."""

    code: str
    min_bid_days: int | None = None
    open_threshold_cents: int | None = None


# Figures of the countries' procurement laws.
LOCALES = {x.code: x for x in (Locale("ua", 30), Locale("co", 10), Locale("gb", 30, 122_976_00), Locale("eu", 35), Locale("br"))}


@dataclass(frozen=True)
class Context:
    """A run's tables, of one source each, by name; its locale; and the column that names a buyer."""

    source_id: str
    locale: Locale
    tables: Mapping[str, DataFrame]
    buyer: str = "buyer_name"


@dataclass(frozen=True)
class Indicator:
    """evaluate gives flags (with `subject`) and one row of counts (`units`, perhaps `unscoreable`). It may run only where its
    validation says so: without an entry it is unvalidated. Subjects of one that flags tenders are ids of tenders of its source,
    or begin with one and a colon."""

    indicator_id: str
    needs: tuple[str, ...]
    evaluate: Callable[[Context], tuple[DataFrame, DataFrame]]
    validation: Mapping[str, str] = field(default_factory=dict)
    flags_tenders: bool = False

    def runs_in(self, locale: str) -> bool:
        return self.validation.get(locale) == VALIDATED


INDICATORS: dict[str, Indicator] = {}


def register(indicator_id: str, needs: tuple[str, ...], evaluate: Callable, validation: Mapping[str, str], flags_tenders: bool = False) -> Indicator:
    """Add an indicator; an id is given once."""
    if indicator_id in INDICATORS:
        raise ValueError(f"{indicator_id} is registered already")
    if odd := set(validation.values()) - {VALIDATED, UNVALIDATED, REJECTED}:
        raise ValueError(f"{indicator_id}: no states of validation: {sorted(odd)}")
    INDICATORS[indicator_id] = Indicator(indicator_id, needs, evaluate, dict(validation), flags_tenders)
    return INDICATORS[indicator_id]


def enabled_for(locale: str) -> list[Indicator]:
    """The indicators validated for a locale, in the order of their ids."""
    return [INDICATORS[k] for k in sorted(INDICATORS) if INDICATORS[k].runs_in(locale)]


def _single_bidder(c: Context) -> tuple[DataFrame, DataFrame]:
    if c.locale.code == "ua":
        return I.single_bidder_by_bids.parts(c.tables["tender"], c.tables["award"], c.tables["bid"])
    if c.locale.code == "co":
        return I.single_bidder_stated.parts(c.tables["tender"], c.tables["award"])
    return I.single_award_competitive.parts(c.tables["tender"], c.tables["award"])


def _short_window(c: Context) -> tuple[DataFrame, DataFrame]:
    return I.short_bid_window.parts(c.tables["tender"], 15 if c.locale.min_bid_days is None else c.locale.min_bid_days)


def _evaluable(c: Context) -> DataFrame:
    I.require_resolution(c.tables["award"], c.tables["resolution"])
    return I.evaluable(c.tables["award"], c.tables["resolution"]) if "evaluable" not in c.tables else c.tables["evaluable"]


EVERYWHERE = dict.fromkeys(("ua", "co", "gb"), VALIDATED)
REGISTER_ONLY = {"gb": VALIDATED, "ua": UNVALIDATED, "co": UNVALIDATED}
RESOLVED = ("award", "resolution", "company")

register("i001", ("tender", "award"), _single_bidder, EVERYWHERE, flags_tenders=True)
register("i002", ("tender",), _short_window, EVERYWHERE, flags_tenders=True)
register("i003", ("tender", "award"), lambda c: I.repeat_winner_share.parts(c.tables["tender"], c.tables["award"], c.buyer), EVERYWHERE)
register("i004", ("tender", "award"), lambda c: I.price_vs_estimate.parts(c.tables["tender"], c.tables["award"]), EVERYWHERE, flags_tenders=True)
register("i005", ("tender",), lambda c: I.direct_award_share.parts(c.tables["tender"], c.source_id), EVERYWHERE)
register("i006", RESOLVED, lambda c: I.incorporation_proximity.parts(_evaluable(c), None, c.tables["company"]), REGISTER_ONLY, flags_tenders=True)
register("i007", RESOLVED, lambda c: I.value_vs_company_size.parts(_evaluable(c), None, c.tables["company"]), REGISTER_ONLY, flags_tenders=True)
register("i008", RESOLVED, lambda c: I.dormancy_delinquency.parts(_evaluable(c), None, c.tables["company"]), REGISTER_ONLY, flags_tenders=True)
register("i009", ("tender", *RESOLVED), lambda c: I.contract_splitting.parts(c.tables["tender"], _evaluable(c), None, c.buyer, c.locale.open_threshold_cents), dict.fromkeys(("gb", "ua", "co"), UNVALIDATED))


def of_source(tables: Mapping[str, DataFrame], source_id: str) -> dict[str, DataFrame]:
    """The tables with the rows of one source: tenders by their own source, what refers to tenders by these."""
    mine = tables["tender"].where(F.col("source_id") == source_id)
    ids = mine.select("tender_id").distinct()
    scoped = {n: t.join(ids, "tender_id", "left_semi") if n in ("award", "bid") else t for n, t in tables.items()}
    return scoped | {"tender": mine}


def evaluated(context: Context, ran: list[Indicator]) -> tuple[DataFrame, DataFrame]:
    """Flags of all indicators (indicator_id, subject, tender_id, details) and their counts (indicator_id, units, unscoreable).

    details: an indicator's own columns as JSON. The tender is the one that stands before a subject's first colon, if there
    is one of that id in the source; subjects that name a buyer have none. It is not looked up for indicators that flag tenders,
    whose flags are many, if no tender's id has a colon itself. Awards that can be scored against a company are found once for
    all indicators that ask for them."""
    needed = {n for i in ran for n in i.needs}
    if missing := sorted(needed - set(context.tables)):
        raise ValueError(f"tables are missing: {missing}")
    if "resolution" in needed:
        context = Context(context.source_id, context.locale, {**context.tables, "evaluable": _evaluable(context)}, context.buyer)
    tenders = context.tables["tender"].select("tender_id").distinct()
    plain = not context.tables["tender"].where(F.contains("tender_id", F.lit(":"))).take(1)
    told, sought, counts = [], [], []
    for one in ran:
        found, n = one.evaluate(context)
        rest = [c for c in found.columns if c not in ("subject", "source_id")]
        details = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
        flags = found.select(F.lit(one.indicator_id).alias("indicator_id"), "subject", subject_tender(F.col("subject")).alias("t"), details.alias("details"))
        (told if plain and one.flags_tenders else sought).append(flags)
        unscoreable = F.col("unscoreable") if "unscoreable" in n.columns else F.lit(0)
        counts.append(n.select(F.lit(one.indicator_id).alias("indicator_id"), "units", unscoreable.cast("long").alias("unscoreable")))
    linked = [f.withColumn("tender_id", F.col("t")) for f in told]
    if sought:
        linked.append(reduce(DataFrame.unionByName, sought).join(tenders.withColumn("t", F.col("tender_id")), "t", "left"))
    return reduce(DataFrame.unionByName, linked).select("indicator_id", "subject", "tender_id", "details"), reduce(DataFrame.unionByName, counts)


def run_indicators(tables: Mapping[str, DataFrame], source_id: str, locale: str, store: FlagStore, dry_run: bool = False, buyer: str = "buyer_name") -> dict[str, Any]:
    """Evaluate the indicators validated for a locale over one source, replace that source's flags of these indicators in the
    store, and report: ran, skipped (not validated), and for each that ran flags, persisted, units and unscoreable.

    Nothing is replaced if any indicator fails, if the stored number differs, or in a dry run."""
    ran = enabled_for(locale)
    report = {"source": source_id, "locale": locale, "dry_run": dry_run, "ran": [i.indicator_id for i in ran], "skipped": sorted(set(INDICATORS) - {i.indicator_id for i in ran})}
    if not ran:
        return report | {"per_indicator": {}}
    flags, counts = evaluated(Context(source_id, LOCALES[locale], of_source(tables, source_id), buyer), ran)
    units = {r["indicator_id"]: {"units": r["units"], "unscoreable": r["unscoreable"]} for r in counts.collect()}
    stored = store.replace(flags, source_id, report["ran"], dry_run)
    return report | {"per_indicator": {i: n | units[i] for i, n in stored.items()}}
