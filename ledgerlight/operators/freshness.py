"""Freshness of sources and the runs that fill them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def freshness(sla: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """source_id, label, days, due, overdue. fresh within the agreed days, stale within twice as many, critical beyond or if
    all runs failed, unknown if there were none; days are exact, not rounded."""
    success = F.col("status") == "success"
    seen = runs.groupBy("source_id").agg(F.max(F.when(success, F.col("finished_at"))).alias("last"), F.count("*").alias("runs"))
    days = F.timestamp_diff("SECOND", F.col("last"), now) / 86400
    label = (
        F.when(F.col("runs").isNull(), "unknown").when(F.col("last").isNull(), "critical").when(days <= F.col("sla_days"), "fresh")
        .when(days <= 2 * F.col("sla_days"), "stale").otherwise("critical")
    )
    out = sla.join(seen, "source_id", "left").select("source_id", "sla_days", label.alias("label"), days.alias("days"))
    return out.withColumn("due", F.col("label") != "fresh").withColumn("overdue", F.col("label").isin("stale", "critical"))


COMPLETE, PARTIAL, UNVERIFIABLE = "complete", "partial", "unverifiable"


def completeness_note(state: str, seen: int | None, advertised: int | None) -> str:
    return f"completeness={state};seen={'' if seen is None else seen};advertised={'' if advertised is None else advertised}"


def read_note(note: Column) -> Column:
    """struct(state, seen, advertised) of a note; all null for any other text."""
    part = lambda key, pattern: F.nullif(F.regexp_extract(note, rf"{key}=({pattern})", 1), F.lit(""))
    return F.struct(part("completeness", "[a-z]+").alias("state"), part("seen", "[0-9]*").cast("long").alias("seen"), part("advertised", "[0-9]*").cast("long").alias("advertised"))


class RunRecorder:
    """Records one run as one row: an exception makes it failed, leaving without finish() unverifiable, and only a run that
    saw all that was advertised is a success. `append` stores the row (a dict)."""

    def __init__(self, source_id: str, append, clock):
        self.source_id, self.append, self.clock, self.result = source_id, append, clock, None

    def finish(self, rows: int, advertised: int | None = None) -> None:
        state = UNVERIFIABLE if advertised is None else COMPLETE if rows >= advertised else PARTIAL
        self.result = (state, rows, advertised)

    def __enter__(self):
        self.started = self.clock()
        return self

    def __exit__(self, kind, error, trace) -> bool:
        state, rows, advertised = self.result or (UNVERIFIABLE, None, None)
        ok = kind is None and state == COMPLETE
        note = f"{kind.__name__}: {error}" if kind else completeness_note(state, rows, advertised)
        self.append({"source_id": self.source_id, "started_at": self.started, "finished_at": self.clock(), "status": "success" if ok else "failed", "rows_ingested": rows or 0, "error_message": note})
        return False
