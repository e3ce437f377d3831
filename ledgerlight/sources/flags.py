"""The store of flags: a run replaces what its indicators flagged in its source before, as a whole or not at all."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlight.sources.store import Versions

FLAG = "source_id string, indicator_id string, subject string, tender_id string, details string"


class FlagStore:
    """Flags (FLAG) under a path. Each version lists, for every source and indicator with flags, their folder and number."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def read(self, version: int | None = None) -> DataFrame:
        """The flags of a version, the latest if none is named."""
        runs = self.versions.read(version).get("runs", [])
        if not runs:
            return self.spark.createDataFrame([], FLAG)
        # a folder holds one source; what later runs have replaced in it is not listed any more
        paths = [f"{self.versions.folder(r['folder'])}/source_id={r['source_id']}/indicator_id={r['indicator_id']}" for r in runs]
        parts = {r["folder"] for r in runs}
        found = None
        for folder in sorted(parts):  # as many as there are sources and unreplaced runs of them
            mine = [p for p, r in zip(paths, runs) if r["folder"] == folder]
            part = self.spark.read.schema(FLAG).option("basePath", self.versions.folder(folder)).parquet(*mine)
            found = part if found is None else found.unionByName(part)
        return found

    def stored(self, folder: str) -> dict[str, int]:
        """The number of flags of each indicator, counted from staged files."""
        rows = self.spark.read.parquet(self.versions.folder(folder)).groupBy("indicator_id").count().collect()
        return {r["indicator_id"]: r["count"] for r in rows}

    def replace(self, flags: DataFrame, source_id: str, ran: Iterable[str], dry_run: bool = False) -> dict[str, dict[str, int]]:
        """Replace what the indicators `ran` have flagged in a source by `flags` (indicator_id, subject, tender_id, details;
        other columns are ignored), and return for each of them how many flags there are and how many were stored.

        Indicators that ran and flagged nothing lose what they had; other indicators and sources keep theirs. The flags are
        staged and counted again from the files; if that is not what was written, or a flag is of another indicator, the
        stage is dropped and an error raised, and the store is as it was. A dry run counts and changes nothing.
        """
        ran = sorted(set(ran))
        if odd := [n for n in (source_id, *ran) if not re.fullmatch(r"[\w.-]+", n)]:
            raise ValueError(f"no names of folders: {odd}")
        rows = flags.select(F.lit(source_id).alias("source_id"), "indicator_id", "subject", "tender_id", "details")
        named = {i: F.count_if(F.col("indicator_id").eqNullSafe(i)) for i in ran}
        others = F.count_if(~F.coalesce(F.col("indicator_id").isin(*ran), F.lit(False)))
        counts = [c.alias(f"n{k}") for k, c in enumerate(named.values())] + [others.alias("others")]
        if dry_run:
            seen = rows.agg(*counts).first().asDict()
        else:
            before = self.versions.latest()
            watch = Observation()
            folder = self.versions.stage(rows.observe(watch, *counts), "source_id", "indicator_id")
            seen = watch.get
        found = {i: seen.get(f"n{k}", 0) for k, i in enumerate(ran)}
        if dry_run:
            return {i: {"flags": n, "persisted": 0} for i, n in found.items()}
        try:
            if seen.get("others"):
                raise ValueError(f"{seen['others']} flags of indicators that didn't run")
            stored = self.stored(folder) if sum(found.values()) else {}
            if stored != {i: n for i, n in found.items() if n}:
                raise RuntimeError(f"flags written: {found}, stored: {stored}")
            content = self.versions.read(before)
            kept = [r for r in content.get("runs", []) if r["source_id"] != source_id or r["indicator_id"] not in ran]
            mine = [{"source_id": source_id, "indicator_id": i, "folder": folder, "flags": n} for i, n in stored.items()]
            self.versions.publish({"runs": kept + mine}, before)
        except Exception:
            self.versions.drop(folder)
            raise
        return {i: {"flags": n, "persisted": stored.get(i, 0)} for i, n in found.items()}

    def vacuum(self, keep: int = 2) -> None:
        """Drop all but the last versions and what only they refer to."""
        self.versions.vacuum(lambda content: {r["folder"] for r in content.get("runs", [])}, keep)
