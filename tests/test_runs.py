"""Runs, rosters and snapshots."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import freshness, gates


def record(work):
    rows = []
    try:
        with freshness.RunRecorder("s", rows.append, iter(range(9)).__next__) as run:
            work(run)
    except RuntimeError:
        pass
    return rows[0]["status"], rows[0]["error_message"]


def boom(run):
    raise RuntimeError("x")


@pytest.mark.parametrize("work,status,state", [
    (lambda r: r.finish(5, 5), "success", "completeness=complete;seen=5;advertised=5"), (lambda r: r.finish(4, 5), "failed", "completeness=partial;seen=4;advertised=5"),
    (lambda r: r.finish(4), "failed", "completeness=unverifiable;seen=4;advertised="), (lambda r: None, "failed", "completeness=unverifiable;seen=;advertised="), (boom, "failed", "RuntimeError: x"),
])
def test_only_complete_is_success(work, status, state):
    assert record(work) == (status, state)


def test_notes_are_read_back(spark):
    rows = spark.createDataFrame([(freshness.completeness_note("partial", 4, None),), ("RuntimeError: x",)], "n string")
    assert [tuple(r[0]) for r in rows.select(freshness.read_note(F.col("n"))).collect()] == [("partial", 4, None), (None, None, None)]


def test_roster_and_snapshot(spark):
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    counts = gates.pending_roster(ids("a", "b", "c", "c"), ids("a"), ids("a", "b"), "k")
    assert tuple(counts.first()) == (1, 1, 1, 3)
    assert not gates.coverage(counts.withColumn("family", F.lit("x"))).first().passed
    files = spark.createDataFrame([("a", b"1"), ("b", b"2")], "key string, content binary")
    manifest = spark.createDataFrame([("a", hashlib.sha256(b"1").hexdigest()), ("b", "0"), ("c", "0")], "key string, sha256 string")
    assert {r.key: r.reason for r in gates.snapshot_integrity(files, manifest).collect()} == {"a": None, "b": "changed", "c": "missing"}


def test_next_pending_resolves_suppliers_once(spark, monkeypatch):
    """Awards by the same supplier are resolved once, so what is sorted and joined does not grow with the awards."""
    from ledgerlight.operators import resolve
    from ledgerlight.plans.registry import QUERIES

    sf, given, resolved = "/root/testdata/sf0.01", [], resolve.resolve_awards
    monkeypatch.setattr(resolve, "resolve_awards", lambda award, company: given.append(award.count()) or resolved(award, company))
    assert QUERIES["f04_next_pending"](spark, sf).columns == ["company_number"]
    assert given[0] < spark.read.parquet(f"{sf}/lineitem.parquet").count() / 20
