"""Batches merged into a stored table."""

import random

import pytest

from ledgerlight.sources.merged import MergedTable
from ledgerlight.sources.store import Conflict

KIND = "a string, b long, v string, seq long"


@pytest.fixture
def table(spark, tmp_path):
    return MergedTable(spark, str(tmp_path / "merged"), ["a", "b"], "seq", buckets=5)


def batch(spark, *rows):
    return spark.createDataFrame(rows, KIND)


def held(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


def test_the_last_write_wins(spark, table):
    with pytest.raises(ValueError):
        table.read()
    assert table.merge(batch(spark, ("x", 1, "old", 1), ("x", 1, "new", 2), ("y", 1, "y", 1)), 0) == 1
    assert table.merge(batch(spark, ("x", 1, "older", 1), ("y", 1, "same", 1), ("z", 9, None, 3)), 1) == 2
    assert held(table) == [("x", 1, "new", 2), ("y", 1, "same", 1), ("z", 9, None, 3)]
    assert held(table, 1) == [("x", 1, "new", 2), ("y", 1, "y", 1)]  # an earlier version can still be read
    assert table.merge(batch(spark, ("z", 9, "again", 9)), 1) == 2 and len(held(table)) == 3  # a batch that is in already
    assert table.merge(batch(spark), 2) == 3 and len(held(table)) == 3  # an empty one
    table.vacuum(keep=1)
    assert len(held(table)) == 3


def test_many_batches_equal_one_aggregation(spark, table):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(20)}", rng.randrange(3), f"v{i}", i) for i in range(600)]
    rng.shuffle(rows)
    for i in range(3):
        table.merge(batch(spark, *rows[i * 200: i * 200 + 200]), i)
    last = {}
    for row in sorted(rows, key=lambda r: r[3]):
        last[row[:2]] = row
    assert held(table) == sorted(last.values())
    again = MergedTable(spark, table.versions.path, ["a", "b"], "seq", buckets=5)  # found again from its files
    assert held(again) == sorted(last.values())


def exchanges(plan):
    """For each scanned table of a plan's text whether an exchange stands above it, below the join."""
    lines, found = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "FileScan" in line or "Scan ExistingRDD" in line:
            above, depth = [], line.find("FileScan") if "FileScan" in line else line.find("Scan")
            for upper in reversed(lines[:i]):
                at = len(upper) - len(upper.lstrip(" :+-*()0123456789"))
                if at < depth:
                    above.append(upper)
                    depth = at
                    if "Join" in upper:
                        break
            found.append(("FileScan" in line, any("Exchange" in x for x in above)))
    return found


@pytest.mark.parametrize("partitions", [2, 40])
def test_the_stored_side_is_not_shuffled(spark, table, partitions):
    table.merge(batch(spark, ("x", 1, "old", 1)), 0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        plan = table.planned(batch(spark, ("x", 1, "new", 2)), table.read())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert sorted(exchanges(plan)) == [(False, True), (True, False)]


def test_null_keys_are_refused(spark, table):
    table.merge(batch(spark, ("x", 1, "old", 1)), 0)
    for row in (("x", None, "v", 2), (None, 1, "v", 2), ("x", 1, "v", None)):
        with pytest.raises(Exception, match="is null"):
            table.merge(batch(spark, row), 1)
    assert held(table) == [("x", 1, "old", 1)] and table.versions.latest() == 1


def test_two_writers(spark, table, monkeypatch):
    table.merge(batch(spark, ("x", 1, "old", 1)), 0)
    monkeypatch.setattr(type(table.versions), "latest", lambda self: 0)
    with pytest.raises(Conflict):
        table.merge(batch(spark, ("x", 1, "lost", 5)), 1)
    monkeypatch.undo()
    assert held(table) == [("x", 1, "old", 1)]


def test_as_the_sink_of_a_stream(spark, table, tmp_path):
    path = str(tmp_path / "in")
    for i in range(3):
        batch(spark, ("x", 1, f"v{i}", i), ("y", i, "y", i)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)
    stream.writeStream.foreachBatch(lambda df, i: table.merge(df, i) and None).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert held(table) == [("x", 1, "v2", 2), ("y", 0, "y", 0), ("y", 1, "y", 1), ("y", 2, "y", 2)]
