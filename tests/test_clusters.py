"""Clusters on a stream: what is held back, what is late, what ends them."""

import random
from datetime import date, timedelta

from ledgerlight.streaming.clusters import DAY, Open, cluster_stream, splitting_flags

KIND = "buyer string, award_date date, tender_id string, value_cents long, match_confidence double"


def test_a_cluster_waits_until_it_can_no_longer_change():
    mine = Open()
    for day in (100, 104, 131):
        mine.add(day, f"t{day}", 5, 0.9)
    assert list(mine.finished(30, 130 * DAY)) == []  # the watermark has not passed the window
    assert list(Open(mine.text()).finished(30, 130 * DAY + 1)) == [(100, 104, 2, 2, 10, 5, 0.9)]
    mine.add(90, "late", 5, None)  # comes out of order: now it is the anchor
    found = list(mine.finished(30, 200 * DAY))
    assert [(a, b, n) for a, b, n, *_ in found] == [(90, 104, 3), (131, 131, 1)] and found[0][-1] == 0.9
    assert mine.held == {} and mine.first() is None


def test_state_is_what_lies_within_the_window():
    rng, mine, most = random.Random(1), Open(), 0
    for day in range(2000):
        mine.add(day - rng.randrange(5), f"t{day}", 1, None)
        list(mine.finished(30, (day - 5) * DAY))
        most = max(most, len(mine.held))
    assert most < 50


def brute(rows, window):
    """(buyer, anchor, awards) of all clusters."""
    found = {}
    for buyer in {r[0] for r in rows}:
        anchor = None
        for day in sorted(r[1] for r in rows if r[0] == buyer):
            if anchor is None or (day - anchor).days > window:
                anchor = day
            found[buyer, anchor] = found.get((buyer, anchor), 0) + 1
    return sorted((b, a, n) for (b, a), n in found.items())


def test_a_stream_with_late_rows(spark, tmp_path):
    rng, start = random.Random(2), date(2020, 1, 1)
    rows = [(f"b{rng.randrange(3)}", start + timedelta(days=i * 2 - rng.randrange(6)), f"t{i}", 100, 0.5) for i in range(120)]
    parts = [rows[i: i + 20] for i in range(0, 120, 20)]
    too_late = [("b0", start - timedelta(days=100), "old", 100, 0.5)]
    end = [(None, start + timedelta(days=500), "end", 0, None)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)
        cluster_stream(stream, ["buyer"], 30).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.buyer, r.anchor, r.awards) for r in spark.read.parquet(out).collect())

    for part in parts[:3]:
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(path)
    half = run()
    everything = brute(rows, 30)
    assert half and set(half) < set(everything)  # those that are out are final, whatever comes
    for part in [*parts[3:], too_late, end]:
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(path)
    assert run() == everything  # restarted from its checkpoint; the row behind the watermark is left out


def test_flags(spark):
    rows = [(3, 40, 100), (2, 40, 100), (3, 120, 140), (3, 30, 90)]
    clusters = spark.createDataFrame(rows, "pieces long, largest long, total_cents long")
    assert [tuple(r) for r in splitting_flags(clusters, 99).collect()] == [(3, 40, 100)]


def test_keys_are_stepped_together(spark, tmp_path):
    """A batch calls Python once a bucket; keys with a null part, a quote and whole numbers come back as they were."""
    from pyspark.sql import functions as F

    keys = [(None, 'a "b"'), (1, "x"), (1, None), (2, "x")]
    rows = [(*k, d, "t", 5, None) for k in keys for d in ("2020-01-01", "2020-01-20", "2020-03-01")] + [(9, "end", "2021-01-01", "t", 1, 0.5)]
    batch = spark.createDataFrame(rows, "n long, s string, d string, tender_id string, value_cents long, match_confidence double").withColumn("award_date", F.to_date("d")).drop("d")
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = cluster_stream(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in"), ["n", "s"], buckets=2)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = [(r.n, r.s, str(r.anchor), r.awards) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got, key=repr) == sorted([(*k, a, n) for k in keys for a, n in (("2020-01-01", 2), ("2020-03-01", 1))], key=repr)
