"""Anchored clusters of awards on a stream: the streaming twin of contract splitting."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY = 86_400_000
CLUSTER = "anchor date, last date, pieces long, awards long, total_cents long, largest long, confidence double"


class Open:
    """A key's awards that are in no finished cluster yet: for each day and tender their number, cents and least confidence."""

    def __init__(self, text: str | None = None):
        self.held: dict[tuple[int, str], list] = {(d, t): rest for d, t, *rest in json.loads(text or "[]")}

    def text(self) -> str:
        return json.dumps([[d, t, *rest] for (d, t), rest in self.held.items()])

    def add(self, day: int, tender: str, cents: int, confidence: float | None) -> None:
        n = self.held.setdefault((day, tender), [0, 0, None])
        n[0], n[1] = n[0] + 1, n[1] + cents
        n[2] = min((c for c in (n[2], confidence) if c is not None), default=None)

    def first(self) -> int | None:
        return min((d for d, _ in self.held), default=None)

    def finished(self, window: int, watermark: int) -> Iterator[tuple]:
        """Take out and give the clusters to which no row behind the watermark can be added, in order. The first day is an
        anchor once nothing earlier can come, and its cluster is whole once nothing within the window can."""
        while self.held and ((anchor := self.first()) + window) * DAY < watermark:
            mine = {k: self.held.pop(k) for k in [k for k in self.held if k[0] <= anchor + window]}
            cents: dict[str, int] = defaultdict(int)
            for (_, tender), (_, value, _) in mine.items():
                cents[tender] += value
            confidence = min((c for *_, c in mine.values() if c is not None), default=None)
            yield anchor, max(d for d, _ in mine), len(cents), sum(n for n, *_ in mine.values()), sum(cents.values()), max(cents.values()), confidence


def cluster_stream(awards: DataFrame, keys: list[str], window: int = 30, late: str = "10 days", buckets: int = 512) -> DataFrame:
    """keys and CLUSTER of a stream of awards (keys, award_date, tender_id, value_cents, match_confidence), appended when a
    cluster can no longer change.

    A cluster holds a key's awards from its first day, the anchor, to `window` days on; the first award beyond starts the
    next. Awards may come out of order by up to `late`; later ones are left out by the watermark. State of a key is what
    lies within the window and the lateness, so it doesn't grow with the stream; a timer ends it when nothing more comes.

    Keys are dealt over `buckets` by hash, and a bucket's keys are stepped together: a batch calls Python once a bucket, not
    once a key. A stream with many millions of open keys is given more buckets.
    """
    names = [f.split()[0] for f in CLUSTER.split(", ")]

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: Open(text) for k, text in json.loads(state.get[0]).items()} if state.exists else {}
        for frame in frames:
            for key, day, tender, cents, confidence in zip(frame["key"], frame["day"].tolist(), frame["tender_id"], frame["value_cents"].tolist(), frame["match_confidence"].tolist()):
                if key not in held:
                    held[key] = Open()
                held[key].add(day, tender, cents, None if pd.isna(confidence) else confidence)
        watermark = state.getCurrentWatermarkMs()
        found = [(key, *row) for key, mine in held.items() for row in mine.finished(window, watermark)]
        held = {key: mine for key, mine in held.items() if mine.held}
        if held:
            state.update((json.dumps({key: mine.text() for key, mine in held.items()}),))
            state.setTimeoutTimestamp(max((min(mine.first() for mine in held.values()) + window) * DAY, watermark) + 1)
        elif state.exists:
            state.remove()
        if found:
            out = pd.DataFrame(found, columns=["key", *names])
            for column in ("anchor", "last"):
                out[column] = pd.to_datetime(out[column], unit="D").dt.date
            yield out

    key, bucket = F.to_json(F.struct(*keys)).alias("key"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
    rows = awards.where("award_date IS NOT NULL AND value_cents IS NOT NULL").select(key, bucket, "tender_id", "value_cents", F.col("match_confidence").cast("double").alias("match_confidence"), F.unix_date("award_date").alias("day"), F.col("award_date").cast("timestamp").alias("at"))
    found = rows.withWatermark("at", late).groupBy("bucket").applyInPandasWithState(step, f"key string, {CLUSTER}", "held string", "append", GroupStateTimeout.EventTimeTimeout)
    kinds = ", ".join(f"`{k}` {awards.schema[k].dataType.simpleString()}" for k in keys)
    return found.select(F.from_json("key", kinds).alias("k"), *names).select(*(F.col("k")[k].alias(k) for k in keys), *names)


def splitting_flags(clusters: DataFrame, threshold: int, pieces: int = 3) -> DataFrame:
    """Of cluster_stream()'s clusters those of three or more tenders, each below the threshold, that together exceed it."""
    return clusters.where((F.col("pieces") >= pieces) & (F.col("largest") < threshold) & (F.col("total_cents") > threshold))
