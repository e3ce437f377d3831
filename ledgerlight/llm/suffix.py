"""Exact substring dedup by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if it lies in a string of `length` bytes that also starts anywhere else. Suffixes are sorted sparsely, at
anchors: of the `length - GRAM + 1` byte grams in a window of `length` bytes, the leftmost with the least hash. Equal
windows have their anchor at the same place, so every repeat is seen at anchors, about one in 170 positions.

1. Anchors are found in one pass. Those whose gram is nowhere else in the corpus (counted with map-side sums) cannot lie
   in a repeat and end here; no other anchor is dropped.
2. Each task takes the suffixes at its anchors (gram hash, up to `length` bytes to the right, then what lies to the left,
   reversed), sorts them, folds equal ones into one, and front-codes the run: a suffix is sent as the length of the
   prefix it shares with the one before, and the rest.
3. Runs are cut at fixed places of the hash range, exchanged, and merged by a loser tree that knows for every loser the
   prefix it shares with the last winner: prefixes once compared are never compared again, and the merge also gives the
   common prefix of neighbours.
4. From the common prefixes to the right and, by a second order, to the left, all repeated windows around each anchor
   follow at once, without comparing pairs; for several lengths, if they are asked for, from the same order.

Equal suffixes are folded before the exchange, so groups of copies do not grow with their size. A gram with more than
`crowd` occurrences is not merged in one task: its windows are counted by their 128-bit digests instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import drop_written, free_shuffles, kept_by_worker, named, small_batches, table, written

GRAM = 64
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of suffixes that a task sorts at a time, and that it merges.
RUN, MERGE = 6_000_000, 10_000_000
#: Positions that are hashed, and suffixes of whole groups that are looked at, together.
CHUNK, GROUPS = 1 << 16, 3000
SENT = "part int, n int, shared binary, sizes binary, rights binary, places binary, texts binary, tails binary"
SPANS = "th binary, of int, first int, last int"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    values = np.random.default_rng(20240229).integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    h, n = values[data], 1
    with np.errstate(over="ignore"):
        factor = MIX
        while n < GRAM:
            h = h[:-n] * factor + h[n:]
            factor, n = factor * factor | np.uint64(1), 2 * n
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
    return h


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows that lie within one text, ascending, and their gram hashes."""
    width = length - GRAM + 1
    inside = np.zeros(len(data) + 1, np.int8)
    sizes = np.diff(offsets)
    long = sizes >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    inside = np.cumsum(inside, dtype=np.int8).astype(bool)
    places, hashes, low = [], [], np.uint64(2 * CHUNK - 1)
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        valid = inside[at: min(at + CHUNK, len(data) - length + 1)]
        if not valid.any():
            continue
        h = gram_hashes(data[at: at + len(valid) + length - 1])
        keyed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        rows = np.append(keyed, np.full(-len(keyed) % width, np.iinfo(np.uint64).max)).reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[: len(valid)], ahead[width - 1: width - 1 + len(valid)])[valid] & low
        least = least[np.append(True, least[1:] != least[:-1])].astype(np.int64)
        places.append(least + at)
        hashes.append(h[least])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    every, first = np.unique(np.concatenate(places), return_index=True)
    # anchors have the least hashes of their windows: mixed again, they are spread evenly over the hash range
    h = np.concatenate(hashes)[first]
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return every, h ^ (h >> np.uint64(33))


def find_anchors(docs: DataFrame, length: int) -> DataFrame:
    """docs: th, text. Returns th, pos, h, copies: the anchors of each text, once for all its copies in a batch."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            ths = batch.column(0).to_pylist()
            seen: dict[bytes, int] = {}
            first = np.array([seen.setdefault(x, i) for i, x in enumerate(ths)], np.int64)
            copies = np.bincount(first, minlength=len(ths)).astype(np.int32)
            _, offsets, values = column.buffers()
            offsets = np.frombuffer(offsets, np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
            data = np.frombuffer(values, np.uint8)[offsets[0]: offsets[-1]] if values else np.zeros(0, np.uint8)
            places, hashes = anchors_of(data, offsets - offsets[0], length)
            row = np.searchsorted(offsets - offsets[0], places, "right") - 1
            keep = copies[row] > 0
            places, hashes, row = places[keep], hashes[keep], row[keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array((places - offsets[row] + offsets[0]).astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array(copies[row])],
                ["th", "pos", "h", "copies"],
            )

    return docs.select("th", "text").mapInArrow(find, "th binary, pos int, h long, copies int")


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, of which `at` bytes are known to be equal."""
    end = min(len(a), len(b))
    while at < end:
        stop = min(at + 64, end)
        if a[at:stop] != b[at:stop]:
            while a[at] == b[at]:
                at += 1
            return at
        at = stop
    return end


def merge_runs(runs: list[Iterator[tuple[bytes, int, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """Merge sorted runs of (string, prefix shared with the one before in the run, what belongs to it), by a loser tree.

    Yields the same for the merged order. A node holds the loser of its match with the prefix it shares with the winner
    that beat it; that winner was the last output of its path, so a newcomer is compared by these lengths first, and by
    bytes only if they are equal, from there on.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    heads = [next(r, None) for r in runs] + [None] * (k - len(runs))
    loser, shared = [-1] * k, [-1] * k  # per inner node

    def play(a: int, b: int, known: int) -> tuple[int, int, int]:
        """winner, loser, their common prefix"""
        if heads[a] is None or heads[b] is None:
            return (b, a, -1) if heads[a] is None else (a, b, -1)
        x, y = heads[a][0], heads[b][0]
        n = common(x, y, known)
        return (a, b, n) if x[n: n + 1] <= y[n: n + 1] else (b, a, n)

    winners = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], loser[node], shared[node] = play(winners[2 * node], winners[2 * node + 1], 0)
    now, have = winners[1], 0
    while heads[now] is not None:
        string, _, what = heads[now]
        yield string, have, what
        heads[now] = following = next(runs[now], None)
        have = -1 if following is None else following[1]
        node = (now + k) >> 1
        while node:
            other = shared[node]
            if have < other:
                now, loser[node], have, shared[node] = loser[node], now, other, have
            elif have == other and have >= 0:
                now, loser[node], shared[node] = play(now, loser[node], have)
            node >>= 1


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    shared, tails, before = np.zeros(len(strings), "<u2"), [], b""
    for i, s in enumerate(strings):
        shared[i] = n = common(before, s, 0)
        tails.append(s[n:])
        before = s
    return shared, tails


def decoded(shared: np.ndarray, sizes: np.ndarray, tails: bytes, what: list) -> Iterator[tuple[bytes, int, object]]:
    before, at = b"", 0
    for n, size, x in zip(shared.tolist(), sizes.tolist(), what):
        before = before[:n] + tails[at: at + size]
        at += size
        yield before, n, x


def repeats(right: np.ndarray, left: np.ndarray, shared: np.ndarray, reversed_left: list[bytes], copied: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For suffixes in sorted order, and each length: the least and the greatest number of bytes before the anchor at which a
    window of so many bytes begins that is repeated (greatest -1: none).

    right, left: bytes at hand on either side; shared: common bytes to the right with the one before; copied: it stands
    for more than one place. A window that begins d before the anchor is repeated if another suffix has the same next
    length - d bytes (the same block of the right order) and the same d bytes before (of the left order).
    """
    n = len(right)
    if not n:
        return
    order = np.array(sorted(range(n), key=reversed_left.__getitem__), np.int64)
    wide = max(1, int(left.max()))
    grid = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in reversed_left), np.uint8).reshape(n, wide)[order]
    differ = grid[1:] != grid[:-1]
    beside = np.where(differ.any(1), differ.argmax(1), wide)
    beside = np.append(0, np.minimum(beside, np.minimum(left[order][1:], left[order][:-1])))
    del grid, differ
    for length in lengths:
        least, most = np.full(n, length, np.int32), np.full(n, -1, np.int32)
        for d in range(min(int(left.max()), length - GRAM) + 1):
            can = (right >= length - d) & (left >= d)
            if not can.any():
                continue
            block = np.empty(n, np.int64)
            block[order] = np.cumsum(beside < d) if d else 0
            block += np.cumsum(shared < length - d) * (n + 1)
            rows = np.flatnonzero(can)
            _, inverse, counts = np.unique(block[rows], return_inverse=True, return_counts=True)
            found = rows[(counts[inverse] > 1) | copied[rows]]
            most[found] = d
            least[found] = np.minimum(least[found], d)
        yield length, least, most


def repeated_spans(texts: DataFrame, anchors: DataFrame, lengths: list[int], crowd: int) -> DataFrame:
    """texts: th, text (copies may repeat). anchors: those for the least length, as find_anchors() gives them, stored.
    Returns th, spans: an array of the length that it is for (of), first and last + 1 of byte ranges."""
    spark = texts.sparkSession
    length = max(lengths)
    # stored, so that the join is between two exchanges of its own and the rows of a common gram can be split
    counts = written(anchors.groupBy("h").agg(F.sum("copies").alias("n")).where("n > 1"), "counts")
    free_shuffles(spark)
    alive = anchors.join(counts, "h").select("th", F.struct("pos", "h", (F.col("n") > crowd).alias("crowd")).alias("at"))
    alive = written(alive.groupBy("th").agg(F.collect_set("at").alias("at")), "anchors")
    drop_written(anchors, counts)
    free_shuffles(spark)
    n, crowded = alive.agg(F.sum(F.size("at")), F.sum(F.size(F.filter("at", lambda x: x["crowd"])))).first()
    parts = max(1, -(-(n or 0) * 2 * length // MERGE))
    # stored, so that texts are shuffled once, whether or not there are crowded grams, and not kept beside the runs below
    there = written(texts.join(alive, "th"), "there")
    drop_written(alive)
    free_shuffles(spark)
    chosen = lambda wanted: F.filter("at", lambda x: x["crowd"] == wanted)
    listed = lambda of: ["th", "text", F.transform(of, lambda x: x["pos"]).alias("pos"), F.transform(of, lambda x: x["h"]).alias("h")]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "n", "shared", "sizes", "rights", "places", "texts", "tails"]
        held: dict[tuple[bytes, int], list] = {}
        size = 0
        kept_by_worker("", lambda: None)

        def run() -> Iterator[pa.RecordBatch]:
            nonlocal size
            order = sorted(held)
            out: dict[str, list] = {k: [] for k in names}
            bounds = [int.from_bytes(s[:4], "big") * parts >> 32 for s, _ in order]
            i = 0
            while i < len(order):
                j = i
                while j < len(order) and bounds[j] == bounds[i]:
                    j += 1
                shared, tails = front_coded([s for s, _ in order[i:j]])
                # a suffix that is here once has its place sent with it; of copies, which are repeats as they stand,
                # one is sent without a place, and the places of all follow with a suffix of size zero
                places, texts = [], []
                for key in order[i:j]:
                    at = held[key]
                    places.append(at[0][1] if len(at) == 1 else -1)
                    texts.append(at[0][0] if len(at) == 1 else bytes(16))
                for k, v in zip(names, (bounds[i], j - i, shared.tobytes(), np.array(list(map(len, tails)), "<u2").tobytes(), np.array([r for _, r in order[i:j]], "<u2").tobytes(), np.array(places, "<i4").tobytes(), b"".join(texts), b"".join(tails))):
                    out[k].append(v)
                sure = sorted({(th, at - (len(s) - 8 - r), at + r) for s, r in order[i:j] if len(found := held[s, r]) > 1 for th, at in found})
                if sure:
                    for k, v in zip(names, (bounds[i], 0, b"", np.array([x[1:] for x in sure], "<i4").tobytes(), b"", b"", b"".join(x[0] for x in sure), b"")):
                        out[k].append(v)
                i = j
            held.clear()
            size = 0
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(names, kinds)], names)

        for batch in batches:
            for th, text, places, hashes in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = text.encode()
                for at, h in zip(places, hashes):
                    right = data[at: at + length]
                    left = data[max(0, at + GRAM - length): at][::-1]
                    if len(left) + len(right) < min(lengths):
                        continue
                    key = (h % (1 << 64)).to_bytes(8, "big") + right + left, len(right)
                    if key in held:
                        held[key].append((th, at))
                    else:
                        held[key] = [(th, at)]
                        size += len(key[0])
                if size > RUN:
                    yield from run()
        if held:
            yield from run()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(of: int, ths: list, first, last) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ths, pa.binary()), pa.array([of] * len(ths), pa.int32()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["th", "of", "first", "last"])

        kept_by_worker("", lambda: None)
        runs = []
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                if not row["n"]:
                    known = np.frombuffer(row["sizes"], "<i4").reshape(-1, 2)
                    for of in lengths:
                        long = np.flatnonzero(known[:, 1] - known[:, 0] >= of)
                        yield spans(of, [row["texts"][16 * i: 16 * i + 16] for i in long.tolist()], known[long, 0], known[long, 1])
                    continue
                rights, places = np.frombuffer(row["rights"], "<u2").tolist(), np.frombuffer(row["places"], "<i4").tolist()
                what = [(r, p, row["texts"][16 * i: 16 * i + 16]) for i, (r, p) in enumerate(zip(rights, places))]
                runs.append(decoded(np.frombuffer(row["shared"], "<u2"), np.frombuffer(row["sizes"], "<u2"), row["tails"], what))

        def found(kept: list, shared: list) -> Iterator[pa.RecordBatch]:
            right = np.array([x[2][0] for x in kept], np.int32)
            left = np.array([len(x[0]) - 8 for x in kept], np.int32) - right
            near = np.minimum(np.array(shared, np.int32) - 8, length)
            for of, least, most in repeats(right, left, near, [x[0][8 + x[2][0]:] for x in kept], np.array([x[2][1] < 0 for x in kept], bool), lengths):
                hit = [i for i in np.flatnonzero(most >= 0) if kept[i][2][1] >= 0]
                at = np.array([kept[i][2][1] for i in hit], np.int64)
                yield spans(of, [kept[i][2][2] for i in hit], at - most[hit], at - least[hit] + of)

        # kept: the suffixes with a neighbour that has the same gram; copies folded into one are known to be repeats
        kept, shared, before = [], [], None
        for x in merge_runs(runs) if runs else ():
            near = x[1] >= 8 + GRAM
            if near and before:
                kept.append(before)
                shared.append(before[1])
            if near:
                kept.append(x)
                shared.append(x[1])
            elif len(kept) > GROUPS:
                yield from found(kept, shared)
                kept, shared = [], []
            before = None if near else x
        if kept:
            yield from found(kept, shared)

    def count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for th, text, places in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = text.encode()
                for of in lengths:
                    starts = sorted({d for at in places for d in range(max(0, at + GRAM - of), at + 1) if d + of <= len(data)})
                    if starts:
                        digests = [hashlib.blake2b(data[d: d + of], digest_size=16).digest() for d in starts]
                        yield pa.RecordBatch.from_arrays([pa.array([th] * len(starts), pa.binary()), pa.array([of] * len(starts), pa.int32()), pa.array(starts, pa.int32()), pa.array(digests, pa.binary())], ["th", "of", "first", "window"])

    normal = there.where(F.exists("at", lambda x: ~x["crowd"])).select(*listed(chosen(False)))
    spans = normal.mapInArrow(send, SENT).repartitionById(parts, "part").mapInArrow(merge, SPANS)
    if crowded:
        windows = written(there.where(F.exists("at", lambda x: x["crowd"])).select(*listed(chosen(True))).mapInArrow(count_windows, "th binary, of int, first int, window binary"), "windows")
        # stored, so that the join is between two exchanges of its own and a hot window's rows can be split
        often = written(windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"), "windows")
        spans = spans.unionByName(windows.join(often, "window").select("th", "of", "first", (F.col("first") + F.col("of")).alias("last")).distinct())
    spans = written(spans.groupBy("th").agg(F.collect_set(F.struct("of", "first", "last")).alias("spans")), "spans")
    drop_written(there, *((windows, often) if crowded else ()))
    free_shuffles(spark)
    return spans


RANGES = "array<struct<first:int,last:int>>"


def joined_ranges(ranges: Column) -> Column:
    """Ranges in order, those that touch folded into one."""
    last = lambda done: F.try_element_at(done, F.lit(-1))
    return F.aggregate(
        ranges, F.array().cast(RANGES),
        lambda done, x: F.when(
            (F.size(done) > 0) & (last(done)["last"] >= x["first"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["first"].alias("first"), F.greatest(last(done)["last"], x["last"]).alias("last")))),
        ).otherwise(F.concat(done, F.array(x))),
    )


def suffix_dedup(docs: DataFrame, length: int = 400, *, also: tuple[int, ...] = (), text: str = "text", crowd: int = 50_000) -> DataFrame:
    """All columns of docs, and n_bytes, spans (array of first and last + 1 of each maximal removed run) and kept (binary).
    For each further length n in `also`, spans_n tells what strings of n bytes that start elsewhere too cover; it is not cut.

    Each row is a document; repeated rows are copies of each other. Null text counts as empty. Texts shorter than
    `length` lose nothing. Columns named as the new ones are replaced. Results depend on no doc_id, so null or repeated
    ones do no harm. Lengths under GRAM are refused.
    """
    lengths = [length, *also]
    if min(lengths) < GRAM:
        raise ValueError(f"lengths must be {GRAM} bytes or more")
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    further = [f"spans_{n}" for n in also]
    own = docs.drop("n_bytes", "spans", "kept", *further)
    texts = own.select(F.unhex(F.md5(body)).alias("th"), body.alias("text"))
    anchors = written(find_anchors(texts, min(lengths)), "grams")
    spans = repeated_spans(texts, anchors, lengths, crowd)
    columns = own.columns
    keyed = own.select(F.unhex(F.md5(body)).alias("th"), F.struct(*named(columns)).alias("row"))
    every = F.array_sort(F.coalesce("spans", F.array().cast("array<struct<of:int,first:int,last:int>>")))
    joined = keyed.join(spans, "th", "left").select(*(F.col("row")[c].alias(c) for c in columns), every.alias("spans"))
    of = lambda n: F.transform(F.filter("spans", lambda x: x["of"] == n), lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last")))
    ranges = {name: F.when(F.size("spans") > 0, joined_ranges(of(n))).otherwise(F.array().cast(RANGES)).alias(name) for n, name in zip(lengths, ["spans", *further])}
    data = F.encode(body, "utf-8")
    with_spans = joined.select(*named(columns), F.octet_length(body).cast("long").alias("n_bytes"), *ranges.values())
    # the kept parts lie before each removed run and behind the last
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda x: x["last"]))
    starts = F.concat(F.transform("spans", lambda x: x["first"]), F.array(F.octet_length(body)))
    parts = F.zip_with(ends, starts, lambda a, b: F.substring(data, a + 1, b - a))
    kept = F.when(F.size("spans") == 0, data).otherwise(F.aggregate(parts, F.lit(b"").cast("binary"), lambda done, x: F.concat(done, x)))
    return with_spans.select(*named(columns), "n_bytes", "spans", *further, kept.alias("kept"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suffix_dedup() of documents at 400 bytes, as digests; n_repeated_240 counts the bytes in shorter repeats too, of 240
    bytes or more, which a passage of fifty words has."""
    found = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), also=(240,))
    covered = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    return found.select("doc_id", "n_bytes", covered("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), covered("spans_240").alias("n_repeated_240"))
