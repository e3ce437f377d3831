"""Benchmark decontamination by SimHash over item-sized windows.

Every window of a text that has as many words as a benchmark item (the whole text, if it has fewer) is fingerprinted from
its word shingles and looked up in a multi-index: cut into BLOCKS blocks, two fingerprints within `radius` bits differ in at
most radius / BLOCKS bits in some block, so a window whose blocks are all farther from an item's is beyond the radius.
Candidates within the radius are verified by the exact weighted Jaccard similarity of their shingles, each weighted by its
number of occurrences.

Which windows are fingerprinted, and against which items, is told by an index of the items' shingles, exactly: a window as
similar as asked has all but w - ceil(similarity * w) of an item's w shingles, so it has one of any one more of them. Each
item is listed under so many of its rarest. A window is compared with those items alone that are listed under a shingle
which stands in it: an opening that most items share lists none of them, unless it is nearly all they have. Items of the
same words are one. So time goes with the pairs of windows and items that have something rare in common.

Items go to the executors in parts of at most PART words; the texts are read once for each part. Within a part the
operator is a map without a shuffle.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import kept_by_worker, named, row_and, small_batches, table, texts_of, with_row

BLOCKS = 8  # of eight bits
PART = 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
MATCH = "item_id long, start long, n_words long, differing_bits int, similarity double, n_windows long"

WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def shingle_hashes(ids: np.ndarray, shingle: int) -> np.ndarray:
    """A 64-bit number for each run of `shingle` words (of all words, if they are fewer)."""
    size = min(shingle, len(ids))
    with np.errstate(over="ignore"):
        out = np.zeros(len(ids) - size + 1, np.uint64)
        for i in range(size):
            out = (out ^ ids[i: len(ids) - size + 1 + i]) * MIX
            out ^= out >> np.uint64(29)
    return out


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """(n + 1, 64): how often each bit is set in the first hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def majority(sums: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * sums > n, axis=1, bitorder="little").view("<u8").ravel()


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / (a.total() + b.total() - both) if a or b else 0.0


class Listed:
    """Shingles of one length, sorted, and the items (as numbers) listed under each."""

    def __init__(self, pairs: list[tuple[int, int]]):
        order = sorted(pairs)
        hashes = np.array([h for h, _ in order], np.uint64)
        self.items = np.array([i for _, i in order], np.int64)
        self.known, self.first = np.unique(hashes, return_index=True)
        self.many = np.diff(np.append(self.first, len(hashes)))
        self.maybe = np.zeros(1 << 20, bool)  # by the low bits, before the search among the known
        self.maybe[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item): where a shingle stands in a text, and each item listed under it."""
        at = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        hit = self.known[slot] == hashes[at]
        at, slot = at[hit], slot[hit]
        return np.repeat(at, self.many[slot]), self.items[spans(self.first[slot], self.many[slot])]


def spans(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... many[0] numbers, then from first[1] on, and so forth."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


class Index:
    """Items of one part, those of the same words as one: their shingles, where they are listed, and fingerprints in blocks."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, radius: int, similarity: float):
        self.shingle, self.radius, self.similarity = shingle, radius, similarity
        self.word: dict[str, int] = {}
        self.names: list[list[tuple[int, int]]] = []  # of each: (place among all items, item_id)
        self.counts: list[Counter] = []
        self.texts: dict[bytes, int] = {}
        sizes, fingerprints = [], []
        often: Counter = Counter()  # (shingle's length, shingle): items with it
        for place, (item_id, text) in enumerate(items):
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.word.setdefault(w, len(self.word) + 1) for w in words], np.uint64)
            if (known := self.texts.setdefault(ids.tobytes(), len(self.names))) < len(self.names):
                self.names[known].append((place, item_id))
                continue
            hashes = shingle_hashes(ids, shingle)
            fingerprints.append(int(majority(bit_sums(hashes)[-1:], len(hashes))[0]))
            sizes.append(len(words))
            self.names.append([(place, item_id)])
            self.counts.append(Counter(hashes.tolist()))
            often.update((min(len(words), shingle), h) for h in self.counts[-1])
        pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, (n, counts) in enumerate(zip(sizes, self.counts)):
            short, total = min(n, shingle), counts.total()
            needed = total - math.ceil(similarity * total - 1e-9) + 1
            for h in sorted(counts, key=lambda h: (often[short, h], h)):
                if needed <= 0:
                    break
                pairs[short].append((h, item))
                needed -= counts[h]
        self.listed = {short: Listed(p) for short, p in pairs.items()}
        self.sizes = np.array(sizes, np.int64)
        u = np.arange(256)
        self.near = np.array([x.bit_count() for x in range(256)])[u[:, None] ^ u] <= radius // BLOCKS
        self.fps = np.array(fingerprints, np.uint64)
        self.blocks = self.fps.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)

    def matches(self, text: str | None) -> list[tuple]:
        """MATCH rows of a text: for each item its most similar window (the first of them) and the number of windows."""
        get = self.word.get
        ids = np.array([get(w, 0) for w in words_of(text)], np.uint64)
        found: dict[int, list] = {}
        for short, listed in self.listed.items():
            if len(ids) < short:
                continue
            place, item = listed.found(shingle_hashes(ids, short))
            for n in np.unique(self.sizes[item]).tolist():
                mine = self.sizes[item] == n
                self.windows(n, place[mine], item[mine], ids, found)
        rows = [(place, item_id, best) for item, best in found.items() for place, item_id in self.names[item]]
        return [(item_id, *best) for _, item_id, best in sorted(rows)]

    def windows(self, n: int, place: np.ndarray, item: np.ndarray, ids: np.ndarray, found: dict[int, list]) -> None:
        """Compare each item of n words with the windows that hold a place of it."""
        n = min(n, len(ids))  # a text shorter than the item is one window
        width = max(1, n - self.shingle + 1)  # shingles of a window
        low = np.maximum(place - width + 1, 0)
        many = np.maximum(np.minimum(place, len(ids) - n) - low + 1, 0)
        # pairs of a window's start and an item, each once, by start
        pairs = np.unique(spans(low, many) * len(self.sizes) + np.repeat(item, many))
        starts, item = np.divmod(pairs, len(self.sizes))
        # runs of starts that lie near each other are fingerprinted from common sums
        cuts = np.flatnonzero(np.diff(starts) > width) + 1
        for at, who in zip(np.split(starts, cuts), np.split(item, cuts)):
            if not len(at):
                continue
            own, slot = np.unique(at, return_inverse=True)
            first = int(own[0])
            hashes = shingle_hashes(ids[first: int(own[-1]) + n], min(n, self.shingle))
            sums = bit_sums(hashes)
            prints = majority(sums[own - first + width] - sums[own - first], width)
            blocks = prints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
            candidate = np.zeros(len(at), bool)
            for block in range(BLOCKS):
                candidate |= self.near[blocks[slot, block], self.blocks[who, block]]
            differing = np.bitwise_count(prints[slot] ^ self.fps[who])
            for k in np.flatnonzero(candidate & (differing <= self.radius)).tolist():
                start, i = int(at[k]) - first, int(who[k])
                alike = weighted_jaccard(Counter(hashes[start: start + width].tolist()), self.counts[i])
                if alike >= self.similarity:
                    best = found.setdefault(i, [0, n, 0, -1.0, 0])
                    if alike > best[3]:
                        best[0], best[2], best[3] = start + first, int(differing[k]), alike
                    best[4] += 1


def parts_of(benchmark: DataFrame, text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items (null texts and ids left out) in parts of at most PART words, each small enough to be sent to all tasks."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).dropna()
    held, size = [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"].split())
        if size >= PART:
            yield held
            held, size = [], 0
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 20, text: str = "text") -> DataFrame:
    """All columns of docs, and matches: an array of structs (MATCH), one for each item a window of the text is similar to.

    Words are lower-cased runs of word characters; start counts words from 0. An item of fewer words than a shingle is
    one shingle; items without words match nothing. Null and empty texts, and all texts if there is no item, have no
    match. Repeated rows are each judged; a column named matches is replaced; ids are not used, so they may be null.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = [c for c in docs.columns if c != "matches"]
    kind = "array<struct<" + MATCH.replace(", ", ",").replace(" ", ":") + ">>"
    out = docs.select(*named(kept))
    names = []
    for number, items in enumerate(parts_of(benchmark)):
        shared = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = kept_by_worker(name, lambda: Index(shared.value, shingle, radius, similarity))
            fields = pa.struct([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[f.split()[1]]) for f in MATCH.split(", ")])
            for batch in batches:
                rows = [[dict(zip((f.name for f in fields), m)) for m in index.matches(x)] for x in texts_of(batch, text)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(fields))], ["row", "found"])

        packed, columns = with_row(out, text)
        names.append(f"matches-{number}")
        out = packed.mapInArrow(search, row_and(packed, f"found {kind}")).select(*(F.col("row")[c].alias(c) for c in columns), F.col("found").alias(names[-1]))
    matches = F.flatten(F.array(*named(names))) if names else F.array().cast(kind)
    return out.select(*named(kept), matches.alias("matches"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that contamination() finds in it."""
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
