"""SimHash near-dedup with pigeonring filtering.

Fingerprints within `radius` differing bits are linked. Cut into m segments round a ring, two such fingerprints have a
segment from which every chain of l consecutive segments differs in at most l * radius / m bits. As budgets below one
are zero, the first segments of that chain are equal: they are the join key. The longer chains are tested one after the
other, each with its own budget, and the last, of all m segments, is the full Hamming check.

Only distinct fingerprints are joined, so copies of a text cost nothing. A key shared by more than `hot` fingerprints is
not joined pairwise: its fingerprints are linked through the balls of radius/2 around them (two fingerprints within
radius 2 share a point that is one bit or less from both). A point lies in 65 such balls at most, so that way is exact
for components, linear, and has no large group. Components are then found by rounds of star contraction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import components, drop_written, free_shuffles, kept_by_worker, named, small_batches, table, written
from ledgerlight.llm.decontam import shingle_hashes

BYTES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each group of consecutive hashes (none empty), the 64-bit number whose bit is one if set in over half of it."""
    sizes = np.diff(np.append(starts, len(hashes)))
    # at most 255 hashes are added at a time: eight one-byte counters then fit into a word
    parts = -(-sizes // 255)
    first = np.cumsum(parts) - parts
    cut = np.repeat(starts - 255 * first, parts) + 255 * np.arange(parts.sum())
    out = np.zeros(len(starts), np.uint64)
    for k in range(8):
        packed = np.add.reduceat((hashes >> np.uint64(k)) & BYTES, cut)
        counts = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        ones = (2 * counts > sizes[:, None]).astype(np.uint64)
        for byte in range(8):
            out |= ones[:, byte] << np.uint64(8 * byte + k)
    return out


def shingle_fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """doc_id, fp (long): SimHash of each row's shingles of lower-cased (A-Z) words split at ASCII white space.

    Shingles are joined by spaces and hashed by XXH64 (seed 42), repeats included. A text of fewer words is one shingle;
    null texts and texts without a word have fingerprint zero.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        digest = partial(xxh64_intdigest, seed=42)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            fps = np.zeros(len(texts), np.uint64)
            hashes, rows, starts, n = [], [], [], 0

            def flush():
                nonlocal n
                if rows:
                    fps[rows] = majority_bits(np.concatenate(hashes), np.array(starts))
                hashes.clear(), rows.clear(), starts.clear()
                n = 0

            for row, body in enumerate(texts.to_pylist()):
                words = body.encode().lower().split() if body else ()
                if not words:
                    continue
                grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
                found = np.array(list(map(digest, grams)), np.uint64)
                hashes.append(found), rows.append(row), starts.append(n)
                n += len(found)
                if n > 200_000:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(compute, "doc_id long, fp long")


def segments(m: int) -> list[tuple[int, int]]:
    """(first bit, bits) of m segments of 64 bits."""
    ends = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def keys(fp: Column, m: int, radius: int) -> tuple[Column, list[Column]]:
    """For each start of a chain its join key, as an array of structs; and for each, the mask of every chain from it."""
    equal = max(c for c in range(1, m + 1) if c * radius < m)  # so many first segments have a budget below one
    parts = segments(m)
    mask = lambda i, n: sum(((1 << w) - 1) << at for at, w in (parts[j % m] for j in range(i, i + n)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    starts = [F.struct(F.lit(i).alias("chain"), fp.bitwiseAND(F.lit(signed(mask(i, equal)))).alias("key")) for i in range(m)]
    return F.array(*starts), [[signed(mask(i, n)) for n in range(equal + 1, m + 1)] for i in range(m)]


def near_pairs(found: DataFrame, radius: int = 2, m: int = 5, hot: int = 64) -> tuple[DataFrame, DataFrame]:
    """found: distinct fingerprints (fp). Returns pairs (u, v) within radius under keys of up to `hot` fingerprints, u < v,
    and the fingerprints (fp) that share a key with more than that."""
    every, masks = keys(F.col("fp"), m, radius)
    keyed = written(found.select("fp", F.explode(every).alias("k")).select("k.*", "fp"), "keys")
    counts = keyed.groupBy("chain", "key").agg(F.count("*").alias("n"))
    small = keyed.join(counts.where(F.col("n").between(2, hot)).drop("n"), ["chain", "key"])
    left, right = small.withColumnRenamed("fp", "u"), small.withColumnRenamed("fp", "v")
    differ = F.expr("u ^ v")
    first = m - len(masks[0]) + 1
    within = reduce(
        lambda a, b: a | b,
        ((F.col("chain") == i) & reduce(lambda a, b: a & b, (F.bit_count(differ.bitwiseAND(F.lit(x))) <= n * radius // m for n, x in enumerate(chain, first))) for i, chain in enumerate(masks)),
    )
    pairs = left.join(right, ["chain", "key"]).where((F.col("u") < F.col("v")) & within).select("u", "v")
    crowd = keyed.join(counts.where(F.col("n") > hot).drop("n"), ["chain", "key"]).select("fp").distinct()
    return pairs, crowd


def ball_links(crowd: DataFrame) -> DataFrame:
    """Edges (u, v) that connect just what is connected by links of two or fewer bits among `crowd` (fp)."""
    points = F.concat(F.array(F.col("fp")), F.array(*(F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64))))
    balls = crowd.select("fp", F.explode(points).alias("point"))
    shared = balls.groupBy("point").agg(F.min("fp").alias("u"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return shared.select("u", F.explode("all").alias("v")).where("u <> v").distinct()


def simhash_components(fps: DataFrame, m: int = 5, hot: int = 64) -> DataFrame:
    """fps: (doc_id, fp), repeats allowed, stored (it is read more than once). Adds component_id, the smallest doc_id that
    is reached over links of two or fewer differing bits, the document's own included; rows with a null doc_id take part,
    and a component of nulls alone has a null id. Every row of fps is returned, an empty table gives none."""
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    pairs, crowd = near_pairs(distinct.select("fp"), 2, m, hot)
    roots = components(pairs.unionByName(ball_links(crowd)))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components: see shingle_fingerprints() and simhash_components()."""
    fps = written(shingle_fingerprints(table(spark, sf_dir, "documents"), 3), "documents")
    return simhash_components(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near duplicates by the similarity of their word shingles


#: 64-bit words of a text's parity bitmap.
WORDS = 8
#: Distinct texts (about) in which shingles are counted for the common order, and how many of the most frequent are sent out.
SAMPLED, COMMON = 10_000, 100_000
#: Texts of a key that are told by the least, the greatest and the xor of their ids, without a join.
TOLD = 3
#: In larger keys members that are not linked yet are compared in blocks of BLOCK members against blocks; each carries
#: about KNOWN of its keys, by which most pairs are not given again under further keys.
BLOCK, KNOWN = 4096, 16
#: Before that, texts meet one another by runs of so many consecutive keys, in so many rounds.
RUNS, ROUNDS = (8, 3), 3


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of lower-cased words; one of all words, if they are fewer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    return np.unique(shingle_hashes(np.array([xxh64_intdigest(w) for w in words], np.uint64), shingle)) if words else np.zeros(1, np.uint64)


def common_shingles(texts: DataFrame, shingle: int, every: int) -> np.ndarray:
    """texts: th, text. The most frequent shingles in a sample of the texts, the most frequent last."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i not in seen:
                    seen.add(i)
                    found.append(shingle_set(text, shingle))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    sample = texts.select("th", "text").where(F.pmod(F.xxhash64("th"), F.lit(every)) == 0)
    counts = sample.mapInArrow(compute, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    top = counts.orderBy(F.desc("n"), "h").limit(COMMON).collect()
    return np.array([r["h"] for r in reversed(top)], np.int64).view(np.uint64)


def folded_bits(wide: np.ndarray, size: int) -> np.ndarray:
    """A parity bitmap (bytes, a power of two of them) as if made with `size` bytes."""
    return np.bitwise_xor.reduce(wide.reshape(-1, size))


def shingle_sketches(texts: DataFrame, shingle: int, similarity: float, common: np.ndarray) -> DataFrame:
    """texts: th, doc_id, text. Returns th, doc_id, n (distinct shingles), fp (their SimHash), wide (a bitmap of two to four bits
    a shingle: each is the parity of the shingles that fall on it), bits (the same folded to WORDS longs) and keys, the first
    n - ceil(similarity * n) + 1 shingles in an order that is the same for all texts, the frequent ones last. Any two sets
    with that Jaccard similarity have one of these keys in common, whatever the order."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.argsort(shared.value)
        known = shared.value[rank]
        for batch in batches:
            sizes, fps, bits, wide, keys, ends = [], np.zeros(batch.num_rows, np.uint64), np.zeros((batch.num_rows, WORDS), np.uint64), [], [np.zeros(0, np.uint64)], [0]
            for row, text in enumerate(batch.column(2).to_pylist()):
                h = shingle_set(text, shingle)
                n = len(h)
                fps[row] = majority_bits(h, np.zeros(1, np.int64))[0]
                size = max(64 * WORDS, 1 << (2 * n - 1).bit_length())
                odd = np.bincount(((h >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
                wide.append(np.packbits(odd.astype(np.uint8), bitorder="little"))
                bits[row] = folded_bits(wide[-1], 8 * WORDS).view("<u8")
                taken = n - int(np.ceil(similarity * n - 1e-9)) + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[np.argsort(np.where(known[at] == h, rank[at] + 1, 0), kind="stable")]
                sizes.append(n), keys.append(h[:taken]), ends.append(ends[-1] + taken)
            lists = lambda offsets, x: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(fps.view(np.int64)), pa.array([x.tobytes() for x in wide], pa.binary()), lists(np.arange(0, bits.size + 1, WORDS), bits.ravel()), lists(ends, np.concatenate(keys))],
                ["th", "doc_id", "n", "fp", "wide", "bits", "keys"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("th", "doc_id", "text").mapInArrow(compute, f"th binary, doc_id {kind}, n long, fp long, wide binary, bits array<long>, keys array<long>")


def fingerprint_pairs(sketches: DataFrame) -> DataFrame:
    """sketches: id, fp, stored. Pairs (u, v), u < v, of texts whose fingerprints are within two bits, stored: enough of them
    to connect all such texts. Texts of one fingerprint meet the least of them only."""
    distinct = written(sketches.groupBy("fp").agg(F.min("id").alias("one")), "fps")
    same = sketches.select("id", "fp").join(distinct, "fp").where("id <> one").select(F.col("one").alias("u"), F.col("id").alias("v"))
    pairs, crowd = near_pairs(distinct.select("fp"))
    edges = pairs.unionByName(ball_links(crowd)).distinct()
    of = lambda x: distinct.select(F.col("fp").alias(x), F.col("one").alias(f"one_{x}"))
    near = edges.join(of("u"), "u").join(of("v"), "v").select(F.least("one_u", "one_v").alias("u"), F.greatest("one_u", "one_v").alias("v"))
    found = written(same.unionByName(near), "pairs")
    drop_written(distinct)
    free_shuffles(sketches.sparkSession)
    return found


def told_and_crowded(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sketches: id, keys, stored. Returns the distinct pairs (u, v), u < v, of texts under keys of up to TOLD texts, stored;
    and key, id, n (members of the key) of larger keys, stored. Of keys with the same members only one is returned."""
    keyed = sketches.select(F.explode("keys").alias("key"), "id")
    told = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor("id").alias("all")).where("n > 1")
    told = written(told.groupBy("n", "low", "high", "all").agg(F.min("key").alias("key")), "told")
    free_shuffles(sketches.sparkSession)
    middle = F.expr("all ^ low ^ high")
    pair = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    low, high = F.col("low"), F.col("high")
    listed = F.when(F.col("n") == 2, F.array(pair(low, high))).otherwise(F.array(pair(low, middle), pair(low, high), pair(middle, high)))
    pairs = written(told.where(F.col("n") <= TOLD).select(F.explode(listed).alias("p")).select("p.*").distinct(), "pairs")
    crowded = written(keyed.join(told.where(F.col("n") > TOLD).select("key", "n"), "key"), "keys")
    drop_written(told)
    free_shuffles(sketches.sparkSession)
    return pairs, crowded


def hub_pairs(crowded: DataFrame) -> DataFrame:
    """(u, v), u < v: each text with the best connected one of all its keys. In a group of near copies that is the text which
    the others were made from, or one near it, so most of a large group is linked by one pair a text."""
    degree = crowded.groupBy("id").agg(F.sum("n").alias("degree"))
    hubs = crowded.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", "id")).alias("hub"))
    best = crowded.join(hubs, "key").groupBy("id").agg(F.max("hub").alias("hub")).where("hub.id <> id")
    return best.select(F.least("id", "hub.id").alias("u"), F.greatest("id", "hub.id").alias("v"))


def sketched(sketches: DataFrame, name: str) -> DataFrame:
    return sketches.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))


def differing_bits(a: Column, b: Column) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(WORDS)))


def not_far(similarity: float, n: Column | None = None, m: Column | None = None, differ: Column | None = None) -> Column:
    """Of pairs, by their sizes and differing bits (else by the columns of sketched() for u and v): whether their sets may be
    so similar. None that are is refused: similar sets are of similar size, and two sets differ in as many shingles as their
    bitmaps differ in bits, or more."""
    if n is None:
        n, m, differ = F.col("n_u"), F.col("n_v"), differing_bits(F.col("bits_u"), F.col("bits_v"))
    return (F.least(n, m) >= F.greatest(n, m) * similarity - 1e-6) & (differ <= (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def run_pairs(keyed: DataFrame, crowded: DataFrame, sketches: DataFrame, roots: DataFrame, similarity: float, seed: int) -> DataFrame:
    """Distinct pairs (u, v), u < v, that are not far and not connected by roots (node, root): each text under a key of
    `crowded` with the nearest of its neighbours in groups with the same run of so many keys (RUNS), in an order by `seed`.
    keyed: id, keys. A text has two neighbours in a group, however large it is, so pairs grow as texts do."""
    own = sketches.select("id", "n", "bits")
    here = keyed.join(crowded.select("id").distinct(), "id").join(roots.withColumnRenamed("node", "id"), "id", "left").join(own, "id")
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.size("keys") - n + 1), lambda i: F.xxhash64(F.lit(n), F.slice("keys", i, n)))
    every = F.concat(*(F.when(F.size("keys") >= n, cut(n)).otherwise(F.array().cast("array<bigint>")) for n in RUNS))
    # size and bitmap go along with each text, so that neighbours are judged where they meet: no rows are made of them
    runs = here.select(F.struct("id", F.coalesce("root", "id").alias("root"), "n", "bits").alias("me"), F.explode(F.array_distinct(every)).alias("run"))
    order = Window.partitionBy("run").orderBy(F.xxhash64("me.id", "run", F.lit(seed)), "me.id")
    beside = runs.select("me", F.lag("me").over(order).alias("before"), F.lead("me").over(order).alias("after"))

    def judged(other: str) -> Column:
        """The pair of `me` and a neighbour, or null if there is none, it is connected, or far."""
        x, y = F.col("me"), F.col(other)
        differ = differing_bits(x["bits"], y["bits"])
        pair = F.struct(differ.alias("bits"), F.least(x["id"], y["id"]).alias("u"), F.greatest(x["id"], y["id"]).alias("v"))
        return F.when((x["root"] != y["root"]) & not_far(similarity, x["n"], y["n"], differ), pair)

    best = beside.groupBy("me.id").agg(F.min(F.least(judged("before"), judged("after"))).alias("pair")).where("pair IS NOT NULL")
    return written(best.select("pair.u", "pair.v").distinct(), "pairs")


def not_far_at_all(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (u, v) those that are not far by their whole bitmaps either, which tell long texts apart as well."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for n, a, b in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                size = min(len(a), len(b))
                differ = folded_bits(np.frombuffer(a, np.uint8), size) ^ folded_bits(np.frombuffer(b, np.uint8), size)
                yes.append(int(np.bitwise_count(differ).sum()) <= n * ((1 - similarity) / (1 + similarity)) + 1e-6)
            yes = pa.array(yes, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(yes), batch.column(1).filter(yes)], ["u", "v"])

    near = pairs.join(sketched(sketches, "u"), "u").join(sketched(sketches, "v"), "v").where(not_far(similarity)).select("u", "v", (F.col("n_u") + F.col("n_v")).alias("n"))
    wide = lambda x: sketches.select(F.col("id").alias(x), F.col("wide").alias(f"wide_{x}"))
    return near.join(wide("u"), "u").join(wide("v"), "v").select("u", "v", "n", "wide_u", "wide_v").mapInArrow(compare, "u long, v long")


def other_pairs(crowded: DataFrame, sketches: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (u, v), u < v, that are not far, share a key of `crowded` and are not connected by roots (node, root).
    Members that are connected need no further link, so a large group of near copies costs its members times the others
    under its keys; texts that are not connected are compared completely."""
    many = crowded.select("key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    many = written(many, "many")
    mixed = many.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    mixed = written(many.join(mixed.where("low < high").select("key", "blocks"), "key"), "mixed")
    drop_written(many)
    # of many keys those whose hash is a multiple of a power of two: texts take the same ones of the keys they share
    share = mixed.groupBy("id").agg(F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.count("*") / KNOWN, F.lit(1.0))))).cast("long").alias("share"))
    some = mixed.join(share, "id").where(F.pmod(F.xxhash64("key"), "share") == 0).groupBy("id").agg(F.collect_list("key").alias("known"))
    members = written(mixed.join(some, "id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<bigint>"))), "members")
    drop_written(mixed)
    side = lambda x, block: members.select("key", F.col("id").alias(x), F.col("root").alias(f"root_{x}"), F.col("known").alias(f"known_{x}"), block.alias("block")).join(sketched(sketches, x), x)
    left, right = side("u", F.pmod(F.xxhash64("id"), "blocks").cast("int")), side("v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    apart = (F.col("u") < F.col("v")) & (F.col("root_u") != F.col("root_v"))
    # a pair is not given again where both are known to have a lesser key; under the least of all it is given
    again = F.exists(F.array_intersect("known_u", "known_v"), lambda x: x < F.col("key"))
    return left.join(right, ["key", "block"]).where(apart & not_far(similarity) & ~again).select("u", "v").distinct()


def joined_by_runs(links: DataFrame, linked: Callable[[DataFrame], DataFrame], keyed: DataFrame, crowded: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """links and those that `linked` confirms of run_pairs(), round by round: of a large group of texts near one another, few
    are left that other_pairs() has to compare with all."""
    for i in range(ROUNDS):
        near = run_pairs(keyed, crowded, sketches, components(links), similarity, i)
        if not near.take(1):
            break
        links = links.unionByName(linked(near))
        drop_written(near)
    return links


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs whose texts have so much Jaccard similarity of their sets of word shingles (as 64-bit hashes)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, own = None, None
        kept_by_worker("", lambda: None)
        for batch in batches:
            yes = []
            for u, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if u != before:
                    before, own = u, shingle_set(a, shingle)
                other = shingle_set(b, shingle)
                both = len(np.intersect1d(own, other, assume_unique=True))
                yes.append(both >= similarity * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(yes, pa.bool_())), batch.column(1).filter(pa.array(yes, pa.bool_()))], ["u", "v"])

    of = lambda x, name: texts.select(F.col("id").alias(x), F.col("text").alias(name))
    both = pairs.join(of("v", "b"), "v").join(of("u", "a"), "u").select("u", "v", "a", "b")
    return both.mapInArrow(compare, "u long, v long")


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group of near-duplicates the one with the least (doc_id, text's digest).

    Texts are linked if the Jaccard similarity of their sets of `shingle`-word shingles (lower-cased, split at white
    space) is `similarity` or more; groups are what links connect. Candidates are texts whose SimHash fingerprints are within
    two bits; an exact prefix filter on the shingles follows, so no link is missed that is too wide for fingerprints (but for
    collisions of 64-bit hashes). All are verified on the sets. Copies, told by 128-bit digests, count as
    one text, so their number does not matter. Null and empty texts are alike, and one row of them stays; a null doc_id is
    the least; of rows repeated in doc_id and text one stays. All columns are returned as they are, whatever their names; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    th = F.unhex(F.md5(body)).alias("th")
    rows = docs.select(th, F.col("doc_id"), body.alias("text"))
    # one text of each digest: the row with the least doc_id brings it; texts are numbered for what follows
    copies = rows.groupBy("th").agg(F.min(F.struct("doc_id")).alias("least"), F.count("*").alias("n"))
    copies = written(copies.withColumn("id", F.monotonically_increasing_id()), "copies")
    one = copies.select(F.col("th").alias("t"), F.col("least.doc_id").alias("d"), "id")
    same = lambda df: (df["th"] == F.col("t")) & df["doc_id"].eqNullSafe(F.col("d"))
    again = bool(rows.groupBy("th", "doc_id").count().where("count > 1").take(1))
    common = common_shingles(rows, shingle, max(1, copies.count() // SAMPLED))
    made = written(shingle_sketches(rows, shingle, similarity, common), "sketches")
    sketches = made.join(one, same(made)).select("id", F.col("n"), "fp", "wide", "bits", "keys")
    sketches = written(sketches.dropDuplicates(["id"]) if again else sketches, "sketches")
    drop_written(made)
    free_shuffles(spark)

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = written(not_far_at_all(pairs, sketches, similarity), "pairs")
        free_shuffles(spark)
        # of copies only the row with the least doc_id is fetched: keyed by both, copies do not meet in one task
        wanted = one.join(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id")
        texts = rows.join(wanted, same(rows)).select("id", "text")
        texts = written(texts.dropDuplicates(["id"]) if again else texts, "texts")
        free_shuffles(spark)
        links = written(verified(pairs, texts, shingle, similarity), "links")
        drop_written(texts, pairs)
        free_shuffles(spark)
        return links

    close = fingerprint_pairs(sketches)
    told, crowded = told_and_crowded(sketches)
    links = linked(close.unionByName(told).unionByName(hub_pairs(crowded)).distinct())
    more = written(other_pairs(crowded, sketches, components(links), similarity), "pairs")
    if more.take(1):
        links = links.unionByName(linked(more))
    drop_written(close, told, crowded, sketches, more)
    roots = components(links).withColumnRenamed("node", "id")
    grouped = copies.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    best = grouped.groupBy("root").agg(F.min(F.struct("least", "th")).alias("best")).select(F.col("best.th").alias("t"), F.col("best.least.doc_id").alias("d"))
    free_shuffles(spark)
    whole = docs.select(th, F.col("doc_id"), F.struct(*named(docs.columns)).alias("row"))
    kept = whole.join(best, same(whole))
    return (kept.dropDuplicates(["t", "d"]) if again else kept).select(*(F.col("row")[c].alias(c) for c in docs.columns))
