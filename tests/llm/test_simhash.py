import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlight.llm import simhash
from ledgerlight.llm.common import components
from ledgerlight.llm.queries import QUERIES


def fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i: i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(keys, linked):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {k: fingerprint(t) for k, t in text.items()}
    want = groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = QUERIES["op5_simhash"](spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{fps[k]:016x}", want[k]) for k in fps}


@pytest.mark.parametrize("hot", [64, 3])
def test_pairs_and_balls_find_all_links(spark, hot):
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(20)]
    values = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for c in centres for _ in range(25)})
    ids = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    got = {x.doc_id: x.component_id for x in simhash.simhash_components(spark.createDataFrame(ids, "doc_id long, fp long"), hot=hot).collect()}
    assert got == groups(list(range(len(values))), lambda a, b: (values[a] ^ values[b]).bit_count() <= 2)


def test_hard_rows(spark, hard, nothing):
    fps = simhash.shingle_fingerprints(hard)
    assert sorted(r.fp % (1 << 64) for r in fps.collect()) == sorted(fingerprint(r.text) for r in hard.collect())
    got = simhash.simhash_components(fps)
    assert got.count() == 12
    zero = {r.component_id for r in got.where("fp = 0").collect()}
    assert zero == {3}  # null ids take part, the least id names the component
    assert simhash.simhash_components(simhash.shingle_fingerprints(nothing)).count() == 0


def test_majority_bits():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, 2000, np.int64).astype(np.uint64)
    starts = np.array([0, 1, 3, 600, 900])
    got = simhash.majority_bits(hashes, starts)
    for g, part in zip(got, np.split(hashes, starts[1:])):
        assert int(g) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in part) > len(part))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7), (200, 200)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(edges.limit(0)).count() == 0


def test_near_dedup(spark, hard, nothing):
    r = random.Random(1)
    base = [[f"w{r.randrange(9999)}" for _ in range(300)] for _ in range(30)]
    rows, kept = [], set()
    for i, words in enumerate(base):
        near = list(words)
        for k in r.sample(range(300), 3):  # 15 of 296 shingles: similarity 0.9
            near[k] = "other"
        far = [w if j % 8 else "gone" for j, w in enumerate(words)]
        rows += [(10 * i + 3, " ".join(words)), (10 * i, " ".join(near)), (10 * i + 5, " ".join(words)), (10 * i + 7, " ".join(far))]
        kept |= {10 * i, 10 * i + 7}
    out = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id for x in out.collect()} == kept
    stay = simhash.near_dedup(hard.withColumn("id", F.lit("clash")))
    assert stay.columns == ["doc_id", "text", "extra", "id"]
    assert sorted((repr(x.doc_id), (x.text or "")[:3]) for x in stay.collect()) == sorted([("1", "One"), ("None", "a b"), ("None", ""), ("6", "123"), ("7", "aaa"), ("8", "wor"), ("9", "é à")])
    assert simhash.near_dedup(nothing).count() == 0


def shingles_of(text, k=5):
    words = text.lower().split()
    return {tuple(words[i: i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def stay_by_brute_force(texts, similarity=0.8):
    """Of each group of texts (doc_id: text) that links connect, the least doc_id."""
    sets = {k: shingles_of(t) for k, t in texts.items()}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both >= similarity * (len(sets[a]) + len(sets[b]) - both)

    return set(groups(sorted(texts), linked).values())


def test_crowded_keys_lose_no_link(spark):
    """Groups of 9, 100 and 1000 texts: the same words in ever other orders, each order once more with its last words
    exchanged; and unrelated texts."""
    r, texts = random.Random(9), []
    for size in (9, 100, 1000):
        words, group = [f"{size}w{i}" for i in range(40)], []
        while len(group) < size:
            order = r.sample(words, len(words))
            group += [order, order[:-2] + order[:-3:-1]][: size - len(group)]
        texts += group + [[f"x{r.randrange(9999)}" for _ in range(40)] for _ in range(size // 3)]
    r.shuffle(texts)
    texts = {i: " ".join(x) for i, x in enumerate(texts)}
    out = simhash.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {x.doc_id for x in out.collect()} == stay_by_brute_force(texts)


def test_recall_of_edits(spark):
    """Pairs just above and below a similarity of 0.8, against an exact join."""
    r, texts = random.Random(8), []
    new = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    for edit in ("added", "cut", "moved", "scattered") * 50:
        words = new(r.choice([50, 100, 200, 400]))
        n, at = len(words), r.randrange(len(words) - 20)
        if edit == "added":
            other = words[:at] + new(r.randint(n // 10, n // 4)) + words[at:]
        elif edit == "cut":
            other = words[:at] + words[at + r.randint(n // 20, n // 5):]
        elif edit == "moved":
            other = words[at:] + words[:at]
        else:
            other = [new(1)[0] if r.random() < 0.025 else w for w in words]
        texts += [words, other]
    texts = {i: " ".join(x) for i, x in enumerate(texts)}
    out = simhash.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {x.doc_id for x in out.collect()} == stay_by_brute_force(texts)


def crowd_of(spark, n):
    """So many texts with the same 40 keys, as run_pairs() takes them: keyed, crowded, sketches, and no roots."""
    ids = spark.range(n)
    keyed = ids.withColumn("keys", F.sequence(F.lit(1).cast("long"), F.lit(40).cast("long")))
    sketches = ids.select("id", F.lit(100).cast("long").alias("n"), F.array(*[F.pmod(F.col("id"), F.lit(4)) if i == 0 else F.lit(0).cast("long") for i in range(simhash.WORDS)]).alias("bits"))
    return keyed, ids, sketches, spark.createDataFrame([], "node long, root long")


def test_rounds_make_no_rows_of_neighbours(spark, monkeypatch):
    """Neighbours are judged where they meet: no join gives more rows than there are texts, and each text gets one pair at most."""
    plans, write = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, tag: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, tag))
    pairs = [tuple(r) for r in simhash.run_pairs(*crowd_of(spark, 300), 0.85, 0).collect()]
    above = plans[0][: plans[0].index("Window")]
    assert "Join" not in above and 100 < len(pairs) <= 300
    assert all(u < v and bin(u % 4 ^ v % 4).count("1") == 0 for u, v in pairs)


def test_near_dedup_goes_by_fingerprints(spark, monkeypatch):
    """Without the exact prefix filter, texts of one fingerprint or of near ones are still linked, and verified."""
    r = random.Random(4)
    words = [f"w{r.randrange(9999)}" for _ in range(3000)]
    other = [f"x{r.randrange(9999)}" for _ in range(3000)]
    texts = {0: " ".join(words), 1: "  ".join(words), 2: " ".join(words + ["end"]), 3: " ".join(other), 4: " ".join(other).upper()}
    none = spark.createDataFrame([], "u long, v long"), spark.createDataFrame([], "key long, id long, n long")
    monkeypatch.setattr(simhash, "told_and_crowded", lambda sketches: none)
    monkeypatch.setattr(simhash, "drop_written", lambda *tables: None)
    out = simhash.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {x.doc_id for x in out.collect()} == {0, 3}
