"""Bottom-k sketches against a brute-force comparison of all pairs."""

import random
import re

import numpy as np
import pytest

from ledgerlight.llm.minhash import bottom_k, least_overlap, listed, may_be_similar, near_duplicates, shingle_set

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    return {tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs, percent=85):
    """Rows as near_duplicates() gives them."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[top(i)] = top(j)
    groups = {}
    for i, (doc_id, _) in enumerate(docs):
        groups.setdefault(top(i) if sets[i] else ("alone", doc_id), []).append(doc_id)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    found = [least[top(i) if sets[i] else ("alone", docs[i][0])] for i in range(len(docs))]
    return sorted(((d, len(s), c, d == c) for (d, _), s, c in zip(docs, sets, found)), key=repr)


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"edit{rng.random()}"
    return out


def corpus(seed):
    """Near copies at all distances, a passage that many texts share, chains of copies, copies that differ in case and blanks."""
    rng, docs = random.Random(seed), []
    passage = [f"p{i}" for i in range(60)]
    for _ in range(12):
        words = [f"w{rng.randrange(10**9)}" for _ in range(rng.choice([3, 8, 40, 120, 400]))]
        docs.append(" ".join(words))
        for _ in range(8):
            docs.append("\t ".join(edited(rng, words, rng.randrange(0, max(1, len(words) // 20) + 1))).upper())
    docs += [" ".join(passage + [f"x{rng.randrange(10**9)}" for _ in range(rng.choice([0, 1, 2, 5, 60]))]) for _ in range(60)]
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1])
def test_brute_force(spark, rows, seed):
    docs = corpus(seed)
    assert rows(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_a_crowd_without_a_centre(spark, rows):
    """Texts that share most of their sketches under the same lists, too far from one another for one centre to link them."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    docs = [(i, " ".join(edited(rng, base, rng.choice([3, 4, 5, 6])))) for i in range(80)]
    found = rows(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert found == brute(docs)
    assert len({r[2] for r in found}) > 5


def test_hard_rows(spark, hard, rows):
    docs = [(r["doc_id"], r["text"]) for r in hard.collect()]
    found = rows(near_duplicates(hard.withColumnRenamed("extra", "keys").selectExpr("*", "'x' AS id", "1 AS n", "2 AS sketch")))
    assert [r[:3] for r in found] == [r[:3] for r in brute(docs)]
    assert all(k == (d == c) for d, _, c, k in found)


def test_no_rows(spark, nothing):
    assert near_duplicates(nothing).count() == 0


def test_other_similarities_and_names(spark, rows):
    docs = corpus(5)[:60]
    found = near_duplicates(spark.createDataFrame(docs, "doc_id long, body string"), percent=60, text="body")
    assert rows(found) == brute(docs, 60)


def test_overlap_bound():
    assert least_overlap(64, 85) == 27
    assert least_overlap(64, 100) == 64
    a = shingle_set(b" ".join(b"%d" % i for i in range(300)), 5)
    assert may_be_similar(a[:64].view(np.int64), a[:64].view(np.int64), 64, 85, 27)
    assert not may_be_similar(a[:64].view(np.int64), a[64:128].view(np.int64), 64, 85, 27)


def test_frequent_values_are_listed_last(spark):
    docs = corpus(1)
    df = spark.createDataFrame([(d, b"x", t.encode()) for d, t in docs], "doc_id long, th binary, text binary")
    sketches = bottom_k(df, 5, 64, "text").withColumnRenamed("doc_id", "id")
    often = {}
    held = {r["id"]: (r["n"], r["sketch"]) for r in sketches.collect()}
    for _, sketch in held.values():
        for v in sketch:
            often[v] = often.get(v, 0) + 1
    for r in listed(sketches, 64, 85).collect():
        n, sketch = held[r["id"]]
        left = set(sketch) - set(r["keys"])
        assert len(r["keys"]) == len(sketch) - min(27, -(-85 * n // 100)) + 1
        assert max(often[v] for v in r["keys"]) <= max(3, min((often[v] for v in left), default=10**9))


def test_near_copies_without_a_centre_are_not_all_compared(spark, rows, monkeypatch):
    """Of many texts that are near one another, few pairs are left for the complete comparison."""
    from ledgerlight.llm import minhash

    rng, left = random.Random(3), []
    base = [f"b{i}" for i in range(200)]
    docs = [(i, " ".join(edited(rng, base, rng.choice([1, 2, 3, 4])))) for i in range(700)]
    complete = minhash.other_pairs
    monkeypatch.setattr(minhash, "other_pairs", lambda *given: left.append(complete(*given)) or left[0])
    monkeypatch.setattr(minhash, "free_shuffles", lambda spark: None)
    counted = minhash.drop_written
    monkeypatch.setattr(minhash, "drop_written", lambda *tables: left.append(tables[-1].count()) if len(tables) == 4 else counted(*tables))
    found = rows(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert found == brute(docs)
    assert left[-1] < len(docs)
