import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlight.llm import suffix
from ledgerlight.llm.queries import QUERIES


def brute(texts, length):
    seen = Counter(t[i: i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - length + 1):
            if seen[t[i: i + length]] > 1:
                gone.update(range(i, i + length))
        runs = sum(1 for i in gone if i - 1 not in gone)
        out.append((len(t), len(gone), runs, bytes(c for i, c in enumerate(t) if i not in gone)))
    return out


def check(spark, texts, length, **more):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, sum(s.last - s.first for s in r.spans), len(r.spans), bytes(r.kept)) for r in suffix.suffix_dedup(docs, length, **more).collect()}
    assert [got[i] for i in range(len(texts))] == brute([(t or "").encode() for t in texts], length)


def material(seed):
    """Passages in several documents with other text around them, periodic texts, copies, and repeats inside one."""
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abé ") for _ in range(n))
    passage = [word(n) for n in (90, 130, 300)]
    texts = [word(r.randint(0, 200)) + r.choice(passage) + word(r.randint(0, 200)) for _ in range(12)]
    return texts + [texts[0], "ab" * 200, "x" * 150, "x" * 400, passage[0] * 3, "", None, passage[1][:99], passage[1][1:100]]


@pytest.mark.parametrize("crowd", [50_000, 2])
@pytest.mark.parametrize("length", [80, 100])
def test_brute_force(spark, length, crowd):
    check(spark, material(length), length, crowd=crowd)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = brute([(d.text or "").encode() for d in docs], 400)
    got = QUERIES["op4_suffix_dedup"](spark, sf).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == [(*w[:3], hashlib.sha256(w[3]).hexdigest()) for w in want]


def test_hard_rows(spark, hard, nothing):
    out = suffix.suffix_dedup(hard.withColumn("kept", F.lit("clash")), 80)
    assert out.columns == ["doc_id", "text", "extra", "n_bytes", "spans", "kept"] and out.count() == 12
    for r in out.collect():
        want = 0 if (r.text or "").startswith(("One", "word", "aaa")) else len((r.text or "").encode())
        assert len(r.kept) == want
    assert suffix.suffix_dedup(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=12), min_size=1, max_size=9))
def test_merge_gives_order_and_common_prefixes(parts):
    runs = []
    for strings in parts:
        strings = sorted(strings)
        runs.append(iter([(s, suffix.common(strings[i - 1], s, 0) if i else 0, i) for i, s in enumerate(strings)]))
    merged = list(suffix.merge_runs(runs))
    got = [s for s, _, _ in merged]
    assert got == sorted(s for p in parts for s in p)
    assert all(n == suffix.common(a, b, 0) for a, (b, n, _) in zip(got, merged[1:]))


@pytest.mark.parametrize("crowd", [50_000, 2])
def test_several_lengths(spark, crowd):
    texts = material(3) + [material(4)[0]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = sorted(suffix.suffix_dedup(docs, 120, also=(64, 90), crowd=crowd).collect(), key=lambda r: r.doc_id)
    data = [(t or "").encode() for t in texts]
    for name, length in (("spans", 120), ("spans_64", 64), ("spans_90", 90)):
        want = brute(data, length)
        assert [(sum(s.last - s.first for s in r[name]), len(r[name])) for r in rows] == [w[1:3] for w in want]
    assert [bytes(r.kept) for r in rows] == [w[3] for w in brute(data, 120)]
    with pytest.raises(ValueError):
        suffix.suffix_dedup(docs, 63)


def test_query_tells_of_shorter_repeats(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = QUERIES["op4_suffix_dedup"](spark, sf).orderBy("doc_id").collect()
    assert [r.n_repeated_240 for r in got] == [w[1] for w in brute([(d.text or "").encode() for d in docs], 240)]


def test_texts_are_shuffled_once(spark, monkeypatch):
    """Texts with anchors are stored; neither runs nor the windows of crowded grams join them again."""
    plans, write = [], suffix.written

    def written(df, tag):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, tag)

    monkeypatch.setattr(suffix, "written", written)
    check(spark, material(80), 80, crowd=2)
    first = dict(reversed(plans))
    assert "Join" in first["there"]
    assert "Exchange" not in first["windows"] and "Join" not in first["windows"]
