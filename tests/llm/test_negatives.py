"""Hard negatives against a plain loop over all pairs."""

import math
import random

import numpy as np
import pytest

from ledgerlight.llm import negatives
from ledgerlight.llm.negatives import hard_negatives, narrow, product, wide

KIND = "vec_id long, embedding array<double>, label int, x string, block int"


def brute(rows, every=100, most=5, low=80, high=100):
    fine = sorted((i, l, tuple(math.floor(256 * c) for c in v)) for i, v, l, *_ in rows if i is not None and l is not None and v is not None and all(c is not None and math.isfinite(c) for c in v))
    fine = list({i: (i, l, x) for i, l, x in reversed(fine)}.values())
    found = []
    for a, label, x in fine:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, l) for i, l, y in fine if i != a)
        for s, p, _ in [t for t in scored if t[2] == label][:most]:
            window = [(n, i) for n, i, l in scored if l != label and low * -s <= 100 * -n <= high * -s][:most]
            found += [(a, p, rank, i, -s, -n) for rank, (n, i) in enumerate(window, 1)]
    return sorted(found, key=repr)


def embeddings(seed, n, d, labels):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(d)] for _ in range(labels)]
    hot = lambda: 0 if rng.random() < 0.4 else rng.randrange(labels)  # noqa: E731  one label holds a third
    return [(i * 5, [c + rng.gauss(0, 0.15) for c in rng.choice(centres)], hot(), "", 1) for i in range(n)]


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("ANCHORS", 3), ("ROWS", 16), ("CHUNK", 4)):
        monkeypatch.setattr(negatives, name, value)


def test_many_blocks(spark, rows, small_blocks):
    made = embeddings(1, 300, 11, 6)
    found = rows(hard_negatives(spark.createDataFrame(made, KIND).repartition(5), every=20))
    assert found == brute(made, 20) and len(found) > 300


def test_ties_and_unusable_rows(spark, rows, small_blocks):
    made = [(i, [float(i % 3), 1.0, float(i % 2)], i % 4, "a", 0) for i in range(120)]
    made += [(None, [1.0, 1.0, 1.0], 1, "a", 0), (200, None, 1, "a", 0), (300, [1.0, None, 1.0], 1, "a", 0), (400, [math.nan, 1.0, 1.0], 1, "a", 0), (500, [math.inf, 1.0, 1.0], 1, "a", 0), (600, [1.0, 1.0, 1.0], None, "a", 0)]
    made += [(100, [2.0, 1.0, 0.0], 9, "a", 0), (100, [2.0, 1.0, 0.0], 9, "a", 0)]  # rows of one vec_id: the least stays
    made += [(700, [1.0], 1, "a", 0), (800, [], 1, "a", 0), (900, [-1.0, -1.0, -1.0], 2, "a", 0)]  # shorter ones; negative scores
    assert rows(hard_negatives(spark.createDataFrame(made, KIND))) == brute(made)


def test_windows(spark, rows, small_blocks):
    made = embeddings(2, 100, 5, 3)
    df = spark.createDataFrame(made, KIND)
    assert rows(hard_negatives(df, every=25, positives=2, negatives=2, low=30, high=90)) == brute(made, 25, 2, 30, 90)


def test_nothing_to_find(spark):
    for made in ([], [(1, [1.0], 1, "", 0)], [(100, [1.0], 1, "", 0)], [(100, [1.0], 1, "", 0), (1, [1.0], 2, "", 0)]):
        assert hard_negatives(spark.createDataFrame(made, KIND)).count() == 0


def test_exact_beyond_doubles(spark, rows):
    made = [(100, [4e5, 1.0], 1, "", 0), (1, [4e5, 1.0], 1, "", 0), (2, [4e5, 0.999], 2, "", 0), (3, [4e5, 0.996], 2, "", 0)]
    found = rows(hard_negatives(spark.createDataFrame(made, KIND)))
    assert found == brute(made) and len({r[5] for r in found}) == 2
    made = [(100, [1e300, 1.0], 1, "", 0), (1, [1e300, 1.0], 1, "", 0), (2, [1e300, 1.0], 2, "", 0)]
    assert len(rows(hard_negatives(spark.createDataFrame(made, KIND)))) == 1


def test_matrices():
    rng = np.random.default_rng(1)
    for bits in (6, 14, 30, 60):
        x = rng.integers(-(1 << bits), 1 << bits, (4, 7))
        assert (wide(narrow(x), 4, 7) == x).all() and len(narrow(x)) <= 28 * (bits + 9) // 8
    a, b = rng.integers(-(1 << 28), 1 << 28, (3, 5)), rng.integers(-(1 << 28), 1 << 28, (4, 5))
    assert (product(a, b) == (a.astype(object) @ b.T.astype(object)).astype(np.int64)).all()
