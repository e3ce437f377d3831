"""Whitening against numpy on all vectors at once."""

import math
from fractions import Fraction

import numpy as np
import pytest

from ledgerlight.llm.queries import QUERIES
from ledgerlight.llm.whitening import merged, summed, whiten

SF = "/root/testdata/sf0.001"


def checked(found, rows, n_components=4):
    """found: rows of the query, by (id, component); rows: (id, vector) as read. Compares with the definition."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), np.int64)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    exact = [[sum((n * int(r[i]) - sums[i]) * (n * int(r[j]) - sums[j]) for r in fit.tolist()) for j in range(3)] for i in range(3)]
    centred = fit - np.array([float(Fraction(s, n)) for s in sums])
    v = centred.T @ centred / n
    assert np.allclose(v[:3, :3], np.array([[float(Fraction(e, n**3)) for e in r] for r in exact]), rtol=1e-10)
    values, basis = np.linalg.eigh(v)
    order = np.argsort(-values)[:n_components]
    white = {}
    for r in found:
        assert r["n"] == n and r["identity_error"] <= 1e-4
        assert r["explained"] == pytest.approx(values[order[r["component"] - 1]] / np.trace(v), rel=1e-4)
        white.setdefault(r["component"], []).append(r)
    by_id = dict(kept)
    for c, rs in white.items():
        assert sorted(r["vec_id"] for r in rs) == sorted(i for i, _ in kept)
        mine = np.array([r["whitened"] for r in rs])
        other = np.array([(np.array(by_id[r["vec_id"]]) - np.array(sums) / n) @ basis[:, order[c - 1]] for r in rs]) / math.sqrt(values[order[c - 1]])
        assert np.allclose(mine, other, atol=1e-8) or np.allclose(mine, -other, atol=1e-8)
        for r in rs:
            assert r["deviation"] == sum((n * x - s) ** 2 for x, s in zip(by_id[r["vec_id"]], sums))
    assert set(white) == set(range(1, n_components + 1))


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    checked(QUERIES["op11_whitening"](spark, SF).collect(), rows)


def test_unusable_and_repeated_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [5, 3, 2, 1, 0.5]], 1) for i in range(200)]
    rows += [(1000 + i, rows[i % 3][1], None) for i in range(300)]  # copies have no weight
    rows += [(2000, None, 1), (2001, [1.0, None, 1.0, 1.0, 1.0], 1), (2002, [math.nan] * 5, 1), (2003, [math.inf, 0.0, 0.0, 0.0, 0.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    read = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    found = QUERIES["op11_whitening"](spark, str(tmp_path)).collect()
    checked(found, read)
    assert found[0]["n"] == 200


def test_other_rows(spark):
    """Other lengths, empty vectors, null and repeated ids, clashing names, huge entries."""
    rows = [(None, [0.0, 1.0], "a", 1), (1, [1.0, 0.0], "b", 2), (1, [1.0, 0.0], "b", 2), (2, [3.0, 5.0], "c", 3), (3, [], "d", 4), (4, [1.0], "e", 5), (5, [1e30, -1e30], "f", 6)]
    found = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, white string, row int"), scale=256).collect()
    assert sorted(r["row"] for r in found) == [1, 2, 2, 3, 6]
    assert {r["n"] for r in found} == {4}
    assert [r["deviation"] for r in found if r["row"] == 6] == [None]
    assert all(len(r["white"]) == len(r["explained"]) for r in found)


def test_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], kind)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind), scale=256).count() == 0
    some = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0])], kind)).collect()  # one of two components has none
    assert [len(r["white"]) for r in some] == [1, 1] and sorted(abs(r["white"][0]) for r in some) == [1, 1]


def test_merging_is_exact_about_sums_and_stable():
    rng = np.random.default_rng(2)
    x = rng.integers(-100, 100, (1000, 6)) + 10**9
    found = summed(x[:1])
    for part in np.array_split(x[1:], 13):
        found = merged(found, summed(part))
    assert found[:2] == (1000, x.sum(axis=0).tolist())
    assert np.allclose(found[2] / 1000, np.cov(x.T, bias=True), rtol=1e-6)
    assert summed(np.full((3, 2), 1 << 62))[1] == [3 << 62] * 2
