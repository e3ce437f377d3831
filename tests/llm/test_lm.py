import math
from collections import Counter

import pytest

from ledgerlight.llm import lm


def brute(texts, order=3, alpha=0.4, least=2):
    docs = [(t or "").encode().lower().split() for t in texts]
    counts = Counter(tuple(w[i: i + n]) for w in docs for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, docs))
    out = []
    for w in docs:
        score = 0.0
        for i in range(len(w)):
            n = min(order - 1, i)
            while n and counts[tuple(w[i - n: i + 1])] < least:
                n -= 1
                score += math.log(alpha)
            score += math.log(counts[tuple(w[i - n: i + 1])] / (counts[tuple(w[i - n: i])] if n else total))
        out.append((len(w), score))
    return out


@pytest.mark.parametrize("block", [2000, 6_000_000])
@pytest.mark.parametrize("order", [1, 3])
def test_brute_force(spark, sample, monkeypatch, block, order):
    monkeypatch.setattr(lm, "BLOCK", block * 10)
    docs = sample.orderBy("doc_id").limit(60).select("doc_id", "text")
    want = dict(zip([r.doc_id for r in docs.collect()], brute([r.text for r in docs.collect()], order)))
    got = lm.stupid_backoff(docs, order).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.n_tokens == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-6 * max(1, r.n_tokens)


def test_hard_rows(spark, hard, nothing):
    got = lm.stupid_backoff(hard).collect()
    want = brute([r.text for r in hard.collect()])
    assert sorted((r.n_tokens, round(r.score, 6)) for r in got) == sorted((n, round(s, 6)) for n, s in want)
    assert all((r.per_token is None) == (r.n_tokens == 0) for r in got)
    assert lm.stupid_backoff(nothing).count() == 0
