import zlib

from pyspark.sql import functions as F

from ledgerlight.llm import langid
from ledgerlight.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    got = QUERIES["op1_langid"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_hard_rows(spark, hard, nothing):
    model = langid.fit(spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("x", None)] * 2, "text string, lang string"))
    assert model["langs"] == ["de", "en"]
    out = langid.identify(hard.withColumn("score", F.lit("clash")), model)
    assert out.columns == ["doc_id", "text", "extra", "lang_pred", "score"] and out.count() == 12
    for r in out.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
    assert langid.identify(nothing, model).count() == 0
    empty = langid.fit(nothing.select("text", F.col("extra").alias("lang")))
    assert {r.lang_pred for r in langid.identify(hard, empty).collect()} == {"und"}


def test_backoff_goes_to_shorter_grams():
    model = {"langs": ["a", "b"], "words": {"known": (-1.0, -9.0)}, "grams": {"<unk": (-2.0, -1.0), "u": (-9.0, -3.0), "z": (-1.0, -5.0)}}
    scorer = langid.Scorer(model)
    assert tuple(scorer.score("known")) == (-1.0, -9.0)
    assert tuple(scorer.score("unkind")) == (-2.0, -1.0)  # a four-gram is known
    assert tuple(scorer.score("zu")) == (-5.0, -4.0)  # only characters are
    assert scorer.score("qq") == 0.0


def plainly(model, text):
    """The language with the greatest sum over all words, word by word."""
    total = [0.0] * len(model["langs"])
    found = False
    for word in langid.letters()(text or ""):
        found = True
        scores = model["words"].get(word)
        for n in (4, 3, 2, 1):
            if scores:
                break
            known = [model["grams"][g] for g in langid.grams_of(word, n) if g in model["grams"]]
            scores = [sum(x) / len(known) for x in zip(*known)] if known else None
        total = [a + b for a, b in zip(total, scores or [0.0] * len(total))]
    return model["langs"][total.index(max(total))] if found else "und"


def test_query_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.lang_pred for r in QUERIES["op1_langid"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: plainly(model, t) for k, t in texts.items()}


def test_model_counts_by_brute_force(spark):
    import math
    from collections import Counter

    rows = [("the cat saw the dog", "en"), ("der hund sah die katze der hund", "de"), ("a cat the cat", "en")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    words = {k: Counter(w for t, lang in rows if lang == k for w in t.split()) for k in ("de", "en")}
    kept = {w for c in words.values() for w, n in c.items() if n > 1}
    assert set(model["words"]) == kept
    for w in kept:
        for i, k in enumerate(("de", "en")):
            mine = {x: n for x, n in words[k].items() if n > 1}
            assert abs(model["words"][w][i] - math.log((mine.get(w, 0) + 0.1) / (sum(mine.values()) + 0.1 * len(kept)))) < 1e-9
