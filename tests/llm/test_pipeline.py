"""The stages on a table with planted and hard cases, each against brute force, and on nothing."""

import random

import public_tokenizers
import pytest
from test_decontam import brute as contaminated
from test_langid import plainly
from test_simhash import stay_by_brute_force
from test_suffix import brute as repeated

import corpus_pipeline
from ledgerlight.llm import langid
from ledgerlight.llm.packing import encoder

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def planted(spark):
    """Sample documents; near and exact copies; a passage of 51 short words in two texts; benchmark passages; nulls, empty
    and very long texts, ties, repeated rows; and, as a further column, names that clash with those used inside."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = docs.where("n_chars BETWEEN 1500 AND 3000 AND lang = 'en'").orderBy("doc_id").limit(20).collect()
    r = random.Random(1)
    rows = [tuple(x) for x in clean]
    base = clean[0].text.split()
    vocabulary = sorted({w for x in clean for w in x.text.split() if w.isalpha() and len(w) > 3})
    new = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage = new(51)
    rows += [
        (1000, clean[0].text, "en", "s", 0), (1001, " ".join(base[:-2]), "en", "s", 0), (1002, "12 34 !!", "en", "s", 0), (1003, None, None, None, None), (None, None, None, None, None), (1009, "", "en", "s", 0),
        (1004, " ".join(new(120)) + " " + items[0] + " end", "en", "s", 0), (1005, " ".join(new(90) + passage + new(30)), "en", "s", 0), (1006, " ".join(new(40) + passage + new(80)), "en", "s", 0),
        (1007, " ".join(new(20_000)), "en", "s", 0), (1008, " ".join(new(60)), "en", "s", 0), (1008, " ".join(new(60)), "en", "s", 0),
    ]
    rows += [rows[-1], (None, " ".join(new(70)), "en", "s", 0)]
    return spark.createDataFrame(rows, docs.schema)


def test_stages_by_brute_force(spark, planted):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    table = planted
    before = [tuple(x) for x in table.collect()]
    model = langid.fit(table.where(~langid.held_out()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SF).cache()
        assert table.columns == COLUMNS
        after = [tuple(x) for x in table.collect()]
        key = lambda rows: sorted(rows, key=repr)
        if name == "language_id":
            sure = {x.doc_id: x.score for x in langid.identify(planted, model).collect()}
            assert key(after) == key([x for x in before if plainly(model, x[1]) != "und" and sure[x[0]] >= corpus_pipeline.SURE])
            assert not {1002, 1003, 1009} & {x[0] for x in after}
        elif name == "near_dedup":
            # rows repeated in id and text are one, and a null id is the least
            texts = {(x[0] is not None, x[0] or 0, x[1]): x[1] for x in before}
            assert key(after) == key({x for x in before if (x[0] is not None, x[0] or 0, x[1]) in stay_by_brute_force(texts)})
            assert {1000, 1001}.isdisjoint(x[0] for x in after) and before[0][0] in {x[0] for x in after}
        elif name == "suffix_dedup":
            cut = repeated([x[1].encode() for x in before], corpus_pipeline.PASSAGE)
            want = [(x[0], (t := w[3].decode("utf-8", "ignore")), *x[2:4], len(t)) for x, w in zip(before, cut)]
            assert key(after) == key(want)
            assert [w[1] > 0 for x, w in zip(before, cut) if x[0] in (1005, 1006)] == [True, True]
        else:
            found = {d for d, _ in contaminated(dict(enumerate(x[1] for x in before)), items)}
            assert key(after) == key([x for i, x in enumerate(before) if i not in found])
            assert 1004 not in {x[0] for x in after}
        before = after
    encode = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()
    for x in table.collect():
        if [y[0] for y in before].count(x.doc_id) == 1:
            mine = sorted((p for p in pieces if p.doc_id == x.doc_id), key=lambda p: p.start)
            assert b"".join(bytes(p.ids) for p in mine) == encode(x.text) + bytes(4)
    assert sum(p.length for p in pieces) == sum(len(encode(x[1])) // 4 + 1 for x in before)


def test_clashing_columns(spark, planted):
    """Further columns, named as those that the stages use inside, come through."""
    more = ("id", "t", "d", "th", "row", "n", "u", "v", "key", "kept", "spans", "matches", "score", "n_bytes")
    table = planted.limit(12)
    for c in more:
        table = table.withColumn(c, table["doc_id"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SF)
        assert set(table.columns) == {*COLUMNS, *more}
    assert all(x[c] == x.doc_id for x in table.collect() for c in more)


def test_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = docs if "ids" in out.columns else out


def test_run(spark):
    """All stages in turn keep every document that is nowhere near another and of no benchmark item."""
    pieces = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    assert kept <= {r.doc_id for r in docs.collect()} and len(kept) > 0.7 * docs.count()
