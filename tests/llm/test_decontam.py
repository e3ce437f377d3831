import random
import time
from collections import Counter

from pyspark.sql import functions as F

from ledgerlight.llm import decontam
from ledgerlight.llm.queries import QUERIES


def brute(docs, items, similarity=0.8, k=5):
    shingles = lambda w: Counter(tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1)))
    found = set()
    for d, text in docs.items():
        words = decontam.words_of(text)
        for i, item in items.items():
            asked = decontam.words_of(item)
            n = len(asked)
            if n and any(decontam.weighted_jaccard(shingles(words[s: s + n]), shingles(asked)) >= similarity for s in range(len(words) - n + 1)):
                found.add((d, i))
    return found


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda t, k: {r[k]: r.text for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()}
    got = QUERIES["op7_decontamination"](spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(read("documents", "doc_id"), read("benchmark", "item_id"))


def test_near_passages_and_short_items(spark):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(400)}"
    items = {i: " ".join(word() for _ in range(n)) for i, n in enumerate([3, 5, 8, 30, 60, 120] * 4)}
    docs = {}
    for d in range(60):
        words = [word() for _ in range(150)]
        passage = items[d % 24].split()
        for _ in range(d % 3):
            passage[r.randrange(len(passage))] = word()
        at = r.randrange(150)
        docs[d] = " ".join(words[:at] + [w.upper() + "," for w in passage] + words[at:])
    frame = lambda rows, schema: spark.createDataFrame(list(rows.items()), schema)
    out = decontam.contamination(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"))
    got = {(x.doc_id, m.item_id) for x in out.collect() for m in x.matches}
    want = brute(docs, items)
    assert len(want) > 20 and got <= want and len(got) >= 0.98 * len(want)


def test_hard_rows(spark, hard, nothing):
    items = spark.createDataFrame([(1, "four five six seven eight"), (2, None), (None, "a b c"), (3, ""), (4, "!!"), (1, "four five six seven eight"), (5, "漢字")], "item_id long, text string")
    out = decontam.contamination(hard.withColumn("matches", F.lit("clash")), items)
    assert out.columns == ["doc_id", "text", "extra", "matches"] and out.count() == 12
    assert {(r.doc_id, m.item_id) for r in out.collect() for m in r.matches} == {(1, 1), (2, 1), (9, 5)}
    assert decontam.contamination(nothing, items).count() == 0
    assert decontam.contamination(hard, items.limit(0)).where("size(matches) > 0").count() == 0


def test_items_in_several_parts(spark, hard, monkeypatch):
    items = spark.createDataFrame([(i, "four five six seven eight") for i in range(5)], "item_id long, text string")
    monkeypatch.setattr(decontam, "PART", 8)
    out = decontam.contamination(hard, items).where("doc_id = 2").first()
    assert sorted(m.item_id for m in out.matches) == list(range(5))


def test_text_shorter_than_its_item(spark):
    words = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:7]))], "item_id long, text string")
    texts = {1: words[:-3], 2: words[2:-1], 3: words[:40], 4: words[:6], 5: words[:3]}
    out = decontam.contamination(spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string"), items)
    assert {(r.doc_id, m.item_id, m.n_words) for r in out.collect() for m in r.matches if m.item_id == 1} == {(1, 1, 57), (2, 1, 57)}


def test_many_items_of_one_size(spark):
    """Items that have nothing to do with a text cost nothing, and none of the others is lost."""
    r = random.Random(11)
    items = {i: " ".join(f"w{r.randrange(300)}" for _ in range(12)) for i in range(3000)}
    docs = {d: " ".join(f"w{r.randrange(300)}" for _ in range(60)) + " " + items[d * 7] + " end" for d in range(40)}
    frame = lambda rows, schema: spark.createDataFrame(list(rows.items()), schema)
    out = decontam.contamination(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"))
    got = {(x.doc_id, m.item_id) for x in out.collect() for m in x.matches}
    assert {(d, d * 7) for d in docs} <= got and got == brute(docs, items)


def test_items_with_a_common_opening():
    """Items of one template, and a text that repeats their opening: neither time nor matches go with their number."""
    r = random.Random(12)
    opening = "which of the following statements is"
    items = [(i, f"{opening} " + " ".join(f"w{r.randrange(5000)}" for _ in range(35))) for i in range(3000)]
    began = time.time()
    index = decontam.Index(items, 5, 20, 0.8)
    built = time.time() - began
    filler = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    text = " ".join(f"{opening} {filler(150)}" for _ in range(50)) + " " + items[7][1] + " " + items[8][1]
    began = time.time()
    found = index.matches(text)
    assert [m[0] for m in found] == [7, 8] and time.time() - began < 1 and built < 20
    docs = {0: text, 1: f"{opening} " * 40}
    few = dict(items[5:9])
    assert {(d, m[0]) for d in docs for m in decontam.Index(list(few.items()), 5, 20, 0.8).matches(docs[d])} == brute(docs, few)


def test_items_that_are_mostly_alike():
    """All but a few words in common: listed under what they share too, so none is lost; windows are counted exactly."""
    r = random.Random(13)
    common = [f"c{i}" for i in range(60)]
    items = {}
    for i in range(30):
        words = list(common)
        words[r.randrange(60)] = f"own{i}"
        items[i] = " ".join(words)
    docs = {0: "before " + items[3] + " after", 1: " ".join(common[2:]) + " end of it", 2: " ".join(common[:30])}
    index = decontam.Index(list(items.items()), 5, 64, 0.8)  # any fingerprint is near enough
    found = {(d, m[0]): m[5] for d in docs for m in index.matches(docs[d])}
    shingles = lambda w: Counter(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4)))
    expected = {}
    for d, text in docs.items():
        words = text.split()
        for i, item in items.items():
            n = min(60, len(words))
            alike = sum(decontam.weighted_jaccard(shingles(words[s: s + n]), shingles(item.split())) >= 0.8 for s in range(len(words) - n + 1))
            if alike:
                expected[d, i] = alike
    assert found == expected and len(found) >= 10
