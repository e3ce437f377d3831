from pyspark.sql import functions as F

from ledgerlight.llm.queries import QUERIES
from ledgerlight.llm.sentences import sentence_dedup, splitter


def brute(docs, run=2):
    """docs: {(doc_id, text)}, each once. Runs of any number of words; a text of fewer sentences is one run."""
    split, seen, out = splitter(), set(), {}
    for doc_id, text in sorted(docs):
        parts = split(text)
        folded = [" ".join(p.split()) for p in parts]
        covered = set()
        for i in range(max(len(parts) - run, 0) + 1):
            key = tuple(folded[i: i + run])
            if any(key):
                covered.update(range(i, min(i + run, len(parts))) if key in seen else ())
                seen.add(key)
        out[doc_id] = "".join(p for i, p in enumerate(parts) if i not in covered), len(parts), len(covered)
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op10_sentence_dedup"](spark, sf).collect()
    assert {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in got} == brute(docs)


def test_split_loses_nothing():
    for text in ("", "  a. b! c?\n\nd", "no end", "...", "\n\n x.\n", "He said “so.” Then left."):
        assert "".join(splitter()(text)) == text
    assert splitter()("A b. C d! E\nF") == ["A b. ", "C d! ", "E\n", "F"]


def test_hard_rows(spark, hard, nothing):
    out = sentence_dedup(hard.withColumn("n_removed", F.lit("clash")), 2, 10)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "n_sentences", "n_removed"] and len(rows) == 12
    assert [r.n_removed for r in rows if r.doc_id == 1] == [0, 0]  # repeated rows are one document
    assert [(r.text, r.n_removed) for r in rows if r.doc_id == 2] == [("", 3)]
    assert sum(r.text is None for r in rows) == 2 and all(r.n_removed == 0 for r in rows if r.doc_id != 2)
    assert sentence_dedup(nothing).count() == 0


def test_repeats_inside_a_document(spark):
    passage = "One two three four five six seven. Eight nine ten eleven twelve thirteen. "
    rows = sentence_dedup(spark.createDataFrame([(1, passage + "Between them. " + passage)], "doc_id long, text string")).first()
    assert rows.text == passage + "Between them. "


def test_short_sentences_and_short_texts(spark, sample):
    verse = "".join(f"line {i}\n" for i in range(30))
    docs = {(1, "Yes. No. " + verse), (2, verse + "Other end."), (3, "Alone."), (4, "Alone."), (5, " \n"), (6, " \n"), (7, "Hi. Ho."), (8, "Hi. Ho.")}
    docs |= {(100 + r.doc_id, r.text) for r in sample.collect()}
    out = sentence_dedup(spark.createDataFrame(list(docs), "doc_id long, text string")).collect()
    got = {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in out}
    assert got == brute(docs)
    assert got[2] == ("Other end.", 31, 30) and got[4] == ("", 1, 1) and got[8] == ("", 2, 2)
