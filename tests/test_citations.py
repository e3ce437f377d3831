"""Citations from fetch to verdict."""

from difflib import SequenceMatcher

import pytest

from ledgerlight.operators import documents as P
from ledgerlight.operators import controls, read_api

PAGE = "The report was published in May. It found that the sample bridge had been closed for repairs since the previous winter. Nobody objected. " * 3


def verdicts(spark, citations, fetches, **more):
    c = spark.createDataFrame(citations, "citation string, url string, quote string")
    f = spark.createDataFrame(fetches, "url string, status_code int, content_type string, body binary")
    return {r.citation: (r.status, None if r.similarity is None else round(r.similarity, 6), r.detail) for r in P.citation_verdicts(c, f, ["blocked.invalid"], ["are you a robot"], **more).collect()}


def test_the_chain(spark):
    html = f"<html><head><title>x</title><noscript>no</noscript></head><body><p>{PAGE}</p></body></html>".encode()
    fetches = [("http://x/a", 200, "text/html", html), ("http://x/gone", 404, "text/html", html), ("http://x/err", 503, None, html), ("http://blocked.invalid/a", 200, None, html), ("http://x/robot", 200, "text/html", b"<p>Are you a ROBOT</p>"),
               ("http://x/a.pdf", 200, None, b"%PDF"), ("http://x/short", 200, "text/plain", b"too short"), ("http://x/latin", 200, "text/plain", ("café " + PAGE).encode("latin-1")), ("http://x/empty", 200, "text/html", b"")]
    quote = "it found the sample bridge was closed for repairs since last winter."
    citations = [("verbatim", "http://x/a", "the sample bridge had  been closed"), ("near", "http://x/a", quote), ("absent", "http://x/a", "0123456789 0123456789"), ("case", "http://x/a", "THE SAMPLE BRIDGE HAD"), ("gone", "http://x/gone", "x"), ("err", "http://x/err", "x"),
                 ("blocked", "http://blocked.invalid/a", "x"), ("robot", "http://x/robot", "x"), ("pdf", "http://x/a.pdf", "x"), ("unknown", "http://x/never", "x"), ("no url", " ", "x"), ("no quote", "http://x/a", None), ("short", "http://x/short", "0123456789"), ("latin", "http://x/latin", "café The report"), ("empty", "http://x/empty", "x")]
    got = verdicts(spark, citations, fetches)
    assert {k: v[0] for k, v in got.items()} == {
        "verbatim": "VERBATIM", "near": "NEAR", "absent": "ABSENT", "case": "NEAR", "gone": "UNFETCHABLE", "err": "UNFETCHABLE", "blocked": "UNFETCHABLE", "robot": "UNFETCHABLE", "pdf": "UNFETCHABLE", "unknown": "UNFETCHABLE",
        "no url": "SKIPPED", "no quote": "SKIPPED", "short": "EXTRACTION_UNRELIABLE", "latin": "VERBATIM", "empty": "EXTRACTION_UNRELIABLE"}
    assert {k: got[k][2] for k in ("gone", "err", "blocked", "robot", "pdf", "unknown", "short")} == {"gone": "not_found", "err": "http_error", "blocked": "blocked_domain", "robot": "challenge_page", "pdf": "no_text", "unknown": "not_fetched", "short": "extracted_text_implausibly_short"}
    sentences = [s for s in PAGE.strip().replace(". ", ".|").split("|")]
    runs = [" ".join(sentences[i: i + n]) for n in (1, 2, 3) for i in range(len(sentences) - n + 1)]
    assert got["near"][1] == round(max(SequenceMatcher(None, quote, s.casefold()).ratio() for s in runs), 6)


def test_a_text_searched_in_part(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_CHARS", 300)
    got = verdicts(spark, [("1", "http://x/a", "0123456789 0123456789")], [("http://x/a", 200, "text/plain", PAGE.encode() * 3)])
    assert got == {"1": ("EXTRACTION_UNRELIABLE", got["1"][1], "searched in part")}


def test_a_url_fetched_twice_and_no_fetch(spark):
    assert verdicts(spark, [("1", "u", "x")], [])["1"][0] == "UNFETCHABLE"
    assert verdicts(spark, [], []) == {}
    got = verdicts(spark, [("1", "http://x/a", "b"), ("2", "http://x/a", "b")], [("http://x/a", 200, "text/plain", b"a b"), ("http://x/a", 200, "text/plain", b"zz")])
    assert {k: v[0] for k, v in got.items()} == {"1": "VERBATIM", "2": "VERBATIM"}


def test_coverage_and_sources(spark):
    entity = spark.createDataFrame([("company", "GB-COH", "1"), ("company", "GB-COH", "2"), ("company", "LEI", "9"), ("person", "GB-COH", "3")], "entity_type string, scheme string, registry_id string")
    numbers = lambda *k: spark.createDataFrame([(x,) for x in k], "company_number string")
    report = read_api.coverage_report("all", entity, numbers("1"), numbers("1"), numbers("1", "2")).first()
    assert (report.ingested, report.failed, report.missing, report.total, report.share) == (1, 1, 0, 2, 0.5)
    assert read_api.coverage_report("procurement_supplier", entity, numbers("1", "1", None), numbers("1"), numbers()).first().share == 1.0
    assert read_api.coverage_report("procurement_supplier", entity, numbers(), numbers("1"), numbers()).first().share is None
    with pytest.raises(ValueError):
        read_api.coverage_report("other", entity, numbers(), numbers(), numbers())
    sources = read_api.list_sources(spark, spark.createDataFrame([("co_secop_ii", "CC"), ("none", "?")], "source_id string, license string")).collect()
    assert [(r.source_id, r.jurisdictions, r.connected) for r in sources] == [("co_secop_ii", ["CO"], True), ("none", None, False)]
    assert "cursor" in read_api.describe_pipeline()


def test_thresholds_and_blocked_controls(spark):
    table = {(r.total, r.recovered): (r.pct, r.passes) for r in controls.threshold_table(spark.createDataFrame([(10,), (10,), (0,)], "total long")).collect()}
    assert table[10, 9] == (90.0, True) and table[10, 8] == (80.0, False) and table[0, 0] == (None, False) and len(table) == 12
    blocked = controls.blocked_controls(spark.createDataFrame([(1, "7"), (2, "NF000001"), (3, None)], "id int, company_number string"), spark.createDataFrame([("00000007",)], "company_number string"))
    assert sorted(r.id for r in blocked.collect()) == [2, 3]


def test_dossier(spark):
    curated = spark.createDataFrame([("i006", "GB", "t1:a1", 9.0), ("i003", "UA", "Buyer→Firm", 9.5), ("i002", None, "t2", 1.0)], "indicator string, jurisdiction string, subject string, score double")
    tender = spark.createDataFrame([("t1", "Bridge", "Council", 123456789, "open", "s"), ("t2", " ", None, 0, None, "s")], "tender_id string, title string, buyer_name string, value_cents long, method string, source_id string")
    assert [tuple(r) for r in read_api.dossier(curated, tender).orderBy("place").collect()] == [
        (1, "Flag 1: i003 in UA", "(no title)", "(unknown buyer)", "not available", "not stated", "none on record"), (2, "Flag 2: i006 in GB", "Bridge", "Council", "1,234,567.89", "open", "s t1"),
        (3, "Flag 3: i002 in an unknown place", "(no title)", "(unknown buyer)", "not available", "not stated", "s t2")]


def test_letters_that_are_frequent_count(spark):
    """Of a quote of 250 characters every seventh word is left out: it is near, though each letter is frequent."""
    words = [w for k in range(9) for w in ("the", "river", f"ran{k}", "over", "the", "stones")]
    quote, page = " ".join(words), "before " + " ".join(w for i, w in enumerate(words) if i % 7 != 6) + " after"
    assert len(quote) > 200
    got = verdicts(spark, [("1", "http://x/a", quote)], [("http://x/a", 200, "text/plain", page.encode())])
    assert got["1"][:2] == ("NEAR", round(SequenceMatcher(None, quote, page, autojunk=False).ratio(), 6))


def test_best_ratio(monkeypatch):
    import random

    r = random.Random(1)
    monkeypatch.setattr(P, "STRETCH", 20)
    for _ in range(300):
        quote, text = ("".join(r.choice("abcABdß .") for _ in range(r.randint(1, 40))) for _ in range(2))
        spans = [(i, j) for i in range(0, len(text), 3) for j in (i + 1, min(len(text), i + 9), len(text))]
        assert P.best_ratio(quote, text, spans) == max(SequenceMatcher(None, quote.casefold(), text[i:j].casefold(), autojunk=False).ratio() for i, j in spans)


def test_many_passages_at_once(monkeypatch):
    """Ratios are difflib's, in whatever parts passages are looked at, and few passages are matched to the end."""
    import random

    import numpy as np

    from ledgerlight.operators import ratios

    r = random.Random(2)
    words = ["".join(r.choice("eeetaoinshrdlucmfwyp") for _ in range(r.randint(2, 8))) for _ in range(300)]
    quotes = [" ".join(r.choices(words, k=k)) for k in (1, 30, 40)] + ["aaaa aaaa", "xyz"]
    texts = [" ".join(r.choices(words, k=300)) for _ in range(2)] + [" ".join(r.choices(words, k=60)) + quotes[2] + "z", "aaaaaaaaaaab" * 20, ""]
    spans = [np.array([(i, min(i + w, len(t))) for w in (5, 90, 200) for i in range(0, len(t), 30)], np.int64).reshape(-1, 2) for t in texts]
    exact = [max([SequenceMatcher(None, q, t[a:b], autojunk=False).ratio() for a, b in s], default=0.0) for q, t, s in zip(quotes, texts, spans)]
    seen = []
    rest = ratios._Passages.rest
    monkeypatch.setattr(ratios._Passages, "rest", lambda self, areas: (seen.extend(np.unique(areas[0])), rest(self, areas))[1])
    assert ratios.best_ratios(quotes, texts, spans, [0.0] * 5, 8192) == exact
    assert len(seen) < sum(map(len, spans)) / 4
    assert ratios.best_ratios(quotes, texts, spans, [0.5] * 5, 8192) == [max(0.5, x) for x in exact]
    for held, together, stretch in ((40, 1 << 16, 8192), (1 << 19, 500, 300)):
        monkeypatch.setattr(ratios, "HELD", held)
        monkeypatch.setattr(ratios, "TOGETHER", together)
        assert ratios.best_ratios(quotes, texts, spans, [0.0] * 5, stretch) == exact


def test_copies_are_compared_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, PAGE), (2, PAGE), (3, "A text of its own, with nothing to be found."), (4, None), (5, PAGE.upper())], "doc_id long, text string")
    quotes = spark.createDataFrame([(7, "it found that the sample bridge was shut"), (8, "no such thing here")], "item_id long, quote string")
    fuzzy, compared = P.fuzzy, []
    monkeypatch.setattr(P, "fuzzy", lambda pairs, threshold: (compared.extend(r.pair for r in pairs.collect()), fuzzy(pairs, threshold))[1])
    got = {r.pair: (r.similarity, r.status) for r in P.near_citations(docs, quotes).collect()}
    assert sorted(compared) == ["1/7", "5/7"] and sorted(got) == ["1/7", "2/7", "5/7"] and got["1/7"] == got["2/7"] == got["5/7"]
    pairs = P.citation_pairs(docs.select("doc_id", P.plain_quotes("text").alias("text")), quotes)
    assert {r.pair: (r.similarity, r.status) for r in fuzzy(pairs.select(P.F.concat_ws("/", "doc_id", "item_id").alias("pair"), "quote", "text")).collect()} == got
