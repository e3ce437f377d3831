"""Substring joins against a plain loop."""

import random

from ledgerlight.operators.ladders import tender_metadata
from ledgerlight.operators.substring import substring_pairs


def test_against_all_pairs(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    texts = [("x" if i % 2 else "y", "common " + word(rng.randrange(12))) for i in range(120)] + [("x", None), ("y", ""), ("x", "a%b_c"), ("x", "a%b_c")]
    patterns = [(rng.choice("xy"), word(rng.randrange(5))) for _ in range(80)] + [("x", "common "), ("x", None), ("y", ""), ("x", "%b_"), ("x", "zzz"), ("z", "a")]
    found = substring_pairs(spark.createDataFrame(patterns, "g string, pattern string"), spark.createDataFrame(texts, "g string, text string"), ["g"])
    expected = {(g, p, t) for g, p in patterns for h, t in texts if g == h and p is not None and t is not None and p in t}
    rows = [tuple(r) for r in found.select("g", "pattern", "text").collect()]
    assert set(rows) == expected and len(rows) == len(expected) > 300
    without = substring_pairs(spark.createDataFrame([("",), ("on",)], "pattern string"), spark.createDataFrame([("common",), ("",)], "text string"))
    assert sorted(map(tuple, without.collect())) == [("", ""), ("", "common"), ("on", "common")]


def test_ways_to_a_tender(spark):
    tender = spark.createDataFrame([("s", "t2", "Borough of Sample"), ("s", "t3", "Sample Borough Council"), ("s", "t1", "Sample Borough Council"), ("s", "t4", None), ("other", "t0", "Sample Borough Council")], "source_id string, tender_id string, buyer_name string")
    asked = {"t4": ("t4", "id"), "sample borough→Firm": ("t1", "arrow"), "BOROUGH → Firm": ("t1", "arrow"), "borough OF sample": ("t2", "buyer"), "of samp": ("t2", "part"), "t3:a1": ("t3", "colon"), "t9:a1": (None, None), "nobody": (None, None), "t0": (None, None), "x" * 60: (None, None)}
    rows = tender_metadata(spark.createDataFrame([("s", k) for k in asked] + [("s", None)], "source_id string, subject string"), tender).collect()
    assert {r.subject: (r.tender_id, r.way) for r in rows if r.subject} == asked


def test_texts_are_not_broadcast(spark):
    """Names that compress well are many in memory: only patterns may be sent to all tasks."""
    texts = spark.range(20_000).selectExpr("concat('Customer#', lpad(id, 9, '0')) AS text")
    for patterns in (["00001"], ["00", ""]):
        found = substring_pairs(spark.createDataFrame([(p,) for p in patterns], "pattern string"), texts)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        joins = [x for x in plan.splitlines() if "Join" in x and ("Contains(" in x or "NestedLoop" in x)]
        assert joins and not [x for x in joins if "BroadcastHashJoin" in x]
        assert all("BuildRight" in x for x in joins if "NestedLoop" in x)


def test_candidates_grow_as_names_do(spark):
    """Numbers in names have all three-digit grams in common; longer patterns are looked up by longer ones."""
    from ledgerlight.operators import substring

    names = spark.range(20_000).selectExpr("concat('Customer#', lpad(id, 9, '0')) AS text")
    patterns = names.selectExpr("substr(text, 12, 7) AS pattern")
    chosen, held = substring.looked_up(patterns, names, [])
    assert held.join(chosen, "gram").count() < 20 * 20_000
