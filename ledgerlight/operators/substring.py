"""Which texts contain which patterns, without comparing all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of grams: a pattern is looked up by the longest that fit into it, one of fewer than three by its own length.
GRAMS = (1, 2, 3, 6, 12)


def _grams(text: str, sizes: Column) -> Column:
    """Distinct runs of so many characters of a text, for each of an array of sizes."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n))
    return F.array_distinct(F.filter(F.flatten(F.transform(sizes, of)), lambda g: g != ""))


def looked_up(asked: DataFrame, have: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """keys, pattern and the gram it is looked up by; and keys, text and those of its grams that patterns have. Long patterns have
    long grams: one of three digits is in as many names as there are names, one of six in a thousandth of them."""
    size = F.greatest(*(F.when(F.char_length("pattern") >= n, n).otherwise(1) for n in GRAMS))
    by_gram = asked.where("pattern <> ''").select(*keys, "pattern", F.explode(_grams("pattern", F.array(size))).alias("gram"))
    # only grams that patterns have are counted and joined
    wanted = by_gram.select(*keys, "gram").distinct()
    held = have.select(*keys, "text", F.explode(_grams("text", F.array(*map(F.lit, GRAMS)))).alias("gram")).join(wanted, [*keys, "gram"], "left_semi")
    often = held.groupBy(*keys, "gram").agg(F.count("*").alias("n"))
    rarest = by_gram.join(often, [*keys, "gram"], "left").groupBy(*keys, "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    return rarest.where("least.n > 0").select(*keys, "pattern", F.col("least.gram").alias("gram")), held


def substring_pairs(patterns: DataFrame, texts: DataFrame, group: list[str] | None = None) -> DataFrame:
    """group, pattern, text: each distinct pattern with each distinct text of its group that contains it, character by
    character. patterns: group, pattern; texts: group, text. Nulls match nothing; an empty pattern is in every text.

    Every pattern is looked up by one of its grams alone, the one that the fewest texts of the group have: an equi-join on
    it gives the candidates, which are then compared as a whole. A pattern with a gram that no text has is done with at once.
    So frequent beginnings of names cost nothing, unless a pattern has no rarer part.
    """
    keys = group or []
    asked = patterns.select(*keys, "pattern").dropna().distinct()
    have = texts.select(*keys, "text").dropna().distinct()
    chosen, held = looked_up(asked, have, keys)
    # texts are never sent to all tasks, however small their names are when compressed
    found = held.hint("merge").join(chosen, [*keys, "gram"]).where(F.contains("text", F.col("pattern"))).select(*keys, "pattern", "text")
    empty = asked.where("pattern = ''")  # one row a group: it is in all texts
    whole = (have.hint("merge").join(empty, keys) if keys else have.crossJoin(F.broadcast(empty))).select(*keys, "pattern", "text")
    return found.unionByName(whole)
