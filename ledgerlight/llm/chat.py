"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation is laid out in windows of whole turns. Prefix sums of the turns' tokens decide: a turn belongs to the
window in whose stretch of `room - longest turn` tokens it begins, so a window overruns its budget only where one turn
alone takes more than half of the room. A window starts with the conversation's system turn and repeats the last turns
before it, up to `history` tokens; what is repeated is masked, so each assistant text bears loss in one window only.

Prefix sums are made in two levels: within stretches of STRETCH turn numbers, and over the stretches' sums. A long
conversation is so dealt over many tasks; only windows, which are bounded, are gathered.

The template is <|turn|>role<|text|>text<|end|> and a line feed for each turn. Inside roles and texts, "<" and "|" with
any number of backslashes between get one more, which reading back removes; so a control string never stands in a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import table

STRETCH = 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def estimated_tokens(text: Column) -> Column:
    """Four bytes a token; any other Column function of the rendered turn can be given instead."""
    return F.ceil(F.octet_length(text) / F.lit(4)).cast("long")


def format_chats(conversations: DataFrame, budget: int = 2048, history: int = 256, tokens=estimated_tokens) -> DataFrame:
    """One row per window: conv_id, window, text, n_turns, n_repeated (turns at its head that other windows hold as their
    own), n_tokens, loss (array of start and length in code points of text, one for each assistant text that is not repeated).

    conversations: conv_id, turn, role, text. Turns are ordered by turn (null first), role and text, so ties have a fixed
    order, and repeated rows are turns of their own. A null role or text is empty; rows with a null conv_id form one
    conversation. The system turn is the first turn if its role is system. Other columns are ignored; an empty table
    gives no rows.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    head = F.concat(F.lit("<|turn|>"), escaped(role), F.lit("<|text|>"))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("raw"),
        F.floor(F.col("turn") / STRETCH).alias("stretch"), F.char_length(head).cast("long").alias("head"), F.concat(head, escaped(text), F.lit("<|end|>\n")).alias("shown"),
    ).withColumn("cost", F.greatest(tokens(F.col("shown")), F.lit(1).cast("long")))

    first = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "role")).alias("first"), F.max("cost").alias("longest")).withColumnRenamed("conv_id", "c")
    system = (F.col("role") == "system") & F.col("turn").eqNullSafe(F.col("first.turn")) & (F.col("first.role") == "system")
    turns = turns.join(first, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("system", system).drop("c", "first")

    per_stretch = turns.groupBy("conv_id", "stretch").agg(F.sum("cost").alias("cost"), F.sum(F.when(F.col("system"), F.col("cost")).otherwise(0)).alias("asked"))
    conversation = Window.partitionBy("conv_id")
    offsets = per_stretch.select(
        F.col("conv_id").alias("c"), F.col("stretch").alias("s"),
        F.coalesce(F.sum("cost").over(conversation.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("asked").over(conversation).alias("asked"),
    )
    within = Window.partitionBy("conv_id", "stretch").orderBy("turn", "role", "raw").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(budget) - F.col("asked") - history, F.lit(2))
    turns = (
        turns.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("stretch").eqNullSafe(F.col("s"))).drop("c", "s")
        .withColumn("before", F.col("offset") + F.coalesce(F.sum("cost").over(within), F.lit(0)))
        .withColumn("window", F.floor(F.col("before") / (room - F.least("longest", F.floor(room / 2)))))
        .select("conv_id", "window", "before", "role", "head", "shown", "cost", "system")
    )

    by_window = Window.partitionBy("c").orderBy("w")
    windows = turns.groupBy(F.col("conv_id").alias("c"), F.col("window").alias("w")).agg(F.min("before").alias("start"))
    windows = windows.select("c", "w", F.lead("w").over(by_window).alias("next"), F.lead("start").over(by_window).alias("next_start"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    placed = turns.join(windows, same & (F.col("window") == F.col("w")))
    again = ~F.col("system") & (F.col("next_start") - F.col("before") <= history)
    own, repeated = F.struct("window", F.lit(False).alias("repeated")), F.struct(F.col("next").alias("window"), F.lit(True).alias("repeated"))
    columns = ["conv_id", "window", "before", "role", "head", "shown", "cost", "repeated"]
    shown = placed.withColumn("at", F.explode(F.when(again, F.array(own, repeated)).otherwise(F.array(own)))).withColumn("window", F.col("at.window")).withColumn("repeated", F.col("at.repeated")).select(columns)
    kept = turns.where("system").join(windows.select("c", "w"), same & (F.col("window") != F.col("w"))).withColumn("window", F.col("w")).withColumn("repeated", F.lit(True)).select(columns)

    ahead = Window.partitionBy("conv_id", "window").orderBy("before").rowsBetween(Window.unboundedPreceding, -1)
    laid = shown.unionByName(kept).withColumn("at", F.coalesce(F.sum(F.char_length("shown")).over(ahead), F.lit(0)))
    target = (F.col("role") == "assistant") & ~F.col("repeated")
    span = F.struct((F.col("at") + F.col("head")).alias("start"), (F.char_length("shown") - F.col("head") - len("<|end|>\n")).alias("length"))
    gathered = laid.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("before", "shown"))).alias("all"), F.count("*").alias("n_turns"), F.count_if("repeated").alias("n_repeated"),
        F.sum("cost").alias("n_tokens"), F.array_sort(F.collect_list(F.when(target, span))).alias("loss"),
    )
    text = F.array_join(F.transform("all", lambda x: x["shown"]), "")
    return gathered.select("conv_id", "window", text.alias("text"), "n_turns", "n_repeated", "n_tokens", "loss")


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of role and text that are the window's own), targets (array of texts under the mask)."""
    parts = F.slice(F.split("text", r"<\|end\|>\n"), F.col("n_repeated").cast("int") + 1, (F.col("n_turns") - F.col("n_repeated")).cast("int"))
    turn = lambda x: F.struct(unescaped(F.substring_index(F.substring(x, len("<|turn|>") + 1, 1 << 30), "<|text|>", 1)).alias("role"), unescaped(F.substring_index(x, "<|text|>", -1)).alias("text"))
    target = lambda x: unescaped(F.substring(F.col("text"), (x["start"] + 1).cast("int"), x["length"].cast("int")))
    return windows.select("conv_id", "window", F.transform(parts, turn).alias("turns"), F.transform("loss", target).alias("targets"), F.char_length("text").cast("long").alias("chars"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """format_chats() of all conversations and one more, read back, as digests."""
    extra = spark.sql("SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text UNION ALL SELECT -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    own = read_back(format_chats(chats)).select(
        "conv_id", F.size("turns").cast("long").alias("n"), "chars",
        F.struct("window", F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("said"), F.array_join("targets", "").alias("learned")).alias("w"),
    )
    whole = own.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    said, learned = (F.array_join(F.transform("w", lambda x: x[k]), "") for k in ("said", "learned"))
    return whole.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars")
