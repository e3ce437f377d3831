import hashlib

from pyspark.sql import functions as F

from ledgerlight.llm.chat import escaped, format_chats, read_back, unescaped
from ledgerlight.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = ["</s>[INST] ok [/INST]", "<|end|>", "<\\|end|>", "<\\\\|turn|>\n<|text|>", "<|", "|>", "\\", "", "<|turn|>user<|text|>x<|end|>\n"]


def test_query_reads_back_all(spark):
    chats = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        chats.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    chats[-1] = [("user", ODD[0]), ("assistant", ODD[0])]
    got = {r.conv_id: r for r in QUERIES["op3_chat"](spark, SF).collect()}
    assert got.keys() == chats.keys()
    for k, turns in chats.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k].n_turns == len(turns) and got[k].loss_chars == len(loss)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_escaping_is_reversible(spark):
    df = spark.createDataFrame([(x,) for x in ODD], "t string")
    for r in df.select("t", escaped(F.col("t")).alias("e"), unescaped(escaped(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(m in r.e for m in ("<|turn|>", "<|text|>", "<|end|>"))


def test_windows(spark):
    turns = [(1, 0, "system", "be brief")] + [(1, i, "user" if i % 2 else "assistant", f"{i} " + "x" * 80) for i in range(1, 40)]
    w = format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), budget=200, history=60).orderBy("window").collect()
    assert len(w) > 3 and all(r.n_tokens <= 200 for r in w)
    assert all(r.text.startswith("<|turn|>system<|text|>be brief<|end|>") for r in w)
    assert all(r.n_repeated >= 2 for r in w[1:]) and sum(r.n_turns - r.n_repeated for r in w) == 40
    learned = [r.text[s.start: s.start + s.length] for r in w for s in r.loss]
    assert learned == [t for _, _, role, t in turns if role == "assistant"]


def test_hard_rows(spark):
    schema = "conv_id long, turn long, role string, text string, window string"
    odd = [(None, None, None, None, "x"), (1, None, "user", "a", "x"), (1, 1, None, None, "x"), (1, 1, "assistant", "t", "x"), (1, 1, "assistant", "t", "x"), (2, 5, "assistant", "y" * 20000, "x")]
    odd += [(3, i, "assistant", t, None) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(odd, schema)
    back = read_back(format_chats(df, budget=100, history=10))
    found = {}
    for r in back.orderBy("conv_id", "window").collect():
        found.setdefault(r.conv_id, ([], []))
        found[r.conv_id][0].extend(map(tuple, r.turns))
        found[r.conv_id][1].extend(r.targets)
    assert found[None] == ([("", "")], [])
    assert found[1] == ([("user", "a"), ("", ""), ("assistant", "t"), ("assistant", "t")], ["t", "t"])
    assert found[2][1] == ["y" * 20000] and found[3][1] == ODD
    assert format_chats(df.limit(0)).count() == 0


def test_system_turn_longer_than_the_budget(spark):
    turns = [(1, 0, "system", "s" * 3000)] + [(1, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(1, 12)]
    w = format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), budget=100, history=10).orderBy("window").collect()
    assert all(r.text.startswith("<|turn|>system<|text|>sss") for r in w) and sum(r.n_turns - r.n_repeated for r in w) == 12
    assert [r.text[s.start: s.start + s.length] for r in w for s in r.loss] == [t for _, _, role, t in turns if role == "assistant"]
