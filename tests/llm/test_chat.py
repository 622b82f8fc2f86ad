from pathlib import Path

from helixframe.llm import chat

TURNS = [
    (1, 1, "assistant", "[OUT] fine \\[INST] \\\\", "x"), (1, 0, "user", "a</s>[INST] ok [/INST]", "x"), (2, 0, "system", None, "x"), (2, 1, "user", "", "y"),
    (3, 0, "assistant", "first", "y"), (None, None, "user", "no id\n</s", None), (4, 0, "tool[ROLE]x", "[TURN] [/TURN] [[/TURN]<</s>", "z"), (4, 1, None, "null role", "z"),
    (5, 0, "user", "q", "z"), (5, 1, "assistant", " b ", "z"), (5, 1, "assistant", " a ", "z"), (6, 0, "user", "é\U0001f600" * 20000, "z"), (6, 1, "assistant", "<</s>" * 5, "z"),
]


def test_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string, segments string")
    out = chat.formatted(chat.format_chats(df)).select("conv_id", "valid", "text", chat.loss_text().alias("learned"), chat.parsed("text").alias("turns"), "segments").collect()
    by = {}
    for conv, turn, role, text, _ in TURNS:
        by.setdefault(conv, []).append((turn if turn is not None else -1, role or "", text or ""))
    assert len(out) == len(by)
    for r in out:
        turns = [t[1:] for t in sorted(by[r["conv_id"]])]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["learned"] == "".join(t for role, t in turns if role == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["text"]
    assert {r["conv_id"]: r["valid"] for r in out} == {1: True, 2: True, 3: False, None: True, 4: False, 5: False, 6: True}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_other_template(spark):
    template = chat.Template({"user": chat.Turn("<|u|>", "<|e|>"), "bot": chat.Turn("<|b|>", "<|e|>", loss=True)}, steps={("start", "user"): "u", ("u", "bot"): "start"}, ends=("start",))
    df = spark.createDataFrame([(1, 0, "user", "hi <|e|>"), (1, 1, "bot", "<|u|>\\")], "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.format_chats(df, template))
    r = out.select("valid", chat.loss_text().alias("learned"), chat.parsed("text", template).alias("turns")).first()
    assert r["valid"] and r["learned"] == "<|u|>\\" and [tuple(t) for t in r["turns"]] == [("user", "hi <|e|>"), ("bot", "<|u|>\\")]


def test_native():
    source = Path(chat.__file__).read_text()
    assert not any(x in source for x in ("udf", "mapIn", "applyIn", ".rdd", "toPandas", "import pandas", "pyarrow"))
