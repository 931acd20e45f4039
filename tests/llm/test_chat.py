import hashlib

from compare import connect, differences
from pyspark.sql import functions as F

from trafficlens.llm import chat, queries

ROWS = [
    (1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "assistant", "b &amp; <|im_end|>\n"), (1, 3, "user", None),
    (2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "</s>[INST] ok [/INST]"),
    (3, None, None, None), (4, 5, "assistant", ""), (None, 0, "system", "&#91;é\U0001f642"), (None, 0, "system", "&#91;é\U0001f642"),
    (5, 0, "a\nb<|turn|>", "<|im_start|>user\nx<|turn|>y"), (5, 0, "tool", "\n\n"),
]


def test_round_trip(spark):
    turns = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id bigint, turn bigint, role string, text string, formatted string")
    chats = chat.format_chats(turns)
    got = {r["conv_id"]: r for r in chat.read_chats(chats, "formatted", "loss_spans").collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in ROWS}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in ROWS if r[0] == conv), key=key)]
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == own
        assert got[conv]["loss_texts"] == [text for role, text in own if role == "assistant"]
    assert got[1]["formatted"].count(chat.START) == 3
    assert "[INST]" not in got[2]["formatted"] and "</s>" not in got[2]["formatted"]
    assert chat.format_chats(turns.limit(0)).collect() == []


def test_long_conversation(spark):
    turns = spark.range(3000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("<w "), 20).alias("text"))
    r = chat.read_chats(chat.format_chats(turns)).first()
    assert len(r["turns"]) == 3000 and "".join(r["loss_texts"]) == "<w " * 20 * 1500


def test_query(spark, small):
    assert differences(queries.op3_chat(spark, small), connect(small), queries.SQL["op3_chat"]) == []
    own = queries.op3_chat(spark, small).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert (own["n_turns"], own["loss_chars"], own["loss_sha256"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
