"""Chat formatting in Spark expressions only: one string per conversation, with a loss mask over assistant texts.

A message holds adjacent turns of one role:

    <|im_start|>role
    first text<|turn|>second text<|im_end|>

Inside roles and texts `&`, `<` and `[` become `&amp;`, `&lt;` and `&#91;` (in roles also a line feed), so that no control
string of this or another template can stand there, and reading back is exact. `loss_spans` are code-point ranges of the
formatted string, one for each assistant text.

Null texts and roles read as ''. Turns sort by (turn, role, text), nulls first; repeated rows are turns of their own. A
null conv_id is a conversation. Columns beyond the four named ones play no part, whatever their names. A conversation is
one output row, so it must fit into a row; spans are built by appending, which is fit for thousands of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, TURN, END = "<|im_start|>", "<|turn|>", "<|im_end|>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    return _replaced(text, ESCAPES)


def unescape(text: Column) -> Column:
    return _replaced(text, [(new, old) for old, new in reversed(ESCAPES)])


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start, length>> (start from 0), one row per conversation."""
    none = F.lit("")
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.replace(escape(F.coalesce(F.col(role), none)), F.lit("\n"), F.lit("&#10;")).alias("role"),
            escape(F.coalesce(F.col(text), none)).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    firsts = F.filter(
        F.sequence(F.lit(0), F.size("t") - 1),
        lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"]),
    )
    chats = chats.withColumn("firsts", firsts)
    messages = F.transform("firsts", lambda first, k: F.struct(
        F.get("t", first)["role"].alias("role"),
        F.slice("t", first + 1, F.coalesce(F.get("firsts", k + 1), F.size("t")) - first)["text"].alias("texts"),
    ))
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    fixed = F.lit(False)
    pieces = F.flatten(F.transform("messages", lambda m: F.concat(
        F.array(piece(F.concat(F.lit(START), m["role"], F.lit("\n")), fixed)),
        F.flatten(F.transform(m["texts"], lambda x, k: F.array(
            piece(F.when(k > 0, F.lit(TURN)).otherwise(none), fixed), piece(x, m["role"] == trained_role)))),
        F.array(piece(F.lit(END), fixed)),
    )))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["s"])).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(
                acc["at"].alias("start"), F.length(p["s"]).cast("bigint").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return (
        chats.withColumn("messages", messages).withColumn("pieces", pieces)
        .select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))
    )


def read_chats(chats: DataFrame, *keep: str) -> DataFrame:
    """conv_id, turns array<struct<role, text>> and loss_texts array<string>, read back from the formatted strings; and `keep`."""
    body = F.split("formatted", r"<\|im_end\|>\n", -1)
    messages = F.transform(F.slice(body, 1, F.size(body) - 1), lambda m: F.substring_index(m, START, -1))
    role = lambda m: unescape(F.replace(F.substring_index(m, "\n", 1), F.lit("&#10;"), F.lit("\n")))
    texts = lambda m: F.split(F.substr(m, F.length(F.substring_index(m, "\n", 1)) + 2), r"<\|turn\|>", -1)
    turns = F.flatten(F.transform(messages, lambda m: F.transform(
        texts(m), lambda x: F.struct(role(m).alias("role"), unescape(x).alias("text")))))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.select("conv_id", *keep, turns.alias("turns"), loss.alias("loss_texts"))
