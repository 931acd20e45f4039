"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, contamination, html_text, language, lexical_search, lm_score, mixing, near_dup, piece_codec, quality, secrets, spelling, sql, token_files


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _remainder(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = contamination.contamination(docs, _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        contamination.item_digest(F.col("item_ids")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.main_text(_table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("*", F.length("text").cast("bigint").alias("n_chars"))


def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = chat.format_chats(turns.unionByName(extra))
    back = chat.read_chats(chats, "formatted")
    turn_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turn_text, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return quality.quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op5_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def _is_kind(kind: str):
    return lambda x: x["kind"] == kind


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secret_spans(_table(spark, folder, "documents").select("doc_id", "text"))
    base = [kind for kind, *_ in secrets.BASE]
    known = F.filter("spans", lambda x: x["kind"].isin(base))
    counts = [F.size(F.filter("spans", _is_kind(kind))).cast("bigint").alias(f"n_{kind}") for kind in base]
    return found.select("doc_id", *counts, F.sha2(secrets.digest(known), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~_remainder(4).eqNullSafe(2)))
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out")
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    path = token_files.write_token_files(docs, tokenizer_path(), token_files.fresh_path(spark))
    return token_files.read_token_files(spark, path)


def op10_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return lm_score.lm_scores(docs, _remainder(7) == 2)


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark"))


def op12_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    docs = piece_codec.encode(_table(spark, folder, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    return piece_codec.decode(docs, path).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_html_text": op2_html_text,
    "op3_chat": op3_chat,
    "op4_quality": op4_quality,
    "op5_near_dup": op5_near_dup,
    "op6_secrets": op6_secrets,
    "op7_language": op7_language,
    "op8_mixing": op8_mixing,
    "op9_token_files": op9_token_files,
    "op10_lm_score": op10_lm_score,
    "op11_lexical_search": op11_lexical_search,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_spelling_variants": op13_spelling_variants,
}
SQL: dict[str, str] = {
    "op1_decontamination": sql.DECONTAMINATION,
    "op3_chat": sql.CHAT,
    "op5_near_dup": sql.NEAR_DUP,
    "op8_mixing": sql.mixing_sql(),
    "op11_lexical_search": sql.LEXICAL_SEARCH,
    "op13_spelling_variants": sql.SPELLING,
}
