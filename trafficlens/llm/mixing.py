"""Mixing sources to target weights, in DataFrame operations only.

The words of a source form one stream, cut into blocks of a fixed number of words. Every output shard draws its source
counts from the target weights; the draws are stratified, so that counts over all shards add up to each source's target
(a multinomial draw without the noise of the totals). A source's j-th draw takes block permutation(j mod blocks), so a
block comes again only after all others have come. Permutations are swap-or-not shuffles, computed in place for any
number of blocks. Draws and document pieces meet in an equi-join on (source, block).

Order of a source's stream: chunks of document ids (id modulo the number of chunks), then id, then a hash of the text;
sums of chunks come first, so no window holds a whole source. Reruns give equal results. A null source is a source of its
own and ranks last; null, empty and blank texts have size 0 and nothing is taken from them; null ids count as 0 in the
order; repeated rows are rows of their own. A text's words are split once, however long it is. Extra columns play no part.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lineage import cut
from .names import fresh

WEIGHTS = (5, 2, 1)
#: most copies of a source's words
REPEATS = 3
BLOCK_WORDS = 64
#: blocks of an output shard
SHARD_SLOTS = 1024
ROUNDS = 12
PRIME = 2**31 - 1
#: draws of a task, about
TASK_SLOTS = 1 << 16
#: rows of documents in a chunk, about, and the least number of chunks of a source
CHUNK_ROWS, CHUNKS = 50_000, 64

_random = random.Random(20260102)
KEYS = [[_random.randrange(1, PRIME) for _ in range(4)] for _ in range(ROUNDS)]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def permuted(x: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """The place of x in a pseudorandom permutation of 0 .. n - 1 that depends on the small integer `key`."""
    rounds = F.array(*(F.array(*(F.lit(k).cast("bigint") for k in ks)) for ks in (KEYS[::-1] if inverse else KEYS)))

    def swap(x: Column, ks: Column) -> Column:
        shift = (((key + 1) * ks[0]) % PRIME * PRIME + ((key + 1) * ks[1]) % PRIME) % n
        other = (shift - x + n) % n
        z = (F.greatest(x, other) % PRIME * ks[2] + (key + 1) * ks[3]) % PRIME
        return F.when((z * z % PRIME) / PRIME >= 0.5, other).otherwise(x)

    return F.aggregate(rounds, x.cast("bigint"), swap)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, text_hash) of all documents, written once, since everything below starts from it."""
    return cut(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("text_hash"),
    ))


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: rank, source_size, target, and its numbers of blocks and draws and its first slot.

    Targets share the sum of sizes by weight; where a share is above `repeats` times the size, it stops there and the
    rest is shared again. With sources in the order of size / weight the final level is the largest of the levels that
    result when all sources before one are stopped.
    """
    everything, whole = Window.partitionBy(), Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(ranked) - 1) % len(weights)).cast("bigint")
    out = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "*", F.row_number().over(ranked).cast("bigint").alias("rank"), weight.alias("weight"))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    cap = F.col("source_size") * repeats
    total = F.sum("source_size").over(whole)
    before = F.sum(cap).over(by_level.rowsBetween(Window.unboundedPreceding, -1))
    left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("level", (total - F.coalesce(before, F.lit(0))).cast("double") / left)
    out = out.withColumn("target", F.least(cap.cast("double"), F.max("level").over(everything) * F.col("weight")))
    out = out.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("bigint"))
    draws = F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5).cast("bigint")
    out = out.withColumn("draws", F.when(F.col("source_size") > 0, F.least(draws, F.col("blocks") * repeats)).otherwise(0))
    first = F.sum("draws").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    return out.select("source", "rank", "source_size", "target", "blocks", "draws",
                      F.coalesce(first, F.lit(0)).alias("first_slot"), F.sum("draws").over(whole).alias("slots"))


def draw_slots(sources: DataFrame, shard_slots: int = SHARD_SLOTS, piece: int = 4096) -> DataFrame:
    """(shard, slot, rank, block): every slot of every output shard and the block that fills it.

    Slot numbers are a permutation of the strata 0 .. slots - 1, which lie source after source; a shard's source counts
    are therefore a draw without replacement from the target counts.
    """
    pieces = sources.where("draws > 0").select(
        "rank", "blocks", "draws", "first_slot", "slots",
        F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("draws") - 1), F.lit(piece).cast("bigint"))).alias("from"))
    # a number of partitions keeps these few small rows from being merged into one, whose draws one task would make
    slots = sources.agg(F.max("slots")).first()[0] or 0
    parts = max(1 + slots // TASK_SLOTS, sources.sparkSession.sparkContext.defaultParallelism)
    each = pieces.repartition(parts, "rank", "from").select(
        "*", F.explode(F.sequence("from", F.least(F.col("from") + piece, F.col("draws")) - 1)).alias("j"))
    slot = permuted(F.col("first_slot") + F.col("j"), F.col("slots"), F.lit(0).cast("bigint"), inverse=True)
    return each.select("rank", permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.col("rank")).alias("block"), slot.alias("slot")) \
        .select(F.expr(f"slot div {shard_slots}").alias("shard"), "slot", "rank", "block")


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """sizes with rank, source_size, target and `start`, the document's first word in its source's stream."""
    chunks = max(CHUNKS, sizes.count() // CHUNK_ROWS)
    same = sizes["source"].eqNullSafe(sources["source"])
    rows = sizes.join(sources, same).select(sizes["*"], "rank", "source_size", "target") \
        .withColumn("chunk", F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)).cast("bigint"), F.lit(chunks).cast("bigint")))
    sums = rows.groupBy("rank", "chunk").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "chunk", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("rank", "chunk").orderBy(F.col("doc_id").asc_nulls_first(), "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return rows.join(sums, ["rank", "chunk"]).withColumn("start", F.col("base") + F.col("before")).drop("base", "before", "chunk")


def pieces_of(rows: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(rank, start, block, first_word, n_words): the part of each document that lies in each block."""
    spread = F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))
    out = rows.where("size > 0").select("rank", "start", "size", spread.alias("block"))
    first = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    last = F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start"))
    return out.select("rank", "start", "block", first.alias("first_word"), (last - first).alias("n_words"))


def drawn_pieces(rows: DataFrame, sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """pieces_of with `draws`, how often each piece is taken; pieces that are not drawn are left out."""
    counts = draw_slots(sources).groupBy("rank", "block").agg(F.count("*").alias("draws"))
    return pieces_of(rows, block).join(counts, ["rank", "block"])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, repeats: int = REPEATS, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (its source's) and taken (words, repeats counted)."""
    sizes = sized(docs, id_col, text_col, source_col)
    sources = cut(source_targets(sizes, weights, repeats, block))
    rows = cut(placed(sizes, sources))
    taken = drawn_pieces(rows, sources, block).groupBy("rank", "start").agg(F.sum(F.col("n_words") * F.col("draws")).alias("taken"))
    # a document of size 0 may share its start with the next one
    full = rows.where("size > 0").join(taken, ["rank", "start"], "left")
    empty = rows.where("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
    return full.unionByName(empty).select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights=WEIGHTS, repeats: int = REPEATS, block: int = BLOCK_WORDS) -> DataFrame:
    """docs with each text replaced by the words taken from it, in order and as often as taken, one space between them.

    Documents of which nothing is taken go. A column n_chars, if there is one, follows the text.
    """
    sizes = sized(docs, id_col, text_col, source_col)
    sources = cut(source_targets(sizes, weights, repeats, block))
    rows = cut(placed(sizes, sources))
    same = Window.partitionBy("doc_id", "source", "text_hash").orderBy("start")
    numbered = rows.where("size > 0").withColumn("_copy", F.row_number().over(same))
    taken = drawn_pieces(rows, sources, block).groupBy("rank", "start").agg(
        F.sort_array(F.collect_list(F.struct("first_word", "n_words", "draws"))).alias("_pieces"))
    wanted = numbered.join(taken, ["rank", "start"]).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"), "_copy", "_pieces")
    hash_, copy, text_ = (fresh(docs, x) for x in ("_hash", "_copy", "_text"))
    pieces, id_, source_ = (fresh(docs, x) for x in ("_pieces", "_id", "_source"))
    wanted = wanted.toDF(id_, source_, f"{hash_}wanted", f"{copy}wanted", pieces)
    texts = docs.withColumn(hash_, F.xxhash64(text_col))
    if numbered.where("_copy > 1").limit(1).count():
        texts = texts.withColumn(copy, F.row_number().over(Window.partitionBy(id_col, source_col, hash_).orderBy(F.lit(0))))
        on = [texts[copy] == wanted[f"{copy}wanted"]]
    else:
        on = []
    on += [texts[id_col].eqNullSafe(wanted[id_]), texts[source_col].eqNullSafe(wanted[source_]), texts[hash_] == wanted[f"{hash_}wanted"]]
    split = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def picked(words: Column) -> Column:
        return F.array_join(F.flatten(F.transform(pieces, lambda p: F.flatten(F.array_repeat(
            F.slice(words, (p["first_word"] + 1).cast("int"), p["n_words"].cast("int")), p["draws"].cast("int"))))), " ")

    # as the argument of a lambda the words are split once, not once for each piece
    out = texts.join(wanted, on).withColumn(text_, F.get(F.transform(F.array(split), picked), 0))
    made = {text_col: F.col(text_), "n_chars": F.length(text_).cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return out.select(*(made.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
