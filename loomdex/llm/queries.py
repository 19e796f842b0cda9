"""The operators applied to their tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, decontam, html, itq, jaccard, licences, mixing, prefixes, quality, shards, toxicity
from .labelled import held_out

TOXIC_AT = 0.7
GOOD_AT = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _judged(scored: DataFrame, at: float) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mixture of all sources, weights by count ** 0.5."""
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def tool_turns(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text), whose messages are all plain, plus what
    tools would add: every assistant turn also calls lookup or measure on its whole text, and
    the answer stands at the same turn, or, in every seventh conversation, before its call; in
    every fifth one calls refer to the answer of the call before. Some answers answer nothing.
    Two of three conversations declare lookup alone, for up to 300 characters."""
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    number = F.col("conv_id")
    name = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    said = c.where("role = 'assistant'")
    after = F.when((number % 5 == 0) & (F.col("turn") > 2), F.struct(name(F.col("turn") - 2).alias("$ref")))
    call = F.struct(F.struct(after.alias("after"), F.char_length("text").alias("chars"), F.col("text").alias("query")).alias("arguments"), name(F.col("turn")).alias("id"), F.when(F.col("turn") % 4 == 1, "lookup").otherwise("measure").alias("name"))
    calls = said.select("conv_id", "turn", F.lit("assistant").alias("role"), F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    answer = F.to_json(F.struct(F.md5(F.col("text").cast("binary")).alias("content"), name(F.col("turn")).alias("tool_call_id")))
    answers = said.select("conv_id", (F.col("turn") - (number % 7 == 0).cast("long")).alias("turn"), F.lit("tool"), answer)
    lost = F.to_json(F.struct(F.concat(F.lit("lost-"), F.col("turn").cast("string")).alias("tool_call_id")))
    stray = c.where("role = 'user' and turn % 4 = 2").select("conv_id", "turn", F.lit("tool"), lost)
    declared = F.lit('{"tools":[{"name":"lookup","parameters":{"properties":{"chars":{"maximum":300,"type":"integer"}},"required":["query"],"type":"object"}}]}')
    tools = c.where("conv_id % 3 != 2").select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long"), F.lit("system"), declared)
    return c.union(calls).union(answers).union(stray).union(tools)


def op2_chat_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with the calls and answers of ``tool_turns``, as the table has none."""
    return chat.format_conversations(tool_turns(_table(spark, sf_dir, "conversations")))


def op3_html_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(_table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return _judged(toxicity.score(docs, model), TOXIC_AT)


def op5_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.drop("start", "end")


def op6_itq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.minimax_shards(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "capacity")


def op8_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return _judged(quality.score(docs, model), GOOD_AT)


def op9_licence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op10_signature_tree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text and of what they decode to."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pfair_mixing, op2_chat_tool_links, op3_html_layout_text, op4_toxic_segments, op5_spaced_seed_decontamination,
        op6_itq_near_duplicates, op7_minimax_shards, op8_quality_discriminant, op9_licence_windows, op10_signature_tree_jaccard,
        op11_conversation_prefix_trie, op12_byte_bpe_round_trip, op13_filter_interactions,
    )
}
