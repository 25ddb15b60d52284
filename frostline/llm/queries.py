"""The registered queries of the training-data operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import bpe, chat, contamination, divergence, infill, mixing, neardup, quality, revisit, suffix, tokens, toxicity, vectors
from frostline.llm.common import Scratch, read, small_batches


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), Scratch(spark, "quality"))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    to = scratch.path("out")
    tokens.write_tokens(read(spark, sf_dir, "documents"), to, scratch)
    return tokens.digests(tokens.read_tokens(spark, to))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), Scratch(spark, "mixing"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), Scratch(spark, "neardup")).select("doc_id", "class_id", F.hex("class_key").alias("class_key"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(turns))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), Scratch(spark, "toxicity"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "contamination")
    return contamination.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), scratch).drop("mark")


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "revisit")
    records = revisit.records_of_pages(read(spark, sf_dir, "pages"))
    return revisit.digests(revisit.with_bodies(scratch.stage("resolved", revisit.resolve(records, scratch)), records))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = read(spark, sf_dir, "embeddings")
    return vectors.nearest(vecs, vecs.where(F.col("vec_id") % 20 == 0), Scratch(spark, "vectors"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(suffix.remove_repeats(read(spark, sf_dir, "documents"), Scratch(spark, "suffix")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"), Scratch(spark, "divergence"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.fill_in_middle(read(spark, sf_dir, "documents")))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.digests(bpe.decode_ids(bpe.encode_texts(read(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_token_binary": op2_token_binary,
    "op3_mix_sources": op3_mix_sources,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_chat_format": op5_chat_format,
    "op6_toxicity": op6_toxicity,
    "op7_decontaminate": op7_decontaminate,
    "op8_revisits": op8_revisits,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_bpe": op13_bpe,
}
ORACLES = {
    "op3_mix_sources": mixing.ORACLE,
    "op5_chat_format": chat.ORACLE,
    "op7_decontaminate": contamination.ORACLE,
    "op8_revisits": revisit.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_fill_in_middle": infill.ORACLE,
}
