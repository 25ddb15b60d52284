"""A training corpus made from ``documents`` in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frostline.llm import contamination, mixing, neardup, quality, tokens
from frostline.llm.common import Scratch, read
from frostline.session import ship_package


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; labels are learned from all the labelled rows it may see."""
    ship_package(spark)
    return quality.keep_accepted(docs, read(spark, sf_dir, "labels"), Scratch(spark, "stage-quality"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least doc_id."""
    ship_package(spark)
    return neardup.keep_one(docs, Scratch(spark, "stage-neardup"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    return contamination.remove_contaminated(docs, read(spark, sf_dir, "benchmark"), Scratch(spark, "stage-contamination"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: every document once at least, small sources up to twice."""
    ship_package(spark)
    return mixing.mix_documents(docs, Scratch(spark, "stage-mixing"), cover=True)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture; a row for each of its documents: doc_id, start, n_tokens, ids_crc32, read back from the files."""
    ship_package(spark)
    scratch = Scratch(spark, "stage-tokens")
    tokens.write_tokens(docs, scratch.path("out"), scratch)
    return tokens.digests(tokens.read_tokens(spark, scratch.path("out")))


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("source mixing", mix_sources),
    ("token output", write_token_files),
]
#: Classifier, MinHash and token ids are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.stage(f"stage{k}", stage(spark, docs, sf_dir))
    return docs
