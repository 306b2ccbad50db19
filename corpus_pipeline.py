"""A corpus pipeline of five operators; each stage's result is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import common, decontam, mix, pack, simhash, toxicity
from lodestone.session import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores below 0.5."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    score = common.fresh("_toxicity", docs)
    return toxicity.score(docs, model, score).where(f"`{score}` < 0.5").drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mix.mix(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return pack.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: The stages hold learnt models, graph components and packing: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; stages meet in tables under the checkpoint folder.

    A stage's table is removed once the next one is written; the last one stays, as the result is read from it.
    """
    base = scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{base}/{k}")
        if k:
            common.forget(spark, f"{base}/{k - 1}")
        docs = spark.read.parquet(path)
    return docs
