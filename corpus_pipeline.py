"""A training-data pipeline from five of the operators: toxicity, near-dedup, substring dedup, decontamination, tokens.

Every stage works on all that its predecessor kept and, but for the last, returns the columns of documents; a changed
text gets its new n_chars. SQL can't express the stages; tests hold them against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import byte_bpe, decontaminate, near_dups, suffix_dedup, toxicity
from tandem.llm.util import discard, stored


def retold(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns of documents, n_chars by the text as it is now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go; it is fitted on the labelled ones among docs."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).filter(~F.col("rejected")).select(docs.columns)


def drop_near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the smallest doc_id."""
    return near_dups.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat those of an earlier document go; a character that is cut in two goes whole."""
    return retold(suffix_dedup.without_repeats(docs), docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of words that stand in benchmark items are cut; documents that mostly consist of them go."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return retold(found.filter(~F.col("excessive")).withColumn("text", F.col("cleaned")), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and the bytes that they decode to, as digests."""
    return byte_bpe.digests(byte_bpe.tokenize(docs.select("doc_id", "text")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_dups),
    ("suffix_dedup", cut_repeats),
    ("decontamination", cut_benchmark),
    ("byte_bpe", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages; a stage's table goes when the next one's is written, the last one's stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
