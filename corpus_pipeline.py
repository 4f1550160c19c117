"""A corpus pipeline of five stages; each one's table is the next one's input.

Toxic documents go; of equal texts one stays; of each group of near duplicates one stays; the rest is mixed
to target weights by source (a document comes as often as the mix takes it); and the mix is tokenized.
Decisions are made by row or by doc_id; rows that share a doc_id share its fate, but for exact copies, of
which one row stays.  Every stage but the last returns the columns of its input.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm import bpe, chosen_path, exact_dedup, mixing, shared, toxicity


def _by_doc_id(spark: SparkSession, docs: DataFrame, kept: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not among those that are dropped.

    The dropped ids are written first: while they are few, they are broadcast and no text is shuffled.
    """
    path = shared.work_dir(spark, f"{name}-dropped")
    dropped = shared.saved(kept.where(~F.col("kept")).select(F.col("doc_id").alias("dropped_doc_id")).distinct(), path)
    return docs.join(shared.small_side(dropped, path), docs["doc_id"] == dropped["dropped_doc_id"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    field = toxicity.learn(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = toxicity.score(docs, field).select("doc_id", (F.col("score") < 0.5).alias("kept"))
    return _by_doc_id(spark, docs, kept, "toxicity")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    found = shared.saved(exact_dedup.exact_dedup(spark, docs).select("doc_id", "keep_id", "kept"), shared.work_dir(spark, "pipeline-copies"))
    # Rows that repeat the kept doc_id and text are equal, so one of them may stand for all.
    repeated = found.where("not kept and doc_id = keep_id")
    kept = _by_doc_id(spark, docs, found.select("doc_id", (F.col("doc_id") == F.col("keep_id")).alias("kept")), "copies")
    return kept.dropDuplicates(["doc_id", "text"]) if repeated.limit(1).count() else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return _by_doc_id(spark, docs, chosen_path.near_dedup(spark, docs, threshold_pct=80, width=5), "near")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, by shard and in order there; their columns go along as one, so no name can clash."""
    rows = mixing.sized(docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("document"))).drop("text")
    return mixing.in_shards(mixing.mix(spark, rows)).select("document.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (packed) and decoded_chars, the length of the decoded text."""
    return bpe.encode(docs, bpe.default_tokenizer(), keep=("source",), chars=True)


def _fresh(stage):
    """The stage, begun when executors have given back what the one before took: else heaps only grow, and workers come on top."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.shrink(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _fresh(drop_toxic)),
    ("exact_dedup", _fresh(drop_copies)),
    ("near_dedup", _fresh(drop_near_copies)),
    ("mixing", _fresh(mix_sources)),
    ("bpe", _fresh(tokenize)),
]

#: Neither the tagger's scores nor the tokens can be had from SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.saved(stage(spark, docs, sf_dir), shared.work_dir(spark, f"pipeline-{name}"))
    return docs
