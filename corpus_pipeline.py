"""From raw documents to token ids in five stages; each stage's result is written as Parquet and reread.

In every stage a null text is an empty one, null ids and sources are values as any other, texts of any length are read whole,
and an empty table gives an empty result. All stages but the last keep the columns of their input, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bytebpe, forest, linededup, mixing, quality, store


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with a score of its threshold or more. Repeated rows fare alike."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's documents go, long ones on more than a thousandth; n_chars follows the text.

    A share of exactly the ratio stays. Null texts and documents without a source stay as they are, repeated rows count as often as they stand.
    """
    clean = linededup.drop_boilerplate(docs, F.col("source"), long_ratio=linededup.LONG_RATIO)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the least id, and of its repeated rows one. Rows without an id or words stay."""
    return forest.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Rows equal in id and text share one draw.

    A document without words has certain copies only, so it goes where its expected copies are below one.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids: every document of the mix, as often as it is there, in no order."""
    ranks = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bytebpe.encoded(docs, ranks, public_tokenizers.PATTERN)


STAGES = [("quality", keep_good), ("line_dedup", drop_boilerplate), ("jaccard_join", drop_near_copies), ("mixing", mix), ("byte_bpe", encode)]

#: The classifier, the MinHash forest and the encoder are beyond SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage made on the way, and its input, go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = set(store.given())
    for name, stage in STAGES:
        path = store.new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        store.clear(spark, keep={path} | before)
        docs = spark.read.parquet(path)
    return docs
