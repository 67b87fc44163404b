"""A training corpus from documents: safe, good, distinct, without secrets, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.

Edge cases, beside those of the operators: an empty table gives empty stages;
rows without id pass the stages that join on ids; rows that share an id are one
document and stay or go together where near duplicates are sought; of a group
of equal texts the smallest id stays; null, empty and very long texts are
decided on like any other; columns that a table has beside its own stay, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollsift.llm.common import beside, discard, materialise, table
from rollsift.llm.jaccard import near_duplicates
from rollsift.llm.packing import pack
from rollsift.llm.quality import accepted as good
from rollsift.llm.queries import vocabulary
from rollsift.llm.secrets import redact
from rollsift.llm.toxicity import accepted as harmless

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network flags go."""
    return harmless(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the discriminant's threshold go."""
    return good(docs, table(spark, sf_dir, "labels"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the smallest id stays."""
    found = near_duplicates(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)
    name = beside(docs, "_gone")
    gone, _ = materialise(found.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "copies")
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col(name), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows."""
    names = docs.columns
    return redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))).select(*names)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicate", near_duplicate), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, written = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if path:
            discard(spark, path)  # the next stage is written
        path = written
    packed = STAGES[-1][1](spark, docs, sf_dir)
    discard(spark, path)  # packing reads its own pieces from here on
    return packed


#: The classifiers and the packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
