"""From raw documents to packed token sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import lines, mixing, packing, quality, simhash
from quillon.llm.common import stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL cannot say hashed n-gram models, SimHash or a tokenizer: the tests hold the stages against brute force.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars being the text's length as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards those labelled good keeps; the others go."""
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that three or more documents hold (but for the last that does)."""
    return _measured(lines.dedup_lines(docs.select(*COLUMNS)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id, then of the least row number. Rows count one by
    one: null ids (last) and repeated ids are grouped by their texts like any others."""
    rows = stash(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = simhash.similar_groups(rows, "row").withColumnRenamed("doc_id", "row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    stays = rows.select("row", "doc_id").join(groups, "row").groupBy("component_id").agg(F.min_by("row", order).alias("row"))
    return rows.join(stays.select("row"), "row", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix uses them: none, once, twice or in part."""
    return _measured(mixing.mixed_documents(docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    return packing.pack_documents(docs, packing.json_bpe)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("mix sources", mix_sources),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
