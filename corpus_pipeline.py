"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import languages, near_dups, packing, private, quality
from millrace.llm.common import crc_fold, documents, stored


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language is no better than a guess."""
    model = languages.train(docs.filter(crc_fold() != 0))
    rows = languages.predict(docs, model, "__lang", "__score")
    return rows.filter((F.col("__lang") != languages.UNKNOWN) & (F.col("__score") >= 0.35)).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose calibrated score is under 0.3."""
    model, _ = quality.train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.predict(docs, model, "__score").filter(F.col("__score") >= 0.3).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of a similarity of 0.8. Of rows of one id the smallest stays; rows without an id stay."""
    copies = near_dups.near_duplicates(docs, percent=80).filter(~F.col("kept")).select("doc_id").distinct()
    whole = docs.join(copies, "doc_id", "left_anti").filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return whole.unionByName(docs.filter("doc_id is null"))


def mask_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; n_chars follows the text."""
    masked = private.masked(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 4096 tokens: a row for each piece."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language", keep_languages),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("private_data", mask_private_data),
    ("packing", pack_sequences),
]

#: No SQL has the models, the tokenizer and the packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
