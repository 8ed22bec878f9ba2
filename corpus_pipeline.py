"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents``; the last returns the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import bpe, language_id, minhash, mixing, passage_dedup
from lexspark.session import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; ``lang`` stays as it was given."""
    dictionaries = language_id.fit_dictionaries(docs.select("text", "lang"))
    return language_id.identify(docs, dictionaries).where("accepted").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of lines that stand earlier; a document that has no other lines goes."""
    rows = passage_dedup.dedup_passages(docs)
    gone = (F.col("n_removed") > 0) & (F.coalesce(F.trim("text"), F.lit("")) == "")
    return rows.where(~gone).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts share four fifths of their five-word shingles."""
    return minhash.one_of_each(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice. Texts without words go, an empty table stays
    empty; of rows that are repeated as they are, whole ones are dealt."""
    rows = mixing.deal_copies(mixing.mix(docs)).where(F.col("copies") > 0)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) in place of texts; ``same`` says that they decode to them. A
    null text counts as empty and has no ids."""
    rows = bpe.encode(docs, decoded="decoded")
    return rows.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("same"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("mixing", mix_sources),
    ("BPE", encode),
]

#: Stages by compression, rolling hashes, signatures and BPE have no SQL form; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage has read goes once the next one's rows are written."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES:
        docs = held.table(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        held.keep(docs)
    return docs
