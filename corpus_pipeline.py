"""A corpus pipeline over `documents`: toxicity, quality rules, near duplicates, personal data, packing.

Every stage works on all rows that the one before kept; each result is written as Parquet and read again.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modalframe.llm.bestfit import pack_documents
from modalframe.llm.circulant import near_duplicates
from modalframe.llm.divergence import filter_quality
from modalframe.llm.ftrl import filter_toxic
from modalframe.llm.pii import redact
from modalframe.llm.queries import public_tokenizer
from modalframe.session import scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; learned from the labels of ``sf_dir``."""
    return filter_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are like some language reference of this corpus."""
    return filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group linked by five-word shingles at 80 percent; of rows repeated under that id with
    the same text one stays."""
    kept = near_duplicates(docs, size=5, percent=80).filter("kept").groupBy(F.col("doc_id").alias("kept_id")).agg((F.count(F.lit(1)) > 1).alias("again"))
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"])).drop("kept_id")
    once = rows.filter("not again")
    return once.unionByName(rows.filter("again").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 1024 ids."""
    return pack_documents(docs, public_tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [("toxicity", toxicity), ("quality rules", quality_rules), ("MinHash near-dedup", near_dedup), ("PII", personal_data), ("best-fit packing", packing)]

#: A learned score, signatures and a tokenizer cannot be written in SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
