"""Preparation of a training corpus, stage by stage: from ``documents`` to packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return
the columns of ``documents``. Null and empty texts, repeated rows and empty tables have the results that the operators define.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import contamination, line_dedup, packing, quality, simhash
from docloom.sources.sizes import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and lie within their language's bands."""
    return quality.keep_good(docs)


def line_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many share; ``n_chars`` follows the text."""
    kept = line_dedup.with_kept_text(docs)
    changed = F.col("_n_dropped") > 0
    new = {
        "text": F.when(changed, F.col("_kept")).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.char_length("_kept").cast("long")).otherwise(F.col("n_chars")),
    }
    return kept.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return contamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence."""
    return packing.pack(docs)


#: (name, function of (spark, docs, sf_dir)), in order.
STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Tokenisers and fingerprints cannot be said in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
