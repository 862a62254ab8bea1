"""Statistics of the corpus that follow a batch at the cost of the batch.

What a batch removes and adds is counted with signs: for each of its terms the change of document frequency and of occurrences, and the change of
the numbers of chunks and tokens. These rows are appended to the statistics, which are sums, so reading adds them up; folding writes the sums anew
when the changes have become many. Nothing of the corpus but the batch's own chunks is looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.fulltext import corpus_counts, postings, term_stats
from docloom.sources.sizes import written

_TERMS = "term string, df long, cf long"
_CORPUS = "n_chunks long, n_tokens long"


def term_changes(added: DataFrame, removed: DataFrame) -> DataFrame:
    """(term, df, cf): how a batch of chunks (chunk_id, file_id, snippet) changes the statistics of its terms; those it leaves are not among them."""
    signed = term_stats(postings(added)).unionByName(
        term_stats(postings(removed)).select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))
    )
    return summed(signed).filter("df <> 0 OR cf <> 0")


def corpus_changes(added: DataFrame, removed: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """One row: how a batch changes the numbers of chunks and tokens. With the ``term_changes`` of the batch as ``terms`` its
    tokens are summed up there, instead of being cut once more."""
    if terms is not None:
        one = F.lit(1).cast("long")
        signed = added.select(one.alias("n")).unionByName(removed.select((-one).alias("n")))
        n_chunks = signed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"))
        n_tokens = terms.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("n_tokens"))
        return n_chunks.crossJoin(F.broadcast(n_tokens))
    less = removed.agg(*corpus_counts()).select((-F.col("n_chunks")).alias("n_chunks"), (-F.col("n_tokens")).alias("n_tokens"))
    return added.agg(*corpus_counts()).unionByName(less).agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


@dataclass(frozen=True)
class Statistics:
    """Statistics as sums of rows below a folder."""

    spark: SparkSession
    folder: str

    def append(self, added: DataFrame, removed: DataFrame) -> None:
        """Add what a batch of chunks changes: rows for the batch's terms, and one for the corpus."""
        terms = written(term_changes(added, removed), "term-changes")
        terms.write.mode("append").parquet(f"{self.folder}/terms")
        corpus_changes(added, removed, terms).write.mode("append").parquet(f"{self.folder}/corpus")

    def terms(self) -> DataFrame:
        """(term, df, cf), as ``fulltext.term_stats`` of all chunks."""
        return summed(self.spark.read.schema(_TERMS).parquet(f"{self.folder}/terms")).filter("df > 0")

    def corpus(self) -> DataFrame:
        """One row, as ``fulltext.corpus_stats`` of all chunks."""
        rows = self.spark.read.schema(_CORPUS).parquet(f"{self.folder}/corpus")
        total = rows.agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
        return total.withColumn("avg_len", F.col("n_tokens") / F.nullif(F.col("n_chunks"), F.lit(0)))

    def folded(self, folder: str) -> Statistics:
        """The same statistics below another folder, one row for each term."""
        self.terms().write.parquet(f"{folder}/terms")
        self.corpus().drop("avg_len").write.parquet(f"{folder}/corpus")
        return Statistics(self.spark, folder)
