"""Document and collection statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.index import token_arrays


def term_frequencies(postings: DataFrame, key: str = "term") -> DataFrame:
    """(doc_id, term, tf, title_tf, content_tf)."""
    return postings.groupBy("doc_id", key).agg(
        F.count(F.lit(1)).alias("tf"), F.count_if(F.col("field") == "title").alias("title_tf"), F.count_if(F.col("field") == "content").alias("content_tf")
    )


def document_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, total_terms); documents without tokens have 0."""
    return token_arrays(docs).select("doc_id", (F.size("title_tokens") + F.size("content_tokens")).alias("total_terms"))


def collection_stats(docs: DataFrame) -> DataFrame:
    """One row (n_docs, avg_len) over all documents, indexed or not; 0 and 0.0 for none."""
    return document_lengths(docs).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("total_terms"), F.lit(0.0)).alias("avg_len"))


def document_frequencies(postings: DataFrame, key: str = "term") -> DataFrame:
    """(term, df)."""
    return postings.select("doc_id", key).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("df"))


def indexed_counts(docs: DataFrame) -> DataFrame:
    """One row (n_indexed, n_docs)."""
    return docs.agg(F.count_if("is_indexed").alias("n_indexed"), F.count(F.lit(1)).alias("n_docs"))
