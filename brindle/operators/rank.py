"""Ranking: BM25 and weighted counts.

Both rank the documents by the query's hits only: a document's hits stay in its row until they are counted, so
the shuffle by document holds a few numbers for each matching document. The collection's figures are one row.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import and_, or_
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.stem import stem_arrays
from brindle.operators.index import StoredIndex, figures_of, lengths_of, may_hold, token_arrays
from brindle.operators.stats import document_lengths, term_frequencies
from brindle.session import materialise, one_row

K1, B = 1.2, 0.75


class Ranking(Protocol):
    """A pluggable ranking: the score of a row of (tf, df, total_terms, n_docs, avg_len), summed over the query's terms."""

    name: str

    def score(self) -> Column: ...


class BM25:
    """BM25 with a floor of one term for lengths."""

    name = "BM25"

    def __init__(self, k1: float = K1, b: float = B) -> None:
        self.k1, self.b = k1, b

    def idf(self) -> Column:
        n, df = F.col("n_docs"), F.col("df")
        return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))

    def score(self) -> Column:
        length = F.greatest(F.col("total_terms"), F.lit(1)) / F.greatest(F.col("avg_len"), F.lit(1.0))
        return self.idf() * F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * length))


def _is(word: str):
    return lambda token: token == word


def rank_documents(docs: DataFrame, terms: list[str], ranking: Ranking | None = None, require_all: bool = True, stems: bool = False) -> DataFrame:
    """(doc_id, score) of the documents that hold all (or any) of the words, or of the stems.

    Each document's frequencies are counted inside its row; nothing but the collection's one row of figures and the scores move. For
    words, documents without them are sorted out before they are cut into tokens.
    """
    ranking = ranking or BM25()
    wanted = list(dict.fromkeys(terms))
    if not wanted:
        return docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    numbers = range(len(wanted))

    def counted(part: DataFrame) -> DataFrame:
        tokens = F.concat("title_tokens", "content_tokens")
        arrays = token_arrays(part).select("doc_id", (stem_arrays(tokens) if stems else tokens).alias("tokens"))
        return arrays.select("doc_id", F.size("tokens").alias("total_terms"), *[F.size(F.filter("tokens", _is(wanted[i]))).alias(f"tf_{i}") for i in numbers])

    figures = counted(docs).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("total_terms").alias("avg_len"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in numbers])
    present = [F.col(f"tf_{i}") > 0 for i in numbers]
    candidates = docs if stems else docs.where(may_hold(wanted, every=require_all))
    rows = counted(candidates).where(reduce(and_ if require_all else or_, present)).withColumn("_f", one_row(figures)).select("*", "_f.*")
    parts = F.array(*[F.struct(F.col(f"tf_{i}").alias("tf"), F.col(f"df_{i}").alias("df")) for i in numbers])
    each = rows.select("doc_id", "total_terms", "n_docs", "avg_len", F.explode(parts).alias("_p")).select("doc_id", "total_terms", "n_docs", "avg_len", "_p.*").where("tf > 0")
    return each.groupBy("doc_id").agg(F.sum(ranking.score()).alias("score"))


def rank_postings(
    postings: DataFrame, docs: DataFrame, terms: list[str], ranking: Ranking | None = None, require_all: bool = True, key: str = "term", index: DataFrame | StoredIndex | None = None
) -> DataFrame:
    """(doc_id, score) from postings that hold (at least) the query's terms: filtered first, then joined with lengths.

    Lengths and figures are those of the whole ``index``; only without one are they counted from the texts.
    """
    ranking = ranking or BM25()
    wanted = list(dict.fromkeys(terms))
    if not wanted:
        return docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    tf = term_frequencies(postings.where(F.col(key).isin(*wanted)), key)
    lengths = document_lengths(docs) if index is None else lengths_of(index, docs)
    figures = index.figures if isinstance(index, StoredIndex) else figures_of(lengths)
    df = tf.groupBy(key).agg(F.count(F.lit(1)).alias("df"))  # one row per query term
    rows = tf.join(F.broadcast(df), key).join(lengths, "doc_id").withColumn("_f", one_row(figures)).select("*", "_f.*")
    scored = rows.groupBy("doc_id").agg(F.sum(ranking.score()).alias("score"), F.countDistinct(key).alias("_n"))
    return (scored.where(F.col("_n") == len(wanted)) if require_all else scored).select("doc_id", "score")


def weighted_count(frequencies: DataFrame, tokens: list[str], key: str = "term") -> DataFrame:
    """(doc_id, score): twice the title matches plus the content matches; a token repeated in the query counts again."""
    times = Counter(tokens)
    weight = F.lit(0)
    for t, n in times.items():
        weight = F.when(F.col(key) == t, n).otherwise(weight)
    rows = frequencies.where(F.col(key).isin(*times) if times else F.lit(False))
    return rows.groupBy("doc_id").agg(F.sum(weight * (2 * F.col("title_tf") + F.col("content_tf"))).cast("double").alias("score"))


def page(ranked: DataFrame, number: int = 0, size: int = 10) -> DataFrame:
    """One page by score, then id; a size of 0 or less gives everything, a negative number the first page."""
    ordered = ranked.orderBy(F.desc("score"), "doc_id")
    return ordered.offset(max(0, number * size)).limit(size) if size > 0 else ordered


def page_count(total: int, size: int) -> int:
    """Number of pages; one where the size is 0 or less."""
    return -(-total // size) if size > 0 else 1


def in_places(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with ``rank``, their place in an order, from 1; each range of the sorted rows counts its own, and the ranges before it are added."""
    ordered = materialise(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ordered.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))  # a row for each range
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = ordered.withColumn("_n", within).join(F.broadcast(sizes), "_part")
    return placed.select(*rows.columns, (F.col("_before") + F.col("_n")).cast("bigint").alias("rank"))
