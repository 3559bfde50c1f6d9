"""Facets, filters and filter options over documents."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import file_extension, file_type_name, size_category, size_category_label, size_category_name, tokenize
from brindle.session import spread

MOST_TERMS, LEAST_DOCUMENTS = 20, 2


def _named() -> Column:
    return F.coalesce(F.col("file_name"), F.lit("")) != ""


def type_facet(docs: DataFrame) -> DataFrame:
    """(value, display_name, count) by file type, most frequent first."""
    counted = docs.where(_named()).groupBy(file_extension(F.col("file_name")).alias("value")).count()
    return counted.select("value", file_type_name(F.col("value")).alias("display_name"), "count").orderBy(F.desc("count"), "value")


def month_facet(docs: DataFrame) -> DataFrame:
    """(value, display_name, count) by month, newest first."""
    counted = docs.groupBy(F.trunc("date_added", "month").alias("month")).count()
    return counted.select(F.date_format("month", "yyyy-MM").alias("value"), F.date_format("month", "MMMM yyyy").alias("display_name"), "count").orderBy(F.desc("value"))


def size_facet(docs: DataFrame) -> DataFrame:
    """(value, display_name, count, ordinal) by size category, smallest first."""
    size = F.col("file_size")
    counted = docs.groupBy(size_category(size).alias("ordinal"), size_category_name(size).alias("value"), size_category_label(size).alias("display_name")).count()
    return counted.orderBy("ordinal")


def term_facet(docs: DataFrame, most: int = MOST_TERMS, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(value, display_name, count): the terms of most documents, unstemmed."""
    text = F.concat_ws(" ", "title", "content")
    terms = spread(docs.select("title", "content")).select(F.explode(F.array_distinct(tokenize(text))).alias("value")).groupBy("value").count()
    return terms.where(F.col("count") >= least).orderBy(F.desc("count"), "value").limit(most).select("value", F.col("value").alias("display_name"), "count")


def extract_facets(docs: DataFrame) -> DataFrame:
    """(facet, value, display_name, count) of all four facets."""
    ext, month, size = file_extension(F.col("file_name")), F.trunc("date_added", "month"), F.col("file_size")
    # one scan of the small columns for three facets; the term facet reads the texts
    entries = F.array(
        F.when(_named(), F.struct(F.lit("file_type").alias("facet"), ext.alias("value"), file_type_name(ext).alias("display_name"))),
        F.struct(F.lit("date").alias("facet"), F.date_format(month, "yyyy-MM").alias("value"), F.date_format(month, "MMMM yyyy").alias("display_name")),
        F.struct(F.lit("size").alias("facet"), size_category_name(size).alias("value"), size_category_label(size).alias("display_name")),
    )
    small = docs.select(F.explode(F.array_compact(entries)).alias("_e")).groupBy("_e.facet", "_e.value", "_e.display_name").count()
    return small.unionByName(term_facet(docs).select(F.lit("term").alias("facet"), "value", "display_name", "count"))


def document_filter(
    types: list[str] | None = None,
    date_from=None,
    date_to=None,
    size_from: int | None = None,
    size_to: int | None = None,
    sizes: list[int] | None = None,
    required: list[str] | None = None,
    excluded: list[str] | None = None,
) -> Column:
    """One predicate for all given filters; bounds are inclusive, required and excluded terms are substrings of title or content."""

    def holds(term: str) -> Column:
        return F.lower(F.coalesce("title", F.lit(""))).contains(term.lower()) | F.lower(F.coalesce("content", F.lit(""))).contains(term.lower())

    tests: list[Column] = []
    if types:
        tests.append(_named() & file_extension(F.col("file_name")).isin(*types))
    if date_from is not None:
        tests.append(F.col("date_added") >= date_from)
    if date_to is not None:
        tests.append(F.col("date_added") <= date_to)
    if size_from is not None:
        tests.append(F.col("file_size") >= size_from)
    if size_to is not None:
        tests.append(F.col("file_size") <= size_to)
    if sizes:
        tests.append(size_category(F.col("file_size")).isin(*sizes))
    tests += [holds(t) for t in required or ()] + [~holds(t) for t in excluded or ()]
    return reduce(and_, tests, F.lit(True))


def apply_filters(docs: DataFrame, **filters) -> DataFrame:
    """Documents that pass all given filters; see ``document_filter``."""
    return docs.where(document_filter(**filters))


def filter_options(docs: DataFrame) -> DataFrame:
    """One row: available types in order, first and last date, smallest and largest size, number of documents.

    For no documents the dates are null, the sizes 0.
    """
    ext = F.when(_named(), file_extension(F.col("file_name")))
    return docs.agg(
        F.array_sort(F.collect_set(ext)).alias("types"), F.min("date_added").alias("date_from"), F.max("date_added").alias("date_to"),
        F.coalesce(F.min("file_size"), F.lit(0)).alias("size_from"), F.coalesce(F.max("file_size"), F.lit(0)).alias("size_to"), F.count(F.lit(1)).alias("n_docs"),
    )
