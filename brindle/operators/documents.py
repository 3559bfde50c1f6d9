"""The document table as immutable frames: lookups, changes, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_first(docs: DataFrame) -> DataFrame:
    return docs.orderBy(F.desc("date_added"), "doc_id")


def by_id(docs: DataFrame, doc_id: int) -> DataFrame:
    return docs.where(F.col("doc_id") == doc_id)


def exists(docs: DataFrame, doc_id: int) -> bool:
    return not by_id(docs, doc_id).isEmpty()


def insert(docs: DataFrame, new: DataFrame) -> DataFrame:
    """``docs`` with those of ``new`` whose ids are not in it."""
    return docs.unionByName(new.join(docs.select("doc_id"), "doc_id", "left_anti"), allowMissingColumns=True)


def update(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``docs`` with the rows of ``changed`` in place of those with the same id; other rows of ``changed`` are left out."""
    kept = docs.join(changed.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(changed.join(docs.select("doc_id"), "doc_id", "left_semi"), allowMissingColumns=True)


def delete(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")
