"""Search analytics over a log of searches and clicks.

Frames: searches(query, ts, result_count, search_time_ms), clicks(query, doc_id, ts). Queries count under their lower-cased, trimmed form.
Look-backs end at an explicit time, never at the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import log_form


def query_rollup(searches: DataFrame, clicks: DataFrame | None = None) -> DataFrame:
    """(query, n_searches, total_results, total_time_ms, first_searched, last_searched, n_clicks, n_clicked_docs, avg_results, avg_time_ms, ctr).

    Clicks of queries that were never searched count in no rollup. The click-through rate is clicks, not clicked documents, by searches.
    """
    stats = searches.where(F.col("query").isNotNull()).groupBy(log_form(F.col("query")).alias("query")).agg(
        F.count(F.lit(1)).alias("n_searches"), F.coalesce(F.sum("result_count"), F.lit(0)).alias("total_results"), F.coalesce(F.sum("search_time_ms"), F.lit(0.0)).alias("total_time_ms"),
        F.min("ts").alias("first_searched"), F.max("ts").alias("last_searched"),
    )
    if clicks is None:
        joined = stats.withColumn("n_clicks", F.lit(0).cast("bigint")).withColumn("n_clicked_docs", F.lit(0).cast("bigint"))
    else:
        per_query = clicks.where("query is not null and doc_id is not null").groupBy(log_form(F.col("query")).alias("query")).agg(F.count(F.lit(1)).alias("n_clicks"), F.countDistinct("doc_id").alias("n_clicked_docs"))
        joined = stats.join(per_query, "query", "left").fillna(0, ["n_clicks", "n_clicked_docs"])
    return joined.select(
        "*", (F.col("total_results") / F.col("n_searches")).alias("avg_results"), (F.col("total_time_ms") / F.col("n_searches")).alias("avg_time_ms"),
        (F.col("n_clicks") / F.col("n_searches")).alias("ctr"),
    )


def top_queries(searches: DataFrame, most: int = 10) -> DataFrame:
    """(query, n_searches) of the most frequent queries."""
    return _counted(searches).orderBy(F.desc("n_searches"), "query").limit(most)


def _counted(searches: DataFrame) -> DataFrame:
    return searches.where(F.col("query").isNotNull()).groupBy(log_form(F.col("query")).alias("query")).agg(F.count(F.lit(1)).alias("n_searches"))


def zero_result_queries(searches: DataFrame, most: int = 10) -> DataFrame:
    """(query, n_searches) of the most frequent queries that never had a result."""
    counted = searches.where(F.col("query").isNotNull()).groupBy(log_form(F.col("query")).alias("query")).agg(F.count(F.lit(1)).alias("n_searches"), F.coalesce(F.sum("result_count"), F.lit(0)).alias("_r"))
    return counted.where("_r = 0").drop("_r").orderBy(F.desc("n_searches"), "query").limit(most)


def popular_documents(clicks: DataFrame, most: int = 10) -> DataFrame:
    """(doc_id, n_clicks) of the documents clicked most."""
    return click_counts(clicks).orderBy(F.desc("n_clicks"), "doc_id").limit(most)


def click_counts(clicks: DataFrame) -> DataFrame:
    """(doc_id, n_clicks)."""
    return clicks.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_clicks"))


def recent_searches(searches: DataFrame, most: int = 50, id_col: str | None = None) -> DataFrame:
    """The newest searches; a limit of 1,000 keeps the log as a bounded log does."""
    order = [F.desc("ts"), *([F.desc(id_col)] if id_col else [])]
    return searches.orderBy(*order).limit(most)


def volume_by_hour(searches: DataFrame, as_of=None, hours: int = 24) -> DataFrame:
    """(hour, n_searches) of the last ``hours`` before ``as_of`` (the newest search if not given)."""
    until = searches.agg(F.max("ts")).scalar() if as_of is None else F.lit(as_of)
    recent = searches.where(F.col("ts") >= until - F.make_interval(hours=F.lit(hours)))
    return recent.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n_searches"))


def summary(searches: DataFrame, clicks: DataFrame) -> DataFrame:
    """One row: searches, distinct queries, averages over queries and over searches, clicks, queries without results."""
    stats = query_rollup(searches)
    figures = stats.agg(
        F.coalesce(F.sum("n_searches"), F.lit(0)).alias("n_searches"), F.count(F.lit(1)).alias("n_queries"),
        F.coalesce(F.avg("avg_results"), F.lit(0.0)).alias("avg_results"), F.coalesce(F.avg("avg_time_ms"), F.lit(0.0)).alias("avg_time_ms"),
        F.coalesce(F.try_divide(F.sum("total_results"), F.sum("n_searches")), F.lit(0.0)).alias("weighted_avg_results"),
        F.coalesce(F.try_divide(F.sum("total_time_ms"), F.sum("n_searches")), F.lit(0.0)).alias("weighted_avg_time_ms"),
        F.count_if(F.col("total_results") == 0).alias("n_zero_result_queries"),
    )
    return figures.withColumn("n_clicks", clicks.where("doc_id is not null").agg(F.count(F.lit(1))).scalar())


def query_suggestions(searches: DataFrame, prefix: str, most: int = 5) -> DataFrame:
    """(query, n_searches): the most frequent queries that start with a prefix, white space at its ends included."""
    wanted = prefix.lower()
    return _counted(searches.where(log_form(F.col("query")).startswith(wanted))).orderBy(F.desc("n_searches"), "query").limit(most)
