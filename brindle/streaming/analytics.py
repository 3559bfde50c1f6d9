"""Search analytics on streams.

The same rollups as in ``operators.analytics``, kept up to date by Structured Streaming. Streams need a TIMESTAMP event time; columns without a
zone are cast in the session's zone. Redelivered events are dropped by their id within the watermark. Results go to Parquet tables: aggregates in update
mode, as the rows that a batch changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import log_form


def read_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet log as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # as a pattern, the path may be a single file as well as a folder
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def with_event_time(events: DataFrame, time_col: str = "ts", late: str = "2 days") -> DataFrame:
    return events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)


def without_redelivery(events: DataFrame, id_col: str) -> DataFrame:
    """Each event once; state is kept as long as the watermark allows late events."""
    return events.dropDuplicatesWithinWatermark([id_col])


def query_rollup(searches: DataFrame) -> DataFrame:
    """(query, n_searches, total_results, total_time_ms, first_searched, last_searched): one row of state for each query."""
    return searches.where("query is not null").groupBy(log_form(F.col("query")).alias("query")).agg(
        F.count(F.lit(1)).alias("n_searches"), F.coalesce(F.sum("result_count"), F.lit(0)).alias("total_results"), F.coalesce(F.sum("search_time_ms"), F.lit(0.0)).alias("total_time_ms"),
        F.min("ts").alias("first_searched"), F.max("ts").alias("last_searched"),
    )


def volume_by_hour(searches: DataFrame) -> DataFrame:
    """(hour, n_searches, newest) in tumbling windows of an hour; newest is the last event's time, by which ``last_hours`` cuts."""
    counted = searches.groupBy(F.window("ts", "1 hour").alias("_w")).agg(F.count(F.lit(1)).alias("n_searches"), F.max("ts").alias("newest"))
    return counted.select(F.col("_w.start").alias("hour"), "n_searches", "newest")


def click_counts(clicks: DataFrame) -> DataFrame:
    """(doc_id, n_clicks)."""
    return clicks.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_clicks"))


def upsert(path: str):
    """A foreachBatch function for streams in update mode: each batch's changed rows become part ``n`` of a Parquet table, written over if the batch runs again."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/part={number}")

    return step


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key of a table that ``upsert`` wrote."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "part")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "part").alias("_row"))
    return newest.select(*keys, "_row.*")


def run_to_folder(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> DataFrame:
    """Run an aggregating stream over all that is there now into the table ``path``, and give the table as it is then.

    State and progress are in ``checkpoint``; run again, it takes in only what is new. Nothing of the result goes through the driver.
    """
    query = stream.writeStream.foreachBatch(upsert(path)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return latest(stream.sparkSession, path, keys)


def append_to_folder(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream of rows over all that is there now, adding to the Parquet table ``path``, and give the table as it is then."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def run_batches(stream: DataFrame, step, checkpoint: str) -> None:
    """Run a stream over all that is there now through a foreachBatch function."""
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_hours(volume: DataFrame, hours: int = 24, as_of=None) -> DataFrame:
    """The hours of a volume table from ``hours`` before ``as_of`` (the newest event's hour if not given) on."""
    until = volume.agg(F.max("newest")).scalar() if as_of is None else F.lit(as_of)
    return volume.where(F.col("newest") >= until - F.make_interval(hours=F.lit(hours)))


def keep_newest(path: str, most: int = 1000, time_col: str = "ts", id_col: str = "event_id"):
    """A foreachBatch function that keeps the newest ``most`` events of a stream as a Parquet table.

    Each batch is cut to its own newest first, so that at most twice ``most`` rows are sorted together.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        order = [F.desc(time_col), F.desc(id_col)]
        newest = batch.orderBy(*order).limit(most)
        if number > 0:
            newest = newest.unionByName(spark.read.parquet(f"{path}/part={number - 1}")).orderBy(*order).limit(most)
        newest.coalesce(1).write.mode("overwrite").parquet(f"{path}/part={number}")

    return step


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``keep_newest`` kept last."""
    kept = spark.read.parquet(path)
    return kept.where(F.col("part") == kept.agg(F.max("part")).scalar()).drop("part")
