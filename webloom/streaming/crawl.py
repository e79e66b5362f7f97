"""The endless jobs as streams: indexing fetched pages as they arrive, and counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webloom.operators.signals import document_flags, emitted_links, indexed_documents, signals
from webloom.sources.imports import FETCHED_SCHEMA


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """New files of the page store, each once; the checkpoint of the query remembers which."""
    return spark.readStream.schema(FETCHED_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def index_batch(batch: DataFrame, batch_id: int, documents_path: str, links_path: str) -> None:
    """Index the pages of a micro-batch whose address isn't indexed yet; a repeated batch replaces itself."""
    spark = batch.sparkSession
    fresh = batch.where("uri is not null").dropDuplicates(["uri"]).withColumn("html", F.decode("data", "UTF-8"))
    try:
        old = spark.read.parquet(documents_path).where(F.col("batch") < batch_id).select("uri")
        fresh = fresh.join(old, "uri", "left_anti")
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
    signalled = document_flags(signals(fresh)).persist()
    indexed_documents(signalled).write.mode("overwrite").parquet(f"{documents_path}/batch={batch_id}")
    emitted_links(signalled).write.mode("overwrite").parquet(f"{links_path}/batch={batch_id}")
    signalled.unpersist()


def start_indexing(pages: DataFrame, documents_path: str, links_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A query that indexes a page stream; with ``once`` it ends when what is there is done."""
    writer = pages.writeStream.foreachBatch(lambda b, i: index_batch(b, i, documents_path, links_path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def events_by_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total over event time; batch and stream alike."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session_start, session_end, n of a user's events without a longer gap."""
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
