"""Incremental ingestion of blocks by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions import columns as C


def ingest(stream: DataFrame, store: str, checkpoint: str) -> None:
    """Reads what a stream (content) has now, and adds blocks whose hash the store, a folder of Parquet files, does not have.

    Each batch writes to a folder of its own number, so one that runs again
    after a failure replaces its own rows and no others. Returns once the stream is drained.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        new = df.select(C.hash_expr(F.col("content")).alias("hash"), "content").groupBy("hash").agg(F.first("content").alias("content"))
        try:
            known = spark.read.option("basePath", store).parquet(f"{store}/batch=*").where(F.col("batch") < number).select("hash")
            new = new.join(known, "hash", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("overwrite").parquet(f"{store}/batch={number}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_bytes(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Blocks and bytes of a stream (ts, content) in windows of event time; rows later than `late` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.octet_length("content")).alias("bytes"))
