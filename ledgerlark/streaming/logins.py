"""Streaming form of the trailing login counts: an extension that the batch models lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def login_counts(stream: DataFrame, time: str = "ts", key: str = "user_id", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Logins per key and window with a watermark; in append mode a window appears once it is closed."""
    logins = stream.where(F.col("event_type").isin("click", "view")).withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    counts = logins.groupBy(F.window("_t", window), key).agg(F.count("*").alias("logins"))
    return counts.select(F.col("window.start").alias("window_start"), key, "logins")


def run_to_table(spark: SparkSession, folder: str, out: str, late: str = "2 days") -> DataFrame:
    """Run the counts over an event folder, as far as it goes, and give the table of counts. Batches
    write the windows that they changed as Parquet (update mode, so state closes with the watermark
    and nothing is gathered in the driver); a window's last count holds. A batch that runs again
    after a failure replaces its own folder."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/counts/batch={batch}")

    query = login_counts(stream, late=late).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    counts = spark.read.parquet(f"{out}/counts")
    return counts.groupBy("window_start", "user_id").agg(F.max_by("logins", "batch").alias("logins"))
