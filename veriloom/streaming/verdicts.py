"""Structured Streaming over the stream of judgements: windowed counts, last verdicts, sessions, repeated deliveries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, with event time in ``at``."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("at", F.col("ts").cast("timestamp"))


def hourly_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Verdict counts in tumbling windows; rows that come later than the watermark are dropped."""
    return stream.withWatermark("at", late).groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def delivered_once(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, also if it is delivered again within the watermark."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def last_verdicts(stream: DataFrame) -> DataFrame:
    """The latest verdict of every claim so far; ties go to the later event."""
    return stream.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("verdict"), F.max("event_id").alias("events_to"))


def run_once(df: DataFrame, mode: str) -> DataFrame:
    """Run a streaming query over all that is there now and give its result as a table in the shared folder.

    A batch is written under its own number, so one that is run again after a failure replaces itself.
    """
    spark = df.sparkSession
    path, batches = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}", []

    def sink(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/{number}")
        batches.append(number)

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    wanted = sorted(set(batches))[-1:] if mode == "complete" else sorted(set(batches))
    if not wanted:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(*[f"{path}/rows/{n}" for n in wanted])
