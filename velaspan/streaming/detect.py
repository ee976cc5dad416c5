"""Incremental detection: a folder of conversations in, detections out, each message once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from velaspan.operators.matching import Rule, detected

CONVERSATION = "id string, conversazione array<struct<sender:string,testo:string>>"


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSON-lines conversations as files arrive."""
    stream = spark.readStream.schema(CONVERSATION).json(path)
    return stream.select("id", F.posexplode("conversazione").alias("idx", "m")).select("id", "idx", F.col("m.sender").alias("sender"), F.col("m.testo").alias("text"))


def detect_stream(messages: DataFrame, rules: list[Rule], out: str, checkpoint: str) -> StreamingQuery:
    """Detections of all rules as Parquet, without state; what has arrived is done, then the query ends.

    The checkpoint makes a restart go on after the last committed batch, so no
    message is detected twice.
    """
    rows = detected(messages.select("id", "idx", "text"), rules)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str, late: str) -> DataFrame:
    """Events of each kind in tumbling windows; events later than ``late`` are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
