"""Statement documents as a stream: detection and card reading happen inside a document's row, so
the batch expressions run unchanged; monthly sums keep state under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import signed_amount
from ..sources.statements import detect_issuer, read_cards


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    """Documents from Parquet files that arrive under path: doc_id and full_text."""
    return spark.readStream.schema("doc_id string, full_text string").parquet(path)


def card_rows(docs: DataFrame) -> DataFrame:
    """Rows of the documents that a card issuer claims, good ones alone."""
    return read_cards(detect_issuer(docs)).where("errored_line is null")


def monthly_totals(rows: DataFrame, late: str = "40 days") -> DataFrame:
    """Sum by 30-day window and direction; rows later than the watermark are left out."""
    timed = rows.withColumn("at", F.col("value_date").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "30 days"), "direction").agg(F.sum(signed_amount()).alias("total"), F.count("*").alias("n"))


def drain(rows: DataFrame, path: str, state: str) -> None:
    """Writes what has arrived to Parquet under path; state remembers what was read, so a second call takes only what is new."""
    rows.writeStream.format("parquet").option("checkpointLocation", state).option("path", path).trigger(availableNow=True).start().awaitTermination()
