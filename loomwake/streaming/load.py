"""Notification load as a stream: daily totals per user with late data, and cues on arriving messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwake.functions.text import has_cue, normalize


def hourly_messages(stream: DataFrame, time: str = "created_at", late: str = "5 days", width: str = "1 hour") -> DataFrame:
    """Messages per user and window of event time; rows later than ``late`` are too late for their window."""
    at = F.col(time).cast("timestamp").alias("at")
    return stream.select("user_id", at).where("at is not null").withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "user_id").agg(F.count("*").alias("n_messages")).select("user_id", F.col("w.start").alias("window_start"), "n_messages")


def once_each(stream: DataFrame, key: str, time: str, late: str = "5 days") -> DataFrame:
    """Each key once, however often it is delivered within the watermark."""
    return stream.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", late).dropDuplicatesWithinWatermark([key]).drop("__at")


def flagged(stream: DataFrame, text: str, groups: list[str]) -> DataFrame:
    """Arriving rows with the cue groups their text shows; stateless, so it needs no watermark."""
    s = stream.withColumn("__t", normalize(text))
    return s.withColumn("cues", F.array_compact(F.array(*[F.when(has_cue("__t", g), F.lit(g)) for g in groups]))).drop("__t")


def with_accounts(stream: DataFrame, accounts: DataFrame) -> DataFrame:
    """Stream-static join with the accounts as they are when a batch runs."""
    return stream.join(accounts, "business_id", "left")
