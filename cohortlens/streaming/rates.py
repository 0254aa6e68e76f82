"""Streams of observations: windowed detection rates with watermarks, the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import status as T


def windowed_rates(rows: DataFrame, window: str = "1 hour", late: str = "2 hours", time: str = "ts", key: str = "feature_type") -> DataFrame:
    """(window_start, key, n, observed, detected, detection_rate) of a stream or a table of (time, key, status).

    Rows later than `late` are left out of a stream; state is kept for open windows only.
    """
    v = T.observed(F.col("status"))
    own = rows.withWatermark(time, late) if rows.isStreaming else rows
    out = own.groupBy(F.window(time, window), key).agg(F.count("*").alias("n"), F.count(v).alias("observed"), F.count_if(v == 1).alias("detected"))
    return out.select(F.col("window.start").alias("window_start"), key, "n", "observed", "detected", F.try_divide(F.col("detected"), F.nullif(F.col("observed"), F.lit(0))).alias("detection_rate"))


def distinct_events(rows: DataFrame, key: str = "event_id", time: str = "ts", late: str = "2 hours") -> DataFrame:
    """The first of repeated events; a stream forgets keys after the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])
