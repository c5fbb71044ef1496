"""Site support over a stream of observations.

The batch operator's sums are additive, so the same plan runs on a stream of
files: late files only move the sums of the sites they touch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def streaming_support(observations: DataFrame, watermark: str | None = None, window: str = "1 hour") -> DataFrame:
    """Alternate and reference support of each site so far; by event-time windows if a watermark is given (column ``ts``)."""
    weight = F.coalesce("weight", F.lit(1.0))
    keys = ["w", "pos"]
    if watermark:
        observations = observations.withWatermark("ts", watermark)
        keys = [F.window("ts", window).alias("window"), *keys]
    return observations.where("allele <> 0").groupBy(*keys).agg(F.sum(F.when(F.col("allele") > 0, weight).otherwise(0.0)).alias("alt"), F.sum(F.when(F.col("allele") < 0, weight).otherwise(0.0)).alias("ref"), F.count(F.lit(1)).alias("n"))
