"""Our extension: the per-version counts over a stream of attempts, by event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_version(stream: DataFrame, time: str, version: str, status: str, bad: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tested and failed attempts of each version and window; rows later than `late` behind the latest are dropped."""
    timed = stream.withWatermark(time, late)
    return timed.groupBy(F.window(time, window).alias("window"), version).agg(F.count("*").alias("tested"), F.count_if(F.col(status) == bad).alias("failures"))
