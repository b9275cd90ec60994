"""Spectrum counts and failure classes over streams of finished runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import count_if
from ..operators.logs import failure_class


def windowed_spectrum(hits: DataFrame, time: str, component: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, component, ef, ep) of a stream of covered components with ``failed``; late rows within the watermark count."""
    return hits.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), component).agg(
        count_if("failed").alias("ef"), count_if(~F.col("failed")).alias("ep"))


def windowed_failures(runs: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, failure_class, n) of a stream of runs with the columns of failure_class."""
    return runs.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), failure_class().alias("failure_class")).agg(F.count("*").alias("n"))
