"""A local session with the settings the library is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """Adaptive execution and skew joins on, UTC, shuffle partitions for one machine; ``conf`` overrides.

    On a cluster the settings come from spark-submit; name spark.checkpoint.dir there.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tesserae")
    settings = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
