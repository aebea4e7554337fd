"""Sessions with the settings that the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution sizes shuffles and splits skewed joins; UTC keeps dates equal on every machine.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; ``settings`` override them (dots as double underscores)."""
    builder = SparkSession.builder.appName("quire")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()
