"""Session factory with the settings that the engine's plans assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "simstrata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, Arrow and UTC. ``master`` is left to spark-submit when it is None."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
