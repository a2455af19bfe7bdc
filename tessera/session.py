"""SparkSession factory with the settings the engine's semantics expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "tessera", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitted settings win."""
    builder = SparkSession.builder.appName(app)
    if "spark.master" not in conf and not os.environ.get("SPARK_MASTER"):
        builder = builder.master(f"local[{cpus or os.cpu_count() or 4}]")
    for key, value in {**CONF, "spark.driver.memory": "8g", "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
