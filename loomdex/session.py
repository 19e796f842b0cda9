"""Session defaults and the place for persistent tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(app: str = "loomdex", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def storage_root(spark: SparkSession) -> str:
    """Folder for indexes and logs: below the warehouse, which driver and executors share."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/loomdex/{spark.sparkContext.applicationId}"
