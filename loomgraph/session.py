"""A local session with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomgraph")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # a long session of iterations must not fill the driver with descriptions of past plans
        .config("spark.sql.maxPlanStringLength", "100000")
        .config("spark.sql.ui.retainedExecutions", "20")
        .config("spark.ui.retainedJobs", "100")
        .config("spark.ui.retainedStages", "100")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
