"""Session settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

# Static-free SQL settings: safe to apply to a session somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when the aggregation above then needs its own exchange: the extra exchange
    # moves partially aggregated rows, the unsplit task would hold the whole hot key.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffles start with many parts, which are then joined up to a size: what a task holds depends on that size, not on the input.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings above to the session. They stay set, also for whatever else uses it: call it at the entry."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers started from now on find this package; where executors do not see its folder, ship it (``--py-files``)."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in [*known, _ROOT] if p)


def local_session(cores: int | str = "*", app: str = "tidesift", shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks on one machine; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
