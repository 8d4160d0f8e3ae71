"""Session settings that follow the amount of data."""

from __future__ import annotations

from pyspark.sql import SparkSession

MIB = 1 << 20
PARTITION_BYTES = 128 * MIB


def recommended_conf(shuffled_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a job whose largest exchange carries ``shuffled_bytes`` on ``cores`` cores.

    Shuffle partitions are sized to fit a task's memory, at least two waves of tasks and a multiple of the
    cores. Too many is harmless: adaptive execution merges small ones. Nothing here is needed for right
    results.
    """
    wanted = max(2 * cores, -(-shuffled_bytes // PARTITION_BYTES))
    partitions = -(-wanted // cores) * cores
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(PARTITION_BYTES),
        "spark.sql.session.timeZone": "UTC",
    }


def open_session(app: str, shuffled_bytes: int, cores: int, hive: bool = False) -> SparkSession:
    """Session with the recommended settings; ``hive`` keeps the catalog between sessions."""
    builder = SparkSession.builder.appName(app)
    for key, value in recommended_conf(shuffled_bytes, cores).items():
        builder = builder.config(key, value)
    return (builder.enableHiveSupport() if hive else builder).getOrCreate()
