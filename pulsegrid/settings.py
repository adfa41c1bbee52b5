"""Spark settings that fit a job to its input."""

from __future__ import annotations

_MB = 1 << 20


def session_settings(input_bytes: int, cores: int, partition_mb: int = 128) -> dict[str, str]:
    """Settings for a job that reads ``input_bytes`` on ``cores`` executor cores.

    Shuffles get partitions of about ``partition_mb`` so that a sort fits a task's
    memory; adaptive execution merges the small ones and splits the skewed ones.
    """
    shuffle = max(2 * cores, -(-input_bytes // (partition_mb * _MB)))
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.files.maxPartitionBytes": str(2 * partition_mb * _MB),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_mb * _MB),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    }
