"""Session settings the jobs are written for."""

from pyspark.sql import SparkSession

SETTINGS = {
    # All stored times are UTC.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: merges small shuffle partitions, turns a join into a broadcast when a side
    # proves small, and splits the partition of a hot join key over several tasks.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The limiter keeps per-key state; RocksDB holds it outside the JVM heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


# What a shuffle or scan task should take: fits executor memory many times over, and is worth a task.
TASK_BYTES = 128 * 2**20


def shuffle_settings(shuffled_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a job that shuffles about ``shuffled_bytes`` on ``cores``.

    The count is an upper bound: adaptive execution merges what turns out small. Too few partitions, on the
    other hand, spill.
    """
    partitions = max(2 * cores, -(-shuffled_bytes // TASK_BYTES))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
        "spark.sql.files.maxPartitionBytes": str(TASK_BYTES),
    }


def build_session(app_name: str = "hexwarden", master: str | None = None, **extra: str) -> SparkSession:
    """Return a session with ``SETTINGS``; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
