"""Session helpers.

Library functions never create a session themselves; they use the session of
the DataFrame they receive.  ``get_session`` is for scripts, the bench and
tests.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "wideprep",
                shuffle_partitions: int | None = None,
                conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must point at shared storage; without it this
    raises, since a folder of the driver's machine cannot serve the executors.
    Only a local master (tests) gets a private scratch folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="wideprep-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# Target bytes per shuffle partition and per scan split: large enough to
# amortise task overhead, small enough to stay in executor memory without spill.
PARTITION_BYTES = 256 * 1024 * 1024


def input_bytes(spark: SparkSession, *paths: str) -> int:
    """Bytes on disk under ``paths`` (Hadoop file-system metadata, no data read)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        total += p.getFileSystem(conf).getContentSummary(p).getLength()
    return total


def tune_for_input(spark: SparkSession, n_bytes: int, partition_bytes: int = PARTITION_BYTES) -> dict:
    """Size shuffles and scans for an input of ``n_bytes``: about one shuffle
    partition per ``partition_bytes`` of input (AQE coalesces the small ones
    and splits skewed ones at run time), the same size for scan splits.  For
    100 TB that is about 400,000 partitions."""
    parts = int(max(shuffle_partitions(spark), -(-n_bytes // partition_bytes)))
    settings = {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    return settings
