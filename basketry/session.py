"""Session helpers.

Operators never rely on session settings for their results (explicit casts,
no session-time-zone functions). The only session state they touch is the
checkpoint directory used to cut lineage in the exact ranking operator.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.errors import PySparkNotImplementedError
from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8,
                  app: str = "basketry", event_log_dir: str | None = None) -> SparkSession:
    """Local session for tests and the benchmark (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "8g")
    )
    if event_log_dir:
        builder = (builder.config("spark.eventLog.enabled", "true")
                   .config("spark.eventLog.dir", event_log_dir))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    always used when present. Only a local session without one (tests, the
    benchmark) gets a fresh scratch folder of its own.
    """
    try:
        sc = spark.sparkContext
    except PySparkNotImplementedError:     # Spark Connect: the server has the context
        configured = spark.conf.get("spark.checkpoint.dir", "")
        if not configured:
            raise RuntimeError("spark.checkpoint.dir is not set on the Spark Connect server") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/object store) so ranked frames survive executor loss")
    scratch = tempfile.mkdtemp(prefix="basketry-ckpt-")
    atexit.register(shutil.rmtree, scratch, ignore_errors=True)
    sc.setCheckpointDir(scratch)
    return scratch
