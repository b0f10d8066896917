"""Session set-up shared by jobs, tests and the bench."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "parlance", master: str | None = None, **conf: str
) -> SparkSession:
    """Session in UTC with ANSI and adaptive execution on; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        # stream state on the executors' disks, not in their heaps
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        # messages of one session are merged before the shuffle
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        # rows handed to Python functions at once: texts are long, and a batch is held several times
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
        # generated methods beyond this size are never compiled by the JVM
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates: ``spark.checkpoint.dir`` as the cluster names it.

    Only where the setting is absent (local tests) is a folder of our own used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    own = tempfile.mkdtemp(prefix="parlance-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own
