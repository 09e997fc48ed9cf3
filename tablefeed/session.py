"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from tablefeed import files

# Only what correctness or large inputs need; cluster sizing stays with the
# cluster's own configuration.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A task that meets few key ranges writes them side by side instead of sorting.
    "spark.sql.maxConcurrentOutputFileWriters": "16",
    # Tables that are loaded at once, and feeds, get equal shares.
    "spark.scheduler.mode": "FAIR",
}


def build_session(app: str = "tablefeed", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local session may go without one; it then gets a temporary folder,
    kept for the life of the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tablefeed-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the scratch root that no other run uses.

    All of an application's are in one folder, which is deleted when the driver's
    JVM ends: what is to stay has to be written elsewhere.
    """
    own = f"{scratch_root(spark)}/tablefeed-{spark.sparkContext.applicationId}"
    files.delete_on_exit(spark, own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the application's scratch tables now; frames that read them are of no use then."""
    own = f"{scratch_root(spark)}/tablefeed-{spark.sparkContext.applicationId}"
    for name in files.names(spark, own):
        files.delete(spark, f"{own}/{name}")
