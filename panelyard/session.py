"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "panelyard", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; callers' settings win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share. A machine-local folder is
    used only in local mode."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured:
            context.setCheckpointDir(configured)
        elif context.master == "local" or context.master.startswith("local["):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="panelyard-checkpoint-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs
    a re-read and not a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
