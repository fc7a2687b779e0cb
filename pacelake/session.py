"""Session defaults: UTC, adaptive execution, skew handling; and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build(app: str = "pacelake", **conf: str) -> SparkSession:
    """A session with the library's defaults; the caller sets the master and sizes partitions for its cluster."""
    return SparkSession.builder.appName(app).config(map=DEFAULTS | conf).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a private one is made, but only if all work is done in this process."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pacelake-ckpt-"))
    return context.getCheckpointDir().get()


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the place that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
