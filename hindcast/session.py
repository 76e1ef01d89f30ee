"""Session defaults and reliable materialisation."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "hindcast") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # Call-site capture costs more than the analysis itself for plans with hundreds of columns.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and tasks share one machine; ``local-cluster`` counts as a cluster."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; only a local session without one gets its own.

    Raises on a cluster without ``spark.checkpoint.dir``: a folder of the driver's machine is not
    seen by the executors.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder next to the checkpoints, on storage every executor reaches."""
    return f"{ensure_checkpoint_dir(spark)}/hindcast-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per session, so that functions pickled by name load there."""
    if getattr(spark, "_hindcast_shipped", False):
        return
    if not is_local(spark) or "hindcast" not in os.listdir():
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/hindcast", "zip", root, "hindcast"))
    spark._hindcast_shipped = True


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder so that several consumers share one computation.

    Reliable checkpoints survive executor loss, which a cache or a local checkpoint does not.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
