"""Session factory with the settings that results depend on (UTC) and that plans profit from (adaptive execution)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode only."""
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_folder is None:
        folder = tempfile.mkdtemp(prefix="sparkfolio-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_folder = "file://" + folder
    return _local_folder


def stage_folder(spark: SparkSession) -> str:
    """The application's own folder below the shared one."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the application's folder."""
    return f"{stage_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear_stages(spark: SparkSession) -> None:
    """Removes all that the application has written to its folder; results that read it can't be read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def get_spark(app: str = "sparkfolio", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, where it isn't installed on them: operators' functions import it there."""
    from pathlib import Path

    here = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{here.name}", "zip", here.parent, here.name))
