"""The folder that driver and executors share for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder inside the session's checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session.  Where neither it nor a
    checkpoint folder is set, a local master (tests) gets a temporary folder;
    on a cluster that is an error, as executors don't share local disks.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="loomquery-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder name in the shared folder; Spark's file system deletes it when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path
