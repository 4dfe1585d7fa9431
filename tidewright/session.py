"""What a session needs: its Python workers find this package, and there is a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def share_package(spark: SparkSession) -> None:
    """Put the package's folder on the workers' path. On a cluster the package is installed or sent along with --py-files; this is for sessions started elsewhere on this machine."""
    home = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(":")
    if home not in known:
        environment["PYTHONPATH"] = ":".join([home, *filter(None, known)])


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: under the session's checkpoint folder, or (a session without one, as in tests) under a local one."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
