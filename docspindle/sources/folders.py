"""Folders for tables that are kept between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that the cluster names in spark.checkpoint.dir. Only a
    local session that names none gets a folder of its own."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="docspindle-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
