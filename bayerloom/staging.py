"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: str | None = None


def scratch_folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, as a plain path; in local mode under a temporary folder where the session names none."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _own = _own or tempfile.mkdtemp(prefix="bayerloom-")
        base = _own
    return f"{base.removeprefix('file://').rstrip('/')}/frames-{uuid.uuid4().hex}"
