"""A folder for scratch files that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A path below spark.checkpoint.dir that nothing uses yet; below a temporary folder where a local session has none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lociflow-")
    return f"{named.rstrip('/')}/lociflow/{uuid.uuid4().hex}"


def upload(spark: SparkSession, local: str) -> str:
    """A local file's place where executors can read it: itself in a local session, else a copy in the shared folder."""
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return local
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = path(f"{scratch(spark)}/input.var")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(path(f"file://{local}"), target)
    return target.toString()
