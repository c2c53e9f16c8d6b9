"""Where streams keep state and output."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run inside the cluster's shared folder (`spark.checkpoint.dir`).

    Only where that is unset, as in local tests, a temporary folder stands in.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="run-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
