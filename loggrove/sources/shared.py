"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A path that nothing has used yet, in the folder that the cluster names in
    ``spark.checkpoint.dir``. Where that is unset, a temporary one is made and set
    on a single machine (a local master, tests); a cluster is asked for it."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="loggrove-")
        context.setCheckpointDir(root)
    return f"{root}/loggrove/{label}-{uuid.uuid4().hex}"
