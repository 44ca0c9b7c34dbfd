"""Cutting lineage of iterative plans through reliable storage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where the session names none, a folder of
    our own on a local master (tests on one machine), and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="heronlake-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably: an executor that is lost later costs no recomputation
    of what came before, and non-deterministic steps are not run a second time."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
