"""Cutting lineage so that a lost executor costs a re-read and not a recomputation."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

CHECKPOINT_KEY = "spark.checkpoint.dir"


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and all runs
    on one machine, as in tests, a temporary folder is used; on a cluster it would be lost with
    its machine, so there an unset folder is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get(CHECKPOINT_KEY, None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="changelode-"))
    return df.checkpoint(eager=True)
