"""Cutting lineage: intermediate results in the folder that the executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from a reliable checkpoint, so what follows is planned and redone from there.

    The folder is the session's (spark.checkpoint.dir). Where none is named, one is made on
    this machine, in local mode only: executors elsewhere could not read it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cut-"))
    return df.checkpoint()
