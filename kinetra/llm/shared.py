"""Cutting lineage in the folder that the cluster's machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> None:
    """Makes sure that a checkpoint folder is set: the cluster's own setting stands; in local mode, as in tests, a new folder will do."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kinetra-checkpoint-"))


def written(df: DataFrame) -> DataFrame:
    """The same rows, computed now and read from the shared folder from here on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
