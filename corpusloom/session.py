"""A session with the settings that the engine relies on."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "corpusloom", master: str | None = None, conf: Mapping[str, str] | None = None) -> SparkSession:
    """Get or make a session. Partition counts and memory are the cluster's to say."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | dict(conf or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of df in the folder that all executors share (spark.checkpoint.dir); only local sessions get one of their own."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loom-checkpoint-"))
    return df.checkpoint(eager=True)
