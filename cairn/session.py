"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitter's own configuration is used."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(master).appName("cairn")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, so later stages neither recompute it nor depend on one executor.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset and all runs
    in one process, as in tests, a folder on this machine is used; elsewhere executors could not share it, and an error says so.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairn-checkpoint-"))
    return df.checkpoint(eager=True)
