"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Settings for long arithmetic expressions, changeable on a running session.
#
# * Projection formulas nest dozens of operations. Constraint propagation turns
#   every comparison on such a column into an IS NOT NULL over the whole formula,
#   pushes it below the projection and computes the formula twice.
# * The JVM does not compile methods above 8000 bytecodes; without the limit one
#   long stage runs in the bytecode interpreter.
LONG_EXPRESSIONS = {
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# The planner takes the size of a table from its file. Here a key of a few bytes often becomes
# a polygon, its edges or its grid cells, hundreds of times that, and such a table would be sent through
# the driver. So only tables of a few rows are broadcast by their file size; what a
# shuffle has measured is broadcast up to the usual limit.
MEASURED_BROADCASTS = {
    "spark.sql.autoBroadcastJoinThreshold": "64k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session made elsewhere."""
    for key, value in {**LONG_EXPRESSIONS, **MEASURED_BROADCASTS}.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, app: str = "geoloom", **conf: str) -> SparkSession:
    """Session with the settings the operators are written for.

    A cluster passes its own master and shuffle settings; nothing here depends
    on the number of executors.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor reaches.

    Only when the session names none (a local test run) is a private one chosen.
    """
    sc = spark.sparkContext
    chosen = sc._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="geoloom-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: lost executors lose nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
