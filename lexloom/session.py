"""Session settings of the engine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Adaptive planning splits skewed joins and sizes shuffles by what they hold; times are UTC; Arrow carries batches.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, name: str = "lexloom", **settings: str) -> SparkSession:
    """A session with the engine's settings; the cluster's own come first where master is not given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a session of one process (master local) may lack the setting: a temporary folder takes its place.  On a
    cluster a folder of one machine would lose what executors write, so a missing setting is an error there.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not named:
        named = tempfile.mkdtemp(prefix="lexloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; each call has its own, so reruns never meet older files."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
