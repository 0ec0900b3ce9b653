"""A session with the settings that the operators are written for."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "faultline", **more: str) -> SparkSession:
    """UTC clock, adaptive plans and skew-join splitting; further settings by keyword with _ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for k, v in (settings | {k.replace("_", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def cut(df):
    """df with its lineage cut by checkpoint(), in the folder of spark.checkpoint.dir. Where that is unset, a local one if all run on this machine; else an error."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def spread(df, *by):
    """df in as many partitions as keep all cores busy, by the columns given. Few bytes can be much work (a pane's expressions), and by bytes alone adaptive plans would leave them to a few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)
