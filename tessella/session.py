"""A Spark session with the settings that the library's plans expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with AQE, skew-join splitting and UTC; ``extra`` overrides anything.

    On a cluster leave ``master`` to spark-submit and set ``spark.checkpoint.dir``
    to a folder that all executors share.
    """
    builder = SparkSession.builder.appName("tessella").master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    for key, value in {**conf, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    Only on one machine, and where that is unset, a temporary folder is taken.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", known)
    return f"{known.rstrip('/')}/tessella/{name}-{uuid.uuid4().hex}"
