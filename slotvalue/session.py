"""A configured local session for tests and benches, and paths on the shared
folder for jobs that write tables of their own."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every plan in this library assumes.  ANSI mode stays on (the
# default); operators use try_* functions where input may be malformed.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "slotvalue", scratch: str | None = None) -> SparkSession:
    """A local session for tests and benchmarks.

    ``scratch`` is a per-run folder for the warehouse.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    if scratch is None:
        scratch = tempfile.mkdtemp(prefix="slotvalue-")
    builder = builder.config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Scratch folders of single-machine sessions that name none, by application.
_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder that the cluster names in
    ``spark.checkpoint.dir``.  Only a session of a single machine that names
    none gets a temporary folder of its own."""
    base = (spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL_SCRATCH.get(app) or "file://" + tempfile.mkdtemp(prefix="slotvalue-scratch-")
        _LOCAL_SCRATCH[app] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
