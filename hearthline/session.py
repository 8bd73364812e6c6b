"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    # HotSpot does not compile larger methods; wide projections then run split up.
    METHOD_LIMIT: "8000",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def local_session(cores: int | str = 8, app: str = "hearthline", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def compiled(spark: SparkSession):
    """Statements run inside have no generated method that HotSpot would not compile, whatever the session's own limit is."""
    before = spark.conf.get(METHOD_LIMIT, None)
    spark.conf.set(METHOD_LIMIT, SETTINGS[METHOD_LIMIT])
    try:
        yield
    finally:
        spark.conf.unset(METHOD_LIMIT) if before is None else spark.conf.set(METHOD_LIMIT, before)


def run_folder(spark: SparkSession) -> str:
    """The folder of this application below ``spark.checkpoint.dir``; all intermediate tables go there.

    Only a local master may run without that setting; there a temporary
    folder is taken, because driver and executors are one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = os.path.join(tempfile.gettempdir(), "hearthline")
    return f"{root.rstrip('/')}/run-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the run folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def release_run_folder(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Results that still read them must have been written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def growing(df):
    """``df`` as a side of a join that goes through a shuffle, whatever size the planner expects.

    The planner takes sizes from compressed files, shrinks them with every column that a parsed struct loses and does not see
    how many rows a generator makes. A side that grows with the input would then be collected by the driver and broadcast.
    """
    return df.hint("merge")


def cut_lineage(df, name: str):
    """Write ``df`` to the shared folder and read it back.

    The written table survives lost executors and is computed once for all
    its readers.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
