"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "graphloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and a UTC clock.

    ``master`` is left to ``spark-submit`` unless given.  Keyword names use ``__``
    for dots: ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a cluster
    the setting is required, because a machine-local folder is lost with its machine.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="graphloom-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The lineage ends at the written table, so values that depend on how rows were
    spread over partitions stay what they were when an executor is lost.
    """
    path = fresh_path(df.sparkSession, label)
    append(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Write the rows of ``df`` into the table at ``path``.

    The shuffles of the job go with its end, not when the driver's memory happens to be cleared.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP_CONF, None)
    conf.set(CLEANUP_CONF, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP_CONF)
        else:
            conf.set(CLEANUP_CONF, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
