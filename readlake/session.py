"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "readlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session pinned to UTC with adaptive execution on; the cluster's own settings win over ours."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it. Only where nothing is set (a test on
    one machine) is a folder of our own chosen."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Stages written by this process and not yet given up.
_WRITTEN: list[str] = []


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def written(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any store that Spark reaches."""
    at, store = _folder(spark, path)
    return store.exists(at)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own tables."""
    at, store = _folder(spark, path)
    store.delete(at, True)


def release_pinned(spark: SparkSession) -> int:
    """Deletes the stages that `pinned` wrote so far, once the results that read them are written. How many there were."""
    many = len(_WRITTEN)
    while _WRITTEN:
        removed(spark, _WRITTEN.pop())
    return many


def pinned(df: DataFrame, name: str = "stage", **options: str) -> DataFrame:
    """`df` computed once and written to the shared folder. A lost executor re-reads it instead of recomputing,
    later stages read only the columns they use, and the planner knows its size. `options` are those of the Parquet writer."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)
