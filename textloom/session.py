"""Session defaults and the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the cluster names no shared folder (tests on one machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def local_session(cores: int | str = "*", memory: str = "12g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; set here only where it is unset, and only on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
        found = LOCAL_CHECKPOINTS
    return f"{found.rstrip('/')}/textloom-{spark.sparkContext.applicationId}"


#: Folders that ``stored`` has written and nobody has removed, by application.
_LEFT: dict[str, list[str]] = {}


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage and outlives lost executors. Whoever has no more use for the
    result removes its folder (``discard``); folders are named after the application, so
    that whoever runs it can remove all that is left (``clear``).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _LEFT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the folders of results of ``stored`` that nothing reads any more."""
    for df in frames:
        path = df.stored_at
        _LEFT[df.sparkSession.sparkContext.applicationId].remove(path)
        _remove(df.sparkSession, path)


def left(spark: SparkSession) -> list[str]:
    """Folders of this application that are still there, oldest first."""
    return list(_LEFT.get(spark.sparkContext.applicationId, ()))


def discard_all(spark: SparkSession, paths: list[str]) -> None:
    """Remove such folders, for callers that hold no frame."""
    for path in paths:
        _LEFT[spark.sparkContext.applicationId].remove(path)
        _remove(spark, path)


def clear(spark: SparkSession) -> None:
    """Remove what ``stored`` has written in this application."""
    _LEFT.pop(spark.sparkContext.applicationId, None)
    _remove(spark, shared_dir(spark))
