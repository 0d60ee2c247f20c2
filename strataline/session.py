"""Session settings and the shared folder for cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "strataline", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session as tests and bench use it; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset a local one is set, on a local master only: elsewhere executors would not see it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all workers share; it is unset on {master}")
        where = "file://" + os.path.join(tempfile.gettempdir(), f"strataline-{uuid.uuid4().hex[:8]}")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one. It is deleted when the driver's JVM ends, or by release()."""
    path = f"{shared_dir(spark)}/strataline-{spark.conf.get('spark.app.id')}"
    if path not in _MARKED:
        hp, fs = _file_system(spark, path)
        fs.mkdirs(hp)
        fs.deleteOnExit(hp)
        _MARKED.add(path)
    return path


_MARKED: set[str] = set()


def _file_system(spark: SparkSession, path: str):
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hp, hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str = "t") -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: lineage is cut and a lost executor costs nothing already done."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete materialized tables that nothing reads any more."""
    for p in paths:
        hp, fs = _file_system(spark, p)
        fs.delete(hp, True)


def release(spark: SparkSession) -> None:
    """Delete all tables this application has materialized; results still to be read must be saved before."""
    path = work_dir(spark)
    remove(spark, [path])
    _MARKED.discard(path)
