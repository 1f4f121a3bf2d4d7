"""Session, shared-folder and staging helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """A session for tests, benchmarks and local work; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName("quillstone")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the master is local (tests on one machine) a temporary folder is
    made and remembered as the checkpoint folder of the context; on a cluster it has to be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(found)
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="quillstone-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_FOLDERS: list[tuple[SparkSession, str]] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; release() or the end of the process removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.register(release)
    _FOLDERS.append((spark, path))
    return path


def release() -> None:
    """Remove all folders made by fresh_folder(); results that read from them must be used up before."""
    while _FOLDERS:
        spark, path = _FOLDERS.pop()
        with contextlib.suppress(Exception):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table to the shared folder and read back (columnar, prunable)."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def conf(spark: SparkSession, **settings: str):
    """Session settings (dots written as __) for the time in which a plan is built."""
    before = {}
    for key, value in settings.items():
        key = key.replace("__", ".")
        before[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
