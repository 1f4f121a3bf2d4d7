"""Tables by name below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` (a file or a folder of files) below root."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A bare scan, dealt out evenly if it has fewer partitions than there are cores.

    Only small inputs are: one file of one row group would keep a single core busy with work per
    text. A large input has partitions enough and is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def texts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """table(), spread for operators that compute much per row."""
    return spread(table(spark, root, name))
