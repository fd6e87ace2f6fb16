"""Tables in the shared folder that the cluster names in spark.checkpoint.dir: where a lineage ends, so that a lost executor costs nothing done before."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def plain_unions(spark: SparkSession) -> None:
    """Keep the planner from taking a union of equally partitioned tables for partitioned itself: in 4.1 a join on such a union
    can fail with unequal numbers of partitions once adaptive execution has changed one of them."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset a folder of this machine serves, on a local master alone: elsewhere executors could not read each other's files."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the application ends."""
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df as a written table."""
    plain_unions(df.sparkSession)
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame) -> DataFrame:
    """df with columns of their own, for joining a table with one that comes from it."""
    from pyspark.sql import functions as F

    return df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns])
