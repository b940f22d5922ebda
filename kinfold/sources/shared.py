"""Where intermediate tables live: the shared folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local session without one (tests) gets a temporary folder;
    a cluster session must name one that all executors reach."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="kinfold-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Writes a reduced table that several branches read and reads it back. The lineage is cut, lost executors
    cost nothing, each branch reads its own columns only, and joins see the table's true size. The files stay until their owner
    discards them (see ``discard``), or the folder is cleaned, like other checkpoints."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/kinfold-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    settled = df.sparkSession.read.schema(df.schema).parquet(path)
    settled.settled_at = path
    return settled


def discard(*tables: DataFrame) -> None:
    """Deletes the files of settled tables that nothing reads any more; other tables are left alone."""
    for table in tables:
        path = getattr(table, "settled_at", None)
        if path:
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
