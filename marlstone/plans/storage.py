"""Where lineage is cut: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir, or the checkpoint folder set). On a local master, as in tests, a
    folder of its own where none is named; on a cluster that is an error, as executors could not share it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    here = "file://" + tempfile.mkdtemp(prefix="marlstone-checkpoint-")
    spark.sparkContext.setCheckpointDir(here)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
