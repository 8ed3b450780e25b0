"""Tables written once to the folder that all machines share, and read back: what several branches of a query use isn't
computed by each of them, and a lost executor costs no more than the tasks since."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN_FOLDER = "leafmark.stored.dir"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this session's own, if all runs in one process."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(OWN_FOLDER, None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir names no folder that the cluster's machines share")
        where = "file://" + tempfile.mkdtemp(prefix="leafmark-")
        spark.conf.set(OWN_FOLDER, where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
