"""Where tables that are written on the way are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one is made where it is unset on one machine."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("parcelry.shared.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="parcelry-")
        spark.conf.set("parcelry.shared.dir", d)
    return d


def new_folder(spark: SparkSession) -> str:
    """A folder of this application that is not there yet."""
    return f"{shared_folder(spark)}/parcelry/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written in the shared folder and read again: lost executors cost no recomputation, and loops no long plans."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
