"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in tests, a folder beside the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return found or os.path.join(os.path.dirname(os.path.abspath(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"))), "lotlens-scratch")


def materialized(df: DataFrame) -> DataFrame:
    """Write to a new table below the shared folder and read it back; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def growing(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input and so is shuffled: its files are far smaller than its rows, and by their size Spark would collect and broadcast more than the driver holds."""
    return df.hint("shuffle_merge")


def file_state(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of all files of the paths, wherever they are stored: another one as soon as a table is written anew."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    digest = hashlib.md5()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(conf).listFiles(at, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
        digest.update("\n".join([path, *sorted(found)]).encode())
    return digest.hexdigest()
