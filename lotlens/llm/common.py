"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``: the only characters that part words.
SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER_TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
HEX = "0123456789abcdef"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = os.path.join(os.path.abspath(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")), "scratch")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write to a new table in the shared folder and read it back: cuts the lineage, and survives lost executors.

    What was shuffled for the table goes when it is written. by: columns that part the table's files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lotlens-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def plain(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that other columns of the input can't clash with those an operator adds."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of the table has, in any case of letters."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in wanted:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(docs: DataFrame, text_col: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def fold(doc_id: object, parts: int = 5) -> int:
    """crc32 of doc_id as text, modulo ``parts``; a null id is hashed as empty text."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


def fold_column(id_col: Column, parts: int = 5) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts
