"""Registers and series from files, by the names of their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.address import ACCENTED, PLAIN

_TABLE = str.maketrans(ACCENTED[: len(PLAIN)], PLAIN, ACCENTED[len(PLAIN) :])


def header_key(name: str) -> str:
    return "".join(c for c in name.translate(_TABLE).upper() if c.isalnum())


def by_header(df: DataFrame, wanted: dict[str, str], prefix: int = 26) -> DataFrame:
    """The wanted columns (new name -> header), found without regard to accents, case and marks, else by the header's beginning; missing ones are null."""
    keys = {header_key(c): c for c in reversed(df.columns)}
    out = []
    for new, header in wanted.items():
        key = header_key(header)
        found = keys.get(key) or next((c for k, c in keys.items() if k[:prefix] == key[:prefix] and len(key) >= prefix), None)
        out.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(new))
    return df.select(*out)


def index_series(spark: SparkSession, path: str) -> DataFrame:
    """{index: {yyyyMM: value}} as index, month, value."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", "map<string, map<string, double>>").alias("m"))
    return parsed.select(F.explode("m").alias("index", "series")).select("index", F.explode("series").alias("month", "value"))


def with_fallback(series: DataFrame, index: str, other: str) -> DataFrame:
    """month, value, origin of an index; where it has no values at all, those of the other one."""
    own, rest = (series.where(F.col("index") == name).select("month", "value", F.lit(name).alias("origin")) for name in (index, other))
    return own.unionByName(rest.join(own.select(F.lit(True).alias("__there")).limit(1), F.lit(True), "left_anti"))
