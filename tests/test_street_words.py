"""A street's words are made once for its name and its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotlens.functions import address as ad
from lotlens.plans import QUERIES


def test_words_are_made_once(spark, sf_dir: str) -> None:
    assert QUERIES["street_keys"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


def test_name_and_key_are_those_made_alone(spark) -> None:
    lines = spark.createDataFrame([("Avenida Prof. José da Silva, 12",), ("R",), ("de da",), ("",), (None,)], "s string")
    both = lines.select(F.inline(F.array(ad.street_name_and_key(F.col("s"), 1)))).collect()
    assert both == lines.select(ad.street_name(F.col("s")).alias("name"), ad.street_key(F.col("s"), 1).alias("key")).collect()
