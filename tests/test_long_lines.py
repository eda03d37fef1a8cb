from __future__ import annotations

from pyspark.sql import functions as F

from lotlens.functions import address as ad


def test_all_words_of_a_long_line_enter_name_and_key(spark) -> None:
    lines = [" ".join(["RUA", *["X"] * 10_005, end]) for end in ("PROF", "ALFA")]
    got = spark.createDataFrame([*[(x,) for x in lines], (None,), ("",), ("Rua",)], "line string").select(ad.street_name(F.col("line")).alias("name"), ad.street_key(F.col("line"), 1).alias("key")).collect()
    words = " ".join(["X"] * 10_005)
    assert [tuple(r) for r in got] == [(f"R {words} PROF", f"{words} PROFESSOR"), (f"R {words} ALFA", f"{words} ALFA"), ("", ""), ("", ""), ("R", "")]
