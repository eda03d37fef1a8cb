"""Merges of new rows into stored tables, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_write(old: DataFrame, new: DataFrame, key: str, newest: list[Column]) -> DataFrame:
    """All rows of the newest write by key; new rows come before old ones, and ``newest`` orders rows of one side."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    first = Window.partitionBy(key).orderBy(F.col("__new").desc(), *newest)
    return both.withColumn("__place", F.row_number().over(first)).where("__place = 1").drop("__new", "__place")


def insert_ignored(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.dropDuplicates([key]).join(old, key, "left_anti").select(*old.columns))


def coalesced(old: DataFrame, new: DataFrame, key: str, filled: list[str], longest: list[str] = (), larger: list[str] = (), newest: list[Column] = ()) -> DataFrame:
    """Old rows with details: ``filled`` columns take a new value that isn't blank, ``longest`` the longer text, ``larger`` the longer array. Of several new rows of
    a key the first by ``newest`` counts, of which any one without an order."""
    first = Window.partitionBy(key).orderBy(*(newest or [F.lit(1)]))
    new = new.withColumn("__first", F.row_number().over(first)).where("__first = 1")
    n = new.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in [*filled, *longest, *larger]])
    out = {}
    for c in filled:
        kind = new.schema[c].dataType.typeName()
        own = F.nullif(F.col(f"__{c}"), F.lit("")) if kind == "string" else F.col(f"__{c}")
        out[c] = F.coalesce(own, F.col(c))
    for c in longest:
        out[c] = F.when(F.length(F.coalesce(f"__{c}", F.lit(""))) > F.length(F.coalesce(c, F.lit(""))), F.col(f"__{c}")).otherwise(F.col(c))
    for c in larger:
        size = lambda x: F.coalesce(F.when(F.col(x).isNotNull(), F.size(x)), F.lit(0))
        out[c] = F.when(size(f"__{c}") > size(c), F.col(f"__{c}")).otherwise(F.col(c))
    return old.join(n, F.col(key) == F.col("__key"), "left").withColumns(out).select(*old.columns)


def seen(old: DataFrame | None, now: DataFrame, key: str = "url", ts: str = "ts") -> DataFrame:
    """key, first_seen, last_seen."""
    fresh = now.groupBy(key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    if old is None:
        return fresh
    return old.unionByName(fresh).groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def backfilled(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The table with null columns derived by rule, and only the rows that changed."""
    filled = df.withColumns({c: F.coalesce(F.col(c), rule) for c, rule in rules.items()})
    changed = df.select("*", *[F.coalesce(F.col(c), rule).alias(f"__{c}") for c, rule in rules.items()])
    moved = None
    for c in rules:
        d = ~F.col(c).eqNullSafe(F.col(f"__{c}"))
        moved = d if moved is None else moved | d
    return filled, changed.where(moved).select(*[F.col(f"__{c}").alias(c) if c in rules else F.col(c) for c in df.columns])
