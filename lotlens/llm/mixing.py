"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each source has one table of its distribution: the cumulative probabilities of
the counts within 12 standard deviations and 30 of its rate, outside of which
less than 2**-53 lies. A row's count is the number of those that its uniform
number reaches, so a row costs a look at its source's table. Tables have about
24 times the root of the rate in entries; a source with a large rate is a small
one, so that all tables together stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, plain, stored

#: Entries of all sources' tables above which they are joined by a shuffle instead of broadcast.
BROADCAST_ENTRIES = 1_000_000
#: Copies of a row that are made at a time.
CHUNK = 1_000_000
SEED = "mix-1"


def _bits(*parts: Column) -> Column:
    """A number of the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, rate: the mean number of copies that gives each source its share of ``epochs`` times all characters.

    Without ``weights`` every source has weight 1; a source that ``weights`` lacks has weight 0, a null source
    is a source of its own, named by None. A source without any character gets rate 0.
    """
    chars = plain(docs, source_col, text_col).toDF("source", "text").groupBy("source").agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("chars"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sized = stored(chars.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(0.0)))
    total = sized.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    return sized.crossJoin(F.broadcast(total)).select(
        "source", F.when(F.col("weight") > 0, F.lit(float(epochs)) * F.col("all_chars") * F.col("weight") / F.col("all_weight") / F.col("chars")).otherwise(0.0).alias("rate")
    )  # one row of totals


def distributions(by_source: DataFrame) -> DataFrame:
    """source, rate, least, cdf: cumulative Poisson probabilities of the counts from ``least`` on. by_source: source, rate; rates of 0 have no row."""
    reach = 12 * F.sqrt("rate") + 30
    least = F.greatest(F.floor(F.col("rate") - reach), F.lit(0)).cast("long")
    counts = by_source.where("rate > 0").select("source", "rate", least.alias("least"), F.explode(F.sequence(least, F.ceil(F.col("rate") + reach).cast("long"))).alias("k"))
    # Terms relative to the first one as logarithms, then to the greatest: large rates neither underflow nor overflow.
    of = Window.partitionBy("source")
    upto = of.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("k") == F.col("least"), 0.0).otherwise(F.log("rate") - F.log(F.col("k").cast("double")))
    terms = counts.withColumn("log", F.sum(step).over(upto)).withColumn("term", F.exp(F.col("log") - F.max("log").over(of)))
    summed = terms.withColumn("cum", F.sum("term").over(upto)).withColumn("p", F.col("cum") / F.max("cum").over(of))
    return summed.groupBy("source", "rate", "least").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("cdf"))


def replicated(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", names: tuple[str, str] = ("__rate", "__copies")) -> DataFrame:
    """All columns of the input and, under the two names, the source's rate and the row's count (a long); rows without a copy go."""
    source, u, least, cdf = free_names(docs, "source", "u", "least", "cdf")
    rate, copies = names
    tables = stored(distributions(stored(rates(docs, weights, epochs, source_col, text_col)))).toDF(source, rate, least, cdf)
    entries = tables.agg(F.coalesce(F.sum(F.size(cdf).cast("long")), F.lit(0))).first()[0]
    joined = docs.join(F.broadcast(tables) if entries <= BROADCAST_ENTRIES else tables, F.col(f"`{source_col}`").eqNullSafe(F.col(source)))
    drawn = joined.withColumn(u, _bits(F.lit(seed), _key(id_col)) / F.lit(float(2**52)))
    return drawn.withColumn(copies, F.col(least) + F.size(F.filter(cdf, lambda p: p <= F.col(u)))).where(F.col(copies) > 0).drop(source, u, least, cdf)


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All columns of the input, and __rate, __copies, __copy (1 to __copies) and __order, one row per copy; where the input
    has such a column the new one gets underscores behind its name.

    A row's count inverts the Poisson distribution with its source's rate at a uniform number hashed from seed and
    doc_id, so that it depends on nothing else: repeated rows and rows with null ids get equal counts. Rows are
    dealt to partitions by __order, a hash of seed, doc_id and copy, and sorted by it: a global shuffle that needs
    neither a sampling pass nor a random number that changes when a task is run again. Empty tables give no rows.
    """
    rate, copies, copy, order, chunk = free_names(docs, "rate", "copies", "copy", "order", "chunk")
    counted = replicated(docs, weights, epochs, seed, id_col, source_col, text_col, (rate, copies))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    parts = counted.withColumn(chunk, F.explode(F.sequence(zero, F.floor((F.col(copies) - 1) / CHUNK).cast("long")))).withColumn(
        copy, F.explode(F.sequence(F.col(chunk) * CHUNK + one, F.least(F.col(copies), (F.col(chunk) + 1) * CHUNK)))
    )
    placed = parts.drop(chunk).withColumn(order, _bits(F.lit(f"{seed}-order"), _key(id_col), F.col(copy).cast("string")))
    return placed.repartition(order).sortWithinPartitions(order)
