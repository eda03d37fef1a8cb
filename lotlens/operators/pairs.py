"""Pairs of sales of one street, drawn without being made.

Sales of a street are counted in cells of a month and a band of area, so narrow that two sales of like area are in the same
band or in neighbouring ones. Two cells far enough apart in time hold as many pairs as the product of their counts; laid end
to end, these number all pairs that can fit. A multiplier that shares no factor with their number deals the numbers out in
another order, and as many of them as it takes, in rounds, are turned back into two sales and looked at. So a street costs
its cells' pairs and its draws: months and bands bound the first, ``most`` and the share of pairs that fit the second. A
street with few pairs, as most have, has them all drawn, without Python.
"""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialized

# Months between two sales, how much larger the one may be, and pairs of a street.
MONTHS, RATIO, MOST = 24, 1.3, 150
#: A prime above the number of pairs of any street.
MULTIPLIER = 2**61 - 1


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def celled(sales: DataFrame, key: str, day: str, area: str, tie: list[str], ratio: float = RATIO) -> DataFrame:
    """Sales with month, band and place, their number in the cell from 0 on, by ``tie``, which must tell sales of a cell apart or leave only equal ones."""
    cell = [key, "__month", "__band"]
    known = sales.where((F.col(area) > 0) & F.col(day).isNotNull() & F.col(key).isNotNull()).withColumns({"__month": month_number(F.col(day)), "__band": F.floor(F.log(area) / log(ratio)).cast("long")})
    return known.withColumn("__place", (F.row_number().over(Window.partitionBy(*cell).orderBy(*tie)) - 1).cast("long"))


def cell_pairs(cells: DataFrame, key: str, months: int = MONTHS) -> DataFrame:
    """key, m0, b0, m1, b1, k1, pairs: cells at least ``months`` apart in the same or neighbouring bands. cells: key, __month, __band, k."""
    first = cells.select(key, F.col("__month").alias("m0"), F.col("__band").alias("b0"), F.col("k").alias("k0"), F.explode(F.array(*[F.col("__band") + d for d in (-1, 0, 1)])).alias("b1"))
    second = cells.select(key, F.col("__month").alias("m1"), F.col("__band").alias("b1"), F.col("k").alias("k1"))
    return first.join(second, [key, "b1"]).where(F.col("m1") - F.col("m0") >= months).select(key, "m0", "b0", "m1", "b1", "k1", (F.col("k0") * F.col("k1")).alias("pairs"))


def numbered_pairs(pairs: DataFrame, key: str) -> DataFrame:
    """``cell_pairs`` with start, the number of a row's first pair, and total, the pairs of its key."""
    of_key = Window.partitionBy(key)
    return pairs.withColumns({"start": F.sum("pairs").over(of_key.orderBy("m0", "b0", "m1", "b1")) - F.col("pairs"), "total": F.sum("pairs").over(of_key)})


def _all_drawn(numbered: DataFrame, key: str) -> DataFrame:
    """What ``_drawn`` gives for keys that have all pairs drawn; numbered: ``numbered_pairs`` with totals of less than 2 ** 31."""
    each = numbered.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pairs") - 1)))
    turn = (F.col("start") + F.col("__i")) * (F.lit(MULTIPLIER) % F.col("total")) % F.col("total")
    return each.select(key, turn.alias("turn"), "m0", "b0", F.expr("__i div k1").alias("p0"), "m1", "b1", (F.col("__i") % F.col("k1")).alias("p1"), "total")


def _drawn(numbered: DataFrame, key: str, begin: int, count: int) -> DataFrame:
    """key, turn, m0, b0, p0, m1, b1, p1, total: the pairs whose turn is from ``begin`` on, ``count`` a key. numbered: ``cell_pairs``, a key's in one group."""
    kind = numbered.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["m0", "b0", "m1", "b1"])
        upto = pdf["pairs"].to_numpy().cumsum()
        total = int(upto[-1])
        back = pow(MULTIPLIER, -1, total) if total > 1 else 0
        turns = range(begin, min(begin + count, total))
        numbers = np.array([turn * back % total for turn in turns], np.int64)
        at = np.searchsorted(upto, numbers, side="right")
        rows = pdf.iloc[at]
        rest = numbers - (upto[at] - rows["pairs"].to_numpy())
        k1 = rows["k1"].to_numpy()
        return pd.DataFrame({key: rows[key].to_numpy(), "turn": np.array(turns, np.int64), "m0": rows["m0"].to_numpy(), "b0": rows["b0"].to_numpy(), "p0": rest // k1, "m1": rows["m1"].to_numpy(), "b1": rows["b1"].to_numpy(), "p1": rest % k1, "total": total})

    return numbered.groupBy(key).applyInPandas(run, f"{key} {kind}, turn long, m0 int, b0 long, p0 long, m1 int, b1 long, p1 long, total long")


def drawn_pairs(sales: DataFrame, key: str, day: str, area: str, tie: list[str], months: int = MONTHS, ratio: float = RATIO, most: int = MOST, first_draw: int = 4) -> DataFrame:
    """turn and both sales of up to ``most`` pairs a key, as structs a (the earlier) and b: at least ``months`` calendar months apart, of areas at most ``ratio`` times each other.

    The pairs are the first ones that fit in the order of their turns; all, where there are fewer. Sales without a key, a day
    or an area above zero have none.
    """
    rows = materialized(celled(sales, key, day, area, tie, ratio))
    columns = sales.columns
    pairs = materialized(numbered_pairs(cell_pairs(rows.groupBy(key, "__month", "__band").agg(F.count("*").alias("k")), key, months), key))
    side = lambda x, n: rows.select(F.col(key), F.col("__month").alias(f"m{n}"), F.col("__band").alias(f"b{n}"), F.col("__place").alias(f"p{n}"), F.struct(*columns).alias(x))
    fits = F.abs(F.log(F.col(f"b.{area}") / F.col(f"a.{area}"))) <= log(ratio)
    found, begin, count = None, 0, first_draw * most
    # The first draw is of all keys, and takes all pairs of those with few.
    few = F.col("total") <= min(count, 2**31 - 1)
    draw = _all_drawn(pairs.where(few), key).unionByName(_drawn(pairs.where(~few), key, begin, count))
    while True:
        tried = materialized(draw.join(side("a", 0), [key, "m0", "b0", "p0"]).join(side("b", 1), [key, "m1", "b1", "p1"]).withColumn("fits", fits))
        hits = tried.where("fits").select(key, "turn", "a", "b")
        found = hits if found is None else found.unionByName(hits)
        begin, count = begin + count, 4 * count
        done = found.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= most).select(key)
        open_keys = materialized(tried.where(F.col("total") > begin).select(key).distinct().join(done, key, "left_anti"))
        if open_keys.isEmpty():
            break
        draw = _drawn(pairs.join(open_keys, key, "left_semi"), key, begin, count)
    place = F.row_number().over(Window.partitionBy(key).orderBy("turn"))  # most x 4 ^ rounds rows a key
    return found.withColumn("__n", place).where(F.col("__n") <= most).select(key, "turn", "a", "b")
