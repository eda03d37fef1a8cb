"""Recent comparable sales of each listing.

A listing's sales are looked for in six steps: financed sales on its street in
its postal code, on its street, in its postal code, and then all sales in the
same three ways. The first step that has ``LEAST`` sales wins, else the first
that has any. All steps of all listings are one set of joins and windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import confidence_class
from ..storage import growing

# How alike areas must be, how many sales a step needs and takes, how old sales may be, and what a usable sale is.
AREA_TOLERANCE, LEAST, MOST, YEARS, LEAST_NUMBERS = 0.25, 3, 500, 10, 3
LEAST_AREA, UNIT_LOW, UNIT_HIGH, FINANCED_SINCE = 20.0, 800.0, 25_000.0, 2011


def usable(sales: DataFrame, least_area: float = LEAST_AREA) -> DataFrame:
    """Market sales of a plausible size and value by area. sales: area, value, market."""
    return sales.where((F.col("area") >= least_area) & (F.col("value") > 0) & F.col("market") & F.try_divide("value", "area").between(UNIT_LOW, UNIT_HIGH))


def financed(text: Column, amount: Column, file_year: Column) -> Column:
    return ((F.trim(F.coalesce(text, F.lit(""))) != "") | (F.coalesce(amount, F.lit(0.0)) > 0)) & (file_year >= FINANCED_SINCE)


def cascade(listings: DataFrame, sales: DataFrame, tie: list[str], tolerance: float = AREA_TOLERANCE, least: int = LEAST, most: int = MOST, years: int = YEARS) -> DataFrame:
    """Each listing's sales of the step that wins: all columns of sales, url, listing_area, price and step (1 to 6).

    listings: url, street, cep, area, price. sales: street, cep, area, financed, sold (date), and the columns of
    ``tie``, which make the order of sales of one day total. Of a step the newest ``most`` sales count, and of them
    those from the year of the newest, less ``years``, on; all if the newest has no date.
    """
    ads = listings.select("url", F.col("street").alias("ad_street"), F.col("cep").alias("ad_cep"), F.col("area").alias("listing_area"), "price").where("listing_area > 0")
    # Areas fall into logarithmic bands as wide as the tolerance: a listing is in two at most, so that the keys of the joins
    # part the sales of a busy street or postal code by size.
    low, high = F.col("listing_area") * (1 - tolerance), F.col("listing_area") * (1 + tolerance)
    band = lambda x: F.floor(F.log(x) / math.log((1 + tolerance) / (1 - tolerance)))
    ads = ads.withColumn("ad_band", F.explode(F.sequence(band(low), band(high))))
    sized = sales.where("area > 0").withColumn("__band", band(F.col("area").cast("double")))
    alike = (F.col("__band") == F.col("ad_band")) & F.col("area").between(low, high)
    on_street = sized.join(growing(ads), (F.col("street") == F.col("ad_street")) & alike).withColumn("levels", F.when(F.col("cep") == F.col("ad_cep"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2))))
    in_code = sized.join(growing(ads), (F.col("cep") == F.col("ad_cep")) & alike).withColumn("levels", F.array(F.lit(3)))
    # One shuffle, of pairs before they are listed under their steps: all windows here and the summary's groups lie within a listing.
    found = on_street.unionByName(in_code).drop("ad_street", "ad_cep", "ad_band", "__band").repartition("url")
    steps = F.when(F.col("financed"), F.concat("levels", F.transform("levels", lambda x: x + 3))).otherwise(F.transform("levels", lambda x: x + 3))
    rows = found.withColumn("step", F.explode(steps)).drop("levels")
    step = Window.partitionBy("url", "step")
    newest = step.orderBy(F.col("sold").desc_nulls_last(), *[F.col(c).desc() for c in tie])
    recent = rows.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most)
    dated = recent.withColumn("newest", F.max("sold").over(step)).where(F.col("newest").isNull() | (F.year("sold") >= F.year("newest") - years))
    counted = dated.withColumn("n", F.count("*").over(step))
    # A step with enough sales beats all without; then the earlier one.
    rank = F.when(F.col("n") >= least, F.col("step")).otherwise(F.col("step") + 6)
    best = counted.withColumn("rank", rank).withColumn("best", F.min("rank").over(Window.partitionBy("url")))
    return best.where("rank = best").drop("place", "newest", "n", "rank", "best")


def summary(comparables: DataFrame, least_numbers: int = LEAST_NUMBERS) -> DataFrame:
    """One row per listing: step, n, n_numbers, n_financed, method, unit_median, estimate, unit_mean, unit_low, unit_high, ratio, confidence, first_year, last_year.

    The median of value by area is taken per house number and then over numbers where a listing has
    ``least_numbers`` numbers, so that one building can't outvote a street; else over all sales. Sales without
    a number count as one number.
    """
    rows = comparables.withColumn("unit", F.col("value") / F.col("area")).withColumn("number", F.coalesce(F.nullif(F.trim(F.col("number").cast("string")), F.lit("")), F.lit("?")))
    # Over a window and not joined, for which the comparables would be computed twice.
    rows = rows.withColumn("of_sales", F.median("unit").over(Window.partitionBy("url")))
    by_number = rows.groupBy("url", "step", "listing_area", "price", "number").agg(
        F.median("unit").alias("number_median"), F.count("*").alias("k"), F.sum("unit").alias("total"), F.min("unit").alias("low"), F.max("unit").alias("high"),
        F.sum(F.col("financed").cast("long")).alias("financed"), F.min(F.year("sold")).alias("first"), F.max(F.year("sold")).alias("last"), F.first("of_sales").alias("of_sales"),
    )
    by_ad = by_number.groupBy("url", "step", "listing_area", "price").agg(
        F.sum("k").alias("n"), F.count("*").alias("n_numbers"), F.sum("financed").alias("n_financed"), F.median("number_median").alias("of_numbers"),
        (F.sum("total") / F.sum("k")).alias("unit_mean"), F.min("low").alias("unit_low"), F.max("high").alias("unit_high"), F.min("first").alias("first_year"), F.max("last").alias("last_year"), F.first("of_sales").alias("of_sales"),
    )
    robust = F.col("n_numbers") >= least_numbers
    out = by_ad.withColumn("unit_median", F.when(robust, F.col("of_numbers")).otherwise(F.col("of_sales"))).withColumn("method", F.when(robust, "por_numero").otherwise("simples"))
    estimate = F.col("unit_median") * F.col("listing_area")
    return out.select(
        "url", "step", "n", "n_numbers", "n_financed", "method", "unit_median", estimate.alias("estimate"), "unit_mean", "unit_low", "unit_high", F.try_divide("price", estimate).alias("ratio"),
        confidence_class(F.col("step") <= 3, F.col("n"), F.col("n_numbers"), F.col("step").isin(1, 2, 4, 5)).alias("confidence"), "first_year", "last_year",
    )


def todo(listings: DataFrame, done: DataFrame, change: float = 1.0) -> DataFrame:
    """Listings without a comparison, or whose price moved by ``change`` or more since."""
    same = (F.col("a.url") == F.col("d.url")) & (F.abs(F.coalesce(F.col("a.price"), F.lit(0.0)) - F.coalesce(F.col("d.price"), F.lit(0.0))) < change)
    return listings.alias("a").join(growing(done.alias("d")), same, "left_anti")


def unique_matches(listings: DataFrame, sales: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Listings at whose place, told by the keys, exactly one sale is known: all their columns, value and ratio of the price to it."""
    single = sales.groupBy(*keys).agg(F.count("*").alias("__n"), F.max(value).alias("__value")).where("__n = 1").drop("__n")
    return listings.join(growing(single), keys).select(*listings.columns, F.col("__value").alias("value"), F.try_divide("price", "__value").alias("ratio"))
