"""Regional prices, price indices, cadastre and statutory values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.address import postal_code
from ..storage import materialized

# Months that an index may be carried on, and how pure a street's postal code must be.
MONTHS_BACK, LEAST_SALES, LEAST_SHARE = 24, 3, 0.60
# Fixed value: how a lot's price by area falls with its size.
ELASTICITY = -0.662
#: Bins that a group's values are cut into at once, and rows that a task ranks for a group.
BINS, SMALL = 1024, 10_000


def floor_quantile(values: Column, q: float) -> Column:
    """The value at place floor(q * n), from 0, of the sorted values; for groups of bounded size."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.least(F.floor(F.size(ordered) * F.lit(q)).cast("int"), F.size(ordered) - 1))


def upper_median(values: Column) -> Column:
    return floor_quantile(values, 0.5)


def placed_values(df: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, n and, under each name, the value at a place (from 0, of n) of each group's sorted values. Nulls and NaN don't count.

    Small groups are sorted, each in a task. No other group is, whatever its size and the range of its values: between a group's
    least and largest value lie BINS bins, whose rows are counted once for all places; the bin that holds a place is cut into
    bins in the same way, between its own least and largest value, until few rows or one value are left of it, and only these
    are ranked. There is a large group for SMALL rows at most, so large groups are broadcast and rows are never shuffled by them.
    """
    x = F.col("__x")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).alias("__value"), F.greatest(F.least(F.col(value).cast("double"), F.lit(1.7e308)), F.lit(-1.7e308)).alias("__x"))
    large = materialized(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi")).where(F.col("n") > SMALL))

    def meet(left: DataFrame, right: DataFrame, on: list[str], more: Column | None = None, how: str = "inner") -> DataFrame:
        """left with the columns of right that aren't in on; nulls are equal. Only right is broadcast."""
        named = right.select(*[F.col(c).alias(f"__of_{c}") if c in on else F.col(c) for c in right.columns])
        met = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in on] + ([] if more is None else [more])
        found = left.join(F.broadcast(named), reduce(lambda a, b: a & b, met, F.lit(True)) if met else None, how)
        return found.drop(*[f"__of_{c}" for c in on])

    any_large = not large.isEmpty()
    group = Window.partitionBy(*keys)
    few = (meet(rows, large.select(*keys), keys, how="left_anti") if keys else rows.limit(0)) if any_large else rows
    few = few.withColumns({"n": F.count("*").over(group), "__at": (F.row_number().over(group.orderBy("__value")) - 1).cast("long")})  # SMALL rows a group
    at = {name: F.col("__at") == place(F.col("n")).cast("long") for name, place in places.items()}
    ranked = few.where(reduce(lambda a, b: a | b, at.values())).groupBy(*keys, "n").agg(*[F.min(F.when(here, F.col("__value"))).alias(name) for name, here in at.items()])
    if not any_large:
        return ranked

    names = F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("n")).cast("long").alias("place")) for name, place in places.items()])
    state = large.select(*keys, "n", F.col("n").alias("__in"), "__lo", "__hi", F.explode(names).alias("__w")).select(*keys, "n", "__in", "__lo", "__hi", F.col("__w.name").alias("__name"), F.col("__w.place").alias("__rest"))
    state = materialized(state.where("__rest >= 0 and __rest < n"))
    bounds = [*keys, "__lo", "__hi"]

    def inside(of: DataFrame) -> DataFrame:
        """The rows between bounds, which are those of one place or several of the group, and otherwise have no rows in common."""
        return meet(rows, of.select(*bounds).distinct(), keys, x.between(F.col("__lo"), F.col("__hi")))

    wide = (F.col("__in") > SMALL) & (F.col("__lo") < F.col("__hi"))
    while not state.where(wide).isEmpty():
        share = (x / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2)
        bins = inside(state.where(wide)).withColumn("__bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int"))
        counts = bins.groupBy(*bounds, "__bin").agg(F.count("*").alias("__k"), F.min("__x").alias("__least"), F.max("__x").alias("__most"))
        counts = counts.withColumn("__upto", F.sum("__k").over(Window.partitionBy(*bounds).orderBy("__bin")))  # BINS rows
        chosen = meet(counts, state.where(wide), bounds).where((F.col("__rest") < F.col("__upto")) & (F.col("__rest") >= F.col("__upto") - F.col("__k")))
        chosen = chosen.select(*keys, "n", F.col("__k").alias("__in"), F.col("__least").alias("__lo"), F.col("__most").alias("__hi"), "__name", (F.col("__rest") - F.col("__upto") + F.col("__k")).alias("__rest"))
        state = materialized(state.where(~wide).unionByName(chosen.select(*state.columns)))
    values = inside(state).groupBy(*bounds, "__value").agg(F.count("*").alias("__k"))
    values = values.withColumn("__upto", F.sum("__k").over(Window.partitionBy(*bounds).orderBy("__value")))  # SMALL rows, or one
    chosen = meet(values, state, bounds).where((F.col("__rest") < F.col("__upto")) & (F.col("__rest") >= F.col("__upto") - F.col("__k")))
    found = chosen.groupBy(*keys, "n").agg(*[F.min(F.when(F.col("__name") == name, F.col("__value"))).alias(name) for name in places])
    return ranked.unionByName(found) if keys else found


def percentiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """keys, n and quantiles between the two nearest values, as ``percentile`` gives them, of groups of any size."""
    places: dict[str, Callable[[Column], Column]] = {}
    for name, q in quantiles.items():
        places |= {f"{name}__0": lambda n, q=q: F.floor((n - 1) * F.lit(q)), f"{name}__1": lambda n, q=q: F.ceil((n - 1) * F.lit(q))}
    found = placed_values(df, keys, value, places)

    def between(name: str, q: float) -> Column:
        low, high, at = F.col(f"{name}__0").cast("double"), F.col(f"{name}__1").cast("double"), (F.col("n") - 1) * F.lit(q)
        return F.when(low == high, low).otherwise(low * (F.ceil(at) - at) + high * (at - F.floor(at))).alias(name)

    return found.select(*keys, "n", *[between(name, q) for name, q in quantiles.items()])


def ranked_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """keys, n and floor-rank quantiles of groups of any size."""

    def at(q: float) -> Callable[[Column], Column]:
        return lambda n: F.least(F.floor(n * F.lit(q)), n - 1)

    return placed_values(df, keys, value, {name: at(q) for name, q in quantiles.items()})


def region_levels(df: DataFrame, levels: list[tuple[str, Column]]) -> DataFrame:
    """A row for each level of a row's region: level, region. One pass: Catalyst expands rows, as in a rollup."""
    pairs = F.array(*[F.struct(F.lit(name).alias("level"), key.cast("string").alias("region")) for name, key in levels])
    return df.select("*", F.explode(pairs).alias("__r")).select(*df.columns, "__r.level", "__r.region")


def region_prices(df: DataFrame, levels: list[tuple[str, Column]], value: str, least: dict[str, int]) -> DataFrame:
    """level, region, n, median, p25, p75 where a level's region has enough rows."""
    places = {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2), "p25": lambda n: F.least(F.floor(n * 0.25), n - 1), "p75": lambda n: F.least(F.floor(n * 0.75), n - 1)}
    found = placed_values(region_levels(df, levels), ["level", "region"], value, places)
    needed = F.element_at(F.create_map(*[F.lit(x) for kv in least.items() for x in kv]), F.col("level"))
    return found.where(F.col("n") >= needed).select("level", "region", "n", ((F.col("low") + F.col("high")) / 2).alias("median"), "p25", "p75")


def finest(df: DataFrame, prices: DataFrame, levels: list[tuple[str, Column]], key: str, columns: list[str]) -> DataFrame:
    """Each row with ``found``, a struct of level, region and the columns of prices at the first of its levels that has them; null where none has.

    prices are grouped rows, so Spark broadcasts them where they are small.
    """
    order = {name: i for i, (name, _) in enumerate(levels)}
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("level"))
    own = region_levels(df, levels).select(key, "level", "region").join(prices, ["level", "region"])
    best = own.groupBy(key).agg(F.min_by(F.struct("level", "region", *columns), rank).alias("found"))
    return df.join(best, key, "left").select(*df.columns, "found")


def finest_region(df: DataFrame, prices: DataFrame, levels: list[tuple[str, Column]], key: str) -> DataFrame:
    """Each row's price at the first of its levels that has one; null where none has."""
    return finest(df, prices, levels, key, ["median"]).select(*df.columns, F.col("found.level").alias("level"), F.col("found.median").alias("unit_price"))


def is_land(complement: Column) -> Column:
    """A record without a complement is a lot, not a unit of a larger building."""
    return F.trim(F.coalesce(complement, F.lit(""))) == ""


def house_values(houses: DataFrame, land: DataFrame, building: DataFrame, levels: list[tuple[str, Column]], key: str, slope: float = ELASTICITY) -> DataFrame:
    """Houses with land_region, building_region, land_price, land_value, building_value, value, land_share; null where a price is missing.

    houses: key, land, built, and what the levels are made of. land: level, region, median, ref (the region's median lot).
    building: level, region, median. A lot's price by area falls with its size: it is the region's, times (land / ref) ** slope.
    """
    found = finest(houses, land, levels, key, ["median", "ref"]).withColumnRenamed("found", "__land")
    both = finest(found, building, levels, key, ["median"]).withColumnRenamed("found", "__building")
    sized = (F.col("__land.ref") > 0) & (F.col("land") > 0)
    price = F.when(sized, F.col("__land.median") * F.pow(F.col("land") / F.col("__land.ref"), F.lit(slope))).otherwise(F.col("__land.median"))
    known = F.col("__land").isNotNull() & F.col("__building").isNotNull()
    valued = both.select(*houses.columns, F.when(known, F.col("__land.level")).alias("land_level"), F.when(known, F.col("__building.level")).alias("building_level"), F.when(known, price).alias("land_price"), F.when(known, F.col("__building.median")).alias("building_price"))
    valued = valued.withColumns({"land_value": F.col("land") * F.col("land_price"), "building_value": F.col("built") * F.col("building_price")}).withColumn("value", F.col("land_value") + F.col("building_value"))
    return valued.withColumn("land_share", F.coalesce(F.try_divide(100 * F.col("land_value"), F.col("value")), F.when(F.col("value").isNotNull(), 0.0)))


def plausible_residual(value: Column, land: Column, land_price: Column, ref: Column, built: Column, slope: float = ELASTICITY, least: float = 40.0) -> Column:
    """What a square metre of building cost beyond land in a sale; null where it isn't plausible."""
    residual = F.try_divide(value - land * land_price * F.pow(land / ref, F.lit(slope)), built)
    return F.when(residual > least, residual)


def building_prices(sales: DataFrame, land: DataFrame, region: str, least: int = 8) -> DataFrame:
    """region, n, residual (median), p25 of what buildings cost beyond land. sales: region, value, area, built. land: region, price, ref."""
    priced = sales.join(land, region).withColumn("residual", plausible_residual(F.col("value"), F.col("area"), F.col("price"), F.col("ref"), F.col("built")))
    places = {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2), "p25": lambda n: F.least(F.floor(n * 0.25), n - 1)}
    return placed_values(priced, [region], "residual", places).where(F.col("n") >= least).select(region, "n", ((F.col("low") + F.col("high")) / 2).alias("residual"), "p25")


def validation(rows: DataFrame, estimate: str, actual: str) -> DataFrame:
    """One row: n, median and quartiles of estimate / actual, the shares within 20 and 30 percent, and the median error."""
    r = F.col("r")
    ratios = materialized(rows.select(F.try_divide(F.col(estimate), F.col(actual)).alias("r")).where("r is not null").withColumn("error", F.abs(r - 1)))
    near = ratios.agg(*[F.avg((F.col("error") <= x).cast("int")).alias(name) for name, x in (("within20", 0.2), ("within30", 0.3))])
    quartiles, error = percentiles(ratios, [], "r", {"median": 0.5, "q1": 0.25, "q3": 0.75}), percentiles(ratios, [], "error", {"median_error": 0.5}).drop("n")
    return quartiles.crossJoin(F.broadcast(near)).crossJoin(F.broadcast(error))  # one row each


def dispersion(df: DataFrame, region: str, year: str, value: str, least: int = 2) -> DataFrame:
    """n regions with at least ``least`` years, and the median over them of how far a year's median lies from the region's, relative to it."""
    by_year = materialized(percentiles(df, [region, year], value, {"m": 0.5}).drop("n"))
    # A region has a row for each year: its medians are of bounded groups.
    whole = by_year.groupBy(region).agg(F.median("m").alias("mm"), F.count("*").alias("years")).where(F.col("years") >= least)
    spread = by_year.join(whole, region).groupBy(region, "mm").agg((F.median(F.abs(F.col("m") - F.col("mm"))) / F.col("mm")).alias("spread"))
    return percentiles(spread, [], "spread", {"spread": 0.5}).select("n", "spread")


def index_errors(pairs: DataFrame, levels: DataFrame, day: str, unit: str) -> DataFrame:
    """One row: n pairs, and of the logarithm of the carried over the real price, without an index and with one, the median error, the median (bias) and the mean error.

    pairs: structs a and b with ``day`` and ``unit``. levels: month ('yyyyMM'), level; pairs of months without one don't count.
    """
    month = lambda side: F.date_format(f"{side}.{day}", "yyyyMM")
    level = lambda n: levels.select(F.col("month").alias(f"month{n}"), F.col("level").alias(f"level{n}"))
    moved = F.log(F.col(f"b.{unit}") / F.col(f"a.{unit}"))
    rows = pairs.select(moved.alias("moved"), month("a").alias("month0"), month("b").alias("month1")).join(level(0), "month0").join(level(1), "month1")
    none, index = -F.col("moved"), F.log(F.col("level1") / F.col("level0")) - F.col("moved")
    kinds = {"none_error": F.abs(none), "none_bias": none, "index_error": F.abs(index), "index_bias": index}
    errors = materialized(rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("x")) for k, x in kinds.items()])).alias("e")).select("e.*"))
    by_kind = percentiles(errors, ["kind"], "x", {"median": 0.5}).join(errors.groupBy("kind").agg(F.avg("x").alias("mean")), "kind")
    of = lambda kind, what: F.max(F.when(F.col("kind") == kind, F.col(what)))
    return by_kind.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[of(k, "median").alias(k) for k in kinds], of("none_error", "mean").alias("none_mean"), of("index_error", "mean").alias("index_mean"))


def effective_codes(listings: DataFrame, streets: DataFrame, least: int = LEAST_SALES) -> DataFrame:
    """Listings with code and origin: their own postal code ('anuncio'), else the street's, of five digits and zeros ('rua'), else empty.

    listings: street, raw_code. streets: street, code5, n; a street counts from ``least`` sales on.
    """
    known = streets.where((F.col("n") >= least) & (F.col("code5") != "")).select("street", "code5")
    own = postal_code(F.col("raw_code"))
    joined = listings.join(known, "street", "left")
    code = F.when(own != "", own).when(F.col("code5").isNotNull(), F.rpad("code5", 8, "0")).otherwise("")
    return joined.select(*listings.columns, code.alias("code"), F.when(own != "", "anuncio").when(F.col("code5").isNotNull(), "rua").otherwise("").alias("origin"))


def lots_of_code(listings: DataFrame, lots: DataFrame) -> DataFrame:
    """url, number, code: the lots of a listing's street that share its postal code in eight digits, else in five, else all.

    listings: url, street, raw_code. lots: street, number, code (null where the register has none).
    """
    digits = F.regexp_replace(F.coalesce("raw_code", F.lit("")), r"\D", "")
    pairs = listings.select("url", "street", digits.alias("__own")).join(lots, "street")
    some = (F.length("__own") >= 5) & F.col("code").isNotNull() & (F.col("code") != "")
    alike = lambda k: some & (F.substring("code", 1, k) == F.substring("__own", 1, k))
    matched = pairs.withColumn("__alike", F.when(alike(8), 8).when(alike(5), 5).otherwise(0))
    best = matched.groupBy("url").agg(F.max("__alike").alias("__best"))
    return matched.join(best, "url").where("__alike = __best").select("url", "number", "code")


def year_series(df: DataFrame, year: str, value: str, least: int) -> DataFrame:
    """year, n, median, and index against the first year with enough rows."""
    by_year = materialized(percentiles(df, [year], value, {"median": 0.5}).where(F.col("n") >= least))
    base = by_year.agg(F.min_by("median", year).alias("base"))
    return by_year.crossJoin(F.broadcast(base)).select(year, "n", "median", F.try_divide("median", "base").alias("index"))  # one row


def dominant(df: DataFrame, key: str, part: str, weight: str, least: int = LEAST_SALES, share: float = LEAST_SHARE) -> DataFrame:
    """key, part, n (of the part), total, share: the part with most weight, the smallest of equal ones, if it has enough of the key's total."""
    sums = df.where(F.col(part).isNotNull()).groupBy(key, part).agg(F.sum(weight).alias("n"))
    best = sums.groupBy(key).agg(F.min_by(F.struct(part, "n"), F.struct(-F.col("n"), part)).alias("best"), F.sum("n").alias("total"))
    out = best.select(key, F.col(f"best.{part}").alias(part), F.col("best.n").alias("n"), "total", (F.col("best.n") / F.col("total")).alias("share"))
    return out.where((F.col("total") >= least) & (F.col("share") >= share))


def elasticity(df: DataFrame, area: str, unit: str, seed: float = ELASTICITY, least: int = 300) -> DataFrame:
    """slope, intercept, r2, n of ln(unit) on ln(area); below ``least`` rows the seed, with the mean as intercept."""
    logs = df.where((F.col(area) > 0) & (F.col(unit) > 0)).select(F.log(area).alias("x"), F.log(unit).alias("y"))
    fit = logs.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("k"), F.regr_r2("y", "x").alias("r2"), F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    enough = F.col("n") >= least
    return fit.select(F.when(enough, F.col("b")).otherwise(seed).alias("slope"), F.when(enough, F.col("k")).otherwise(F.col("my") - seed * F.col("mx")).alias("intercept"), "r2", "n")


def weighted_fit(df: DataFrame, y: str, x: list[str], weight: str) -> list[float]:
    """Weighted least squares by normal equations: all sums in one aggregation, a small system on the driver."""
    import numpy as np

    cells = {f"a{i}_{j}": F.sum(F.col(weight) * F.col(p) * F.col(q)) for i, p in enumerate(x) for j, q in enumerate(x)}
    cells |= {f"b{i}": F.sum(F.col(weight) * F.col(p) * F.col(y)) for i, p in enumerate(x)}
    row = df.agg(*[c.alias(n) for n, c in cells.items()]).first()
    a = np.array([[row[f"a{i}_{j}"] or 0.0 for j in range(len(x))] for i in range(len(x))])
    return np.linalg.lstsq(a, np.array([row[f"b{i}"] or 0.0 for i in range(len(x))]), rcond=None)[0].tolist()


def chained_index(monthly: DataFrame, month: str, percent: str, base: float = 100.0) -> DataFrame:
    """Monthly percentages as a level: the running product, as a running sum of logarithms. One series has a few hundred rows."""
    so_far = Window.orderBy(month).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return monthly.select(month, percent, (F.exp(F.sum(F.log1p(F.col(percent) / 100)).over(so_far)) * base).alias("level"))


def carried_index(index: DataFrame, first: str, last: str, back: int = MONTHS_BACK) -> DataFrame:
    """index: month ('yyyyMM'), level. Every month from first to last with the level of the nearest month at or before it, up to ``back`` months."""
    spark = index.sparkSession
    calendar = spark.sql(f"select date_format(m, 'yyyyMM') as month, m from (select explode(sequence(to_date('{first}01', 'yyyyMMdd'), to_date('{last}01', 'yyyyMMdd'), interval 1 month)) as m)")
    known = index.select(F.col("month").alias("known"), "level")
    dense = calendar.join(known, F.col("month") == F.col("known"), "left").withColumn("at", F.when(F.col("level").isNotNull(), F.col("m")))
    before = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a month
    filled = dense.select("month", "m", F.last("level", ignorenulls=True).over(before).alias("level"), F.last("at", ignorenulls=True).over(before).alias("at"))
    return filled.where(F.months_between("m", "at") <= back).select("month", "level")


def index_factor(dated: DataFrame, month: str, index: DataFrame, first: str, last: str, back: int = MONTHS_BACK) -> DataFrame:
    """Rows with factor: the index's last level over that of the row's month; 1 where the index doesn't reach."""
    latest = index.agg(F.max_by("level", "month").alias("latest"))
    levels = carried_index(index, first, last, back).crossJoin(F.broadcast(latest)).select(F.col("month").alias("__m"), F.try_divide("latest", "level").alias("__f"))
    return dated.join(levels, F.col(month) == F.col("__m"), "left").select(*dated.columns, F.coalesce("__f", F.lit(1.0)).alias("factor"))


def plausible_medians(lots: DataFrame, keys: list[str], least: int = 3, most_area: float = 1000.0, least_area: float = 10.0) -> DataFrame:
    """Medians of plausible areas by street or block, number of lots and share of houses. A null area doesn't count against a lot."""
    fits = (F.col("built").isNull() | F.col("built").between(least_area, most_area)) & (F.col("land").isNull() | (F.col("land") >= least_area))
    return lots.groupBy(*keys).agg(
        F.median(F.when(fits & F.col("is_house"), F.col("built"))).alias("built"), F.median(F.when(fits & F.col("is_house"), F.col("land"))).alias("land"),
        F.count(F.when(fits & F.col("is_house"), 1)).alias("n"), F.avg(F.col("is_house").cast("double")).alias("house_share"),
    ).where(F.col("n") >= least)


def exact_lot(listings: DataFrame, lots: DataFrame) -> DataFrame:
    """url and the lot at the listing's street and number whose built area is nearest, the smallest lot_id of equal ones; not below half or above twice the listed area."""
    near = lots.select("street", "number", "lot_id", F.col("built").alias("lot_built"), F.col("land").alias("lot_land"))
    found = listings.select("url", "street", "number", "area").join(near, ["street", "number"])
    best = found.groupBy("url", "area").agg(F.min_by(F.struct("lot_id", "lot_built", "lot_land"), F.struct(F.abs(F.col("lot_built") - F.col("area")), "lot_id")).alias("lot"))
    kept = F.try_divide("lot.lot_built", "area").between(0.5, 2.0)
    return best.where(kept).select("url", "lot.*")


def official_areas(listings: DataFrame, lots: DataFrame, streets: DataFrame, blocks: DataFrame) -> DataFrame:
    """url, level (lote, rua, quadra or null), official_built, official_land: the first level that knows the listing."""
    lot = exact_lot(listings, lots).select("url", "lot_built", "lot_land")
    street = streets.select("street", F.col("built").alias("street_built"), F.col("land").alias("street_land"))
    block = blocks.select("block", F.col("built").alias("block_built"), F.col("land").alias("block_land"))
    all_three = listings.select("url", "street", "block", "area").join(lot, "url", "left").join(street, "street", "left").join(block, "block", "left")
    level = F.when(F.col("lot_built").isNotNull(), "lote").when(F.col("street_built").isNotNull(), "rua").when(F.col("block_built").isNotNull(), "quadra")
    pick = lambda x: F.when(level == "lote", F.col(f"lot_{x}")).when(level == "rua", F.col(f"street_{x}")).when(level == "quadra", F.col(f"block_{x}"))
    return all_three.select("url", "area", level.alias("level"), pick("built").alias("official_built"), pick("land").alias("official_land"))


def similar_houses(listings: DataFrame, houses: DataFrame, tolerance: float = 0.25, least: int = 5) -> DataFrame:
    """url, n, land_value, building_value: medians over houses of the street of like area, both ends included, where there are enough."""
    alike = (F.col("h.street") == F.col("a.street")) & F.col("h.area").between(F.col("a.area") * (1 - tolerance), F.col("a.area") * (1 + tolerance))
    found = listings.alias("a").join(houses.alias("h"), alike)
    return found.groupBy(F.col("a.url").alias("url")).agg(F.count("*").alias("n"), F.median("h.land_value").alias("land_value"), F.median("h.building_value").alias("building_value")).where(F.col("n") >= least)
