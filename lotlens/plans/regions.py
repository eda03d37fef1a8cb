"""Regional prices, indices, cadastre and statutory values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as s
from ..operators import pairs as pr
from ..operators import valuation as val
from ..sources import views as v
from ..storage import growing
from .registry import query

#: Customers' regions, finest first: customer group, nation, region, all.
def levels() -> list[tuple[str, Column]]:
    return [("cep5", F.expr("custkey div 4")), ("cep4", F.col("nation")), ("cep3", F.col("zone")), ("city", F.lit("city"))]


LEAST = {"cep5": 40, "cep4": 8, "cep3": 8, "city": 1}

PRICED = """priced AS (SELECT o_orderkey AS id, o_totalprice AS price, c_custkey AS custkey, c_nationkey AS nation, n_regionkey AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
levels AS (SELECT *, 'cep5' AS level, (custkey // 4)::VARCHAR AS key FROM priced UNION ALL SELECT *, 'cep4', nation::VARCHAR FROM priced UNION ALL SELECT *, 'cep3', region::VARCHAR FROM priced UNION ALL SELECT *, 'city', 'city' FROM priced),
prices AS (SELECT level, key AS region, count(*) AS n, median(price) AS median, list_sort(list(price))[floor(0.25 * count(*))::INT + 1] AS p25, list_sort(list(price))[least(floor(0.75 * count(*))::INT, count(*) - 1) + 1] AS p75
  FROM levels GROUP BY level, key HAVING count(*) >= CASE level WHEN 'cep5' THEN 40 WHEN 'city' THEN 1 ELSE 8 END)"""


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (v.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return joined.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))


def regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return val.region_prices(priced(spark, sf_dir).withColumnRenamed("region", "zone"), levels(), "price", LEAST)


@query("region_medians", f"WITH {PRICED} SELECT level, region, n, round(median, 4) AS median, p25, p75 FROM prices")
def region_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regional(spark, sf_dir).select("level", "region", "n", F.round("median", 4).alias("median"), "p25", "p75")


@query("region_cascade_lookup", f"""WITH {PRICED}, c AS (SELECT c_custkey AS custkey, c_nationkey AS nation, n_regionkey AS zone FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT custkey, coalesce(CASE WHEN a.median IS NOT NULL THEN 'cep5' END, CASE WHEN b.median IS NOT NULL THEN 'cep4' END, CASE WHEN d.median IS NOT NULL THEN 'cep3' END, 'city') AS level, round(coalesce(a.median, b.median, d.median, e.median), 4) AS unit_price
FROM c LEFT JOIN prices a ON a.level = 'cep5' AND a.region = (custkey // 4)::VARCHAR LEFT JOIN prices b ON b.level = 'cep4' AND b.region = nation::VARCHAR LEFT JOIN prices d ON d.level = 'cep3' AND d.region = zone::VARCHAR LEFT JOIN prices e ON e.level = 'city'""")
def region_cascade_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = v.table(spark, sf_dir, "customer"), v.table(spark, sf_dir, "nation")
    who = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nation"), F.col("n_regionkey").alias("zone"))
    found = val.finest_region(who, regional(spark, sf_dir), levels(), "custkey")
    return found.select("custkey", "level", F.round("unit_price", 4).alias("unit_price"))


_UNITS = f"WITH {v.SALE}, {v.USABLE}, u AS (SELECT *, value / area AS unit, year(sold) AS y FROM usable)"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.comparables import usable

    return usable(v.sales(spark, sf_dir), least_area=1.0).withColumns({"unit": F.col("value") / F.col("area"), "y": F.year("sold")})


@query("elasticity_ols", f"{_UNITS} SELECT round(regr_slope(ln(unit), ln(area)), 6) AS slope, round(regr_intercept(ln(unit), ln(area)), 6) AS intercept, round(regr_r2(ln(unit), ln(area)), 6) AS r2, count(*) AS n FROM u")
def elasticity_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return val.elasticity(units(spark, sf_dir), "area", "unit").select(*[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")], "n")


@query("year_series", f"""{_UNITS}, m AS (SELECT y AS year, count(*) AS n, median(unit) AS median FROM u GROUP BY y HAVING count(*) >= 100)
SELECT year::INT AS year, n, round(median, 4) AS median, round(median / (SELECT arg_min(median, year) FROM m), 6) AS index FROM m""")
def year_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = val.year_series(units(spark, sf_dir).withColumnRenamed("y", "year"), "year", "unit", 100)
    return out.select("year", "n", F.round("median", 4).alias("median"), F.round("index", 6).alias("index"))


@query("residual_model", f"""{_UNITS}, land AS (SELECT street % 50 AS zone, median(unit) AS price, median(area) AS ref FROM u WHERE area >= 5 AND area < 30 GROUP BY zone HAVING count(*) >= 12),
r AS (SELECT zone, (value - area * price * pow(area / ref, -0.662)) / area AS residual FROM u JOIN land ON street % 50 = zone WHERE area >= 30 AND y >= 1996)
SELECT zone::BIGINT AS zone, count(*) AS n, round(median(residual), 4) AS residual, list_sort(list(round(residual, 4)))[floor(0.25 * count(*))::INT + 1] AS p25 FROM r WHERE residual > 40 GROUP BY zone HAVING count(*) >= 8""")
def residual_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What buildings cost beyond land: sales of small areas give a region's land price, larger ones the rest."""
    u = units(spark, sf_dir).withColumn("zone", F.col("street") % 50)
    small = u.where("area >= 5 and area < 30")
    price, ref = (val.percentiles(small, ["zone"], of, {name: 0.5}).where("n >= 12").drop("n") for of, name in (("unit", "price"), ("area", "ref")))
    land = price.join(ref, "zone")
    sold = u.where("area >= 30 and y >= 1996").withColumn("built", F.col("area"))
    return val.building_prices(sold, land, "zone").select("zone", "n", F.round("residual", 4).alias("residual"), F.round("p25", 4).alias("p25"))


@query("model_validation", f"""{_UNITS}, fit AS (SELECT street % 50 AS zone, median(unit) AS price FROM u WHERE y < 2000 GROUP BY zone), t AS (SELECT price / unit AS r FROM u JOIN fit ON street % 50 = zone WHERE y >= 2000)
SELECT count(*) AS n, round(median(r), 6) AS median, round(quantile_cont(r, 0.25), 6) AS q1, round(quantile_cont(r, 0.75), 6) AS q3, round(avg((abs(r - 1) <= 0.2)::INT), 6) AS within20, round(avg((abs(r - 1) <= 0.3)::INT), 6) AS within30, round(median(abs(r - 1)), 6) AS median_error FROM t""")
def model_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit before a year, tested from it on."""
    u = units(spark, sf_dir).withColumn("zone", F.col("street") % 50)
    fit = val.percentiles(u.where("y < 2000"), ["zone"], "unit", {"price": 0.5}).drop("n")
    found = val.validation(u.where("y >= 2000").join(fit, "zone"), "price", "unit")
    return found.select("n", *[F.round(c, 6).alias(c) for c in found.columns if c != "n"])


@query("ratio_region", f"""WITH {PRICED}, r AS (SELECT (custkey // 4)::VARCHAR AS region, price / (1000 + 10 * (id % 1000)) AS ratio FROM priced WHERE price / (1000 + 10 * (id % 1000)) > 0.05 AND price / (1000 + 10 * (id % 1000)) < 20)
SELECT region, count(*) AS n, round(list_sort(list(ratio))[floor(count(*) / 2)::INT + 1], 6) AS ratio, round(list_sort(list(ratio))[floor(0.25 * count(*))::INT + 1], 6) AS p25, round(list_sort(list(ratio))[floor(0.75 * count(*))::INT + 1], 6) AS p75 FROM r GROUP BY region HAVING count(*) >= 15""")
def ratio_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper medians of a ratio by region."""
    r = priced(spark, sf_dir).select(F.expr("cast(custkey div 4 as string)").alias("zone"), (F.col("price") / (1000 + 10 * (F.col("id") % 1000))).alias("ratio")).where("ratio > 0.05 and ratio < 20")
    out = val.ranked_quantiles(r, ["zone"], "ratio", {"ratio": 0.5, "p25": 0.25, "p75": 0.75}).where("n >= 15")
    return out.select(F.col("zone").alias("region"), "n", *[F.round(c, 6).alias(c) for c in ("ratio", "p25", "p75")])


@query("dominant_region_per_key", """WITH s AS (SELECT l_partkey AS key, l_suppkey % 3 AS part, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT key, sum(n)::BIGINT AS total, arg_min(part, ROW(-n, part)) AS part, max(n) AS n FROM s GROUP BY key)
SELECT key, part, n, total, round(n / total, 6) AS share FROM t WHERE total >= 3 AND n / total >= 0.6""")
def dominant_region_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_suppkey") % 3).alias("part"), F.lit(1).cast("long").alias("one"))
    return val.dominant(rows, "key", "part", "one").withColumn("share", F.round("share", 6))


MONTHLY = "monthly AS (SELECT strftime(l_shipdate, '%Y%m') AS month, (count(*) % 17 - 8) / 10.0::DOUBLE AS pct FROM lineitem GROUP BY month)"
CHAIN = f"{MONTHLY}, chain AS (SELECT month, pct, exp(sum(ln(1 + pct / 100)) OVER (ORDER BY month)) * 100 AS level FROM monthly)"


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyyMM").alias("month")).agg(F.count("*").alias("k"))
    return rows.select("month", ((F.col("k") % 17 - 8) / 10.0).alias("pct"))


@query("index_chain", f"WITH {CHAIN} SELECT month, pct, round(level, 6) AS level FROM chain")
def index_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return val.chained_index(monthly(spark, sf_dir), "month", "pct").withColumn("level", F.round("level", 6))


@query("index_asof_factor", f"""WITH {CHAIN}, holes AS (SELECT month, level FROM chain WHERE month::INT % 4 <> 2), d AS (SELECT DISTINCT strftime(l_shipdate, '%Y%m') AS month FROM lineitem UNION SELECT unnest(['199001', '199406', '200312', '200401']))
SELECT d.month, round(CASE WHEN h.level IS NOT NULL AND date_diff('month', strptime(h.month || '01', '%Y%m%d'), strptime(d.month || '01', '%Y%m%d')) <= 24 THEN (SELECT arg_max(level, month) FROM holes) / h.level ELSE 1.0 END, 6) AS factor
FROM d ASOF LEFT JOIN holes h ON d.month >= h.month""")
def index_asof_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = val.chained_index(monthly(spark, sf_dir), "month", "pct").where("cast(month as int) % 4 <> 2").select("month", "level")
    months = v.table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyyMM").alias("month")).unionByName(spark.createDataFrame([("199001",), ("199406",), ("200312",), ("200401",)], "month string")).distinct()
    return val.index_factor(months, "month", holes, "199001", "200412").withColumn("factor", F.round("factor", 6))


@query("index_backtest", f"""{_UNITS}, {CHAIN}, lvl AS (SELECT month, level FROM chain),
e AS (SELECT *, year(sold) * 12 + month(sold) AS mon, floor(ln(area) / ln(1.3))::BIGINT AS band FROM u WHERE area > 0),
c AS (SELECT *, row_number() OVER (PARTITION BY street, mon, band ORDER BY orderkey, number, suppkey, area, value) - 1 AS place, count(*) OVER (PARTITION BY street, mon, band) AS k FROM e),
g AS (SELECT street, mon, band, any_value(k) AS k FROM c GROUP BY ALL),
w AS (SELECT a.street, a.mon AS m0, a.band AS b0, b.mon AS m1, b.band AS b1, b.k AS k1, sum(a.k * b.k) OVER (PARTITION BY a.street ORDER BY a.mon, a.band, b.mon, b.band) - a.k * b.k AS start, sum(a.k * b.k) OVER (PARTITION BY a.street) AS total
  FROM g a JOIN g b ON a.street = b.street AND abs(a.band - b.band) <= 1 AND b.mon - a.mon >= 24),
p AS (SELECT a.street, ln(b.unit / a.unit) AS moved, ln(b.area / a.area) AS size, strftime(a.sold, '%Y%m') AS ma, strftime(b.sold, '%Y%m') AS mb, ((start + a.place * k1 + b.place)::HUGEINT * 2305843009213693951 % total) AS turn
  FROM w JOIN c a ON a.street = w.street AND a.mon = m0 AND a.band = b0 JOIN c b ON b.street = w.street AND b.mon = m1 AND b.band = b1 WHERE abs(ln(b.area / a.area)) <= ln(1.3)),
k AS (SELECT *, row_number() OVER (PARTITION BY street ORDER BY turn) AS place FROM p),
x AS (SELECT moved, ln(lb.level / la.level) - moved AS indexed FROM k JOIN lvl la ON la.month = ma JOIN lvl lb ON lb.month = mb WHERE place <= 150)
SELECT count(*) AS n, round(median(abs(moved)), 6) AS none_error, round(median(-moved), 6) AS none_bias, round(avg(abs(moved)), 6) AS none_mean, round(median(abs(indexed)), 6) AS index_error, round(median(indexed), 6) AS index_bias, round(avg(abs(indexed)), 6) AS index_mean FROM x""")
def index_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far an index carries a sale's unit price to that of a later sale of the street, against no index: pairs of months, 150 a street at most."""
    u = units(spark, sf_dir).select("street", "sold", "area", "unit", "orderkey", "number", "suppkey", "value")
    pairs = pr.drawn_pairs(u, "street", "sold", "area", ["orderkey", "number", "suppkey", "area", "value"])
    levels = val.chained_index(monthly(spark, sf_dir), "month", "pct").select("month", "level")
    return val.index_errors(pairs, levels, "sold", "unit").select("n", *[F.round(c, 6).alias(c) for c in ("none_error", "none_bias", "none_mean", "index_error", "index_bias", "index_mean")])


LOT = """lot AS (SELECT l_partkey AS street, l_partkey // 20 AS block, l_linenumber AS number, l_orderkey * 10 + l_linenumber AS lot_id, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_quantity END AS built, CASE WHEN l_discount > 0.09 THEN NULL ELSE l_quantity * (1 + l_suppkey % 3) END AS land, l_returnflag <> 'N' AS is_house FROM lineitem)"""
AREAS = f"""WITH {v.AD}, {LOT},
fit AS (SELECT *, (built IS NULL OR built BETWEEN 10 AND 1000) AND (land IS NULL OR land >= 10) AND is_house AS ok FROM lot),
street_ref AS (SELECT street, median(built) FILTER (ok) AS built, median(land) FILTER (ok) AS land, count(*) FILTER (ok) AS n, avg(is_house::INT) AS share FROM fit GROUP BY street HAVING count(*) FILTER (ok) >= 3),
block_ref AS (SELECT block, median(built) FILTER (ok) AS built, median(land) FILTER (ok) AS land, count(*) FILTER (ok) AS n, avg(is_house::INT) AS share FROM fit GROUP BY block HAVING count(*) FILTER (ok) >= 3),
cand AS (SELECT ad.url, ad.area, arg_min(ROW(lot.lot_id, lot.built, lot.land), ROW(abs(lot.built - ad.area), lot.lot_id)) FILTER (lot.built IS NOT NULL) AS l FROM ad JOIN lot USING (street, number) GROUP BY ad.url, ad.area),
exact AS (SELECT url, l[2] AS built, l[3] AS land FROM cand WHERE area > 0 AND l[2] / area BETWEEN 0.5 AND 2.0),
official AS (SELECT ad.url, ad.area, CASE WHEN e.built IS NOT NULL THEN 'lote' WHEN s.built IS NOT NULL THEN 'rua' WHEN b.built IS NOT NULL THEN 'quadra' END AS level, CASE WHEN e.built IS NOT NULL THEN e.built WHEN s.built IS NOT NULL THEN s.built ELSE b.built END AS ob,
  CASE WHEN e.built IS NOT NULL THEN e.land WHEN s.built IS NOT NULL THEN s.land ELSE b.land END AS ol FROM ad LEFT JOIN exact e USING (url) LEFT JOIN street_ref s ON ad.street = s.street AND ad.street % 3 > 0 LEFT JOIN block_ref b ON ad.block = b.block)"""


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey as street", "l_partkey div 20 as block", "l_linenumber as number", "l_orderkey * 10 + l_linenumber as lot_id", "if(l_tax > 0.07, null, l_quantity) as built",
        "if(l_discount > 0.09, null, l_quantity * (1 + l_suppkey % 3)) as land", "l_returnflag <> 'N' as is_house",
    )


@query("street_block_ref", f"{AREAS} SELECT 'rua' AS kind, street AS key, round(built, 4) AS built, round(land, 4) AS land, n, round(share, 6) AS house_share FROM street_ref UNION ALL SELECT 'quadra', block, round(built, 4), round(land, 4), n, round(share, 6) FROM block_ref")
def street_block_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lots(spark, sf_dir)
    both = [val.plausible_medians(rows, [k]).select(F.lit(kind).alias("kind"), F.col(k).alias("key"), F.round("built", 4).alias("built"), F.round("land", 4).alias("land"), "n", F.round("house_share", 6).alias("house_share")) for kind, k in (("rua", "street"), ("quadra", "block"))]
    return both[0].unionByName(both[1])


def official(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lots(spark, sf_dir)
    streets = val.plausible_medians(rows, ["street"]).where("street % 3 > 0")
    return val.official_areas(v.listings(spark, sf_dir), rows.where("built is not null"), streets, val.plausible_medians(rows, ["block"]))


@query("cadastre_cascade", f"{AREAS} SELECT url, area, level, round(ob, 4) AS official_built, round(ol, 4) AS official_land FROM official")
def cadastre_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return official(spark, sf_dir).select("url", "area", "level", F.round("official_built", 4).alias("official_built"), F.round("official_land", 4).alias("official_land"))


_MATCH = """m AS (SELECT *, coalesce(ob > 0 AND abs(area - ob) / ob <= 0.15, false) AS b, coalesce(ol > 0 AND abs(area - ol) / ol <= 0.15, false) AS t FROM official),
k AS (SELECT *, CASE WHEN area IS NULL OR area = 0 THEN 'sem dado' WHEN b AND t THEN 'ambos' WHEN b THEN 'construcao' WHEN t THEN 'terreno' ELSE 'nenhum' END AS match FROM m),
g AS (SELECT *, CASE WHEN match = 'ambos' THEN 0.0 WHEN match <> 'sem dado' THEN 100 * (area / CASE WHEN match = 'terreno' THEN ol WHEN ob > 0 THEN ob END - 1) END::DOUBLE AS dif FROM k),
graded AS (SELECT *, CASE WHEN dif IS NULL THEN 'sem dado' WHEN abs(dif) <= 15 THEN 'compativel' WHEN abs(dif) <= 30 THEN 'atencao' ELSE 'divergente' END AS grade FROM g)"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = [F.col(c) for c in ("area", "official_built", "official_land")]
    return official(spark, sf_dir).withColumns({"match": s.area_match(*three), "difference": s.area_difference(*three)}).withColumn("grade", s.grade(F.col("difference")))


@query("area_match", f"{AREAS}, {_MATCH} SELECT url, match, round(dif, 4) AS difference, grade FROM graded")
def area_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).select("url", "match", F.round("difference", 4).alias("difference"), "grade")


@query("area_report", f"{AREAS}, {_MATCH} SELECT level, match, grade, count(*) AS n FROM graded GROUP BY ALL")
def area_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).groupBy("level", "match", "grade").agg(F.count("*").alias("n"))


_LAW = """h AS (SELECT l_partkey AS street, l_linenumber AS number, l_orderkey * 10 + l_linenumber AS lot_id, l_quantity AS area, l_quantity * 2 AS land, 5.0 + l_suppkey % 7 AS front, l_suppkey % 3 AS corners,
  CASE l_linenumber % 4 WHEN 0 THEN 'Lote de fundos' WHEN 1 THEN 'Lote encravado' WHEN 2 THEN 'Terreno interno' ELSE 'Normal' END AS kind, 1000.0 + l_tax * 10000 AS ut, 2000.0 AS ub, CASE WHEN l_discount = 0 THEN 0.0 ELSE 1 - l_discount END AS obsolete FROM lineitem),
d AS (SELECT *, greatest(10.0, least(200.0, floor(land / front)))::DOUBLE AS depth FROM h),
law AS (SELECT *, CASE WHEN corners < 2 AND front > 0 AND land > 0 THEN CASE WHEN depth < 20 THEN sqrt(depth / 20) WHEN depth <= 40 THEN 1.0 ELSE sqrt(40 / depth) END ELSE 1.0 END AS factor,
  land * ut * CASE WHEN corners < 2 AND front > 0 AND land > 0 THEN CASE WHEN depth < 20 THEN sqrt(depth / 20) WHEN depth <= 40 THEN 1.0 ELSE sqrt(40 / depth) END ELSE 1.0 END * CASE kind WHEN 'Lote de fundos' THEN 0.6 WHEN 'Lote encravado' THEN 0.5 WHEN 'Terreno interno' THEN 0.7 ELSE 1.0 END::DOUBLE AS land_value,
  area * ub * coalesce(nullif(obsolete, 0.0), 1.0)::DOUBLE AS building_value FROM d)"""


def statutory(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("Lote de fundos", "Lote encravado", "Terreno interno", "Normal")])
    h = v.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("street"), F.col("l_linenumber").alias("number"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("lot_id"), F.col("l_quantity").alias("area"), (F.col("l_quantity") * 2).alias("land"),
        (5.0 + F.col("l_suppkey") % 7).alias("front"), (F.col("l_suppkey") % 3).alias("corners"), F.get(kinds, F.col("l_linenumber") % 4).alias("kind"), (1000.0 + F.col("l_tax") * 10000).alias("ut"),
        F.when(F.col("l_discount") == 0, 0.0).otherwise(1 - F.col("l_discount")).alias("obsolete"),
    )
    return h.withColumns({
        "factor": s.depth_factor(F.col("land"), F.col("front"), F.col("corners")),
        "land_value": s.statutory_land_value(F.col("land"), F.col("ut"), F.col("front"), F.col("corners"), F.col("kind"), F.lit(1.0)),
        "building_value": s.statutory_building_value(F.col("area"), F.lit(2000.0), F.col("obsolete")),
    })


@query("statutory_value", f"WITH {_LAW} SELECT street, number, lot_id, round(factor, 6) AS factor, round(land_value, 2) AS land_value, round(building_value, 2) AS building_value FROM law")
def statutory_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statutory(spark, sf_dir).select("street", "number", "lot_id", F.round("factor", 6).alias("factor"), F.round("land_value", 2).alias("land_value"), F.round("building_value", 2).alias("building_value"))


@query("statutory_similar", f"""WITH {v.AD}, {_LAW} SELECT ad.url, count(*) AS n, round(median(law.land_value), 2) AS land_value, round(median(law.building_value), 2) AS building_value FROM ad JOIN law ON ad.street = law.street AND law.area BETWEEN ad.area * 0.75 AND ad.area * 1.25 GROUP BY ad.url HAVING count(*) >= 5""")
def statutory_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = val.similar_houses(v.listings(spark, sf_dir), statutory(spark, sf_dir))
    return out.select("url", "n", F.round("land_value", 2).alias("land_value"), F.round("building_value", 2).alias("building_value"))


@query("assessed_projection", f"""{v.SUMMARISED}, dom AS (SELECT key, part FROM (SELECT key, sum(n) AS total, arg_min(part, ROW(-n, part)) AS part, max(n) AS n FROM (SELECT l_partkey AS key, l_suppkey % 3 AS part, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY key) WHERE total >= 3 AND n / total >= 0.5),
z AS (SELECT ad.url, CASE WHEN ad.url % 2 = 0 THEN ad.url % 3 ELSE dom.part END AS zone, coalesce(estimate, ad.price) AS base, ad.url % 3 AS corners FROM ad LEFT JOIN summary USING (url) LEFT JOIN dom ON ad.street = dom.key)
SELECT url, zone, round(base * (0.4 + 0.1 * zone), 6) AS assessed, round(base * (0.4 + 0.1 * zone) * CASE corners WHEN 0 THEN 1.157 WHEN 1 THEN 1.256 ELSE 1.045 END, 6) AS reference FROM z WHERE zone IS NOT NULL""")
def assessed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessed and reference value from the market estimate, else the price; the region is the listing's own, else its street's dominant one."""
    from .market import summaries

    rows = v.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("street"), (F.col("l_suppkey") % 3).alias("part"), F.lit(1).cast("long").alias("one"))
    street = val.dominant(rows, "street", "part", "one", share=0.5).select("street", "part")
    ads = v.listings(spark, sf_dir).select("url", "street", "price").join(growing(summaries(spark, sf_dir).select("url", "estimate")), "url", "left").join(growing(street), "street", "left")
    z = ads.select("url", F.when(F.col("url") % 2 == 0, F.col("url") % 3).otherwise(F.col("part")).alias("zone"), F.coalesce("estimate", "price").alias("base"), (F.col("url") % 3).alias("corners")).where("zone is not null")
    assessed = F.col("base") * (0.4 + 0.1 * F.col("zone"))
    return z.select("url", "zone", F.round(assessed, 6).alias("assessed"), F.round(s.reference_value(assessed, F.col("corners")), 6).alias("reference"))


@query("intra_dispersion", f"""{_UNITS}, a AS (SELECT street % 200 AS zone, y, median(unit) AS m FROM u GROUP BY ALL), b AS (SELECT zone, median(m) AS mm, count(*) AS years FROM a GROUP BY zone HAVING count(*) >= 2), c AS (SELECT a.zone, median(abs(a.m - b.mm)) / any_value(b.mm) AS spread FROM a JOIN b USING (zone) GROUP BY a.zone)
SELECT count(*) AS n, round(median(spread), 6) AS spread FROM c""")
def intra_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = val.dispersion(units(spark, sf_dir).select((F.col("street") % 200).alias("zone"), "y", "unit"), "zone", "y", "unit")
    return found.select("n", F.round("spread", 6).alias("spread"))


@query("weighted_mean", f"{_UNITS} SELECT y::INT AS year, financed, count(*) AS n, round(sum(value) / nullif(sum(area), 0), 4) AS unit FROM u GROUP BY ALL")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).groupBy(F.col("y").alias("year"), "financed").agg(F.count("*").alias("n"), F.round(F.try_divide(F.sum("value"), F.sum("area")), 4).alias("unit"))


@query("correlation", f"""{v.SUMMARISED} SELECT upkeep, count(*) AS n, round(median(ratio), 6) AS median_ratio, round(100.0 * avg((ratio < 1)::INT), 4) AS pct_below, round((SELECT corr(upkeep, ratio) FROM summary JOIN ad USING (url)), 6) AS r FROM summary JOIN ad USING (url) WHERE upkeep IS NOT NULL GROUP BY upkeep""")
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .market import summaries

    rows = summaries(spark, sf_dir).select("url", "ratio").join(growing(v.listings(spark, sf_dir).select("url", "upkeep")), "url").where("upkeep is not null")
    r = rows.agg(F.round(F.corr("upkeep", "ratio"), 6).alias("r"))
    by = rows.groupBy("upkeep").agg(F.count("*").alias("n"), F.round(100.0 * F.avg((F.col("ratio") < 1).cast("int")), 4).alias("pct_below"))
    medians = val.percentiles(rows, ["upkeep"], "ratio", {"median_ratio": 0.5}).select("upkeep", F.round("median_ratio", 6).alias("median_ratio"))
    return by.join(medians, "upkeep", "left").crossJoin(F.broadcast(r))  # one row


@query("unique_match", f"WITH {v.AD}, {v.SALE}, one AS (SELECT street, number, max(value) AS value FROM sale GROUP BY street, number HAVING count(*) = 1) SELECT url, value, round(price / value, 6) AS ratio FROM ad JOIN one ON ad.street = one.street AND ad.number = one.number")
def unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings at whose street and number one sale alone is known."""
    from ..operators.comparables import unique_matches

    return unique_matches(v.listings(spark, sf_dir).select("url", "street", "number", "price"), v.sales(spark, sf_dir), ["street", "number"]).select("url", "value", F.round("ratio", 6).alias("ratio"))


@query("weighted_fit", f"""{_UNITS}, m AS (SELECT sum(1 / area) AS a, count(*)::DOUBLE AS b, sum(area) AS c, sum(area * area) AS d, sum(area * area * area) AS e, sum(value / area) AS x, sum(value) AS y, sum(value * area) AS z FROM u),
t AS (SELECT *, a * (c * e - d * d) - b * (b * e - c * d) + c * (b * d - c * c) AS det FROM m)
SELECT 'constant' AS term, round((x * (c * e - d * d) - b * (y * e - z * d) + c * (y * d - z * c)) / det, 4) AS coefficient FROM t UNION ALL SELECT 'area', round((a * (y * e - z * d) - x * (b * e - c * d) + c * (b * z - c * y)) / det, 4) FROM t
UNION ALL SELECT 'square', round((a * (c * z - d * y) - b * (b * z - c * y) + x * (b * d - c * c)) / det, 4) FROM t""")
def weighted_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value explained by area, area squared and a constant, weighted by 1 / area."""
    u = units(spark, sf_dir).withColumns({"one": F.lit(1.0), "square": F.col("area") * F.col("area"), "w": 1 / F.col("area")})
    found = val.weighted_fit(u, "value", ["one", "area", "square"], "w")
    return spark.createDataFrame([(n, round(x, 4)) for n, x in zip(("constant", "area", "square"), found, strict=True)], "term string, coefficient double")
