"""The driver's tables seen as listings and sales, in DataFrame form and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as listings: one row is one advertisement."""
    k, size = F.col("p_partkey"), F.col("p_size")
    floors = F.array(*[F.lit(x) for x in ("terra", "grama", "cimento", "misto")])
    return table(spark, sf_dir, "part").select(
        k.alias("url"), k.alias("street"), F.expr("p_partkey div 8").alias("cep"), F.expr("p_partkey div 20").alias("block"), (k % 7 + 1).cast("int").alias("number"),
        size.cast("double").alias("area"), (size * (1 + k % 3)).cast("double").alias("land"), (F.col("p_retailprice") * size).alias("price"), F.col("p_brand").alias("area_name"),
        F.col("p_type").alias("portal"), (size % 6).cast("int").alias("rooms"), F.when(k % 7 != 0, 1 + size % 5).cast("int").alias("upkeep"), (F.col("p_type") == "PROMO").alias("has_problem"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("financing"), F.when(k % 5 < 4, F.get(floors, (k % 5).cast("int"))).alias("floor"), (k % 5 == 0).alias("has_dirt"),
        (size % 7 > 2).alias("yard"), (k % 4 == 1).alias("trees"), F.when(k % 10 < 3, F.expr("p_partkey div 10")).alias("dup_group"), (k % 10 == 0).alias("dup_best"),
        k.alias("ingest_seq"), (size % 7).cast("int").alias("text_score"), F.when(k % 97 == 0, F.lit("2001-01-01")).alias("removed_at"),
    )


AD = """ad AS (SELECT p_partkey AS url, p_partkey AS street, p_partkey // 8 AS cep, p_partkey // 20 AS block, (p_partkey % 7 + 1)::INT AS number, p_size::DOUBLE AS area,
  (p_size * (1 + p_partkey % 3))::DOUBLE AS land, p_retailprice * p_size AS price, p_brand AS area_name, p_type AS portal, (p_size % 6)::INT AS rooms,
  CASE WHEN p_partkey % 7 <> 0 THEN 1 + p_size % 5 END::INT AS upkeep, p_type = 'PROMO' AS has_problem, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS financing,
  CASE p_partkey % 5 WHEN 0 THEN 'terra' WHEN 1 THEN 'grama' WHEN 2 THEN 'cimento' WHEN 3 THEN 'misto' END AS floor, p_partkey % 5 = 0 AS has_dirt, p_size % 7 > 2 AS yard,
  p_partkey % 4 = 1 AS trees, CASE WHEN p_partkey % 10 < 3 THEN p_partkey // 10 END AS dup_group, p_partkey % 10 = 0 AS dup_best, p_partkey AS ingest_seq,
  (p_size % 7)::INT AS text_score, CASE WHEN p_partkey % 97 = 0 THEN '2001-01-01' END AS removed_at FROM part)"""


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as recorded sales."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("street"), F.expr("l_partkey div 8 + l_suppkey % 2").alias("cep"), F.col("l_quantity").alias("area"), F.col("l_extendedprice").alias("value"),
        F.col("l_linenumber").alias("number"), F.to_date("l_shipdate").alias("sold"), (F.col("l_linestatus") == "F").alias("financed"), (F.col("l_returnflag") != "R").alias("market"),
        F.col("l_orderkey").alias("orderkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"),
    )


SALE = """sale AS (SELECT l_partkey AS street, l_partkey // 8 + l_suppkey % 2 AS cep, l_quantity AS area, l_extendedprice AS value, l_linenumber AS number, l_shipdate::DATE AS sold,
  l_linestatus = 'F' AS financed, l_returnflag <> 'R' AS market, l_orderkey AS orderkey, l_suppkey AS suppkey, l_tax AS tax, l_discount AS discount FROM lineitem)"""

#: Makes the order of sales of one day total; equal rows are interchangeable.
TIE = ["orderkey", "suppkey", "number", "area", "value", "discount", "tax"]

USABLE = "usable AS (SELECT * FROM sale WHERE area >= 1 AND value > 0 AND market AND value / area BETWEEN 800 AND 25000)"

CASCADE = """pairs AS (
  SELECT s.*, a.url, a.area AS listing_area, a.price, CASE WHEN s.cep = a.cep THEN [1, 2] ELSE [2] END AS levels FROM usable s JOIN ad a ON s.street = a.street AND s.area BETWEEN a.area * 0.75 AND a.area * 1.25
  UNION ALL SELECT s.*, a.url, a.area, a.price, [3] FROM usable s JOIN ad a ON s.cep = a.cep AND s.area BETWEEN a.area * 0.75 AND a.area * 1.25),
stepped AS (SELECT * EXCLUDE (levels), unnest(CASE WHEN financed THEN list_concat(levels, list_transform(levels, lambda x: x + 3)) ELSE list_transform(levels, lambda x: x + 3) END) AS step FROM pairs),
newest AS (SELECT *, row_number() OVER (PARTITION BY url, step ORDER BY sold DESC, orderkey DESC, suppkey DESC, number DESC, area DESC, value DESC, discount DESC, tax DESC) AS place FROM stepped),
recent AS (SELECT *, max(sold) OVER (PARTITION BY url, step) AS last_sold FROM newest WHERE place <= 500),
counted AS (SELECT *, count(*) OVER (PARTITION BY url, step) AS k FROM recent WHERE year(sold) >= year(last_sold) - 10),
ranked AS (SELECT *, min(CASE WHEN k >= 3 THEN step ELSE step + 6 END) OVER (PARTITION BY url) AS best, CASE WHEN k >= 3 THEN step ELSE step + 6 END AS rank FROM counted),
comp AS (SELECT * FROM ranked WHERE rank = best)"""

SUMMARY = """unit AS (SELECT *, value / area AS u FROM comp),
by_number AS (SELECT url, step, listing_area, price, number, median(u) AS m, count(*) AS k, sum(u) AS t, min(u) AS lo, max(u) AS hi, sum(financed::INT)::BIGINT AS f, min(year(sold)) AS y0, max(year(sold)) AS y1 FROM unit GROUP BY ALL),
by_ad AS (SELECT url, step, listing_area, price, sum(k)::BIGINT AS n, count(*) AS n_numbers, sum(f)::BIGINT AS n_financed, median(m) AS mn, sum(t) / sum(k) AS unit_mean, min(lo) AS unit_low, max(hi) AS unit_high, min(y0) AS first_year, max(y1) AS last_year FROM by_number GROUP BY ALL),
all_sales AS (SELECT url, median(u) AS ms FROM unit GROUP BY url),
summary AS (SELECT url, step, n, n_numbers, n_financed, CASE WHEN n_numbers >= 3 THEN 'por_numero' ELSE 'simples' END AS method, CASE WHEN n_numbers >= 3 THEN mn ELSE ms END AS unit_median,
  CASE WHEN n_numbers >= 3 THEN mn ELSE ms END * listing_area AS estimate, unit_mean, unit_low, unit_high, price / (CASE WHEN n_numbers >= 3 THEN mn ELSE ms END * listing_area) AS ratio,
  CASE WHEN step <= 3 AND n >= 5 AND n_numbers >= 4 AND step IN (1, 2) THEN 'alta' WHEN step <= 3 OR (n >= 8 AND n_numbers >= 5 AND step IN (4, 5)) THEN 'media' ELSE 'baixa' END AS confidence, first_year, last_year
  FROM by_ad JOIN all_sales USING (url))"""

SCORED = """scored AS (SELECT ad.*, ratio, confidence, CASE WHEN ratio IS NOT NULL AND upkeep IS NOT NULL THEN round(greatest(0.0::DOUBLE,
    0.5::DOUBLE * least(0.5::DOUBLE, greatest(0.0::DOUBLE, 1.0::DOUBLE - ratio)) * CASE confidence WHEN 'alta' THEN 1.0 WHEN 'media' THEN 0.8 WHEN 'baixa' THEN 0.5 ELSE 1.0 END::DOUBLE / 0.5::DOUBLE
    + 0.5::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (upkeep - 1.0::DOUBLE) / 4.0::DOUBLE)) - CASE WHEN has_problem THEN 0.15 ELSE 0.0 END::DOUBLE), 4) END AS score
  FROM ad LEFT JOIN summary USING (url))"""

COMPARED = f"WITH {AD}, {SALE}, {USABLE}, {CASCADE}"
SUMMARISED = f"{COMPARED}, {SUMMARY}"
LISTED = f"{SUMMARISED}, {SCORED}"
