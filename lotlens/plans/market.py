"""Listings and their comparable sales."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comparables as c
from ..operators import listing as ls
from ..operators import serving as sv
from ..sources import views as v
from ..storage import file_state, growing, materialized, shared_folder
from .registry import query


def comparables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.cascade(v.listings(spark, sf_dir), c.usable(v.sales(spark, sf_dir), least_area=1.0), v.TIE)


#: The folders of published marts, by application, folder of tables and state of their files.
_MARTS: dict[tuple[str, str, str], str] = {}
_SOURCES = ("part", "lineitem")


def publish(spark: SparkSession, sf_dir: str) -> str:
    """Compute comparisons and scored listings, and write them for all pages and reports to read."""
    folder = f"{shared_folder(spark)}/mart-{uuid.uuid4().hex}"
    found = materialized(c.summary(comparables(spark, sf_dir)))
    sv.publish({"comparisons": found, "listings": ls.with_comparisons(v.listings(spark, sf_dir), found)}, folder)
    return folder


def served(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A published table: published first where that wasn't done for these very files of the tables, or the mart's own are gone."""
    key = (spark.sparkContext.applicationId, sf_dir, file_state(spark, *[f"{sf_dir}/{t}.parquet" for t in _SOURCES]))
    folder = _MARTS.get(key)
    if folder is not None:
        try:
            return sv.published(spark, folder, name)[0]
        except AnalysisException:
            pass
    _MARTS[key] = publish(spark, sf_dir)
    return sv.published(spark, _MARTS[key], name)[0]


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return served(spark, sf_dir, "comparisons")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return served(spark, sf_dir, "listings")


@query("quality_sales", f"WITH {v.SALE}, {v.USABLE} SELECT street, cep, area, value, number, sold::VARCHAR AS sold, financed, orderkey, round(value / area, 4) AS unit FROM usable")
def quality_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.usable(v.sales(spark, sf_dir), least_area=1.0)
    return rows.select("street", "cep", "area", "value", "number", F.col("sold").cast("string").alias("sold"), "financed", "orderkey", F.round(F.col("value") / F.col("area"), 4).alias("unit"))


@query("comps_cascade", f"{v.COMPARED} SELECT url, step, count(*) AS n, min(sold)::VARCHAR AS oldest, max(sold)::VARCHAR AS newest, round(sum(value), 2) AS total FROM comp GROUP BY url, step")
def comps_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = comparables(spark, sf_dir).groupBy("url", "step").agg(F.count("*").alias("n"), F.min("sold").cast("string").alias("oldest"), F.max("sold").cast("string").alias("newest"), F.round(F.sum("value"), 2).alias("total"))
    return found


@query(
    "comps_summary",
    f"""{v.SUMMARISED} SELECT url, step, n, n_numbers, n_financed, method, round(unit_median, 4) AS unit_median, round(estimate, 6) AS estimate, round(unit_mean, 4) AS unit_mean,
  round(unit_low, 4) AS unit_low, round(unit_high, 4) AS unit_high, round(ratio, 6) AS ratio, confidence, first_year::INT AS first_year, last_year::INT AS last_year FROM summary""",
)
def comps_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = {"unit_median": 4, "estimate": 6, "unit_mean": 4, "unit_low": 4, "unit_high": 4, "ratio": 6}
    return c.summary(comparables(spark, sf_dir)).withColumns({k: F.round(k, n) for k, n in places.items()})


@query("comps_detail", f"{v.COMPARED} SELECT url, step, street, number, sold::VARCHAR AS sold, area, value, financed, orderkey, round(value / area, 4) AS unit FROM comp")
def comps_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparables(spark, sf_dir).select("url", "step", "street", "number", F.col("sold").cast("string").alias("sold"), "area", "value", "financed", "orderkey", F.round(F.col("value") / F.col("area"), 4).alias("unit"))


_CARD = "url, area_name, price, land, upkeep, confidence, round(ratio, 6) AS ratio, score"
_ACTIVE, _ONE = "removed_at IS NULL", "(dup_group IS NULL OR dup_best)"
_CHEAP = "coalesce(nullif(price, 0), 9e12)"


def card(df: DataFrame) -> DataFrame:
    return df.select("url", "area_name", "price", "land", "upkeep", "confidence", F.round("ratio", 6).alias("ratio"), "score")


def _filtered(name: str, where: str, filters: ls.Filters, joined: bool = False) -> None:
    source, tables = ("scored", v.LISTED) if joined else ("ad", f"WITH {v.AD}")
    columns = _CARD if joined else "url, area_name, price, land, rooms, financing, floor"

    @query(name, f"{tables} SELECT {columns} FROM {source} WHERE {_ACTIVE} AND {_ONE} AND {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if joined:
            return card(filters.apply(scored(spark, sf_dir)))
        return filters.apply(v.listings(spark, sf_dir)).select("url", "area_name", "price", "land", "rooms", "financing", "floor")


_filtered("filter_price_max", "price <= 20000", ls.Filters(price_max=20_000))
_filtered("filter_land_min", "land >= 60", ls.Filters(land_min=60))
_filtered("filter_rooms_min", "rooms >= 3", ls.Filters(rooms_min=3))
_filtered("filter_tristate", "(financing IS NULL OR NOT financing)", ls.Filters(financing=False))
_filtered("filter_financing_yes", "financing", ls.Filters(financing=True))
_filtered("filter_or_multi", "(has_dirt OR floor = 'grama')", ls.Filters(floors=["terra", "grama"]))
_filtered("filter_flags", "yard AND trees", ls.Filters(yard=True, trees=True))
_filtered("filter_in_list", "area_name IN ('Brand#2', 'Brand#13')", ls.Filters(areas=["brand-2", "BRAND#13"]))
_filtered("filter_unknown_area_empty", "false", ls.Filters(areas=["no such place"]))
_filtered("filter_below_market", "ratio < 1", ls.Filters(below_market=True), joined=True)
_filtered("filter_combined", "price <= 40000 AND rooms >= 2 AND yard AND ratio < 1 AND (has_dirt OR floor = 'cimento')", ls.Filters(price_max=40_000, rooms_min=2, yard=True, below_market=True, floors=["terra", "cimento"]), joined=True)


def _ordered(name: str, by: str, sql_order: str, number: int = 1) -> None:
    @query(name, f"{v.LISTED} SELECT {_CARD} FROM (SELECT * FROM scored WHERE {_ACTIVE} AND {_ONE} ORDER BY {sql_order}, ingest_seq LIMIT 60 OFFSET {60 * (number - 1)})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return card(ls.page(ls.Filters().apply(scored(spark, sf_dir)), by, number))


_ordered("listing_default", "fit", f"score DESC NULLS LAST, {_CHEAP}")
_ordered("page_3", "fit", f"score DESC NULLS LAST, {_CHEAP}", 3)
_ordered("order_price_asc", "price_asc", f"{_CHEAP}, coalesce(dup_best::INT, 0) DESC")
_ordered("order_price_desc", "price_desc", "price DESC NULLS LAST, coalesce(dup_best::INT, 0) DESC")
_ordered("order_land", "land", "land DESC NULLS LAST, coalesce(dup_best::INT, 0) DESC")
_ordered("order_recent", "recent", "ingest_seq DESC")
_ordered("order_below", "below", f"ratio ASC NULLS LAST, text_score DESC NULLS LAST, {_CHEAP}")
_ordered("order_text", "text", f"text_score DESC NULLS LAST, {_CHEAP}")


@query("coverage", f"WITH {v.AD} SELECT count(*) AS total, count(upkeep) AS analysed FROM ad WHERE {_ACTIVE} AND {_ONE} AND price <= 40000")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.coverage(v.listings(spark, sf_dir), ls.Filters(price_max=40_000, floors=["terra"], trees=True))


@query(
    "report_by_area",
    f"""{v.SUMMARISED} SELECT area_name, count(*) AS n, round(avg(ratio), 6) AS mean_ratio, count(*) FILTER (ratio < 1) AS below, round(avg(unit_median), 4) AS mean_unit,
  round(100.0 * avg((step <= 3)::INT), 4) AS pct_financed FROM summary JOIN ad USING (url) GROUP BY area_name HAVING count(*) >= 5""",
)
def report_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = summaries(spark, sf_dir).join(growing(v.listings(spark, sf_dir).select("url", "area_name")), "url")
    return _report(joined.groupBy("area_name")).where("n >= 5")


@query(
    "report_by_street",
    f"""{v.SUMMARISED} SELECT street, area_name, count(*) AS n, round(avg(ratio), 6) AS mean_ratio, count(*) FILTER (ratio < 1) AS below, round(avg(unit_median), 4) AS mean_unit,
  round(100.0 * avg((step <= 3)::INT), 4) AS pct_financed FROM summary JOIN ad USING (url) WHERE area_name ILIKE '%#1%' GROUP BY street, area_name""",
)
def report_by_street(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = summaries(spark, sf_dir).join(growing(v.listings(spark, sf_dir).select("url", "street", "area_name").where(F.col("area_name").ilike("%#1%"))), "url")
    return _report(joined.groupBy("street", "area_name"))


def _report(grouped):
    return grouped.agg(
        F.count("*").alias("n"), F.round(F.avg("ratio"), 6).alias("mean_ratio"), F.count_if(F.col("ratio") < 1).alias("below"),
        F.round(F.avg("unit_median"), 4).alias("mean_unit"), F.round(100.0 * F.avg((F.col("step") <= 3).cast("int")), 4).alias("pct_financed"),
    )


@query("freshness", f"{v.SUMMARISED} SELECT last_year::INT AS last_year, count(*) AS n FROM summary GROUP BY last_year ORDER BY n DESC, last_year LIMIT 1")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(spark, sf_dir).groupBy("last_year").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "last_year").limit(1)


@query(
    "incremental_todo",
    f"""WITH {v.AD}, done AS (SELECT url, CASE WHEN url % 11 = 0 THEN price + 5 WHEN url % 11 = 1 THEN price + 0.5 ELSE price END AS price FROM ad WHERE url % 2 = 0)
SELECT url, price FROM ad a WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.url = a.url AND abs(coalesce(a.price, 0) - coalesce(d.price, 0)) < 1)""",
)
def incremental_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    ads = v.listings(spark, sf_dir)
    moved = F.when(F.col("url") % 11 == 0, F.col("price") + 5).when(F.col("url") % 11 == 1, F.col("price") + 0.5).otherwise(F.col("price"))
    return c.todo(ads, ads.where("url % 2 = 0").select("url", moved.alias("price"))).select("url", "price")


@query("fit_score_udf", f"{v.LISTED} SELECT url, score FROM scored WHERE score IS NOT NULL")
def fit_score_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score as a SQL function, which Catalyst inlines."""
    from ..functions.scores import FIT_SCORE_SQL

    spark.sql(FIT_SCORE_SQL)
    rows = v.listings(spark, sf_dir).join(growing(summaries(spark, sf_dir).select("url", "ratio", "confidence")), "url", "left")
    return rows.select("url", F.expr("fit_score(ratio, cast(upkeep as double), has_problem, confidence)").alias("score")).where("score is not null")




@query("set_union_levels", f"WITH {v.SALE} SELECT street AS key, 'rua' AS level FROM sale UNION SELECT cep, 'cep' FROM sale")
def set_union_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.sales(spark, sf_dir)
    return s.select(F.col("street").alias("key"), F.lit("rua").alias("level")).unionByName(s.select(F.col("cep").alias("key"), F.lit("cep").alias("level"))).distinct()


@query("set_intersect_names", "SELECT p_brand AS name FROM part WHERE p_size > 40 INTERSECT SELECT p_brand FROM part WHERE p_type = 'PROMO'")
def set_intersect_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v.table(spark, sf_dir, "part")
    return p.where("p_size > 40").select(F.col("p_brand").alias("name")).intersect(p.where("p_type = 'PROMO'").select("p_brand"))


@query("set_except_seen", "SELECT o_custkey AS id FROM orders EXCEPT SELECT user_id FROM events")
def set_except_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).subtract(v.table(spark, sf_dir, "events").select("user_id"))


@query("group_price_range", f"""WITH {v.AD}, g AS (SELECT dup_group AS grp, * FROM ad WHERE dup_group IS NOT NULL),
r AS (SELECT *, min(price) OVER (PARTITION BY grp) AS low, max(price) OVER (PARTITION BY grp) AS high, count(*) OVER (PARTITION BY grp) AS copies, row_number() OVER (PARTITION BY grp ORDER BY price IS NULL, price, url) AS place FROM g)
SELECT grp, url AS cheapest, copies, low, high, round(high - low, 2) AS saving FROM r WHERE place = 1""")
def group_price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.duplicates import price_ranges

    members = v.listings(spark, sf_dir).where("dup_group is not null").select(F.col("dup_group").alias("group"), F.col("url").alias("id"), "price")
    return price_ranges(members).select(F.col("group").alias("grp"), F.get("detail", F.lit(0))["id"].alias("cheapest"), "copies", "low", "high", F.round("saving", 2).alias("saving"))


@query("copy_places", f"""WITH {v.AD}, g AS (SELECT url // 10 AS grp, url, CASE WHEN url % 9 > 0 THEN floor(price / 5000) * 5000 END AS price FROM ad)
SELECT grp, url, count(*) OVER (PARTITION BY grp) AS copies, (row_number() OVER (PARTITION BY grp ORDER BY price IS NULL, price, url))::INT AS place, CASE WHEN price IS NOT NULL THEN rank() OVER (PARTITION BY grp ORDER BY price IS NULL, price) - 1 END AS cheaper, price - min(price) OVER (PARTITION BY grp) AS above FROM g""")
def copy_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each listing stands among its copies."""
    from ..operators.duplicates import copy_places as places

    members = v.listings(spark, sf_dir).select(F.expr("url div 10").alias("group"), F.col("url").alias("id"), F.when(F.col("url") % 9 > 0, F.floor(F.col("price") / 5000) * 5000.0).alias("price"))
    return places(members).select(F.col("group").alias("grp"), F.col("id").alias("url"), "copies", "place", "cheaper", "above")


@query("group_guard_principal", f"""WITH {v.AD}, m AS (SELECT url // 10 AS grp, url AS id, CASE WHEN url % 10 < 5 THEN 'x' ELSE area_name END AS area_name, url // 30 AS street, price, url % 4 AS photos FROM ad)
SELECT grp, count(*) AS n, arg_min(id, ROW(price IS NULL, price, -photos, id)) AS principal, count(DISTINCT street) > 1 OR count(DISTINCT nullif(area_name, '')) > 1 AS dropped FROM m GROUP BY grp""")
def group_guard_principal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.duplicates import guarded

    name = F.when(F.col("url") % 10 < 5, "x").otherwise(F.col("area_name"))
    members = v.listings(spark, sf_dir).select(F.expr("url div 10").alias("group"), F.col("url").alias("id"), name.alias("area_name"), F.expr("url div 30").alias("street"), "price", (F.col("url") % 4).alias("photos"))
    return guarded(members).withColumnRenamed("group", "grp")


@query("group_consensus_inherit", """WITH m AS (SELECT o_custkey // 3 AS grp, o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE (o_custkey % 3)::VARCHAR END AS cep, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE (o_custkey // 6)::VARCHAR END AS street,
   CASE WHEN o_orderkey % 6 = 0 THEN (o_custkey % 2)::VARCHAR ELSE '' END AS number FROM orders),
n AS (SELECT grp, count(DISTINCT nullif(cep, '')) AS nc, count(DISTINCT nullif(street, '')) AS ns, count(DISTINCT nullif(number, '')) AS nn, max(nullif(cep, '')) AS cep, max(nullif(street, '')) AS street, max(nullif(number, '')) AS number FROM m GROUP BY grp)
SELECT grp, CASE WHEN nc = 1 THEN cep END AS cep, CASE WHEN ns = 1 AND nn <= 1 THEN street END AS street, CASE WHEN ns = 1 AND nn = 1 THEN number END AS number,
  CASE WHEN nc = 1 THEN 'cep' WHEN ns = 1 AND nn <= 1 THEN 'rua' WHEN nc > 1 THEN 'ceps divergentes' WHEN ns > 1 THEN 'ruas divergentes' WHEN nn > 1 THEN 'numeros divergentes' ELSE 'sem endereco' END AS reason FROM n""")
def group_consensus_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.duplicates import consensus

    o = v.table(spark, sf_dir, "orders")
    members = o.selectExpr("o_custkey div 3 as `group`", "o_orderkey as id", "if(o_orderkey % 4 = 0, '', cast(o_custkey % 3 as string)) as cep", "if(o_orderkey % 5 = 0, '', cast(o_custkey div 6 as string)) as street", "if(o_orderkey % 6 = 0, cast(o_custkey % 2 as string), '') as number")
    return consensus(members).withColumnRenamed("group", "grp")


@query("group_inherit_upkeep", f"""WITH {v.AD}, m AS (SELECT url // 10 AS grp, url, upkeep, url % 4 AS photos FROM ad),
b AS (SELECT grp, upkeep AS best FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY photos DESC, url) AS place FROM m WHERE upkeep IS NOT NULL) WHERE place = 1)
SELECT grp, url, coalesce(upkeep, best) AS upkeep FROM m LEFT JOIN b USING (grp)""")
def group_inherit_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.duplicates import inherited

    members = v.listings(spark, sf_dir).select(F.expr("url div 10").alias("group"), "url", "upkeep", (F.col("url") % 4).alias("photos"))
    return inherited(members, "upkeep", F.col("upkeep").isNotNull(), [F.col("photos").desc(), F.col("url")]).select(F.col("group").alias("grp"), "url", "upkeep")
